"""Queries of files: WAV files written from the views' chunks, listed, their heads read, read again by ranges; bad files beside good ones."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.operators import catalogs as K
from undula.operators import chunks as H
from undula.plans import device_queries  # noqa: F401  (its SQL is used here)
from undula.plans import views as V
from undula.plans.measure_queries import rounded
from undula.plans.registry import SQL, query
from undula.sources import wav as W
from undula.sources import wav_ranges as A
from undula.sources.shared import shared_folder

RATE = 48_000


def folder(chunks: DataFrame, chunk: int) -> str:
    """The chunks as WAV files in a new folder that driver and executors share."""
    where = f"{shared_folder(chunks.sparkSession)}/wav-{uuid.uuid4().hex}".removeprefix("file:")
    A.write_chunks(chunks, where, RATE, 24, chunk)
    return where


def stem(path: str) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.wav$", 1)


def read_again(spark: SparkSession, where: str, size: int, chunk: int) -> DataFrame:
    d = A.read_chunks(spark, where, range_bytes=size, chunk=chunk)
    return H.to_samples(d.filter("error is null").withColumn("track", stem("track")), chunk)


@query("s1_audio_files", "select vec_id || '.wav' \"name\", 44 + 3 * len(embedding) length from embeddings")
def s1(spark: SparkSession, d: str) -> DataFrame:
    return W.audio_files(spark, folder(V.clip_chunks(spark, d), 64)).select(F.concat(stem("path"), F.lit(".wav")).alias("name"), "length")


@query("s2_wav_ranges", SQL["s2_wav_round_trip"])
def s2(spark: SparkSession, d: str) -> DataFrame:
    """Every file cut in ranges of 100 bytes and chunks of 16 samples."""
    return rounded(read_again(spark, folder(V.clip_chunks(spark, d), 64), 100, 16), 5, "x")


@query("s3_wav_heads", SQL["s3_wav_info"])
def s3(spark: SparkSession, d: str) -> DataFrame:
    heads = A.read_heads(spark, folder(V.clip_chunks(spark, d), 64))
    return heads.select(stem("path").alias("path"), "rate", "channels", "frames", "duration", "subtype", "bit_depth")


@query("s4_wav_of_chunks", f"with {V.REELS} select cast(track as varchar) track, channel, i, round(round(greatest(-1, least(1, x)) * 8388607) / 8388608, 5) x from reels")
def s4(spark: SparkSession, d: str) -> DataFrame:
    """Stereo reels of many chunks each, written in order and read again."""
    return rounded(read_again(spark, folder(V.reel_chunks(spark, d), 64), 1000, 64), 5, "x")


@query("s6_outcomes", "select vec_id % 10 \"batch\", count(*) filter (vec_id % 7 <> 0) ok, count(*) filter (vec_id % 7 = 0) failed, case when bool_or(vec_id % 7 = 0) then 'not a RIFF WAVE file' else '' end errors from embeddings group by 1")
def s6(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh file is broken: a reader's error is a record beside the good ones."""
    files = W.wav_files(V.clips(spark, d), RATE).withColumnRenamed("track", "path")
    broken = F.when(F.col("path").cast("long") % 7 == 0, F.expr("substring(content, 5, 100)")).otherwise(F.col("content"))
    read = W.read_wav(files.withColumn("content", broken)).withColumn("batch", F.col("path").cast("long") % 10)
    return K.outcomes(read, "batch").select("batch", "ok", "failed", F.array_join("errors", ",").alias("errors"))


@query("x1_three_passes", f"""with {V.REELS}, a as (select track, channel, i, 0.25 * coalesce(lag(x) over w, 0) + 0.5 * x + 0.25 * coalesce(lead(x) over w, 0) x from reels window w as (partition by track, channel order by i)),
b as (select track, channel, i, 0.25 * coalesce(lag(x) over w, 0) + 0.5 * x + 0.25 * coalesce(lead(x) over w, 0) x from a window w as (partition by track, channel order by i)),
c as (select track, channel, i, 0.25 * coalesce(lag(x) over w, 0) + 0.5 * x + 0.25 * coalesce(lead(x) over w, 0) x from b window w as (partition by track, channel order by i)) select track, channel, i, round(x, 6) x from c""")
def x1(spark: SparkSession, d: str) -> DataFrame:
    """A filter of three samples, three times, with borders exchanged between passes."""

    def smooth(x: np.ndarray, rate: int) -> np.ndarray:
        p = np.pad(np.nan_to_num(x), 1)
        return 0.25 * p[:-2] + 0.5 * p[1:-1] + 0.25 * p[2:]

    return rounded(H.to_samples(H.applied(V.reel_chunks(spark, d), smooth, RATE, 3, 1, 1, 64), 64), 6, "x")
