"""Views that turn the given tables into signals, each once as a DataFrame and once as SQL.

samples: track, channel, i (sample index), x (amplitude). Rates are nominal: clips 48,000, reels and series 1,000.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding is a mono track of 64 samples."""
    d = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("track"), F.posexplode("embedding").alias("i", "x"))
    return d.select("track", F.lit(0).alias("channel"), F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x"))


CLIPS = "clips as (select vec_id track, 0 channel, cast(unnest(range(len(embedding))) as bigint) i, cast(unnest(embedding) as double) x from embeddings)"


def clip_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same clips as a chunk table: a clip is one chunk."""
    d = read(spark, sf_dir, "embeddings")
    return d.select(F.col("vec_id").alias("track"), F.lit(0).alias("channel"), F.lit(0).cast("long").alias("chunk"), F.col("embedding").cast("array<double>").alias("xs"))


def reels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stereo: clips of one label, even vec_ids left and odd ones right, in vec_id order, cut to the shorter side."""
    by = Window.partitionBy("label", "channel").orderBy("vec_id")
    d = read(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("vec_id") % 2).cast("int").alias("channel"), "embedding")
    d = d.withColumn("nth", F.row_number().over(by) - 1)
    count = d.groupBy("label", "channel").count().groupBy("label").agg(F.min("count").alias("n"), F.count("*").alias("sides")).filter("sides = 2")
    d = d.join(count, "label").filter("nth < n").select(F.col("label").cast("long").alias("track"), "channel", "nth", F.posexplode("embedding").alias("pos", "x"))
    return d.select("track", "channel", (F.col("nth").cast("long") * 64 + F.col("pos")).alias("i"), F.col("x").cast("double").alias("x"))


def reel_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same reels as a chunk table: a clip is a chunk of 64 samples."""
    by = Window.partitionBy("label", "channel").orderBy("vec_id")
    d = read(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), (F.col("vec_id") % 2).cast("int").alias("channel"), F.col("embedding").cast("array<double>").alias("xs"))
    count = d.groupBy("label", "channel").count().groupBy("label").agg(F.min("count").alias("n"), F.count("*").alias("sides")).filter("sides = 2")
    d = d.withColumn("chunk", (F.row_number().over(by) - 1).cast("long")).join(count, "label").filter("chunk < n")
    return d.select(F.col("label").alias("track"), "channel", "chunk", "xs")


REELS = """numbered as (select vec_id, label, cast(vec_id % 2 as int) channel, embedding, row_number() over (partition by label, vec_id % 2 order by vec_id) - 1 nth from embeddings),
sides as (select label, min(n) n from (select label, channel, count(*) n from numbered group by all) group by label having count(*) = 2),
reels as (select cast(label as bigint) track, channel, cast(nth * 64 + unnest(range(len(embedding))) as bigint) i, cast(unnest(embedding) as double) x from numbered join sides using (label) where nth < n)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's event values in time order are a mono track."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("track"), F.lit(0).alias("channel"), (F.row_number().over(by) - 1).cast("long").alias("i"), ((F.col("value") - 250) / 250).alias("x"))


SERIES = "series as (select user_id track, 0 channel, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) i, (value - 250) / 250 x from events)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier's order lines in ship order are a mono track that reaches full scale."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    by = Window.partitionBy("l_suppkey").orderBy(*order)
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("track"), F.lit(0).alias("channel"), (F.row_number().over(by) - 1).cast("long").alias("i"), ((F.col("l_quantity") - 25.5) / 24.5).alias("x"))


LINES = "lines as (select l_suppkey track, 0 channel, cast(row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 as bigint) i, (l_quantity - 25.5) / 24.5 x from lineitem)"


#: Samples a second of the takes, their chunks, and where what is planted in them stands (first sample, samples).
TAKE_RATE, TAKE_CHUNKS = 16_000, 4
HISS, AIR, FADE = (17_000, 800), (19_000, 2_400), (23_000, 6_400)
#: Chunks of takes that a task makes, and that it hands on at a time.
TASK_CHUNKS, BATCH_CHUNKS = 2048, 64


def take_of(chunk: int, kinds: tuple[int, ...], size: int) -> np.ndarray:
    """A chunk of a take with these defects, without its noise."""
    i = chunk * size + np.arange(size)
    turn = lambda hz: np.sin(i * (2 * math.pi * hz / TAKE_RATE))
    within = lambda part: (i >= part[0]) & (i < part[0] + part[1])
    x = 0.2 * turn(300)
    if 6 in kinds:
        x = np.where(within(FADE), 0.04 * x, x)
    if 5 in kinds:
        x = np.where(within(AIR), 0.05 * (turn(1500) + turn(1900) + turn(2300) + turn(2700) + turn(3100)), x)
    if 1 in kinds:
        x += np.where(i == 6000, 1.5, 0.0)
    if 2 in kinds:
        x += np.where(i == 9000, 0.75, 0.0)
    if 3 in kinds:
        x += np.where(i < 16_384, 0.02 * turn(50), 0.0)
    if 4 in kinds:
        x += np.where(within(HISS), 0.6 * np.sin((i - HISS[0]) * (math.pi / HISS[1])) ** 2 * turn(6000), 0.0)
    if 7 in kinds:
        x += np.where(i < 16_384, 0.005 * (turn(3000) + turn(5000)), 0.0)
    return x


def noise_of(seed: int, i: np.ndarray) -> np.ndarray:
    """Noise of up to 1e-5 from the XXH64 of places, seeded by the hash of their track."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda v, n: (v << np.uint64(n)) | (v >> np.uint64(64 - n))
    h = np.array([seed]).astype(np.uint64) + p5 + np.uint64(8)
    h = turned(h ^ (turned(i.astype(np.uint64) * p2, 31) * p1), 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return ((h ^ (h >> np.uint64(32))).astype(np.int64) % 2001 - 1000) / 1e8


def takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mono chunk table: for every supplier a tone of 300 Hz with the defects numbered s_suppkey % 8 and s_suppkey / 8 % 8.

    1 a click, 2 a small click, 3 hum at 50 Hz, 4 a hiss at 6 kHz, 5 breath-like tones, 6 a quiet stretch, 7 two narrow tones, 0 none.
    The keys are few bytes and one file, the samples are 262 KB a track, so keys are dealt before samples are made."""
    from undula.operators.chunks import SIZE, listed

    k = F.col("s_suppkey").cast("long")
    d = read(spark, sf_dir, "supplier")
    tasks = max(spark.sparkContext.defaultParallelism, -(-d.count() * TAKE_CHUNKS // TASK_CHUNKS))
    d = d.select(k.alias("track"), F.array((k % 8).cast("int"), (F.floor(k / 8) % 8).cast("int")).alias("kinds"), F.xxhash64(k).alias("seed"))
    d = d.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(TAKE_CHUNKS - 1)))).withColumn("chunk", F.col("chunk").cast("long"))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain: dict[tuple, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_CHUNKS):
                b, made = whole.slice(at, BATCH_CHUNKS), []
                for chunk, kinds, seed in zip(*(b.column(c).to_pylist() for c in ("chunk", "kinds", "seed")), strict=True):
                    of = (chunk, tuple(sorted(set(kinds))))
                    if of not in plain:
                        plain[of] = take_of(*of, SIZE)
                    made.append(plain[of] + noise_of(seed, chunk * SIZE + np.arange(SIZE)))
                yield pa.RecordBatch.from_arrays([b.column("track"), b.column("chunk"), listed(made)], names=["track", "chunk", "xs"])

    return d.repartition(tasks, "track", "chunk").mapInArrow(sampled, "track long, chunk long, xs array<double>")


def mix_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix, track, gain_db, pan, mute, solo, shift (samples): one mix per nation, one track per supplier."""
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("mix"), k.alias("track"), F.round(F.col("s_acctbal") / 1000, 1).alias("gain_db"), ((k % 21 - 10) / 10.0).alias("pan"), (k % 7 == 0).alias("mute"), (k % 13 == 5).alias("solo"), (k % 5).alias("shift"), F.col("s_name").alias("name"))


MIX = "mix_tracks as (select s_nationkey mix, s_suppkey track, round(s_acctbal / 1000, 1) gain_db, (s_suppkey % 21 - 10) / 10.0::double pan, s_suppkey % 7 = 0 mute, s_suppkey % 13 = 5 solo, s_suppkey % 5 shift, s_name name from supplier)"


def plugins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plugin catalog from the parts: key, name (vendor style), vendor, format, path."""
    p = F.col("p_partkey")
    name = F.concat(F.when(p % 3 == 0, "RX 10 ").when(p % 3 == 1, "Waves  ").otherwise(""), F.col("p_name"), F.when(p % 4 == 0, " 2").otherwise(""))
    return read(spark, sf_dir, "part").select(p.alias("key"), name.alias("name"), F.col("p_brand").alias("vendor"), F.when(F.col("p_size") % 2 == 0, "vst3").otherwise("au").alias("format"), F.concat(F.lit("/plugins/"), p.cast("string")).alias("path"))


PLUGINS = "plugins as (select p_partkey key, case p_partkey % 3 when 0 then 'RX 10 ' when 1 then 'Waves  ' else '' end || p_name || case when p_partkey % 4 = 0 then ' 2' else '' end \"name\", p_brand vendor, case when p_size % 2 = 0 then 'vst3' else 'au' end format, '/plugins/' || p_partkey path from part)"


def speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, a, b (half open), kind: turns of a conversation laid end to end; the assistant's are speech."""
    n = F.length("text").cast("long")
    by = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    d = read(spark, sf_dir, "conversations").withColumn("b", F.sum(n).over(by))
    return d.select(F.col("conv_id").alias("track"), (F.col("b") - n).alias("a"), "b", F.when(F.col("role") == "assistant", "speech").otherwise("noise").alias("kind"))


SPEECH = "speech as (select conv_id track, cast(sum(length(text)) over w - length(text) as bigint) a, cast(sum(length(text)) over w as bigint) b, case when role = 'assistant' then 'speech' else 'noise' end kind from conversations window w as (partition by conv_id order by turn))"
