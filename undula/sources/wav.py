"""PCM WAV files as tables of samples, and back. Files are listed and read by Spark, so any store that it reads will do."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of audio files.
EXTENSIONS = ("wav", "flac", "mp3", "ogg", "aiff", "aif", "m4a", "wma", "opus")
SUBTYPES = {(1, 16): "PCM_16", (1, 24): "PCM_24", (1, 32): "PCM_32", (1, 8): "PCM_U8", (3, 32): "FLOAT", (3, 64): "DOUBLE"}
CHUNK = 48_000


def audio_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, length, modified of audio files, extensions in any case, in order of path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*EXTENSIONS)).select("path", "length", F.col("modificationTime").alias("modified")).orderBy("path")


def header(data: bytes) -> tuple[int, int, int, int, bytes]:
    """code (1 PCM, 3 float), channels, rate, bits, the samples' bytes; ValueError if this is no WAV file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, fmt = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            fmt = (struct.unpack("<H", body[24:26])[0] if code == 0xFFFE else code, channels, rate, bits)
        elif name == b"data" and fmt:
            return (*fmt, body)
        at += 8 + size + size % 2
    raise ValueError("no samples")


def decoded(code: int, bits: int, body: bytes) -> np.ndarray:
    if code == 3:
        return np.frombuffer(body[: len(body) // (bits // 8) * (bits // 8)], f"<f{bits // 8}").astype(float)
    if bits == 8:
        return (np.frombuffer(body, np.uint8).astype(float) - 128) / 128
    width = bits // 8
    raw = np.frombuffer(body[: len(body) // width * width], np.uint8).reshape(-1, width)
    wide = np.zeros((len(raw), 4), np.uint8)
    wide[:, 4 - width :] = raw
    return wide.view("<i4")[:, 0] / float(1 << 31)


def read_wav(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """binaryFile rows to chunks: path, channel, chunk, start, rate, xs, error. A bad file is one row with its error; the rest go on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                rows = []
                try:
                    code, channels, rate, bits, body = header(bytes(data))
                    x = decoded(code, bits, body)
                    x = x[: len(x) // channels * channels].reshape(-1, channels)
                    rows = [(path, c, k // chunk, k, rate, x[k : k + chunk, c].astype(np.float32).tolist(), None) for c in range(channels) for k in range(0, max(len(x), 1), chunk)]
                except (ValueError, struct.error, ZeroDivisionError) as e:
                    rows = [(path, None, None, None, None, None, str(e))]
                yield pd.DataFrame(rows, columns=["path", "channel", "chunk", "start", "rate", "xs", "error"]).astype({"channel": "Int32", "chunk": "Int64", "start": "Int64", "rate": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, channel int, chunk long, start long, rate int, xs array<float>, error string")


def samples_of(chunks: DataFrame) -> DataFrame:
    """Chunks to samples: track (the path), channel, i, x."""
    good = chunks.filter("error is null").select(F.col("path").alias("track"), "channel", "start", F.posexplode("xs").alias("k", "x"))
    return good.select("track", "channel", (F.col("start") + F.col("k")).alias("i"), F.col("x").cast("double").alias("x"))


def wav_info(files: DataFrame) -> DataFrame:
    """path, rate, channels, frames, duration, subtype, bit_depth, size_mb, error; read from the files' heads."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    code, channels, rate, bits, body = header(bytes(data))
                    rows.append((path, rate, channels, len(body) // (channels * bits // 8), SUBTYPES.get((code, bits)), None))
                except (ValueError, struct.error, ZeroDivisionError) as e:
                    rows.append((path, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "rate", "channels", "frames", "subtype", "error"]).astype({"rate": "Int32", "channels": "Int32", "frames": "Int64"})

    d = files.select("path", "content").mapInPandas(run, "path string, rate int, channels int, frames long, subtype string, error string").join(files.select("path", "length"), "path")
    depth = F.when(F.col("subtype") == "PCM_16", 16).when(F.col("subtype") == "PCM_24", 24).when(F.col("subtype").isin("PCM_32", "FLOAT"), 32).when(F.col("subtype") == "DOUBLE", 64)
    return d.select("path", "rate", "channels", "frames", (F.col("frames") / F.col("rate")).alias("duration"), "subtype", depth.alias("bit_depth"), F.round(F.col("length") / 1048576, 2).alias("size_mb"), "error")


def encoded(x: np.ndarray, bits: int) -> bytes:
    full = (1 << (bits - 1)) - 1
    whole = np.round(np.clip(x, -1, 1) * full).astype("<i4")
    return (whole << (32 - bits)).view(np.uint8).reshape(-1, 4)[:, 4 - bits // 8 :].tobytes()


def wav_files(samples: DataFrame, rate: int, bits: int = 24) -> DataFrame:
    """track, content: one file per track as a row, as a file is one object; write it with write_wav or any sink for bytes."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="i", columns="channel", values="x").sort_index().fillna(0.0).to_numpy()
        body = encoded(wide.reshape(-1), bits)
        channels = wide.shape[1]
        head = b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits) + b"data" + struct.pack("<I", len(body))
        return pd.DataFrame({"track": [str(key[0])], "content": [head + body + b"\0" * (len(body) % 2)]})

    return samples.groupBy("track").applyInPandas(run, "track string, content binary")


def write_wav(samples: DataFrame, folder: str, rate: int, bits: int = 24) -> DataFrame:
    """One file per track under a folder that all executors share (a mounted store), folders made; path, bytes, sha256 of each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        import os

        for batch in batches:
            rows = []
            for track, data in zip(batch["track"], batch["content"], strict=True):
                path = os.path.join(folder, f"{track}.wav")
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(f"{path}.part", "wb") as f:
                    f.write(data)
                os.replace(f"{path}.part", path)  # a task that runs again leaves the same file
                rows.append((track, path, len(data), hashlib.sha256(data).hexdigest()))
            yield pd.DataFrame(rows, columns=["track", "path", "bytes", "sha256"])

    return wav_files(samples, rate, bits).mapInPandas(run, "track string, path string, bytes long, sha256 string")


def changed_sources(files: DataFrame, edits: DataFrame) -> DataFrame:
    """edits (path, sha256) whose source now has another content hash, or is gone: path, sha256, now, changed."""
    now = files.select("path", F.sha2("content", 256).alias("now"))
    return edits.join(now, "path", "left").withColumn("changed", F.coalesce(F.col("now") != F.col("sha256"), F.lit(True)))


def apply_chunks(chunks: DataFrame, fn, passes: int = 1) -> DataFrame:
    """A user function (samples, rate) to samples over every chunk on its own, any number of times. xs and rate are columns."""

    def run(xs: pd.Series, rate: pd.Series) -> pd.Series:
        out = []
        for x, r in zip(xs, rate, strict=True):
            y = np.asarray(x, float)
            for _ in range(passes):
                y = fn(y, int(r))
            out.append(np.asarray(y, float).tolist())
        return pd.Series(out)

    return chunks.withColumn("xs", F.pandas_udf(run, "array<double>")("xs", "rate"))


def resampled(samples: DataFrame, from_rate: int, to_rate: int, chunk: int = 8192) -> DataFrame:
    """Samples at another rate (operators/chunks.py has the form for chunk tables)."""
    from undula.operators import chunks as H

    return H.to_samples(H.resampled(H.from_samples(samples, chunk), from_rate, to_rate, chunk), chunk)
