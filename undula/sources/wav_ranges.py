"""WAV files by byte ranges: a Spark data source whose partitions are parts of files, one that reads heads only, and a writer.

Reading. The driver lists files and cuts them by length alone; small files share a partition. A task reads the head of each
file of its partition, chunk header by chunk header (never a body but `fmt `), then the samples of the chunks that begin in its
range. So one long file is read by many tasks, and a task holds one chunk at a time. Rows are those of a chunk table
(operators/chunks.py): track (the path), channel, chunk, rate, xs, error. A file that is no WAV file is one row with its error.

Heads. format "wav_heads" gives path, rate, channels, frames, subtype, bytes, error of each file and reads no sample.

Writing. A task gets whole tracks, sorted, and writes chunk after chunk to a file of its own; only when all tasks are done the
driver gives the files their names, and if one fails it deletes what others wrote. A track that runs again leaves one file.

Paths are local or URIs that pyarrow.fs knows (s3, gs, hdfs, file). Sizes in headers that pass the file's end are cut to it.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from undula.sources.wav import SUBTYPES, decoded, encoded

#: Bytes of a range; samples of a chunk.
RANGE, CHUNK = 16 << 20, 8192
#: So many partitions of a table at most, about: each is a task, and the driver keeps what tasks report.
PARTS = 1024
ROWS = "track string, channel int, chunk long, rate int, xs array<double>, error string"
HEADS = "path string, rate int, channels int, frames long, subtype string, bytes long, error string"


@dataclass
class Head:
    code: int
    channels: int
    rate: int
    bits: int
    start: int
    size: int

    @property
    def block(self) -> int:
        return self.channels * self.bits // 8

    @property
    def frames(self) -> int:
        return self.size // self.block


def head_of(file, length: int) -> Head:
    """The head of a file with seek and read; ValueError if it is no WAV file with samples that decoded() knows."""
    first = file.read(12)
    if first[:4] != b"RIFF" or first[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, fmt = 12, None
    while at + 8 <= length:
        file.seek(at)
        name, size = struct.unpack("<4sI", file.read(8))
        if name == b"fmt ":
            body = file.read(min(size, 40))
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            fmt = (struct.unpack("<H", body[24:26])[0] if code == 0xFFFE else code, channels, rate, bits)
        elif name == b"data" and fmt:
            if not fmt[1] or (fmt[0], fmt[3]) not in SUBTYPES:
                raise ValueError(f"unknown format {fmt}")
            return Head(*fmt, at + 8, min(size, length - at - 8))
        at += 8 + size + size % 2
    raise ValueError("no samples")


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str, recursive: bool) -> list[tuple[str, int]]:
    """(path, bytes) of the WAV files in a folder, or of one file, in order."""
    store, inner = place(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = store.get_file_info(inner)
    found = store.get_file_info(fs.FileSelector(inner, recursive=recursive)) if info.type == fs.FileType.Directory else [info]
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and (f.path.lower().endswith(".wav") or f.path == inner))


@dataclass
class Part(InputPartition):
    """Ranges of files: (path, length, first byte, byte after the last)."""

    ranges: list[tuple[str, int, int, int]]


def parts(files: list[tuple[str, int]], size: int, most: int | None = None) -> list[Part]:
    """Long files cut into ranges of `size` bytes, short ones put together up to that size. Where that would make more than `most` parts
    or so, a part takes more of them in a row, those of one file as one."""
    out, now, room = [], [], 0
    limit = max(size, -(-sum(length for _, length in files) // most)) if most else size
    for path, length in files:
        for low in range(0, max(length, 1), size):
            high = min(low + size, length)
            if now and room + high - low > limit:
                out.append(Part(now))
                now, room = [], 0
            if now and now[-1][0] == path:
                now[-1] = (path, length, now[-1][2], high)
            else:
                now.append((path, length, low, high))
            room += high - low
    return [*out, Part(now)] if now else out


class WavReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.recursive = options["path"], options.get("recursive", "false").lower() == "true"
        self.size, self.chunk = int(options.get("range_bytes", RANGE)), int(options.get("chunk", CHUNK))
        self.most = int(options.get("parts", 0)) or None

    def partitions(self) -> list[Part]:
        return parts(listed(self.path, self.recursive), self.size, self.most)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        for path, length, low, high in partition.ranges:
            store, inner = place(path)
            with store.open_input_file(inner) as file:
                try:
                    head = head_of(file, length)
                except (ValueError, struct.error) as e:
                    if low == 0:
                        yield rows(path, None, None, None, [None], str(e))
                    continue
                step = self.chunk * head.block
                first = max(1, -(-(low - head.start) // step)) if low else 0  # the first chunk belongs to the range that holds the head
                for k in range(first, -(-head.frames // self.chunk)):
                    at = head.start + k * step
                    if at >= high and k:
                        break
                    file.seek(at)
                    x = decoded(head.code, head.bits, file.read(min(step, head.frames * head.block - k * step)))
                    yield rows(path, k, head.rate, head.channels, list(x.reshape(-1, head.channels).T), None)


def rows(path: str, chunk: int | None, rate: int | None, channels: int | None, xs: list, error: str | None) -> pa.RecordBatch:
    n = len(xs)
    columns = [([path] * n, pa.string()), (list(range(n)) if channels else [None] * n, pa.int32()), ([chunk] * n, pa.int64()), ([rate] * n, pa.int32()), (xs, pa.list_(pa.float64())), ([error] * n, pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns], names=["track", "channel", "chunk", "rate", "xs", "error"])


class HeadReader(WavReader):
    def partitions(self) -> list[Part]:
        """Files by number, as only heads are read."""
        files = listed(self.path, self.recursive)
        return [Part([(path, length, 0, length) for path, length in files[i : i + 256]]) for i in range(0, len(files), 256)]

    def read(self, partition: Part) -> Iterator[tuple]:
        for path, length, _, _ in partition.ranges:
            store, inner = place(path)
            with store.open_input_file(inner) as file:
                try:
                    h = head_of(file, length)
                    yield path, h.rate, h.channels, h.frames, SUBTYPES[h.code, h.bits], length, None
                except (ValueError, struct.error) as e:
                    yield path, None, None, None, None, length, str(e)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class WavWriter(DataSourceArrowWriter):
    """Rows (track, n, chunk, xs of all channels), whole tracks sorted by chunk."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.rate, self.bits, self.chunk = options["path"].rstrip("/"), int(options["rate"]), int(options.get("bits", 24)), int(options.get("chunk", CHUNK))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = place(self.folder)
        done, now, out, at = [], None, None, 0
        try:
            for b in iterator:
                for track, n, chunk, xs in zip(*(b.column(c).to_pylist() for c in ("track", "n", "chunk", "xs")), strict=True):
                    channels = len(xs)
                    if track != now:
                        if out:
                            self.silence(out, total - at, width)
                            out.close()
                        now, at, total, width = track, 0, n, channels
                        final = f"{folder}/{track}.wav"
                        store.create_dir(final.rsplit("/", 1)[0], recursive=True)
                        done.append((f"{final}.{uuid.uuid4().hex}.part", final))
                        out = store.open_output_stream(done[-1][0])
                        size = n * channels * self.bits // 8
                        out.write(b"RIFF" + struct.pack("<I", 36 + size + size % 2) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, self.rate, self.rate * channels * self.bits // 8, channels * self.bits // 8, self.bits) + b"data" + struct.pack("<I", size))
                    self.silence(out, chunk * self.chunk - at, width)
                    length = max(len(x) for x in xs)
                    wide = np.zeros((length, channels))
                    for c, x in enumerate(xs):
                        wide[: len(x), c] = np.nan_to_num(np.asarray(x, float))
                    out.write(encoded(wide.reshape(-1), self.bits))
                    at = chunk * self.chunk + length
            if out:
                self.silence(out, total - at, width)
                out.close()
        except BaseException:
            if out:
                out.close()
            self.delete([t for t, _ in done])  # a failed attempt leaves nothing
            raise
        return Written(done)

    def silence(self, out, frames: int, channels: int) -> None:
        for part in range(0, frames, self.chunk):
            out.write(bytes(min(self.chunk, frames - part) * channels * self.bits // 8))

    def delete(self, paths: list[str]) -> None:
        store, _ = place(self.folder)
        for path in paths:
            if store.get_file_info(path).type == fs.FileType.File:
                store.delete_file(path)

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = place(self.folder)
        for temporary, final in (f for m in messages if m for f in m.files):
            store.move(temporary, final)

    def abort(self, messages: list[Written | None]) -> None:
        self.delete([t for m in messages if m for t, _ in m.files])


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> WavReader:
        return WavReader(self.options)

    def writer(self, schema, overwrite: bool) -> WavWriter:
        return WavWriter(self.options)


class WavHeads(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav_heads"

    def schema(self) -> str:
        return HEADS

    def reader(self, schema) -> HeadReader:
        return HeadReader(self.options)


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(WavSource)
    spark.dataSource.register(WavHeads)
    return spark


def read_chunks(spark: SparkSession, path: str, recursive: bool = False, range_bytes: int = RANGE, chunk: int = CHUNK) -> DataFrame:
    """track, channel, chunk, rate, xs, error of the WAV files in a folder."""
    most = max(PARTS, 4 * spark.sparkContext.defaultParallelism)
    return registered(spark).read.format("wav").option("recursive", recursive).option("parts", most).option("range_bytes", range_bytes).option("chunk", chunk).load(path)


def read_heads(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, rate, channels, frames, duration, subtype, bit_depth, size_mb, error, without reading a sample."""
    d = registered(spark).read.format("wav_heads").option("recursive", recursive).load(path)
    depth = F.when(F.col("subtype") == "PCM_16", 16).when(F.col("subtype") == "PCM_24", 24).when(F.col("subtype").isin("PCM_32", "FLOAT"), 32).when(F.col("subtype") == "DOUBLE", 64)
    return d.select("path", "rate", "channels", "frames", (F.col("frames") / F.col("rate")).alias("duration"), "subtype", depth.alias("bit_depth"), F.round(F.col("bytes") / 1048576, 2).alias("size_mb"), "error")


def write_chunks(chunks: DataFrame, folder: str, rate: int, bits: int = 24, chunk: int = CHUNK) -> None:
    """One file `folder/track.wav` for each track of a chunk table, its folders made. A task writes whole tracks, one chunk at a time."""
    n = chunks.groupBy("track").agg(F.max(F.col("chunk") * chunk + F.size("xs")).alias("n"), (F.max("channel") + 1).alias("channels"))
    wide = chunks.groupBy("track", "chunk").agg(F.map_from_entries(F.collect_list(F.struct("channel", "xs"))).alias("by"))
    none = F.array().cast("array<double>")
    every = F.transform(F.sequence(F.lit(0), F.col("channels") - 1), lambda c: F.coalesce(F.try_element_at("by", c), none))
    d = wide.join(n, "track").select(F.col("track").cast("string").alias("track"), "n", "chunk", every.alias("xs"))
    d = d.repartition("track").sortWithinPartitions("track", "chunk")
    registered(chunks.sparkSession)
    d.write.format("wav").option("rate", rate).option("bits", bits).option("chunk", chunk).mode("append").save(folder)
