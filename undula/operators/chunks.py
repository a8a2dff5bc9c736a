"""Chunk tables: samples as arrays. Columns track, channel, chunk, xs; xs[k] is sample chunk * size + k, NaN where there is none.

A shuffle moves a row for each chunk, not one for each sample. A table that was written in this form (by a source, or by
from_samples once) is measured and mixed without its samples ever being rows: what channels or tracks of a mix must share is
an array sum, which is merged in the map task, dealt by chunk and merged again in a stream, so neither many tracks of a mix
nor many channels meet in memory. Frames, windows and events that pass a chunk's border get what they lack from block sums
or from the pieces of both chunks.

size is the same for a whole table and a multiple of the hop of frames. Chunks may be shorter than size. Empty tables give
empty results; columns besides the four are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from undula.functions import kernels as K
from undula.functions.columns import from_db
from undula.operators.edits import pan_factor
from undula.operators.frames import frames_of_blocks, kept_places
from undula.operators.mix import active
from undula.operators.regions import first_of
from undula.operators.spectral import mean_power

SIZE = 8192
COLUMNS = ["track", "channel", "chunk", "xs"]
#: Samples of partial sums that a task holds before it emits them: 12 bytes each.
HELD = 1 << 22
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}


def from_samples(samples: DataFrame, size: int = SIZE) -> DataFrame:
    """The chunk table of samples in long form (track, channel, i, x): the one shuffle in which samples travel as rows."""

    def run(chunk: pd.Series, i: pd.Series, x: pd.Series) -> pd.Series:
        out = []
        for c, places, values in zip(chunk, i, x, strict=True):
            places = np.asarray(places) - c * size
            xs = np.full(int(places.max()) + 1, np.nan)
            xs[places] = np.asarray(values, float)
            out.append(xs)
        return pd.Series(out)

    listed = samples.groupBy("track", "channel", F.floor(F.col("i") / size).alias("chunk")).agg(F.collect_list(F.struct("i", F.col("x").cast("double").alias("x"))).alias("s"))
    xs = F.pandas_udf(run, "array<double>")("chunk", "s.i", "s.x")
    return listed.select("track", "channel", "chunk", nan_for_null(xs).alias("xs"))


def nan_for_null(xs: Column) -> Column:
    """pandas hands NaN over as null."""
    return F.transform(xs, lambda x: F.coalesce(x, F.lit(float("nan"))))


def to_samples(chunks: DataFrame, size: int = SIZE) -> DataFrame:
    """track, channel, i, x."""
    d = chunks.select("track", "channel", "chunk", F.posexplode("xs").alias("k", "x")).filter(~F.isnan("x"))
    return d.select("track", "channel", (F.col("chunk") * size + F.col("k")).alias("i"), "x")


def arrays(column: pa.ListArray) -> list[np.ndarray]:
    """The rows of an Arrow column of arrays, as views of one numpy array."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1]) if len(ends) else []


def listed(rows: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), pa.int32()), pa.array(flat))


def by_chunk(d: DataFrame, keys: list[str], fn: Callable[..., list[tuple]], fields: str, *values: str) -> DataFrame:
    """Rows (keys, fields) that fn makes of the arrays in `values` and the chunk's number; fn(chunk, *arrays) returns a list of tuples."""
    made = StructType.fromDDL(fields)
    types = [ARROW[f.dataType.simpleString()] for f in made.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, of = [], []
            for row, (chunk, *xs) in enumerate(zip(b.column("chunk").to_pylist(), *(arrays(b.column(v)) for v in values), strict=True)):
                rows = fn(chunk, *xs)
                found += rows
                of += [row] * len(rows)
            columns = zip(*found, strict=True) if found else [()] * len(types)
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(of, pa.int64())) for k in keys), *(pa.array(v, t) for v, t in zip(columns, types, strict=True))], names=[*keys, *made.names])

    return d.mapInArrow(run, StructType([*(d.schema[k] for k in keys), *made.fields]))


def summed(d: DataFrame, keys: list[str], held: int = HELD) -> DataFrame:
    """keys, total, n: by place the sum of the arrays xs of equal keys, and how many have a sample there.

    A task sums what it meets of a key, and holds `held` samples at most; the sums are dealt and sorted by key and added
    up row after row, so a key with any number of arrays needs the memory of one."""
    schema = StructType([*(d.schema[k] for k in keys), *StructType.fromDDL("total array<double>, n array<int>").fields])

    def added(a: tuple | None, total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if a is None:
            return total.copy(), n.astype(np.int32)
        short, long = (a, (total, n)) if len(a[0]) < len(total) else ((total, n), a)
        total, n = long[0].copy(), long[1].astype(np.int32)
        total[: len(short[0])] += short[0]
        n[: len(short[0])] += short[1].astype(np.int32)
        return total, n

    def batch(sums: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
        columns = [pa.array([key[j] for key, _ in sums], t) for j, t in enumerate(types)]
        return pa.RecordBatch.from_arrays([*columns, listed([t for _, (t, _) in sums]), listed([n for _, (_, n) in sums])], names=[*keys, "total", "n"])

    def keys_of(b: pa.RecordBatch) -> tuple[list[tuple], list[pa.DataType]]:
        return list(zip(*(b.column(k).to_pylist() for k in keys), strict=True)), [b.column(k).type for k in keys]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, tuple] = {}
        room = 0
        for b in batches:
            of, types = keys_of(b)
            for key, xs in zip(of, arrays(b.column("xs")), strict=True):
                known = ~np.isnan(xs)
                room += 0 if key in sums else len(xs)
                sums[key] = added(sums.get(key), np.where(known, xs, 0.0), known)
                if room > held:
                    yield batch(list(sums.items()), types)
                    sums, room = {}, 0
        if sums:
            yield batch(list(sums.items()), types)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, room = None, [], 0
        for b in batches:
            of, types = keys_of(b)
            for key, total, n in zip(of, arrays(b.column("total")), arrays(b.column("n")), strict=True):
                if now and now[0] == key:
                    now = (key, added(now[1], total, n))
                    continue
                if now:
                    done.append(now)
                    room += len(now[1][0])
                now = (key, added(None, total, n))
                if room > held:
                    yield batch(done, types)
                    done, room = [], 0
        if now:
            yield batch([*done, now], types)

    parts = d.select(*keys, "xs").mapInArrow(partial, schema)
    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(fold, schema)


def mono(chunks: DataFrame) -> DataFrame:
    """track, channel 0, chunk, xs: the mean of the channels that have a sample."""
    mean = F.zip_with("total", "n", lambda t, n: F.when(n > 0, t / n).otherwise(F.lit(float("nan"))))
    return summed(chunks, ["track", "chunk"]).select("track", F.lit(0).alias("channel"), "chunk", mean.alias("xs"))


def gain(chunks: DataFrame, db: Column | float) -> DataFrame:
    return chunks.withColumn("_f", from_db(db)).withColumn("xs", F.transform("xs", lambda x: x * F.col("_f"))).drop("_f")


def pan(chunks: DataFrame, where: Column | float) -> DataFrame:
    factor = pan_factor(where if isinstance(where, Column) else F.lit(float(where)), F.col("channel"))
    return chunks.withColumn("_f", factor).withColumn("xs", F.transform("xs", lambda x: x * F.col("_f"))).drop("_f")


def sides(chunks: DataFrame) -> DataFrame:
    """track, chunk, l, r of chunks that have both channels: two rows meet, not their samples."""
    side = lambda c: F.any_value(F.when(F.col("channel") == c, F.col("xs")), F.lit(True))
    return chunks.filter("channel < 2").groupBy("track", "chunk").agg(side(0).alias("l"), side(1).alias("r")).filter("l is not null and r is not null")


def to_mid_side(chunks: DataFrame) -> DataFrame:
    """track, chunk, mid, side of stereo tracks, where both channels have a sample."""
    both = F.zip_with("l", "r", lambda a, b: F.struct((((a + b) / 2)).alias("mid"), ((a - b) / 2).alias("side")))
    both = F.filter(both, lambda s: s["mid"].isNotNull())  # the longer side's end
    d = sides(chunks).select("track", "chunk", both.alias("s"))
    return d.select("track", "chunk", F.transform("s", lambda s: s["mid"]).alias("mid"), F.transform("s", lambda s: s["side"]).alias("side"))


def from_mid_side(ms: DataFrame) -> DataFrame:
    side = lambda sign: F.zip_with("mid", "side", lambda m, s: m + sign * s)
    both = F.array(F.struct(F.lit(0).alias("channel"), side(1).alias("xs")), F.struct(F.lit(1).alias("channel"), side(-1).alias("xs")))
    return ms.select("track", "chunk", F.explode(both).alias("c")).select("track", "c.channel", "chunk", "c.xs")


def shifted(chunks: DataFrame, by: Column, size: int = SIZE) -> DataFrame:
    """Later by so many samples: a chunk's array is cut at the border that it now crosses, and both pieces keep their places in the chunks they fall in."""
    first, rest = F.floor((F.col("chunk") * size + by) / size), F.pmod(by, F.lit(size)).cast("int")
    nan = lambda n: F.array_repeat(F.lit(float("nan")), n)
    room = size - F.col("_r")
    head = F.struct(F.col("_q").alias("chunk"), F.concat(nan(F.col("_r")), F.slice("xs", F.lit(1), room)).alias("xs"))
    tail = F.struct((F.col("_q") + 1).alias("chunk"), F.slice("xs", room + 1, F.lit(size)).alias("xs"))
    pieces = F.when(F.size("xs") > room, F.array(head, tail)).otherwise(F.array(head))
    d = chunks.withColumn("_q", first).withColumn("_r", rest).withColumn("_p", F.explode(pieces)).withColumn("chunk", F.col("_p.chunk")).withColumn("xs", F.col("_p.xs"))
    return d.drop("_q", "_r", "_p")


def stereo(chunks: DataFrame) -> DataFrame:
    """Mono doubled; of more than two channels the first two."""
    wide = chunks.groupBy("track").agg(F.max("channel").alias("last"))
    d = chunks.filter("channel < 2").join(wide, "track")
    return d.withColumn("channel", F.explode(F.when(F.col("last") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array("channel")))).select(COLUMNS)


def mixed(chunks: DataFrame, config: DataFrame, size: int = SIZE) -> DataFrame:
    """mix, channel, chunk, xs: stereo tracks shifted, weighted and summed."""
    on = active(config).select("mix", "track", "gain_db", "pan", "shift")
    d = chunks.join(on, "track").withColumn("_f", from_db(F.col("gain_db")) * pan_factor(F.col("pan"), F.col("channel")))
    d = shifted(d.withColumn("xs", F.transform("xs", lambda x: x * F.col("_f"))), F.col("shift"), size)
    total = F.zip_with("total", "n", lambda t, n: F.when(n > 0, t).otherwise(F.lit(float("nan"))))
    return summed(d, ["mix", "channel", "chunk"]).select("mix", "channel", "chunk", total.alias("xs"))


def frame_metrics(chunks: DataFrame, frame: int = 2048, hop: int = 512, size: int = SIZE) -> DataFrame:
    """track, frame_no, start, rms, peak, zcr of every full frame of the mono signal. Chunks give a row for each hop; only these are windowed."""
    if size % hop or frame % hop:
        raise ValueError("chunks and frames must be whole numbers of hops")

    def blocks(chunk: int, xs: np.ndarray) -> list[tuple]:
        k = np.flatnonzero(~np.isnan(xs))
        if not len(k):
            return []
        x, block = xs[k], k // hop
        starts = np.flatnonzero(np.r_[True, np.diff(block) > 0])
        sign = np.sign(x)
        step = np.r_[0.0, np.abs(np.diff(sign))]
        step[starts] = 0
        ends = np.r_[starts[1:], len(x)] - 1
        parts = zip(block[starts], np.add.reduceat(x * x, starts), np.maximum.reduceat(np.abs(x), starts), np.add.reduceat(step, starts), sign[starts], sign[ends], k[ends], strict=True)
        return [(int(b) + chunk * (size // hop), float(e), float(p), float(s), float(f), float(z), int(last) + chunk * size) for b, e, p, s, f, z, last in parts]

    found = by_chunk(mono(chunks), ["track"], blocks, "frame_no long, e double, p double, inner double, first double, final double, last long", "xs")
    return frames_of_blocks(found, frame, hop)


def clipping(chunks: DataFrame, limit: float = 0.999, first: int = 10, size: int = SIZE) -> DataFrame:
    """track, clipped (of any channel), by_channel, places: the first few. Only arrays with a clipped sample are dealt by chunk."""
    over = lambda x: ~F.isnan(x) & (F.abs(x) >= limit)
    marks = F.transform("xs", lambda x: F.when(over(x), F.lit(1.0)).otherwise(F.lit(float("nan"))))
    hit = chunks.filter(F.exists("xs", over)).select("track", "channel", "chunk", F.size(F.filter("xs", over)).alias("n"), marks.alias("xs"))
    per = hit.groupBy("track", "channel").agg(F.sum("n").alias("n")).groupBy("track").agg(F.sort_array(F.collect_list(F.struct("channel", "n"))).alias("by_channel"))

    def union(chunk: int, counts: np.ndarray) -> list[tuple]:
        k = np.flatnonzero(counts)
        return [(len(k), (k[:first] + chunk * size).tolist())]

    found = by_chunk(summed(hit, ["track", "chunk"]), ["track"], union, "clipped long, places array<long>", "n")
    early = first_of(found.select("track", F.explode("places").alias("a")), first).groupBy("track").agg(F.sort_array(F.collect_list("a")).alias("places"))
    out = chunks.select("track").distinct().join(found.groupBy("track").agg(F.sum("clipped").alias("clipped")), "track", "left").join(per, "track", "left").join(early, "track", "left")
    return out.select("track", F.coalesce("clipped", F.lit(0)).alias("clipped"), "by_channel", "places")


def correlation(chunks: DataFrame, window: int, size: int = SIZE) -> DataFrame:
    """track, overall correlation, and of full windows with a signal on both sides: least, mean, percent below zero, count.
    A chunk gives the moments of each window that it touches; a window's moments are added up."""

    def moments(chunk: int, left: np.ndarray, right: np.ndarray) -> list[tuple]:
        n = min(len(left), len(right))
        k = np.flatnonzero(~np.isnan(left[:n] + right[:n]))
        if not len(k):
            return []
        w, a, b = (k + chunk * size) // window, left[k], right[k]
        starts = np.flatnonzero(np.r_[True, np.diff(w) > 0])
        of = lambda v: np.add.reduceat(v, starts).tolist()
        return list(zip(w[starts].tolist(), of(np.ones(len(k))), of(a), of(b), of(a * a), of(b * b), of(a * b), [int(k[-1]) + chunk * size] * len(starts), strict=True))

    found = by_chunk(sides(chunks), ["track"], moments, "w long, n double, a double, b double, aa double, bb double, ab double, last long", "l", "r")
    sums = [F.sum(c).alias(c) for c in ("n", "a", "b", "aa", "bb", "ab")]
    va, vb = F.col("n") * F.col("aa") - F.col("a") * F.col("a"), F.col("n") * F.col("bb") - F.col("b") * F.col("b")
    r = F.try_divide(F.col("n") * F.col("ab") - F.col("a") * F.col("b"), F.sqrt(F.greatest(va, F.lit(0.0)) * F.greatest(vb, F.lit(0.0))))
    std = lambda v: F.sqrt(F.greatest(v, F.lit(0.0))) / F.col("n")
    per = found.groupBy("track", "w").agg(*sums, F.max("last").alias("last"))
    overall = per.groupBy("track").agg(*sums, (F.max("last") + 1).alias("end")).select("track", r.alias("overall"), "end")
    full = per.join(overall.select("track", "end"), "track").filter((F.col("w") + 1) * window <= F.col("end")).filter((std(va) >= 1e-8) & (std(vb) >= 1e-8)).select("track", r.alias("c"))
    agg = full.groupBy("track").agg(F.min("c").alias("least"), F.avg("c").alias("mean"), (100 * F.avg(F.when(F.col("c") < 0, 1.0).otherwise(0.0))).alias("negative_pct"), F.count("*").alias("windows"))
    out = overall.join(agg, "track", "left").withColumn("overall", F.coalesce("overall", F.lit(0.0)))
    return out.select("track", "overall", F.coalesce("least", "overall").alias("least"), "mean", F.coalesce("negative_pct", F.lit(0.0)).alias("negative_pct"), F.coalesce("windows", F.lit(0)).alias("windows"))


def imbalance(chunks: DataFrame) -> DataFrame:
    """track, imbalance_db: left over right RMS; null if a side is silent. Stereo tracks only. No array is shuffled."""
    known = F.filter("xs", lambda x: ~F.isnan(x))
    d = chunks.select("track", "channel", F.aggregate(known, F.lit(0.0), lambda a, x: a + x * x).alias("e"), F.size(known).alias("n"))
    rms = lambda c: F.sqrt(F.try_divide(F.sum(F.when(F.col("channel") == c, F.col("e"))), F.sum(F.when(F.col("channel") == c, F.col("n")))))
    d = d.groupBy("track").agg(rms(0).alias("l"), rms(1).alias("r"), F.max("channel").alias("last")).filter("last = 1")
    return d.select("track", F.when((F.col("l") > 0) & (F.col("r") > 0), 20 * F.log10(F.col("l") / F.col("r"))).alias("imbalance_db"))


def head_tail_silence(chunks: DataFrame, rate: int, threshold_db: float = -60.0, size: int = SIZE) -> DataFrame:
    """track, head_ms, tail_sec (null if all is silent), all_silence."""
    limit = 10 ** (threshold_db / 20)

    def ends(chunk: int, xs: np.ndarray) -> list[tuple]:
        loud, known = np.flatnonzero(np.abs(xs) > limit), np.flatnonzero(~np.isnan(xs))
        return [(int(loud[0]) + chunk * size if len(loud) else None, int(loud[-1]) + chunk * size if len(loud) else None, int(known[-1]) + chunk * size)] if len(known) else []

    d = by_chunk(mono(chunks), ["track"], ends, "a long, b long, last long", "xs").groupBy("track").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.max("last").alias("last"))
    return d.select("track", F.round(F.col("a") / rate * 1000, 1).alias("head_ms"), F.round((F.col("last") - F.col("b")) / rate, 3).alias("tail_sec"), F.col("a").isNull().alias("all_silence"))


def neighbourhoods(events: DataFrame, chunks: DataFrame, before: int, after: int, size: int = SIZE) -> DataFrame:
    """events (track, at, ...) with `xs`, the samples of their track in [at - before, at + after), NaN beyond its ends, and `start`, the first one's place.

    An interval join of events to chunks: an event is dealt to the chunks that its interval touches, each gives its slice,
    and the slices of both sides of a border are put together. Events with the same track and place share their slice."""
    low, high = F.greatest(F.col("at") - before, F.lit(0)), F.col("at") + after - 1
    asked = events.select("track", "at").distinct().withColumn("chunk", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))
    own = chunks.select(F.col("track"), "chunk", F.col("xs").alias("_xs"))
    offset = F.greatest(low - F.col("chunk") * size, F.lit(0)).cast("int")
    length = (F.least(high + 1 - F.col("chunk") * size, F.lit(size)) - offset).cast("int")
    piece = asked.join(own, ["track", "chunk"]).select("track", "at", F.struct("chunk", offset.alias("offset"), F.slice("_xs", offset + 1, length).alias("xs")).alias("p")).filter(F.size("p.xs") > 0)
    whole = piece.select("track", "at", F.struct((F.col("p.chunk") * size + F.col("p.offset")).alias("start"), F.col("p.xs").alias("xs")).alias("p"))
    pieces = whole.groupBy("track", "at").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return events.join(pieces.select("track", "at", F.get("p", F.lit(0))["start"].alias("start"), in_a_row("p").alias("xs")), ["track", "at"])


def in_a_row(pieces: str) -> Column:
    """The arrays of sorted pieces (start, xs) as one, with NaN between them."""
    gap = lambda p, k: F.coalesce(F.get(pieces, k + 1)["start"] - p["start"] - F.size(p["xs"]), F.lit(0)).cast("int")
    return F.flatten(F.transform(pieces, lambda p, k: F.concat(p["xs"], F.array_repeat(F.lit(float("nan")), gap(p, k)))))


def haloed(chunks: DataFrame, left: int, right: int, size: int = SIZE, skip: Column | None = None) -> DataFrame:
    """Each chunk with what its track has up to `left` samples before it and `right` after it: xs begins at max(0, chunk * size - left).

    Neighbours get just the border that they need, so chunks travel once and a halo costs its own length. With `skip` (left must be
    0) a chunk goes without so many of its own first samples, which are then not shuffled: xs begins at chunk * size + skip, a column."""
    keys = [k for k in ("track", "channel") if k in chunks.columns]
    here, length = F.col("chunk") * size, F.size("xs")
    offset = F.greatest((F.col("chunk") + F.col("_d")) * size - left - here, F.lit(0)).cast("int")
    if skip is not None:
        offset = F.when(F.col("_d") == 0, skip).otherwise(offset).cast("int")
    end = F.least((F.col("chunk") + F.col("_d") + 1) * size + right - here, length).cast("int")
    steps = F.array(*(F.lit(d) for d in range(-right // size, -(-left // size) + 1)))
    dealt = chunks.withColumn("_d", F.explode(steps)).withColumn("_o", offset).withColumn("_n", end - offset).filter("chunk + _d >= 0 and (_n > 0 or _d = 0)")
    piece = F.struct((here + F.col("_o")).alias("start"), F.slice("xs", F.col("_o") + 1, F.col("_n")).alias("xs"))
    d = dealt.select(*keys, (F.col("chunk") + F.col("_d")).alias("chunk"), (F.col("_d") == 0).alias("own"), F.when(F.col("_d") == 0, F.col("_o")).alias("skip"), piece.alias("p"))
    d = d.groupBy(*keys, "chunk").agg(F.sort_array(F.collect_list("p")).alias("p"), F.max("own").alias("own"), F.max("skip").alias("skip")).filter("own")
    if skip is not None:
        return d.select(*keys, "chunk", "skip", in_a_row("p").alias("xs"))
    ahead = F.get("p", F.lit(0))["start"] - F.greatest(F.col("chunk") * size - left, F.lit(0))
    return d.select(*keys, "chunk", F.concat(F.array_repeat(F.lit(float("nan")), ahead.cast("int")), in_a_row("p")).alias("xs"))


def by_frames(chunks: DataFrame, frame: int, hop: int, fn: Callable[[np.ndarray], list[np.ndarray]], names: list[str], size: int = SIZE) -> DataFrame:
    """track, frame_no, start, n and the named values of every full frame of a mono chunk table (track, chunk, xs); a track
    shorter than a frame is one frame of n samples. fn: frames as a matrix to one column for each name.

    Frames inside a chunk are read where it is; only those that pass its end need samples of two chunks, and only these samples are shuffled."""

    def rows(start: int, matrix: np.ndarray) -> list[tuple]:
        if not len(matrix):
            return []
        starts = start + hop * np.arange(len(matrix))
        return list(zip((starts // hop).tolist(), starts.tolist(), [matrix.shape[1]] * len(matrix), *(np.asarray(v, float).tolist() for v in fn(matrix)), strict=True))

    def frames(begin: int, end: int, xs: np.ndarray) -> list[tuple]:
        """Of the full frames of xs, which begins at place `begin`, those that start before `end`."""
        first = -(-begin // hop) * hop
        return rows(first, np.lib.stride_tricks.sliding_window_view(xs, frame)[first - begin : max(end - begin, 0) : hop]) if len(xs) >= frame else []

    def inside(chunk: int, xs: np.ndarray) -> list[tuple]:
        return frames(chunk * size, (chunk + 1) * size, np.nan_to_num(xs))

    def across(chunk: int, skip: np.ndarray, xs: np.ndarray) -> list[tuple]:
        begin, xs = chunk * size + int(skip[0]), np.nan_to_num(xs)
        return rows(0, xs[None]) if begin == 0 and 0 < len(xs) < frame else frames(begin, (chunk + 1) * size, xs)

    fields = "frame_no long, start long, n long, " + ", ".join(f"{n} double" for n in names)
    own = chunks.select("track", "chunk", "xs")
    lead = F.pmod(-F.col("chunk") * size, F.lit(hop))
    whole = F.greatest(F.floor((F.size("xs") - lead - frame) / hop) + 1, F.lit(0))  # frames that end in the chunk
    tails = haloed(own, 0, frame - 1, size, F.least(lead + whole * hop, F.size("xs"))).withColumn("skip", F.array(F.col("skip").cast("double")))
    return by_chunk(own, ["track"], inside, fields, "xs").unionByName(by_chunk(tails, ["track"], across, fields, "skip", "xs"))


def click_candidates(chunks: DataFrame, rate: int, sensitivity: float, window_ms: float = 50.0, reach: int = 0, near: Callable[[np.ndarray], tuple] | None = None, fields: str = "", size: int = SIZE) -> DataFrame:
    """track, i, ratio of all steps of a mono chunk table over `sensitivity` times the local RMS, and the named fields that `near` gives
    of the samples in [i - reach, i + reach), as far as the track has them."""
    window = max(int(window_ms / 1000 * rate), 16)
    left, right = max(window, reach), max(window + 1, reach)

    def run(chunk: int, xs: np.ndarray) -> list[tuple]:
        start, low = chunk * size, max(0, chunk * size - left)
        places, ratios = K.click_ratios(xs, low, start, start + size, window)
        over = ratios > sensitivity
        found = [(int(p), float(r)) for p, r in zip(places[over], ratios[over], strict=True)]
        return [(p, r, *near(xs[max(p - reach - low, 0) : p + reach - low])) for p, r in found] if near else found

    return by_chunk(haloed(chunks.select("track", "chunk", "xs"), left, right, size), ["track"], run, "i long, ratio double" + (f", {fields}" if fields else ""), "xs")


def apart(places: DataFrame, rate: int, apart_ms: float = 5.0) -> DataFrame:
    """track, i: the first of the candidates within `apart_ms`."""
    return kept_places(places.select("track", "i"), max(int(apart_ms / 1000 * rate), 1))


def click_places(chunks: DataFrame, rate: int, sensitivity: float = 6.0, window_ms: float = 50.0, apart_ms: float = 5.0, size: int = SIZE) -> DataFrame:
    """track, i of the clicks of a mono chunk table: steps over `sensitivity` times the local RMS, the first of those within `apart_ms`."""
    return apart(click_candidates(chunks, rate, sensitivity, window_ms, size=size), rate, apart_ms)


def long_term_spectrum(chunks: DataFrame, rate: int, fft: int = 16384, hop: int | None = None, min_rms: float = 0.01, size: int = SIZE, bins: list[int] | None = None) -> DataFrame:
    """track, bin, freq, power, frames of a mono chunk table: mean power over frames that are loud enough. A chunk yields one array of sums, of
    `bins` alone if they are given."""
    hop = hop or fft // 2
    held = slice(None) if bins is None else np.array(bins)
    right = fft - hop if hop <= fft and size % hop == 0 else fft - 1  # where hops meet a chunk's end, its last frame starts a hop before it

    def run(chunk: int, xs: np.ndarray) -> list[tuple]:
        begin, power, n = chunk * size, np.zeros(fft // 2 + 1), 0
        xs = np.nan_to_num(xs)
        for at in range(-(-begin // hop) * hop - begin, min(size, len(xs) - fft + 1), hop):
            frame = xs[at : at + fft]
            if np.sqrt((frame * frame).mean()) >= min_rms:
                power, n = power + np.abs(np.fft.rfft(frame * np.hanning(fft))) ** 2, n + 1
        return [(power[held].tolist(), n)]

    return mean_power(by_chunk(haloed(chunks.select("track", "chunk", "xs"), 0, right, size), ["track"], run, "power array<double>, n long", "xs"), rate, fft, bins)


def ends(chunks: DataFrame, size: int = SIZE) -> DataFrame:
    """track, n: samples of each track."""
    return chunks.groupBy("track").agg(F.max(F.col("chunk") * size + F.size("xs")).alias("n"))


def applied(chunks: DataFrame, fn: Callable[[np.ndarray, int], np.ndarray], rate: int, passes: int = 1, left: int = 0, right: int = 0, size: int = SIZE) -> DataFrame:
    """A user function (samples, rate) to as many samples over every channel, any number of times. Before each pass chunks
    exchange borders: fn sees up to `left` samples before a chunk and `right` after it, so what reaches no further is the same at any size."""
    for _ in range(passes):
        d = haloed(chunks, left, right, size).withColumnRenamed("xs", "wide").join(chunks.select("track", "channel", "chunk", F.size("xs").alias("_n")), ["track", "channel", "chunk"])

        def run(chunk: pd.Series, n: pd.Series, wide: pd.Series) -> pd.Series:
            out = []
            for c, m, x in zip(chunk, n, wide, strict=True):
                before = min(left, c * size)
                y = np.asarray(fn(np.asarray(x, float), rate), float)
                if len(y) != len(x):
                    raise ValueError("the function must return as many samples as it gets")
                out.append(y[before : before + m])
            return pd.Series(out)

        chunks = d.select("track", "channel", "chunk", nan_for_null(F.pandas_udf(run, "array<double>")("chunk", "_n", "wide")).alias("xs"))
    return chunks


def resampled(chunks: DataFrame, from_rate: int, to_rate: int, size: int = SIZE) -> DataFrame:
    """The chunk table at another rate: a polyphase filter for the reduced ratio, whose length grows with it, on chunks with a halo.
    A chunk's output is cut at the borders of the new table's chunks and put together there. NaN counts as silence."""
    common = math.gcd(from_rate, to_rate)
    up, down = to_rate // common, from_rate // common
    reach, bank = K.resample_reach(up, down), K.polyphase_bank(up, down)
    wide = haloed(chunks, reach, reach, size).join(chunks.groupBy("track", "channel").agg(F.max(F.col("chunk") * size + F.size("xs")).alias("n")), ["track", "channel"])

    def run(chunk: int, xs: np.ndarray, n: np.ndarray) -> list[tuple]:
        start = chunk * size
        first, y = K.resampled(np.nan_to_num(xs), max(0, start - reach), start, start + size, int(n[0]), bank, up, down)
        out = []
        for c in range(first // size, -(-(first + len(y)) // size)):
            a, b = max(first, c * size), min(first + len(y), (c + 1) * size)
            out.append((c, np.concatenate([np.full(a - c * size, np.nan), y[a - first : b - first]])))
        return out

    pieces = by_chunk(wide.withColumn("ns", F.array(F.col("n").cast("double"))), ["track", "channel"], run, "chunk long, xs array<double>", "xs", "ns")
    total = F.zip_with("total", "n", lambda t, n: F.when(n > 0, t).otherwise(F.lit(float("nan"))))
    return summed(pieces, ["track", "channel", "chunk"]).select("track", "channel", "chunk", total.alias("xs"))
