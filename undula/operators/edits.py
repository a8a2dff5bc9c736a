"""Edits of signals on the time line. samples: track, channel, i, x, and any columns that name the signal further.

Every function takes and returns DataFrames. Windows over samples are bounded by chunks; what a whole track decides (its
length, peak, mean) is an aggregate joined back, so one long track is never read by one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from undula.functions.columns import from_db
from undula.sources.shared import stored

KEY = ["track", "channel"]
COLUMNS = ["track", "channel", "i", "x"]
#: Samples in a chunk, the unit of windows over samples.
CHUNK = 65_536
CURVES = ("linear", "cosine", "equal_power", "exponential", "logarithmic")


def totals(samples: DataFrame) -> DataFrame:
    """track, n (samples of its longest channel), channels, peak, rms: one aggregate, summed before it is dealt."""
    return samples.groupBy("track").agg((F.max("i") + 1).alias("n"), F.count_distinct("channel").alias("channels"), F.max(F.abs("x")).alias("peak"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))


def lengths(samples: DataFrame) -> DataFrame:
    return samples.groupBy("track").agg((F.max("i") + 1).alias("n"))


def with_neighbours(samples: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Adds before (the sample before, null at the start). Each chunk gets the last sample of the one before it as a halo."""
    own = F.floor(F.col("i") / chunk)
    rows = samples.withColumn("chunk", F.explode(F.when(F.col("i") % chunk == chunk - 1, F.array(own, own + 1)).otherwise(F.array(own))))
    by = Window.partitionBy(*KEY, "chunk").orderBy("i")
    return rows.withColumn("before", F.lag("x").over(by)).filter(F.floor(F.col("i") / chunk) == F.col("chunk")).drop("chunk")


def mono(samples: DataFrame) -> DataFrame:
    return samples.groupBy("track", "i").agg(F.avg("x").alias("x")).select("track", F.lit(0).alias("channel"), "i", "x")


def stereo(samples: DataFrame) -> DataFrame:
    """Mono doubled; of more than two channels the first two."""
    wide = samples.groupBy("track").agg(F.max("channel").alias("last"))
    out = samples.filter("channel < 2").join(wide, "track").withColumn("channel", F.explode(F.when(F.col("last") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array("channel"))))
    return out.select(COLUMNS)


def to_mid_side(samples: DataFrame) -> DataFrame:
    """track, i, mid, side of stereo tracks."""
    side = lambda c: F.max(F.when(F.col("channel") == c, F.col("x")))
    lr = samples.filter("channel < 2").groupBy("track", "i").agg(side(0).alias("l"), side(1).alias("r")).filter("l is not null and r is not null")
    return lr.select("track", "i", ((F.col("l") + F.col("r")) / 2).alias("mid"), ((F.col("l") - F.col("r")) / 2).alias("side"))


def from_mid_side(ms: DataFrame) -> DataFrame:
    lr = F.array(F.struct(F.lit(0).alias("channel"), (F.col("mid") + F.col("side")).alias("x")), F.struct(F.lit(1).alias("channel"), (F.col("mid") - F.col("side")).alias("x")))
    return ms.select("track", "i", F.explode(lr).alias("s")).select("track", "s.channel", "i", "s.x")


def gain(samples: DataFrame, db: Column | float) -> DataFrame:
    return samples.withColumn("x", F.col("x") * from_db(db))


def pan_factor(pan: Column, channel: Column) -> Column:
    """Equal power; pan is clipped to -1..1."""
    angle = (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), pan)) + 1) * (F.pi() / 4)
    return F.when(channel == 0, F.cos(angle)).otherwise(F.sin(angle))


def pan(samples: DataFrame, where: Column | float) -> DataFrame:
    return samples.withColumn("x", F.col("x") * pan_factor(where if isinstance(where, Column) else F.lit(float(where)), F.col("channel")))


def trim(samples: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    kept = samples.filter(F.col("i") >= start)
    return (kept if end is None else kept.filter(F.col("i") < end)).withColumn("i", F.col("i") - start)


def pad(samples: DataFrame, head: int = 0, tail: int = 0) -> DataFrame:
    if head < 0 or tail < 0:
        raise ValueError("padding can't be negative")
    ends = samples.groupBy(*KEY).agg((F.max("i") + 1).alias("n"))
    zeros = [ends.select(*KEY, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(head - 1).cast("long"))).alias("i"), F.lit(0.0).alias("x"))] if head else []
    zeros += [ends.select(*KEY, F.explode(F.sequence(F.col("n") + head, F.col("n") + head + tail - 1)).alias("i"), F.lit(0.0).alias("x"))] if tail else []
    return reduce(DataFrame.unionByName, [samples.select(*KEY, (F.col("i") + head).alias("i"), "x"), *zeros])


def curve(k: Column, n: Column, kind: str = "linear") -> Column:
    """A fade's factor at place k of n, 0 at the start and 1 at the end (evenly spaced, both ends included)."""
    x = F.when(n > 1, k / (n - 1)).otherwise(F.lit(0.0))
    if kind == "linear":
        return x
    if kind == "cosine":
        return 0.5 * (1 - F.cos(F.pi() * x))
    if kind == "equal_power":
        return F.sqrt(x)
    raw = {"exponential": lambda v: F.pow(F.lit(10.0), (v - 1) * 3), "logarithmic": lambda v: 1 - F.pow(F.lit(10.0), -v * 3)}[kind]
    low, high = raw(F.lit(0.0)), raw(F.lit(1.0))  # stretched so that it begins at 0 and ends at 1
    return (raw(x) - low) / (high - low)


def fade_in(samples: DataFrame, n: int, kind: str = "linear") -> DataFrame:
    d = samples.join(lengths(samples), "track")
    size = F.least(F.lit(n), F.col("n"))
    return d.withColumn("x", F.when(F.col("i") < size, F.col("x") * curve(F.col("i"), size, kind)).otherwise(F.col("x"))).select(COLUMNS)


def fade_out(samples: DataFrame, n: int, kind: str = "linear") -> DataFrame:
    """A fade of no samples changes nothing."""
    d = samples.join(lengths(samples), "track")
    size, back = F.least(F.lit(n), F.col("n")), F.col("n") - 1 - F.col("i")
    return d.withColumn("x", F.when(back < size, F.col("x") * curve(back, size, kind)).otherwise(F.col("x"))).select(COLUMNS)


def dc_offset(samples: DataFrame) -> DataFrame:
    return samples.groupBy(*KEY).agg(F.avg("x").alias("dc"))


def remove_dc(samples: DataFrame) -> DataFrame:
    return samples.join(dc_offset(samples), KEY).withColumn("x", F.col("x") - F.col("dc")).select(COLUMNS)


def summed(pieces: list[DataFrame]) -> DataFrame:
    """Pieces laid over each other; a place where several meet is their sum."""
    return reduce(DataFrame.unionByName, [p.select(COLUMNS) for p in pieces]).groupBy(*KEY, "i").agg(F.sum("x").alias("x"))


def cut_region(samples: DataFrame, start: int, end: int, crossfade: int = 0) -> DataFrame:
    """Without [start, end); the two sides overlap by the crossfade, as far as both are that long."""
    d = samples.join(lengths(samples), "track").filter((F.col("i") < start) | (F.col("i") >= end))
    cf = F.least(F.lit(crossfade), F.lit(start), F.greatest(F.col("n") - end, F.lit(0)))
    left, at = F.col("i") < start, F.when(F.col("i") < start, F.col("i")).otherwise(F.col("i") - end + start - cf)
    k = F.when(left, F.col("i") - (start - cf)).otherwise(F.col("i") - end)
    into = curve(k, cf, "linear")
    weight = F.when(left & (k >= 0), 1 - into).when(~left & (k < cf), into).otherwise(F.lit(1.0))
    return summed([d.select("track", "channel", at.alias("i"), (F.col("x") * weight).alias("x"))])


def aligned(clip: DataFrame, base: DataFrame) -> DataFrame:
    """clip with the channels of base, for the tracks of both: mono doubled for stereo, stereo averaged for mono; any other difference is an error."""
    size = lambda d, name: d.groupBy("track").agg((F.max("channel") + 1).alias(name))
    d = clip.select(COLUMNS).join(size(base, "have").join(size(clip, "own"), "track"), "track")
    here, first = F.array(F.col("channel").cast("int")), F.array(F.lit(0))
    to = F.when(F.col("own") == F.col("have"), here).when((F.col("own") == 1) & (F.col("have") == 2), F.array(F.lit(0), F.lit(1))).when((F.col("own") == 2) & (F.col("have") == 1), first)
    to = F.coalesce(to, F.raise_error(F.format_string("a clip of %d channels can't go into %d", "own", "have")).cast("array<int>"))
    return d.withColumn("channel", F.explode(to)).groupBy(*KEY, "i").agg(F.avg("x").alias("x"))


def splice(base: DataFrame, clip: DataFrame, at: int, mode: str, crossfade: int = 0) -> DataFrame:
    """clip put into base at a place (not beyond a track's end): insert, overwrite or mix. Length grows only by insert, whose two seams overlap by the crossfade as far as all parts are that long. Tracks without a clip stay."""
    if mode not in ("insert", "overwrite", "mix"):
        raise ValueError(f"no splice mode {mode}")
    clip = aligned(clip, base)
    sizes = lengths(base).join(clip.groupBy("track").agg((F.max("i") + 1).alias("m")), "track", "left").withColumn("m", F.coalesce("m", F.lit(0)))
    sizes = sizes.withColumn("p", F.least(F.lit(max(0, at)), "n")).withColumn("c1", F.least(F.lit(crossfade), "p", "m")).withColumn("c2", F.least(F.lit(crossfade), F.col("n") - F.col("p"), F.col("m") - F.col("c1")))
    i, x = F.col("i"), F.col("x")
    if mode != "insert":
        shifted = clip.join(sizes, "track").select(*KEY, (i + F.col("p")).alias("i"), x.alias("y"))
        both = base.join(shifted, [*KEY, "i"], "left")
        return both.withColumn("x", F.coalesce("y", "x") if mode == "overwrite" else x + F.coalesce("y", F.lit(0.0))).select(COLUMNS)
    d, left = base.join(sizes, "track"), i < F.col("p")
    k1, k2 = i - (F.col("p") - F.col("c1")), i - F.col("p")
    weight = F.when(left & (k1 >= 0), 1 - curve(k1, F.col("c1"))).when(~left & (k2 < F.col("c2")), curve(k2, F.col("c2"))).otherwise(1.0)
    sides = d.select(*KEY, F.when(left, i).otherwise(i + F.col("m") - F.col("c1") - F.col("c2")).alias("i"), (x * weight).alias("x"))
    k2 = i - (F.col("m") - F.col("c2"))
    weight = F.when(i < F.col("c1"), curve(i, F.col("c1"))).when(k2 >= 0, 1 - curve(k2, F.col("c2"))).otherwise(1.0)
    inside = clip.join(sizes, "track").select(*KEY, (i + F.col("p") - F.col("c1")).alias("i"), (x * weight).alias("x"))
    return summed([sides, inside]) if crossfade > 0 else sides.unionByName(inside)


def concat(clips: DataFrame, crossfade: int = 0) -> DataFrame:
    """clips: track, part, channel, i, x. Parts in order, each overlapping the one before by the crossfade."""
    sizes = clips.groupBy("track", "part").agg((F.max("i") + 1).alias("n"))
    order = Window.partitionBy("track").orderBy("part")
    cf = F.when(F.lag("n").over(order).isNull(), F.lit(0)).otherwise(F.least(F.lit(crossfade), "n", F.lag("n").over(order)))
    placed = sizes.withColumn("lead_in", cf).withColumn("lead_out", F.coalesce(F.lead("lead_in").over(order), F.lit(0)))
    placed = placed.withColumn("start", F.sum(F.col("n") - F.col("lead_out")).over(order) - (F.col("n") - F.col("lead_out")))
    d = clips.join(placed, ["track", "part"])
    out = F.col("i") - (F.col("n") - F.col("lead_out"))
    weight = F.when(F.col("i") < F.col("lead_in"), curve(F.col("i"), F.col("lead_in"))).otherwise(F.lit(1.0)) * F.when(out >= 0, 1 - curve(out, F.col("lead_out"))).otherwise(F.lit(1.0))
    return summed([d.select("track", "channel", (F.col("start") + F.col("i")).alias("i"), (F.col("x") * weight).alias("x"))])


def normalize(samples: DataFrame, peak_db: float | None = -1.0, rms_db: float | None = None) -> DataFrame:
    """To a peak or, without one, an RMS level, all channels together; below 1e-10 unchanged."""
    level, target = ("peak", peak_db) if peak_db is not None else ("rms", rms_db)
    d = samples.join(totals(samples).select("track", level), "track")
    return d.withColumn("x", F.when(F.col(level) < 1e-10, F.col("x")).otherwise(F.col("x") * (from_db(target) / F.col(level)))).select(COLUMNS)


def loud_range(samples: DataFrame, threshold_db: float) -> DataFrame:
    """track, first and last place where the mono magnitude exceeds the threshold; null if nowhere."""
    loud = F.when(F.abs("x") > from_db(threshold_db), F.col("i"))
    return mono(samples).groupBy("track").agg(F.min(loud).alias("first"), F.max(loud).alias("last"), (F.max("i") + 1).alias("n"))


def trim_silence(samples: DataFrame, threshold_db: float = -40.0, pad_samples: int = 0) -> DataFrame:
    """Without the silence at both ends, but for pad_samples; an all silent track is unchanged."""
    d = samples.join(loud_range(samples, threshold_db), "track")
    a = F.coalesce(F.greatest(F.col("first") - pad_samples, F.lit(0)), F.lit(0))
    return d.filter((F.col("i") >= a) & (F.col("i") <= F.coalesce(F.col("last") + pad_samples, F.col("n")))).withColumn("i", F.col("i") - a).select(COLUMNS)


def delay_compensated(samples: DataFrame, latency: int) -> DataFrame:
    """Shifted left by the latency, zeros at the end, length kept."""
    ends = samples.groupBy(*KEY).agg((F.max("i") + 1).alias("n"))
    zeros = ends.select(*KEY, F.explode(F.sequence(F.greatest(F.col("n") - latency, F.lit(0)), F.col("n") - 1)).alias("i"), F.lit(0.0).alias("x"))
    moved = samples.filter(F.col("i") >= latency).select(*KEY, (F.col("i") - latency).alias("i"), "x")
    return moved.unionByName(zeros) if latency > 0 else samples.select(COLUMNS)


def gate_envelope(samples: DataFrame, threshold_db: float, attack: int, release: int, frame: int, hop: int) -> DataFrame:
    """track, a, b, open, y0: runs of hops that a gate opens or closes, and the envelope's value before each run.

    A hop is closed if the full frame that begins there is quieter than the threshold. Within a run the one-pole envelope
    has a closed form, so only runs are folded in order, never samples.
    """
    m = mono(samples)
    hops = m.groupBy("track", F.floor(F.col("i") / hop).alias("h")).agg(F.sum(F.col("x") * F.col("x")).alias("e"), F.count("*").alias("k"))
    size = lengths(m)
    w = Window.partitionBy("track").orderBy("h")
    framed = hops.join(size, "track").withColumn("power", F.sum("e").over(w.rowsBetween(0, frame // hop - 1)) / frame)
    closed = (F.col("h") * hop + frame <= F.col("n")) & (F.sqrt("power") < from_db(threshold_db))
    flagged = framed.withColumn("open", F.when(closed, 0).otherwise(1))
    flagged = flagged.withColumn("run", F.sum(F.when(F.col("open") != F.lag("open", 1, -1).over(w), 1).otherwise(0)).over(w))
    runs = flagged.groupBy("track", "run").agg((F.min("h") * hop).alias("a"), F.least(F.max("h") * hop + hop, F.first("n")).alias("b"), F.max("open").alias("open"))
    keep_open, keep_closed = 1 - 1 / attack, 1 - 1 / release

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, y = object(), 0.0
        for batch in batches:
            out = []
            for track, start, end, is_open in zip(*(batch.column(c).to_pylist() for c in ("track", "a", "b", "open")), strict=True):
                if track != of:
                    of, y = track, float(is_open)  # the first sample is as its hop
                out.append(y)
                y = 1 - (1 - y) * keep_open ** (end - start) if is_open else y * keep_closed ** (end - start)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("track", "a", "b", "open")), pa.array(out, pa.float64())], names=["track", "a", "b", "open", "y0"])

    runs = runs.select("track", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("open").cast("int").alias("open"))
    schema = StructType([runs.schema["track"], *StructType.fromDDL("a long, b long, open int, y0 double").fields])
    return runs.repartition("track").sortWithinPartitions("track", "a").mapInArrow(fold, schema)  # one pass in order, one number kept


def gate(samples: DataFrame, threshold_db: float = -50.0, attack: int = 480, release: int = 2400, frame: int = 1024, hop: int = 512) -> DataFrame:
    """A noise gate; runs meet their samples hop by hop, by equality."""
    runs = gate_envelope(samples, threshold_db, attack, release, frame, hop)
    hops = runs.withColumn("h", F.explode(F.sequence(F.floor(F.col("a") / hop), F.floor((F.col("b") - 1) / hop))))
    d = samples.withColumn("h", F.floor(F.col("i") / hop)).join(hops, ["track", "h"])
    k = (F.col("i") - F.col("a") + 1).cast("double")
    y = F.when(F.col("open") == 1, 1 - (1 - F.col("y0")) * F.pow(F.lit(1 - 1 / attack), k)).otherwise(F.col("y0") * F.pow(F.lit(1 - 1 / release), k))
    return d.withColumn("x", F.col("x") * y).select(COLUMNS)


#: Edit operations and the parameters they need.
OPERATIONS = {
    "cut_region": ["start_sec", "end_sec"], "trim": ["start_sec", "end_sec"], "trim_silence": [], "splice": ["clip", "position_sec", "mode"], "fade_in": ["duration_sec"], "fade_out": ["duration_sec"], "pad": [],
    "remove_dc": [], "loudness_normalize": [], "normalize": [], "gain": ["db"], "gate": [], "process": ["plugin"], "chain": ["steps"],
}


def validated(ops: DataFrame) -> DataFrame:
    """ops (source, op_no, type, params) with known and missing (required parameters that are absent)."""
    need = F.create_map(*(x for k, v in OPERATIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))))
    return ops.withColumn("known", F.col("type").isin(*OPERATIONS)).withColumn("missing", F.coalesce(F.array_except(need[F.col("type")], F.map_keys("params")), F.array().cast("array<string>")))


def render(samples: DataFrame, ops: list[tuple[str, dict]], rate: int, every: int = 4, clips: dict[str, tuple[DataFrame, int]] | None = None) -> DataFrame:
    """An edit list applied in order, each operation on the time line that the one before left; plans are cut every few steps.

    clips: samples and rate of what splice operations name; a clip of another rate is an error, as is what can't be applied."""
    from undula.operators import loudness

    def spliced(d: DataFrame, p: dict) -> DataFrame:
        clip, own = (clips or {})[p["clip"]]
        if own != rate:
            raise ValueError(f"clip {p['clip']} has {own} samples a second, not {rate}")
        return splice(d, clip, at(p["position_sec"]), p["mode"], ms(p.get("crossfade_ms")))

    at = lambda sec: int(round(float(sec) * rate))
    ms = lambda v: int(round(float(v or 0) / 1000 * rate))
    side = lambda p, end: at(p[f"{end}_sec"]) if p.get(f"{end}_sec") is not None else ms(p.get(f"{end}_ms"))
    known = {
        "cut_region": lambda d, p: cut_region(d, at(p["start_sec"]), at(p["end_sec"]), ms(p.get("crossfade_ms"))),
        "trim": lambda d, p: trim(d, at(p["start_sec"]), at(p["end_sec"])),
        "trim_silence": lambda d, p: trim_silence(d, float(p.get("threshold_db", -40)), int(p.get("pad_samples", 0))),
        "fade_in": lambda d, p: fade_in(d, at(p["duration_sec"]), p.get("curve", "linear")),
        "fade_out": lambda d, p: fade_out(d, at(p["duration_sec"]), p.get("curve", "linear")),
        "pad": lambda d, p: pad(d, side(p, "head"), side(p, "tail")),
        "splice": spliced,
        "remove_dc": lambda d, _: remove_dc(d),
        "loudness_normalize": lambda d, p: loudness.normalized(d, rate, float(p.get("target_lufs", -14.0)), float(p.get("max_true_peak_dbtp", -1.0))),
        "normalize": lambda d, p: normalize(d, p.get("peak_db", None if "target_rms_db" in p else -1.0), p.get("target_rms_db")),
        "gain": lambda d, p: gain(d, float(p["db"])),
        "gate": lambda d, p: gate(d, float(p.get("threshold_db", -50)), max(1, int(float(p.get("attack_sec", 0.01)) * rate)), max(1, int(float(p.get("release_sec", 0.05)) * rate)), int(p.get("frame", 1024)), int(p.get("hop", 512))),
    }
    for number, (kind, params) in enumerate(ops):
        if kind not in known or any(k not in params for k in OPERATIONS[kind]):
            raise ValueError(f"operation {number}: {kind} with {sorted(params)} can't be applied")
        samples = known[kind](samples, params)
        if number % every == every - 1:
            samples = stored(samples, "edited")
    return samples


def delivery_operations(
    remove_offset: bool, head_ms: float, tail_sec: float, fade_in_ms: float, fade_out_sec: float, target_lufs: float | None = None, max_true_peak_dbtp: float = -1.0, fade_curve: str = "linear"
) -> list[tuple[str, dict]]:
    """The edit list that prepares a track for delivery; with a target, its loudness comes last."""
    ops: list[tuple[str, dict]] = [("remove_dc", {})] if remove_offset else []
    ops += [("fade_in", {"duration_sec": fade_in_ms / 1000, "curve": fade_curve})] if fade_in_ms else []
    ops += [("fade_out", {"duration_sec": fade_out_sec, "curve": fade_curve})] if fade_out_sec else []
    ops += [("pad", {"head_ms": head_ms, "tail_sec": tail_sec})] if head_ms or tail_sec else []
    return ops + ([("loudness_normalize", {"target_lufs": target_lufs, "max_true_peak_dbtp": max_true_peak_dbtp})] if target_lufs is not None else [])
