"""Measurements of signals by frame, window and track.

Frames are sums over blocks of one hop, so samples are read once and only blocks, a hop's share of the rows, are windowed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undula.functions import kernels as K
from undula.functions.columns import from_db
from undula.operators.edits import CHUNK, lengths, mono, totals, with_neighbours
from undula.sources.shared import stored


def statistics(samples: DataFrame, rate: int) -> DataFrame:
    """track, frames, channels, duration, peak, rms over all channels."""
    return totals(samples).select("track", F.col("n").alias("frames"), "channels", (F.col("n") / rate).alias("duration"), "peak", "rms")


def frame_metrics(samples: DataFrame, size: int = 2048, hop: int = 512) -> DataFrame:
    """track, frame_no, start, rms, peak, zcr of every full frame of the mono signal. size is a multiple of hop."""
    step = F.abs(F.signum("x") - F.signum("before"))
    first = F.col("i") % hop == 0
    d = with_neighbours(mono(samples), max(CHUNK // hop, 1) * hop)
    blocks = d.groupBy("track", F.floor(F.col("i") / hop).alias("frame_no")).agg(
        F.sum(F.col("x") * F.col("x")).alias("e"), F.max(F.abs("x")).alias("p"), F.sum(F.when(~first, step).otherwise(0)).alias("inner"), F.sum(F.when(first, F.coalesce(step, F.lit(0))).otherwise(0)).alias("lead"), F.max("i").alias("last")
    )
    return windowed(blocks, size, hop)


def windowed(blocks: DataFrame, size: int, hop: int) -> DataFrame:
    """Frames from blocks (track, frame_no, e, p, inner, lead, last) of one hop: energy, peak, steps inside and into the block, last place."""
    ends = blocks.groupBy("track").agg((F.max("last") + 1).alias("n"))
    m = size // hop
    w = Window.partitionBy("track").orderBy("frame_no").rowsBetween(0, m - 1)
    later = Window.partitionBy("track").orderBy("frame_no").rowsBetween(1, m - 1)
    zcr = (F.sum("inner").over(w) + (F.coalesce(F.sum("lead").over(later), F.lit(0)) if m > 1 else F.lit(0))) / (2 * size)
    out = blocks.select("track", "frame_no", (F.col("frame_no") * hop).alias("start"), F.sqrt(F.sum("e").over(w) / size).alias("rms"), F.max("p").over(w).alias("peak"), zcr.alias("zcr"))
    return out.join(ends, "track").filter(F.col("start") + size <= F.col("n")).drop("n")


def frames_of_blocks(blocks: DataFrame, size: int, hop: int) -> DataFrame:
    """The same from blocks with the signs of their first and final sample instead of `lead`: the step into a block is that from the block before."""
    before = F.lag("final").over(Window.partitionBy("track").orderBy("frame_no"))
    return windowed(blocks.withColumn("lead", F.coalesce(F.abs(F.col("first") - before), F.lit(0.0))), size, hop)


def summary(frames: DataFrame, tracks: DataFrame, names: list[str]) -> DataFrame:
    """track, metric, mean, min, max, std (population) of each metric; zeros for tracks without a frame."""
    long = frames.unpivot(["track"], names, "metric", "v")
    found = long.groupBy("track", "metric").agg(F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.stddev_pop("v").alias("std"))
    every = tracks.select("track").distinct().withColumn("metric", F.explode(F.array(*map(F.lit, names))))
    return every.join(found, ["track", "metric"], "left").select("track", "metric", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean", "min", "max", "std")))


def clipping(samples: DataFrame, limit: float = 0.999, first: int = 10) -> DataFrame:
    """track, clipped (of any channel), by_channel, places: the first few, chosen before anything is collected."""
    hit = samples.filter(F.abs("x") >= limit)
    per = hit.groupBy("track", "channel").agg(F.count("*").alias("n")).groupBy("track").agg(F.sort_array(F.collect_list(F.struct("channel", "n"))).alias("by_channel"))
    union = hit.select("track", "i").distinct()
    counted = union.groupBy("track").agg(F.count("*").alias("clipped"))
    places = union.withColumn("k", F.row_number().over(Window.partitionBy("track").orderBy("i"))).filter(F.col("k") <= first).groupBy("track").agg(F.sort_array(F.collect_list("i")).alias("places"))
    out = samples.select("track").distinct().join(counted, "track", "left").join(per, "track", "left").join(places, "track", "left")
    return out.select("track", F.coalesce("clipped", F.lit(0)).alias("clipped"), "by_channel", "places")


def prefix_sums(d: DataFrame, value: Column, chunk: int = CHUNK) -> DataFrame:
    """d (track, i) with s: the sum of value over i and all before, by chunk sums first, so that no window is longer than a chunk or the list of chunks."""
    c = d.withColumn("chunk", F.floor(F.col("i") / chunk)).withColumn("v", value)
    before = c.groupBy("track", "chunk").agg(F.sum("v").alias("t"))
    order = Window.partitionBy("track").orderBy("chunk")
    before = before.select("track", "chunk", (F.sum("t").over(order) - F.col("t")).alias("offset"))
    inside = Window.partitionBy("track", "chunk").orderBy("i")
    return c.join(before, ["track", "chunk"]).withColumn("s", F.sum("v").over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col("offset")).drop("chunk", "v", "offset")


def dealt(samples: DataFrame, chunk: int, left: int, right: int) -> DataFrame:
    """samples with column chunk: each chunk has its own samples, up to `left` before them and `right` after them. Behind a track's end comes a chunk of halo alone.

    They are dealt by (track, chunk), over as many tasks as the session names: kernels cost more than their rows' bytes tell."""
    tasks = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbers = F.sequence(F.greatest(F.floor((F.col("i") - right) / chunk), F.lit(0)), F.floor((F.col("i") + left) / chunk))
    return samples.select("track", "channel", "i", "x", F.explode(numbers).alias("chunk")).repartition(tasks, "track", "chunk")


def click_chunks(samples: DataFrame, window: int, sensitivity: float, chunk: int = CHUNK) -> DataFrame:
    """track, ratio (the largest step of a chunk over the RMS around it), places (of the steps above `sensitivity`). All channels of a chunk meet in one task; no other shuffle is needed."""
    kind = samples.schema["track"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        start = int(pdf["chunk"].iloc[0]) * chunk
        first, signal = K.mono(pdf["i"].to_numpy(), pdf["x"].to_numpy(float))
        places, ratios = K.click_ratios(signal, first, start, start + chunk, window)
        found = [{"track": pdf["track"].iloc[0], "ratio": float(ratios.max()), "places": places[ratios > sensitivity].tolist()}] if len(ratios) else []
        return pd.DataFrame(found, columns=["track", "ratio", "places"], dtype=object)

    return dealt(samples, chunk, window, window + 1).groupBy("track", "chunk").applyInPandas(run, f"track {kind}, ratio double, places array<long>")


def thinned(places: Column, apart: int) -> Column:
    """A sorted array without places that lie within `apart` of the last one kept."""
    return F.aggregate(places, F.array().cast("array<bigint>"), lambda acc, c: F.when((F.size(acc) == 0) | (c - F.coalesce(F.element_at(acc, -1), F.lit(0)) > apart), F.concat(acc, F.array(c))).otherwise(acc))


def kept_places(candidates: DataFrame, apart: int) -> DataFrame:
    """track, i of the candidates (track, i) without those within `apart` of the last one kept.

    A candidate more than `apart` after the one before it is kept whatever came before, so only runs between such gaps are folded."""
    by = Window.partitionBy("track").orderBy("i")
    new = F.when(F.col("i") - F.lag("i").over(by) <= apart, 0).otherwise(1)
    listed = candidates.withColumn("new", new).withColumn("run", F.sum("new").over(by)).groupBy("track", "run").agg(F.sort_array(F.collect_list("i")).alias("c"))
    return listed.select("track", F.explode(thinned(F.col("c"), apart)).alias("i"))


def clicks(samples: DataFrame, rate: int, sensitivity: float = 6.0, window_ms: float = 50.0, apart_ms: float = 5.0) -> DataFrame:
    """track, n_clicks, places (kept candidates), max_ratio: steps to the next sample over the local RMS of a centred window, held at the track's ends."""
    chunks = stored(click_chunks(samples, max(int(window_ms / 1000 * rate), 16), sensitivity), "clicks")  # read twice below
    top = chunks.groupBy("track").agg(F.max("ratio").alias("max_ratio"))
    kept = kept_places(chunks.select("track", F.explode("places").alias("i")), max(int(apart_ms / 1000 * rate), 1)).groupBy("track").agg(F.sort_array(F.collect_list("i")).alias("places"))
    out = samples.select("track").distinct().join(top, "track", "left").join(kept, "track", "left")
    return out.select("track", F.coalesce(F.size("places"), F.lit(0)).alias("n_clicks"), F.coalesce("places", F.array().cast("array<bigint>")).alias("places"), "max_ratio")


def sides(samples: DataFrame) -> DataFrame:
    """track, i, l, r of tracks that have both channels."""
    side = lambda c: F.max(F.when(F.col("channel") == c, F.col("x")))
    return samples.filter("channel < 2").groupBy("track", "i").agg(side(0).alias("l"), side(1).alias("r")).filter("l is not null and r is not null")


def correlation(samples: DataFrame, window: int) -> DataFrame:
    """track, overall correlation, and of full windows with a signal on both sides: least, mean, percent below zero, count."""
    lr = sides(samples)
    overall = lr.groupBy("track").agg(F.corr("l", "r").alias("overall"), (F.max("i") + 1).alias("n"))
    win = lr.groupBy("track", F.floor(F.col("i") / window).alias("w")).agg(F.corr("l", "r").alias("c"), F.stddev_pop("l").alias("sl"), F.stddev_pop("r").alias("sr"))
    full = win.join(overall.select("track", "n"), "track").filter((F.col("w") + 1) * window <= F.col("n")).filter("sl >= 1e-8 and sr >= 1e-8")
    agg = full.groupBy("track").agg(F.min("c").alias("least"), F.avg("c").alias("mean"), (100 * F.avg(F.when(F.col("c") < 0, 1.0).otherwise(0.0))).alias("negative_pct"), F.count("*").alias("windows"))
    out = overall.join(agg, "track", "left").withColumn("overall", F.coalesce(F.nanvl("overall", F.lit(0.0)), F.lit(0.0)))
    return out.select("track", "overall", F.coalesce("least", "overall").alias("least"), "mean", F.coalesce("negative_pct", F.lit(0.0)).alias("negative_pct"), F.coalesce("windows", F.lit(0)).alias("windows"))


def imbalance(samples: DataFrame) -> DataFrame:
    """track, imbalance_db: left over right RMS; null if a side is silent. Stereo tracks only."""
    rms = lambda c: F.sqrt(F.avg(F.when(F.col("channel") == c, F.col("x") * F.col("x"))))
    d = samples.groupBy("track").agg(rms(0).alias("l"), rms(1).alias("r"), F.max("channel").alias("last")).filter("last = 1")
    return d.select("track", F.when((F.col("l") > 0) & (F.col("r") > 0), 20 * F.log10(F.col("l") / F.col("r"))).alias("imbalance_db"))


def head_tail_silence(samples: DataFrame, rate: int, threshold_db: float = -60.0) -> DataFrame:
    """track, head_ms, tail_sec (null if all is silent), all_silence."""
    loud = F.when(F.abs("x") > from_db(threshold_db), F.col("i"))
    d = mono(samples).groupBy("track").agg(F.min(loud).alias("a"), F.max(loud).alias("b"), F.max("i").alias("last"))
    return d.select("track", F.round(F.col("a") / rate * 1000, 1).alias("head_ms"), F.round((F.col("last") - F.col("b")) / rate, 3).alias("tail_sec"), F.col("a").isNull().alias("all_silence"))


def overview(samples: DataFrame, width: int, kind: str = "rms") -> DataFrame:
    """track, col, above, below: the positive and negative halves of each column, over the largest of all."""
    m = mono(samples).join(lengths(mono(samples)), "track").withColumn("col", F.floor(F.col("i") / F.greatest(F.lit(1), F.floor(F.col("n") / width)))).filter(F.col("col") < width)
    up, down = F.when(F.col("x") >= 0, F.col("x")), F.when(F.col("x") < 0, F.col("x"))
    a, b = (F.sqrt(F.avg(up * up)), F.sqrt(F.avg(down * down))) if kind == "rms" else (F.greatest(F.max("x"), F.lit(0.0)), F.greatest(-F.min("x"), F.lit(0.0)))
    cols = m.groupBy("track", "col").agg(F.coalesce(a, F.lit(0.0)).alias("a"), F.coalesce(b, F.lit(0.0)).alias("b"))
    top = cols.groupBy("track").agg(F.greatest(F.max("a"), F.max("b"), F.lit(1e-10)).alias("top"))
    return cols.join(top, "track").select("track", "col", (F.col("a") / F.col("top")).alias("above"), (F.col("b") / F.col("top")).alias("below"))


def resampled(series: DataFrame, width: int) -> DataFrame:
    """series (track, k, v) at `width` evenly spaced places, scaled to 0..1."""
    n = series.groupBy("track").agg((F.max("k") + 1).alias("n"))
    places = n.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).withColumn("k", F.floor(F.col("col") * (F.col("n") - 1) / (width - 1)))
    d = places.join(series, ["track", "k"])
    w = Window.partitionBy("track")
    span = F.max("v").over(w) - F.min("v").over(w)
    return d.select("track", "col", ((F.col("v") - F.min("v").over(w)) / F.when(span > 0, span).otherwise(1.0)).alias("v"))
