"""Runs, events and segments along a track: gaps and islands, merging, complements, greedy choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undula.functions.columns import from_db


def runs(frames: DataFrame, flag: Column, order: str = "frame_no", extra: dict[str, Column] | None = None) -> DataFrame:
    """track, run, flag, and the aggregates asked for of each stretch of equal flags."""
    w = Window.partitionBy("track").orderBy(order)
    d = frames.withColumn("flag", flag).withColumn("change", F.when(F.col("flag") == F.lag("flag").over(w), 0).otherwise(1))
    return d.withColumn("run", F.sum("change").over(w)).groupBy("track", "run").agg(F.first("flag").alias("flag"), *(v.alias(k) for k, v in (extra or {}).items()))


def silence(frames: DataFrame, ends: DataFrame, threshold_db: float, min_samples: int) -> DataFrame:
    """track, a, b of quiet stretches: from the first quiet frame to the start of the first loud one, or the track's end."""
    islands = runs(frames, F.col("rms") < from_db(threshold_db), "frame_no", {"a": F.min("start")})
    d = islands.withColumn("next", F.lead("a").over(Window.partitionBy("track").orderBy("a"))).filter("flag").join(ends.select("track", "n"), "track")
    return d.select("track", "a", F.coalesce("next", "n").alias("b")).filter(F.col("b") - F.col("a") >= min_samples)


def merged(events: DataFrame, max_gap: float, keys: list[str] | None = None, score: str | None = None, rate: int | None = None, first: list[str] | None = None) -> DataFrame:
    """Events (a, b) of a key joined when the gap to what came before is at most max_gap (seconds, if a rate is given); the
    greatest score is kept, and of the columns in `first` the first event's."""
    keys = keys or ["track"]
    w = Window.partitionBy(*keys).orderBy("a", "b")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.col("a") / rate - reach / rate if rate else F.col("a") - reach
    d = events.withColumn("new", F.when(gap <= max_gap, 0).otherwise(1)).withColumn("group", F.sum("new").over(w))
    kept = [F.min_by(c, F.struct("a", "b")).alias(c) for c in first or []]
    return d.groupBy(*keys, "group").agg(F.min("a").alias("a"), F.max("b").alias("b"), *([F.max(score).alias(score)] if score else []), *kept).drop("group")


def mask_events(frames: DataFrame, flag: Column, size: int, min_samples: int, max_gap: int, score: Column) -> DataFrame:
    """track, a, b, score: runs of active frames that are long enough, then merged over short gaps."""
    found = runs(frames, flag, "frame_no", {"a": F.min("start"), "b": F.max("start") + size, "score": F.max(score)}).filter("flag")
    return merged(found.filter(F.col("b") - F.col("a") >= min_samples).select("track", "a", "b", "score"), max_gap, score="score")


def complement(segments: DataFrame, ends: DataFrame) -> DataFrame:
    """track, a, b: what segments leave free between 0 and the track's length n."""
    w = Window.partitionBy("track").orderBy("a", "b")
    cursor = F.coalesce(F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gaps = segments.select("track", cursor.alias("a"), F.col("a").alias("b"))
    last = ends.join(segments.groupBy("track").agg(F.max("b").alias("end")), "track", "left").select("track", F.coalesce("end", F.lit(0)).alias("a"), F.col("n").alias("b"))
    return gaps.unionByName(last).filter("a < b")


def timeline(speech: DataFrame, noise: DataFrame) -> DataFrame:
    """Both kinds in one table: track, place in order of time, a, b, kind."""
    both = speech.select("track", "a", "b", F.lit("speech").alias("kind")).unionByName(noise.select("track", "a", "b", F.lit("noise").alias("kind")))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("track").orderBy("a", "b")))


def segment_summary(segments: DataFrame) -> DataFrame:
    """track, counts and lengths of speech and noise, share of speech."""
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("b") - F.col("a")).otherwise(0))
    n = lambda kind: F.count_if(F.col("kind") == kind)
    d = segments.groupBy("track").agg(n("speech").alias("n_speech"), n("noise").alias("n_noise"), of("speech").alias("speech"), of("noise").alias("noise"))
    total = F.col("speech") + F.col("noise")
    return d.withColumn("ratio", F.when(total > 0, F.col("speech") / total).otherwise(0.0))


def first_of(events: DataFrame, n: int, by: list[str] | None = None) -> DataFrame:
    """The first n events of each track; the cut comes before anything is collected."""
    k = F.row_number().over(Window.partitionBy("track").orderBy(*(by or ["a"])))
    return events.withColumn("k", k).filter(F.col("k") <= n)


def spaced_top(values: DataFrame, n: int, apart: float) -> DataFrame:
    """track, place, at, v: greedy, best first, none within `apart` of one chosen before; equal values by greater place first.

    No track becomes one array. In a cell as wide as `apart` at most one value is chosen, and a chosen one rules out others in
    its own cell and two on each side at most (their neighbours, and one more for rounding). So while fewer than n are
    chosen, one of the best 5 n - 4 cells is untouched, and every choice is at least as good as the best value of the last of
    these. Cells keep their best, map tasks first; only values that good are listed and chosen from."""
    d = values.select("track", F.col("at").cast("double").alias("at"), F.col("v").cast("double").alias("v")).filter("v is not null and at is not null")
    d = d.withColumn("cell", F.floor(F.col("at") / float(apart))).withColumn("s", F.struct("v", "at"))
    cells, few = d.groupBy("track", "cell").agg(F.max("s").alias("best")), 5 * n - 4
    ranked = cells.withColumn("k", F.row_number().over(Window.partitionBy("track").orderBy(F.desc("best")))).filter(F.col("k") <= few)
    least = ranked.groupBy("track").agg(F.min(F.when(F.col("k") == few, F.col("best"))).alias("least"))
    good = d.join(least, "track").filter(F.col("least").isNull() | (F.col("s") >= F.col("least")))
    listed = good.groupBy("track").agg(F.sort_array(F.collect_list("s"), asc=False).alias("c"))
    empty = F.array().cast("array<struct<v:double,at:double>>")
    pick = F.aggregate("c", empty, lambda acc, c: F.when((F.size(acc) >= n) | F.exists(acc, lambda s: F.abs(s["at"] - c["at"]) < apart), acc).otherwise(F.concat(acc, F.array(F.struct(c["v"].alias("v"), c["at"].alias("at"))))))
    return listed.select("track", F.posexplode(pick).alias("place", "s")).select("track", "place", "s.at", "s.v")


def speech_segments(frames: DataFrame, flag: Column, hop: int, min_speech: int, min_silence: int, pad: int) -> DataFrame:
    """track, a, b: active stretches, joined over short silences, long enough, padded; neighbours meet at the middle of their gap."""
    found = runs(frames, flag, "frame_no", {"a": F.min("frame_no") * hop, "b": (F.max("frame_no") + 1) * hop}).filter("flag").select("track", "a", "b")
    kept = merged(found, min_silence - 1).filter(F.col("b") - F.col("a") >= min_speech)
    ends = frames.groupBy("track").agg(((F.max("frame_no") + 1) * hop).alias("n"))
    w = Window.partitionBy("track").orderBy("a")
    before, after = F.lag("b").over(w), F.lead("a").over(w)
    a = F.greatest(F.col("a") - pad, F.coalesce(F.floor((before + F.col("a")) / 2), F.lit(0)))
    b = F.least(F.col("b") + pad, F.coalesce(F.floor((F.col("b") + after) / 2), F.col("n")))
    return kept.join(ends, "track").select("track", F.greatest(a, F.lit(0)).alias("a"), F.least(b, F.col("n")).alias("b"))
