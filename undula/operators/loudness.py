"""Loudness after BS.1770-4: K-weighted energies of 100 ms, gates, ranges, peaks, leveling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undula.functions import kernels as K
from undula.functions.columns import from_db
from undula.operators.edits import COLUMNS, curve
from undula.operators.spectral import chunked

#: Weights of left, right, centre and the two surround channels; further ones don't count.
CHANNEL_WEIGHTS = (1.0, 1.0, 1.0, 1.41, 1.41)
#: Hops of 100 ms in a gating block, and in a short-term window.
BLOCK, SHORT = 4, 30


def loud(power: Column) -> Column:
    return F.when(power > 0, -0.691 + 10 * F.log10(power))


def energies(samples: DataFrame, rate: int, weighted: bool = True, hops: int = 100) -> DataFrame:
    """track, hop, e: mean square in each full 100 ms, summed over the channels by their weights. K-weighting, by the filters of this rate, reads chunks with a halo."""
    step = rate // 10
    own = samples.filter(F.col("channel") < len(CHANNEL_WEIGHTS))
    by_channel = F.array(*map(F.lit, CHANNEL_WEIGHTS))[F.col("channel")]
    if not weighted:
        d = own.groupBy("track", "channel", F.floor(F.col("i") / step).alias("hop")).agg((F.sum(F.col("x") * F.col("x")) / step).alias("e"), F.count("*").alias("k")).filter(F.col("k") == step)
        return d.groupBy("track", "hop").agg(F.sum(F.col("e") * by_channel).alias("e"))

    def run(xs: pd.Series, before: pd.Series) -> pd.Series:
        out = []
        for x, halo in zip(xs, before, strict=True):
            y = K.k_filtered(np.asarray(x, float), int(halo), rate)
            out.append((y[: len(y) // step * step].reshape(-1, step) ** 2).mean(1).tolist())
        return pd.Series(out)

    chunks = chunked(own, step * hops, left=K.k_tail(rate))
    d = chunks.select("track", "channel", "start", F.posexplode(F.pandas_udf(run, "array<double>")("xs", "before")).alias("k", "e"))
    return d.groupBy("track", (F.col("start") / step + F.col("k")).cast("long").alias("hop")).agg(F.sum(F.col("e") * by_channel).alias("e"))


def windowed(e: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """Mean power of every n hops in a row: keys, hop, p."""
    w = Window.partitionBy(*keys).orderBy("hop").rowsBetween(0, n - 1)
    return e.select(*keys, "hop", (F.sum("e").over(w) / n).alias("p"), F.count("*").over(w).alias("k")).filter(F.col("k") == n).drop("k")


def integrated(e: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, lufs: blocks of 400 ms each 100 ms, gated at -70 LUFS and then 10 LU below the mean of the rest; null if none is left."""
    keys = keys or ["track"]
    blocks = windowed(e, BLOCK, keys).withColumn("l", loud(F.col("p")))
    first = blocks.filter("l > -70").groupBy(*keys).agg((loud(F.avg("p")) - 10).alias("gate"))
    out = blocks.join(first, keys).filter("l > -70 and l > gate").groupBy(*keys).agg(loud(F.avg("p")).alias("lufs"))
    return e.select(*keys).distinct().join(out, keys, "left")


def short_term(e: DataFrame, n: int = SHORT) -> DataFrame:
    """track, hop, lufs of windows of n hops; null for silence."""
    return windowed(e, n, ["track"]).select("track", "hop", loud(F.col("p")).alias("lufs"))


def loudness_range(series: DataFrame) -> DataFrame:
    """track, lra: 95th less 10th percentile (linear) of the short-term values; 0 for less than two."""
    d = series.filter("lufs is not null").groupBy("track").agg(F.percentile("lufs", F.lit(0.95)).alias("hi"), F.percentile("lufs", F.lit(0.10)).alias("lo"), F.count("*").alias("k"))
    return series.select("track").distinct().join(d, "track", "left").select("track", F.when(F.col("k") >= 2, F.col("hi") - F.col("lo")).otherwise(0.0).alias("lra"))


def sample_peak(samples: DataFrame) -> DataFrame:
    """track, peak_db; null for silence."""
    return samples.groupBy("track").agg(F.max(F.abs("x")).alias("p")).select("track", F.when(F.col("p") > 0, 20 * F.log10("p")).alias("peak_db"))


def true_peak(samples: DataFrame, factor: int = 4, chunk: int = 48_000) -> DataFrame:
    """track, true_peak_db: largest of all channels after oversampling; null for silence."""
    run = F.pandas_udf(lambda xs: xs.map(lambda x: K.oversampled_peak(np.asarray(x, float), factor)), "double")
    d = chunked(samples, chunk, left=24, right=24).select("track", run("xs").alias("p")).groupBy("track").agg(F.max("p").alias("p"))
    return d.select("track", F.when(F.col("p") > 0, 20 * F.log10("p")).alias("true_peak_db"))


def report(samples: DataFrame, rate: int, short: int = SHORT, weighted: bool = True) -> DataFrame:
    """One row per track: integrated, largest and mean short-term loudness, range, peaks, duration; rounded to two digits."""
    e = energies(samples, rate, weighted)
    s = short_term(e, short)
    most = s.groupBy("track").agg(F.max("lufs").alias("short_max"), F.avg("lufs").alias("short_mean"))
    out = samples.groupBy("track").agg(((F.max("i") + 1) / rate).alias("duration")).join(sample_peak(samples), "track").join(true_peak(samples), "track")
    for part in (integrated(e), most, loudness_range(s)):
        out = out.join(part, "track", "left")
    return out.select("track", *(F.round(c, 2).alias(c) for c in ("duration", "lufs", "short_max", "short_mean", "lra", "peak_db", "true_peak_db")))


def normalized(samples: DataFrame, rate: int, target: float = -14.0, ceiling: float = -1.0, weighted: bool = True) -> DataFrame:
    """To a loudness, then lower if the true peak would pass the ceiling; true peak scales with gain, so it is measured once."""
    gain = target - F.col("lufs")
    found = integrated(energies(samples, rate, weighted)).join(true_peak(samples), "track").select("track", F.coalesce(F.least(gain, ceiling - F.col("true_peak_db")), F.lit(0.0)).alias("gain_db"))
    return samples.join(found, "track").withColumn("x", F.col("x") * from_db(F.col("gain_db"))).select(COLUMNS)


def segment_gains(e: DataFrame, segments: DataFrame, ends: DataFrame, step: int, target: float, noise_db: float, min_samples: int) -> DataFrame:
    """track, a, b, kind, lufs, gain_db, was_db (the gain before it): speech to the target, gaps lowered; short or silent speech keeps 0 dB."""
    from undula.operators.regions import complement

    hops = segments.withColumn("hop", F.explode(F.sequence(F.ceil(F.col("a") / step), F.greatest(F.ceil(F.col("a") / step), F.floor(F.col("b") / step) - 1))))
    per = integrated(hops.join(e, ["track", "hop"]).select("track", "a", "b", "hop", "e"), ["track", "a", "b"])
    speech = segments.select("track", "a", "b").join(per, ["track", "a", "b"], "left").withColumn("kind", F.lit("speech"))
    level = F.when((F.col("b") - F.col("a") >= min_samples) & F.col("lufs").isNotNull(), target - F.col("lufs")).otherwise(0.0)
    gaps = complement(segments, ends).select("track", "a", "b", F.lit(None).cast("double").alias("lufs"), F.lit("noise").alias("kind"))
    both = speech.withColumn("gain_db", level).unionByName(gaps.withColumn("gain_db", F.lit(float(noise_db))))
    return both.withColumn("was_db", F.coalesce(F.lag("gain_db").over(Window.partitionBy("track").orderBy("a")), F.lit(0.0)))


def apply_gains(samples: DataFrame, gains: DataFrame, ramp: int, cell: int = 4096) -> DataFrame:
    """Gains of [a, b) on samples; segments meet samples by cells of the time line, by equality, and ramp from the gain before."""
    cells = gains.withColumn("cell", F.explode(F.sequence(F.floor(F.col("a") / cell), F.floor((F.col("b") - 1) / cell))))
    d = samples.withColumn("cell", F.floor(F.col("i") / cell)).join(cells, ["track", "cell"]).filter((F.col("i") >= F.col("a")) & (F.col("i") < F.col("b")))
    g, was = from_db(F.col("gain_db")), from_db(F.col("was_db"))
    k, n = F.col("i") - F.col("a"), F.least(F.lit(ramp), F.col("b") - F.col("a"))
    factor = F.when((F.abs(g - was) > 1e-6) & (k < n), was + (g - was) * curve(k, n)).otherwise(g)
    return d.withColumn("x", F.col("x") * factor).select(COLUMNS)


def level_utterances(samples: DataFrame, rate: int, segments: DataFrame, target: float = -20.0, ceiling: float = -1.0, noise_db: float = -12.0, ramp_ms: float = 30.0, min_ms: float = 200.0) -> DataFrame:
    """Each utterance to the target, gaps lower, the whole track under the ceiling, length kept."""
    ends = samples.groupBy("track").agg((F.max("i") + 1).alias("n"))
    gains = segment_gains(energies(samples, rate), segments, ends, rate // 10, target, noise_db, int(min_ms * rate / 1000))
    out = apply_gains(samples, gains, int(ramp_ms * rate / 1000))
    cut = true_peak(out).select("track", F.coalesce(F.least(F.lit(0.0), ceiling - F.col("true_peak_db")), F.lit(0.0)).alias("cut"))
    return out.join(cut, "track").withColumn("x", F.col("x") * from_db(F.col("cut"))).select(COLUMNS)
