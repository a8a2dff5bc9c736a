"""Responses of devices: samples of x_in and x_out, or of one impulse, for many settings; one chunk of numpy per setting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undula.operators.edits import mono


def arrays(samples: DataFrame, n: int, skip: int = 0) -> DataFrame:
    """track, xs: n samples of each track after `skip`, zeros where it is shorter. n is the size of one transform."""
    d = samples.filter((F.col("i") >= skip) & (F.col("i") < skip + n)).groupBy("track").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s"))
    xs = F.transform("s", lambda v: v["x"])
    return d.select("track", F.concat(xs, F.array_repeat(F.lit(0.0), F.lit(n) - F.size(xs))).alias("xs"))


def frequency_response(samples: DataFrame, rate: int, size: int = 16384, skip: int = 0) -> DataFrame:
    """track, bin, freq, magnitude, magnitude_db, phase (degrees) of the Hann-windowed response."""

    def run(xs: pd.Series) -> pd.Series:
        f = np.fft.rfft(np.stack(xs.map(np.asarray)) * np.hanning(size), axis=1)
        return pd.Series(list(np.stack([np.abs(f), np.angle(f, deg=True)], 2).tolist()))

    d = arrays(mono(samples), size, skip).select("track", F.posexplode(F.pandas_udf(run, "array<array<double>>")("xs")).alias("bin", "v"))
    return d.select("track", "bin", (F.col("bin") * (rate / size)).alias("freq"), F.col("v")[0].alias("magnitude"), (20 * F.log10(F.col("v")[0] + 1e-10)).alias("magnitude_db"), F.col("v")[1].alias("phase"))


def peaks(spectrum: DataFrame, places: list[tuple[int, int, int]]) -> DataFrame:
    """track, order, peak: greatest magnitude in bins [lo, hi) of each place (order, lo, hi), a list as long as the harmonics asked for."""
    p = F.broadcast(spectrum.sparkSession.createDataFrame(places, "order int, lo int, hi int"))
    return spectrum.join(p, (F.col("bin") >= F.col("lo")) & (F.col("bin") < F.col("hi"))).groupBy("track", "order").agg(F.max("magnitude").alias("peak"))


def harmonic_places(freq: float, rate: int, size: int, last: int = 16) -> list[tuple[int, int, int]]:
    """Search ranges in bins: the fundamental a twentieth around, harmonics a fiftieth, 3 bins at least."""
    out = []
    for h in range(1, min(last, int(rate / 2 / freq)) + 1):
        b = round(h * freq * size / rate)
        r = max(3, b // (20 if h == 1 else 50))
        if b < size // 2 + 1:
            out.append((h, max(0, b - r), min(size // 2 + 1, b + r)))
    return out


def distortion(spectrum: DataFrame, freq: float, rate: int, size: int, last: int = 16) -> DataFrame:
    """track, fundamental_db, thd, thd_n (percent)."""
    p = peaks(spectrum, harmonic_places(freq, rate, size, last))
    total = spectrum.groupBy("track").agg(F.sum(F.col("magnitude") * F.col("magnitude")).alias("total"))
    by = p.groupBy("track").agg(F.max(F.when(F.col("order") == 1, F.col("peak"))).alias("f"), F.coalesce(F.sum(F.when(F.col("order") > 1, F.col("peak") * F.col("peak"))), F.lit(0.0)).alias("h"))
    d = by.join(total, "track")
    base = F.col("f") + 1e-10
    return d.select("track", (20 * F.log10(base)).alias("fundamental_db"), (100 * F.sqrt("h") / base).alias("thd"), (100 * F.sqrt(F.greatest(F.lit(0.0), F.col("total") - F.col("f") * F.col("f"))) / base).alias("thd_n"))


def intermodulation(spectrum: DataFrame, low: float, high: float, rate: int, size: int, orders: int = 10) -> DataFrame:
    """track, imd (percent): side bands at high +- n * low over the peak at high."""
    places = [(0, max(0, round(high * size / rate) - 3), round(high * size / rate) + 3)]
    for n in range(1, orders + 1):
        for sign in (-1, 1):
            b = round((high + sign * n * low) * size / rate)
            if 0 < b < size // 2 + 1:
                places.append((sign * n, max(0, b - 2), min(size // 2 + 1, b + 3)))
    p = peaks(spectrum, places)
    d = p.groupBy("track").agg(F.max(F.when(F.col("order") == 0, F.col("peak"))).alias("f"), F.sum(F.when(F.col("order") != 0, F.col("peak") * F.col("peak"))).alias("s"))
    return d.select("track", (100 * F.sqrt("s") / (F.col("f") + 1e-10)).alias("imd"))


def sweep(samples: DataFrame, rate: int, start_hz: float, end_hz: float, size: int = 4096, hop: int = 2048) -> DataFrame:
    """track, frame_no, freq (of the sweep at the frame's middle), level_db, thd (harmonics 2 to 7); frames up to a quarter of the rate."""
    from undula.operators.spectral import frame_chunks, per_frame

    freqs = np.fft.rfftfreq(size, 1 / rate)

    def run(x: np.ndarray) -> list[np.ndarray]:
        from undula.functions.kernels import spectra

        mag = spectra(x, size, hop)
        top = mag[:, 1:].argmax(1) + 1
        rows = np.arange(len(mag))
        harm = sum(np.where(h * top < mag.shape[1], mag[rows, np.minimum(h * top, mag.shape[1] - 1)], 0) ** 2 for h in range(2, 8))
        return [freqs[top], 20 * np.log10(mag[rows, top] + 1e-10), 100 * np.sqrt(harm) / (mag[rows, top] + 1e-10)]

    m = mono(samples)
    n = m.groupBy("track").agg((F.max("i") + 1).alias("n"))
    d = per_frame(frame_chunks(m, size, hop), size, hop, run, ["peak_hz", "level_db", "thd"]).join(n, "track")
    at = (F.col("frame_no") * hop + size / 2) / F.col("n")
    return d.withColumn("freq", start_hz * F.pow(F.lit(end_hz / start_hz), at)).filter(F.col("freq") <= rate / 4).select("track", "frame_no", "freq", "peak_hz", "level_db", "thd")


def level_ramp(samples: DataFrame, first_db: float, step_db: float, step: int) -> DataFrame:
    """track, k, in_db, out_db, change: peak of each step of a level ramp that begins at first_db and changes by step_db, as many steps as a track has."""
    d = mono(samples).groupBy("track", F.floor(F.col("i") / step).alias("k")).agg(F.round(20 * F.log10(F.max(F.abs("x")) + 1e-10), 2).alias("out_db"))
    d = d.withColumn("in_db", F.lit(float(first_db)) + F.col("k") * float(step_db))
    return d.select("track", "k", "in_db", "out_db", F.round(F.col("out_db") - F.col("in_db"), 2).alias("change"))


def envelope(samples: DataFrame, block: int = 256) -> DataFrame:
    """track, k, db: RMS of full blocks; the last block, full or not, is left out."""
    m = mono(samples)
    n = m.groupBy("track").agg((F.max("i") + 1).alias("n"))
    d = m.groupBy("track", F.floor(F.col("i") / block).alias("k")).agg(F.avg(F.col("x") * F.col("x")).alias("e"))
    return d.join(n, "track").filter(F.col("k") * block < F.col("n") - block).select("track", "k", F.round(20 * F.log10(F.sqrt("e") + 1e-10), 2).alias("db"))


def waveshape(pairs: DataFrame, points: int = 256) -> DataFrame:
    """pairs (track, x_in, x_out) to a curve at even inputs from -1 to 1: track, k, x_in, x_out; equal inputs are averaged, between inputs is linear, beyond them the end holds."""
    pooled = pairs.groupBy("track", "x_in").agg(F.avg("x_out").alias("x_out"))
    grid = pooled.select("track").distinct().select("track", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k")).withColumn("x_in", F.lit(-1.0) + 2.0 * F.col("k") / (points - 1)).withColumn("x_out", F.lit(None).cast("double"))
    known = pooled.withColumn("k", F.lit(None).cast("int")).select("track", "k", "x_in", "x_out")
    w = Window.partitionBy("track").orderBy("x_in", F.col("k").asc_nulls_first())
    point = F.when(F.col("k").isNull(), F.struct("x_in", "x_out"))
    d = known.unionByName(grid.select("track", "k", "x_in", "x_out")).withColumn("lo", F.last(point, True).over(w)).withColumn("hi", F.first(point, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    t = (F.col("x_in") - F.col("lo.x_in")) / (F.col("hi.x_in") - F.col("lo.x_in"))
    y = F.when(F.col("lo").isNull(), F.col("hi.x_out")).when(F.col("hi").isNull() | (F.col("hi.x_in") == F.col("lo.x_in")), F.col("lo.x_out")).otherwise(F.col("lo.x_out") + t * (F.col("hi.x_out") - F.col("lo.x_out")))
    return d.filter("k is not null").select("track", "k", "x_in", y.alias("x_out"))


def shape_summary(curve: DataFrame) -> DataFrame:
    """track, linearity (correlation of out with in), asymmetry (mean of out at x plus out at -x)."""
    n = curve.groupBy("track").agg(F.max("k").alias("top"), F.corr("x_in", "x_out").alias("linearity"))
    other = curve.select("track", F.col("k").alias("k2"), F.col("x_out").alias("y2"))
    both = curve.join(n, "track").withColumn("k2", F.col("top") - F.col("k")).join(other, ["track", "k2"])
    return both.groupBy("track", "linearity").agg(F.avg(F.abs(F.col("x_out") + F.col("y2"))).alias("asymmetry"))


def equalizer_response(samples: DataFrame, bypass: int, rate: int, size: int = 16384) -> DataFrame:
    """track, bin, freq, db, phase, delay of every setting over the bypass track. The bypass response, one transform, goes to all tasks."""

    def run(xs: pd.Series, ref: pd.Series) -> pd.Series:
        out = []
        for x, r in zip(xs, ref, strict=True):
            h = np.fft.rfft(np.asarray(x, float)) / (np.fft.rfft(np.asarray(r, float)) + 1e-12)
            phase = np.unwrap(np.angle(h))
            delay = -np.gradient(phase) / (2 * np.pi * rate / size) if len(phase) > 1 else np.zeros(len(phase))
            out.append(np.stack([20 * np.log10(np.abs(h) + 1e-10), np.degrees(phase), delay], 1).tolist())
        return pd.Series(out)

    d = arrays(mono(samples), size)
    ref = F.broadcast(d.filter(F.col("track") == bypass).select(F.col("xs").alias("ref")))
    v = d.crossJoin(ref).select("track", F.posexplode(F.pandas_udf(run, "array<array<double>>")("xs", "ref")).alias("bin", "v"))  # one row on the right
    return v.select("track", "bin", (F.col("bin") * (rate / size)).alias("freq"), *(F.col("v")[i].alias(n) for i, n in enumerate(("db", "phase", "delay"))))


def sweep_summary(curves: DataFrame, lo: float = 20.0, hi: float = 20_000.0) -> DataFrame:
    """track, least_db, most_db, most_hz within a range."""
    d = curves.filter(F.col("freq").between(lo, hi))
    return d.groupBy("track").agg(F.min("db").alias("least_db"), F.max("db").alias("most_db"), F.max_by("freq", F.struct("db", -F.col("freq"))).alias("most_hz"))


def level_dependence(curves: DataFrame, limit: float = 0.5) -> DataFrame:
    """curves (setting, level, bin, db): setting, deviation (largest from the first level), nonlinear."""
    first = curves.groupBy("setting", "bin").agg(F.min_by("db", "level").alias("ref"))
    return curves.join(first, ["setting", "bin"]).groupBy("setting").agg(F.max(F.abs(F.col("db") - F.col("ref"))).alias("deviation")).withColumn("nonlinear", F.col("deviation") > limit)


def curve_difference(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, bin, db, phase: differences of two curves bin by bin, pair by pair if keys name the pairs."""
    on = [*(keys or []), "bin"]
    r = b.select(*on, F.col("db").alias("db2"), F.col("phase").alias("phase2"))
    return a.join(r, on).select(*on, (F.col("db") - F.col("db2")).alias("db"), (F.col("phase") - F.col("phase2")).alias("phase"))


def largest_difference(differences: DataFrame, keys: list[str]) -> DataFrame:
    """keys, db, db_bin, phase, phase_bin: the largest differences by amount and where they are, the first of equals."""
    most = lambda c: F.max_by(F.struct(F.abs(c).alias("v"), F.col("bin").alias("at")), F.struct(F.abs(c), -F.col("bin")))
    d = differences.groupBy(*keys).agg(most("db").alias("d"), most("phase").alias("p"))
    return d.select(*keys, F.col("d.v").alias("db"), F.col("d.at").alias("db_bin"), F.col("p.v").alias("phase"), F.col("p.at").alias("phase_bin"))


def chain_latency(used: DataFrame, chains: DataFrame) -> DataFrame:
    """chains (chain, step, track) with the latency of each step's device (track, used) to chain, steps, total samples."""
    return chains.join(used.select("track", "used"), "track", "left").groupBy("chain").agg(F.count("*").alias("steps"), F.coalesce(F.sum("used"), F.lit(0)).alias("total"))


def latency(impulses: DataFrame, reported: DataFrame, around: int = 100) -> DataFrame:
    """track, measured (place of the peak, the first of equals), confidence (peak over the mean beside it), used."""
    m = mono(impulses).withColumn("v", F.abs("x"))
    top = m.groupBy("track").agg(F.max_by("i", F.struct("v", -F.col("i"))).alias("measured"), F.max("v").alias("peak"))
    far = m.join(top, "track").filter((F.col("i") < F.col("measured") - around) | (F.col("i") >= F.col("measured") + around)).groupBy("track").agg(F.avg("v").alias("floor"))
    d = top.join(far, "track", "left").join(reported, "track", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    sure = F.when(F.col("floor") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("peak") / F.col("floor") - 1) / 19))).when(F.col("peak") > 1e-6, 1.0).otherwise(0.0)
    d = d.withColumn("confidence", sure)
    used = F.when((F.col("confidence") >= 0.5) | (F.coalesce("reported", F.lit(0)) <= 0), F.col("measured")).otherwise(F.col("reported"))
    return d.select("track", "measured", F.round("confidence", 4).alias("confidence"), used.alias("used"))
