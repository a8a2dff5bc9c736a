"""Spectra of frames. Samples become chunks with a halo; chunks are read independently by numpy inside pandas UDFs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.functions import kernels as K
from undula.operators.edits import mono

#: Octave bands, mixing bands and hum candidates in Hz.
OCTAVES = [(20.0, 60.0, "sub"), (60.0, 250.0, "low"), (250.0, 500.0, "low_mid"), (500.0, 2000.0, "mid"), (2000.0, 4000.0, "upper_mid"), (4000.0, 8000.0, "presence"), (8000.0, 16000.0, "air"), (16000.0, 24000.0, "ultra")]
MIX_BANDS = [(20.0, 200.0, "sub"), (200.0, 800.0, "low"), (800.0, 4000.0, "mid"), (4000.0, 20000.0, "high")]
HUM = [50.0, 60.0, 100.0, 120.0, 150.0, 180.0]
#: Hops in a chunk.
HOPS = 64


def chunked(samples: DataFrame, chunk: int, left: int = 0, right: int = 0) -> DataFrame:
    """track, channel, chunk, start, before, xs: the chunk's samples in order with up to `left` before and `right` after it; `before` says how many came before."""
    own = F.floor(F.col("i") / chunk)
    low, high = F.floor((F.col("i") - right) / chunk), F.floor((F.col("i") + left) / chunk)
    ends = samples.groupBy("track", "channel").agg(F.floor(F.max("i") / chunk).alias("last"))
    rows = samples.join(ends, ["track", "channel"]).withColumn("chunk", F.explode(F.sequence(F.greatest(low, F.lit(0)), F.least(high, "last"))))
    listed = rows.groupBy("track", "channel", "chunk").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s"), F.sum(F.when(own < F.col("chunk"), 1).otherwise(0)).alias("before"))
    return listed.select("track", "channel", "chunk", (F.col("chunk") * chunk).alias("start"), "before", F.transform("s", lambda v: v["x"]).alias("xs"))


def frame_chunks(samples: DataFrame, size: int, hop: int, hops: int = HOPS) -> DataFrame:
    """Chunks of `hops` frames' starts, with what their last frames reach beyond."""
    return chunked(samples, hop * hops, 0, size - hop)


def per_frame(chunks: DataFrame, size: int, hop: int, fn, fields: list[str]) -> DataFrame:
    """track, channel, frame_no and the named values of every full frame. fn: samples to one column of values for each field."""

    def run(xs: pd.Series) -> pd.Series:
        out = []
        for x in xs:
            x = np.asarray(x, float)
            out.append(np.stack(fn(x), 1).tolist() if len(x) >= size else [])
        return pd.Series(out)

    values = F.pandas_udf(run, "array<array<double>>")
    d = chunks.select("track", "channel", "start", F.posexplode(values("xs")).alias("k", "v"))
    return d.select("track", "channel", (F.col("start") / hop + F.col("k")).cast("long").alias("frame_no"), *(F.col("v")[i].alias(f) for i, f in enumerate(fields)))


def frame_spectra(samples: DataFrame, rate: int, size: int = 2048, hop: int = 512) -> DataFrame:
    """track, channel, frame_no, centroid, entropy."""
    return per_frame(frame_chunks(mono(samples), size, hop), size, hop, lambda x: K.centroid_entropy(K.spectra(x, size, hop), rate, size), ["centroid", "entropy"])


def spectrogram(samples: DataFrame, size: int = 2048, hop: int = 512, floor: float = 1e-10) -> DataFrame:
    """track, channel, frame_no, db: an array over bins for every frame."""

    def run(xs: pd.Series) -> pd.Series:
        return pd.Series([(20 * np.log10(np.maximum(K.spectra(np.asarray(x, float), size, hop), floor))).tolist() for x in xs])

    d = frame_chunks(mono(samples), size, hop).select("track", "channel", "start", F.posexplode(F.pandas_udf(run, "array<array<double>>")("xs")).alias("k", "db"))
    return d.select("track", "channel", (F.col("start") / hop + F.col("k")).cast("long").alias("frame_no"), "db")


def long_term_spectrum(samples: DataFrame, rate: int, size: int = 16384, hop: int | None = None, min_rms: float = 0.01) -> DataFrame:
    """track, bin, freq, power, frames: mean power over frames that are loud enough. Chunks yield sums, which are added by bin."""
    hop = hop or size // 2

    def run(xs: pd.Series) -> pd.DataFrame:
        power, n = [], []
        for x in xs:
            x = np.asarray(x, float)
            loud = np.sqrt((K.framed(x, size, hop) ** 2).mean(1)) >= min_rms if len(x) >= size else np.zeros(0, bool)
            mag = K.spectra(x, size, hop)[loud] if len(x) >= size else np.zeros((0, size // 2 + 1))
            power.append((mag**2).sum(0).tolist())
            n.append(int(loud.sum()))
        return pd.DataFrame({"power": power, "n": n})

    sums = frame_chunks(mono(samples), size, hop).select("track", F.pandas_udf(run, "power array<double>, n long")("xs").alias("s"))
    return mean_power(sums.select("track", "s.n", "s.power"), rate, size)


def mean_power(sums: DataFrame, rate: int, size: int, bins: list[int] | None = None) -> DataFrame:
    """track, bin, freq, power, frames from sums of power over n frames; bins are those that the sums hold, if not all."""
    d = sums.select("track", "n", F.posexplode("power").alias("bin", "p"))
    d = d.withColumn("bin", F.get(F.lit(bins), F.col("bin"))) if bins is not None else d
    d = d.groupBy("track", "bin").agg(F.sum("p").alias("p"), F.sum("n").alias("frames"))
    return d.select("track", "bin", (F.col("bin") * (rate / size)).alias("freq"), F.when(F.col("frames") > 0, F.col("p") / F.col("frames")).otherwise(0.0).alias("power"), "frames")


def hum_bins(rate: int, size: int, candidates: list[float]) -> list[int]:
    """The bins of a spectrum that hum() reads for these candidates: those around each, and the last, which is the spectrum's top."""
    near = {round(c * size / rate) + k for c in candidates for k in range(-22, 23)}
    return sorted({b for b in near if 0 <= b <= size // 2} | {size // 2})


def bands(spark, rows: list[tuple[float, float, str]]) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, "lo double, hi double, band string"))  # a handful of rows


def band_energy(spectrum: DataFrame, of: list[tuple[float, float, str]] = OCTAVES) -> DataFrame:
    """track, band, percent, db (of the total, floor -300)."""
    b = bands(spectrum.sparkSession, of)
    total = spectrum.groupBy("track").agg(F.sum("power").alias("total"))
    found = spectrum.join(b, (F.col("freq") >= F.col("lo")) & (F.col("freq") < F.col("hi"))).groupBy("track", "band").agg(F.sum("power").alias("e"))
    d = total.crossJoin(b).join(found, ["track", "band"], "left").withColumn("share", F.when(F.col("total") > 0, F.coalesce("e", F.lit(0.0)) / F.col("total")).otherwise(0.0))
    return d.select("track", "band", (100 * F.col("share")).alias("percent"), (10 * F.log10(F.col("share") + 1e-30)).alias("db"))


def hum(spectrum: DataFrame, candidates: list[float] = HUM, threshold_db: float = 10.0) -> DataFrame:
    """track, candidate, snr_db, is_hum: the nearest bin (the lower one of two) over the median of bins at its sides."""
    c = F.broadcast(spectrum.sparkSession.createDataFrame([(x,) for x in candidates], "candidate double"))
    top = spectrum.groupBy("track").agg(F.max("freq").alias("top"))
    nearest = spectrum.join(c).join(top, "track").filter("candidate <= top").groupBy("track", "candidate").agg(F.min_by(F.struct("bin", "power"), F.struct(F.abs(F.col("freq") - F.col("candidate")), "bin")).alias("b"))
    near = nearest.select("track", "candidate", F.col("b.bin").alias("at"), F.col("b.power").alias("e"))
    offset = F.col("bin") - F.col("at")
    floor = near.join(spectrum.select("track", "bin", "power"), "track").filter(((offset >= -20) & (offset < -3)) | ((offset >= 3) & (offset < 20))).groupBy("track", "candidate", "at", "e").agg(F.median("power").alias("floor"))
    snr = F.when((F.col("e") > 0) & (F.col("floor") > 0), 10 * F.log10(F.col("e") / F.col("floor")))
    return floor.select("track", "candidate", snr.alias("snr_db"), F.coalesce(snr > threshold_db, F.lit(False)).alias("is_hum"))


def slope(spectrum: DataFrame, mid: tuple[float, float] = (1000.0, 3000.0), high: tuple[float, float] = (10000.0, 16000.0)) -> DataFrame:
    """track, mid_db, high_db, slope_db; null where a band is empty or silent."""
    level = lambda r: F.avg(F.when(F.col("freq").between(*r), F.col("power")))
    d = spectrum.groupBy("track").agg(level(mid).alias("m"), level(high).alias("h"))
    db = lambda c: F.when((F.col("m") > 0) & (F.col("h") > 0), 10 * F.log10(F.col(c) + 1e-30))
    return d.select("track", db("m").alias("mid_db"), db("h").alias("high_db"), (db("h") - db("m")).alias("slope_db"))


def diagnostics(spectrum: DataFrame, n: int = 10, apart: float = 30.0, candidates: list[float] = HUM, from_hz: float = 20.0) -> DataFrame:
    """One record of each track of a long-term spectrum: frames, bands (name, percent, db), dominant (the n strongest bins from
    from_hz, `apart` Hz from each other: at, power), hum (candidate, snr_db, is_hum), slope (mid_db, high_db, slope_db)."""
    from undula.operators.regions import spaced_top

    frames = spectrum.groupBy("track").agg(F.max("frames").alias("frames"))
    of_band = band_energy(spectrum).groupBy("track").agg(F.sort_array(F.collect_list(F.struct("band", "percent", "db"))).alias("bands"))
    peaks = spaced_top(spectrum.filter(F.col("freq") >= from_hz).select("track", F.col("freq").alias("at"), F.col("power").alias("v")), n, apart)
    dominant = peaks.groupBy("track").agg(F.sort_array(F.collect_list(F.struct("place", "at", F.col("v").alias("power")))).alias("dominant"))
    found = hum(spectrum, candidates).groupBy("track").agg(F.sort_array(F.collect_list(F.struct("candidate", "snr_db", "is_hum"))).alias("hum"))
    leaning = slope(spectrum).select("track", F.struct("mid_db", "high_db", "slope_db").alias("slope"))
    out = frames
    for part in (of_band, dominant, found, leaning):
        out = out.join(part, "track", "left")
    return out


def mix_band_levels(samples: DataFrame, rate: int, size: int = 4096, hop: int = 2048, of: list[tuple[float, float, str]] = MIX_BANDS) -> DataFrame:
    """track, band, level: K-weighted RMS in dB, -120 where a band is empty, silent or the track too short."""
    b = bands(samples.sparkSession, of)
    limits = [(lo, hi) for lo, hi, _ in of]
    d = per_frame(frame_chunks(mono(samples), size, hop), size, hop, lambda x: list(K.band_powers(x, rate, size, hop, limits).T), [name for _, _, name in of])
    means = d.unpivot(["track"], [name for _, _, name in of], "band", "p").groupBy("track", "band").agg(F.avg("p").alias("p"), F.max("p").alias("most"))
    every = samples.select("track").distinct().crossJoin(b.select("band"))
    sound = F.coalesce(F.col("most") >= 1e-20, F.lit(False))
    return every.join(means, ["track", "band"], "left").select("track", "band", F.when(sound, 20 * F.log10(F.greatest(F.sqrt("p"), F.lit(1e-10)))).otherwise(-120.0).alias("level"))
