"""Responses of devices from recorded test signals: equalizers by deconvolved sweeps, waveshapers by folded cycles.

A test signal is a few seconds long, so a track's record is one array of a bounded size; tracks are spread over tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.operators.response import waveshape

#: A response is minimum phase if, without a twentieth of the bins at both ends, its phase is within so many degrees of the one that its magnitude implies, on average.
PHASE_DEGREES, TRIM = 15.0, 20
#: A curve is symmetric if f(-x) and -f(x) differ by less than this share of its peak, on average.
SYMMETRY = 0.05


def log_sweep(rate: int, seconds: float, lo: float = 20.0, hi: float = 20_000.0, level_db: float = -12.0) -> np.ndarray:
    """A sine whose frequency grows exponentially."""
    n, span = int(seconds * rate), np.log(hi / lo)
    t = np.arange(n) / rate
    return 10 ** (level_db / 20) * np.sin(2 * np.pi * lo * seconds / span * (np.exp(t * span / seconds) - 1))


def inverse_sweep(rate: int, seconds: float, lo: float = 20.0, hi: float = 20_000.0, level_db: float = -12.0) -> np.ndarray:
    """The filter that turns the sweep into an impulse: the sweep backwards, falling by 6 dB an octave, scaled to a peak of 1."""
    sweep = log_sweep(rate, seconds, lo, hi, level_db)
    back = sweep[::-1] * np.exp(-np.arange(len(sweep)) / rate * np.log(hi / lo) / seconds)
    return back / np.abs(deconvolved(sweep, back)).max()


def deconvolved(x: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """The linear convolution, by FFTs of the full length."""
    n = len(x) + len(inverse) - 1
    size = 1 << (n - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(inverse, size), size)[:n]


def at_peak(ir: np.ndarray, size: int) -> np.ndarray:
    """A Hann-windowed stretch of `size` samples that begins an eighth of it before the impulse response's peak.

    The window is highest at the peak: its rise is an eighth of the size long, its fall the rest."""
    peak, before = int(np.argmax(np.abs(ir))), size // 8
    padded = np.concatenate([np.zeros(max(0, before - peak)), ir[max(0, peak - before) :]])[:size]
    padded = np.pad(padded, (0, size - len(padded)))
    rise, fall = np.hanning(2 * before + 1)[: before + 1], np.hanning(2 * (size - before) - 1)[size - before :]
    return padded * np.concatenate([rise, fall])


def implied_phase(magnitude: np.ndarray) -> np.ndarray:
    """The phase (radians) of the minimum-phase system with this magnitude at the bins of a real FFT: minus the Hilbert transform of its logarithm, by the cepstrum."""
    n = 2 * (len(magnitude) - 1)
    cepstrum = np.fft.irfft(np.log(np.maximum(magnitude, 1e-10)), n)
    cepstrum[1 : n // 2] *= 2
    cepstrum[n // 2 + 1 :] = 0
    return np.fft.rfft(cepstrum, n).imag


def is_minimum_phase(magnitude: np.ndarray, phase: np.ndarray) -> bool:
    trim = max(1, len(magnitude) // TRIM)
    if len(magnitude) < 4:
        return True
    off = np.angle(np.exp(1j * (phase - implied_phase(magnitude))))[trim:-trim]  # a whole turn is no difference
    return bool(np.degrees(np.abs(off)).mean() < PHASE_DEGREES)


def records(samples: DataFrame) -> DataFrame:
    """track, xs: the first channel of each track as one array."""
    listed = samples.filter("channel = 0").groupBy("track").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s"))
    return listed.select("track", F.transform("s", lambda v: v["x"]).alias("xs"))


def equalizer_response(samples: DataFrame, bypass, rate: int, inverse: np.ndarray, size: int = 32_768) -> tuple[DataFrame, DataFrame]:
    """(curve, verdict) of every track relative to the bypass track. samples hold what came back of one sweep in each setting.

    curve: track, bin, freq, db, phase (degrees, unwrapped), delay (ms). verdict: track, minimum_phase. The bypass spectrum,
    one row of a bounded size, goes to all tasks."""

    def spectra(xs: pd.Series) -> pd.DataFrame:
        found = [np.fft.rfft(at_peak(deconvolved(np.asarray(x, float), inverse), size)) for x in xs]
        peaks = [int(np.argmax(np.abs(deconvolved(np.asarray(x, float), inverse)))) for x in xs]
        return pd.DataFrame({"re": [f.real.tolist() for f in found], "im": [f.imag.tolist() for f in found], "peak": peaks})

    def relative(re: pd.Series, im: pd.Series, peak: pd.Series, re0: pd.Series, im0: pd.Series, peak0: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, p, a0, b0, p0 in zip(re, im, peak, re0, im0, peak0, strict=True):
            own, ref = np.asarray(a) + 1j * np.asarray(b), np.asarray(a0) + 1j * np.asarray(b0)
            omega = 2 * np.pi * np.arange(len(own)) / size
            h = own / (np.abs(ref) + 1e-10) * np.exp(-1j * np.angle(ref)) * np.exp(-1j * omega * (p - p0))  # windows begin at each one's own peak
            phase = np.unwrap(np.angle(h))
            out.append((20 * np.log10(np.abs(h) + 1e-10), np.degrees(phase), -np.gradient(phase, omega[1]) / rate * 1000, is_minimum_phase(np.abs(h), phase)))
        return pd.DataFrame({"db": [o[0].tolist() for o in out], "phase": [o[1].tolist() for o in out], "delay": [o[2].tolist() for o in out], "minimum_phase": [o[3] for o in out]})

    d = records(samples).select("track", F.pandas_udf(spectra, "re array<double>, im array<double>, peak long")("xs").alias("s")).select("track", "s.*")
    ref = F.broadcast(d.filter(F.col("track") == bypass).select(F.col("re").alias("re0"), F.col("im").alias("im0"), F.col("peak").alias("peak0"), F.lit(1).alias("one")))
    both = d.withColumn("one", F.lit(1)).join(ref, "one")
    fields = "db array<double>, phase array<double>, delay array<double>, minimum_phase boolean"
    r = both.select("track", F.pandas_udf(relative, fields)("re", "im", "peak", "re0", "im0", "peak0").alias("r")).select("track", "r.*")
    curve = r.select("track", F.posexplode(F.arrays_zip("db", "phase", "delay")).alias("bin", "v"))
    return curve.select("track", "bin", (F.col("bin") * (rate / size)).alias("freq"), "v.db", "v.phase", "v.delay"), r.select("track", "minimum_phase")


def cycles(signals: DataFrame, rate: int, frequency: float, start: int = 0, settle: int = 1, count: int = 3) -> DataFrame:
    """signals (track, level, i, x_in, x_out) folded by the period: track, level, step, x_in, x_out, the mean over `count` whole
    cycles after `settle` ones that begin at `start`. Cycles that end before they are whole are left out."""
    period = int(rate / frequency)
    at = F.col("i") - start - settle * period
    d = signals.withColumn("cycle", F.floor(at / period)).withColumn("step", F.pmod(at, F.lit(period))).filter((F.col("cycle") >= 0) & (F.col("cycle") < count))
    whole = d.groupBy("track", "level", "cycle").agg(F.count("*").alias("n")).filter(F.col("n") == period)
    d = d.join(whole.select("track", "level", "cycle"), ["track", "level", "cycle"])
    return d.groupBy("track", "level", "step").agg(F.avg("x_in").alias("x_in"), F.avg("x_out").alias("x_out"))


def waveshaper(signals: DataFrame, rate: int, frequency: float, start: int = 0, settle: int = 1, count: int = 3, points: int = 256) -> tuple[DataFrame, DataFrame]:
    """(curve, report): curve has track, k, x_in, x_out at even inputs from -1 to 1, all levels pooled; report has track, coverage (of
    the inputs from -1 to 1), asymmetry (mean of |f(-x) + f(x)| over the peak), symmetric, linearity."""
    pooled = cycles(signals, rate, frequency, start, settle, count)
    curve = waveshape(pooled.select("track", "x_in", "x_out"), points)
    span = pooled.groupBy("track").agg(((F.max("x_in") - F.min("x_in")) / 2).alias("coverage"))
    # both halves without the middle point of an odd number
    other = curve.filter(F.col("k") < points // 2).select("track", (points - 1 - F.col("k")).alias("k"), F.col("x_out").alias("y2"))
    off = curve.join(other, ["track", "k"]).groupBy("track").agg(F.avg(F.abs(F.col("x_out") + F.col("y2"))).alias("off"))
    peak = curve.groupBy("track").agg((F.max(F.abs("x_out")) + 1e-10).alias("peak"), F.corr("x_in", "x_out").alias("linearity"))
    d = span.join(peak, "track").join(off, "track", "left").withColumn("asymmetry", F.coalesce(F.col("off") / F.col("peak"), F.lit(0.0)))
    return curve, d.select("track", F.round("coverage", 4).alias("coverage"), "asymmetry", (F.col("asymmetry") < SYMMETRY).alias("symmetric"), "linearity")
