"""Greedy choices without whole tracks, resampling by a long filter, functions on chunks with borders exchanged."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from undula.functions import kernels as K
from undula.operators import chunks as H
from undula.operators import regions as R


def greedy(pairs, n, apart):
    chosen = []
    for v, at in sorted(pairs, reverse=True):
        if len(chosen) < n and all(abs(at - a) >= apart for _, a in chosen):
            chosen.append((v, at))
    return chosen


@pytest.mark.parametrize(("n", "apart", "levels"), [(1, 5.0, 9), (4, 7.5, 3), (8, 0.3, 1000), (50, 40.0, 1)])
def test_spaced_top_equals_the_greedy_loop(spark, n, apart, levels):
    draw = np.random.default_rng(n)
    rows = [(t, float(i) * (0.1 if apart < 1 else 1), float(draw.integers(0, levels))) for t, m in ((1, 900), (2, 3), (3, 300)) for i in range(m)]
    got = {}
    for r in R.spaced_top(spark.createDataFrame(rows, "track long, at double, v double"), n, apart).orderBy("track", "place").collect():
        got.setdefault(r["track"], []).append((r["v"], r["at"]))
    assert got == {t: greedy([(v, at) for u, at, v in rows if u == t], n, apart) for t in (1, 2, 3)}


def test_spaced_top_of_a_million_bins(spark):
    bins = spark.range(1_000_000, numPartitions=4).select(F.lit(1).alias("track"), F.col("id").cast("double").alias("at"), (F.pmod(F.xxhash64("id"), F.lit(100_003)) / 7).alias("v"))
    got = [(r["v"], r["at"]) for r in R.spaced_top(bins, 20, 800.0).orderBy("place").collect()]
    pairs = [(r["v"], r["at"]) for r in bins.filter("v > 14000").collect()]  # the greedy loop ends far above this
    assert got == greedy(pairs, 20, 800.0) and got[-1][0] > 14_100
    assert R.spaced_top(bins.limit(0), 3, 1.0).count() == 0


RATES = [(96_000, 16_000), (48_000, 32_000), (44_100, 48_000), (8_000, 44_100), (16_000, 16_000), (11_025, 8_000)]


@pytest.mark.parametrize(("a", "b"), RATES)
def test_resampling_keeps_what_fits_and_stops_the_rest(a, b):
    g = np.gcd(a, b)
    up, down, n = b // g, a // g, a // 4
    t, bank, low = np.arange(n) / a, K.polyphase_bank(b // g, a // g), min(a, b) / 2
    out = lambda x: K.resampled(x, 0, 0, n, n, bank, up, down)[1]
    y, s = out(np.sin(2 * np.pi * 0.8 * low * t)), slice(b // 16, b // 6)
    want = np.sin(2 * np.pi * 0.8 * low * np.arange(len(y)) / b)
    assert len(y) == -(-n * up // down) and np.abs(y - want)[s].max() < 2e-4
    for share in (1.1, 1.3, 1.9):
        if share * low < a / 2:
            assert 20 * np.log10(np.abs(out(np.sin(2 * np.pi * share * low * t)))[s].max()) < -80


@pytest.mark.parametrize("size", [50, 64, 4096])
def test_resampled_chunks_show_no_seams(spark, size):
    draw = np.random.default_rng(6)
    x = {(1, 0): draw.normal(size=1000), (1, 1): draw.normal(size=1000), (2, 0): draw.normal(size=7)}
    long = spark.createDataFrame([(t, c, i, float(v)) for (t, c), xs in x.items() for i, v in enumerate(xs)], "track long, channel int, i long, x double")
    for a, b in ((48_000, 32_000), (44_100, 48_000), (96_000, 16_000)):
        got = {}
        for r in H.to_samples(H.resampled(H.from_samples(long, size), a, b, size), size).collect():
            got.setdefault((r["track"], r["channel"]), {})[r["i"]] = r["x"]
        g = np.gcd(a, b)
        for key, xs in x.items():
            want = K.resampled(xs, 0, 0, len(xs), len(xs), K.polyphase_bank(b // g, a // g), b // g, a // g)[1]
            assert sorted(got[key]) == list(range(len(want))) and np.allclose([got[key][i] for i in range(len(want))], want, atol=1e-9)


def test_three_passes_are_the_same_at_any_size(spark):
    def smooth(x, rate):
        """A filter of five samples, what is missing beyond the ends counts as silence."""
        p = np.concatenate([np.zeros(3), np.nan_to_num(x), np.zeros(1)])
        return 0.4 * p[3:-1] + 0.3 * p[2:-2] + 0.2 * p[0:-4] + 0.1 * p[4:]

    x = np.random.default_rng(8).normal(size=333)
    long = spark.createDataFrame([(t, 0, i, float(v)) for t in (1, 2) for i, v in enumerate(x[: 333 // t])], "track long, channel int, i long, x double")
    want = {1: x, 2: x[:166]}
    for _ in range(3):
        want = {t: smooth(v, 0) for t, v in want.items()}
    for size in (7, 64, 1000):
        out = {}
        for r in H.to_samples(H.applied(H.from_samples(long, size), smooth, 8000, 3, 3, 1, size), size).collect():
            out.setdefault(r["track"], {})[r["i"]] = r["x"]
        for t, v in want.items():
            assert np.allclose([out[t][i] for i in range(len(v))], v, atol=1e-12) and len(out[t]) == len(v)
