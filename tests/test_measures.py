"""One pass over chunks: the records and what follows from them, against numpy on whole tracks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_signals import signal, sine
from undula.functions import kernels as K
from undula.operators import frames as M
from undula.operators import loudness as L
from undula.operators import measures as A


def test_window_sums_lose_nothing_after_loud_values():
    v = np.random.default_rng(1).random(1000)
    np.testing.assert_allclose(K.window_sums(v, 37), np.convolve(v, np.ones(37), "valid"))
    assert len(K.window_sums(v[:5], 6)) == 0
    v = np.r_[np.full(20_000, 1e6), np.full(2000, 1e-12)]
    np.testing.assert_allclose(K.window_sums(v, 1000)[-1000:], 1e-9)


def plain_ratios(x, window):
    n, out = len(x), []
    w = min(window, n)
    for i in range(n - 1):
        at = max(0, min(i - max((w - 2) // 2, 0), n - w))
        out.append(abs(x[i + 1] - x[i]) / np.sqrt(max((x[at : at + w] ** 2).mean(), 1e-12)))
    return np.array(out)


@pytest.mark.parametrize(("n", "chunk"), [(700, 64), (700, 5000), (20, 7), (2, 5), (128, 64)])
def test_click_ratios_equal_plain_code_at_every_chunk(spark, n, chunk):
    rng = np.random.default_rng(n)
    left, right = rng.standard_normal((2, n))
    want = plain_ratios((left + right) / 2, 32)
    got = M.click_chunks(signal(spark, left, right), 32, 1.5, chunk).collect()
    assert sorted(p for r in got for p in r["places"]) == np.flatnonzero(want > 1.5).tolist()
    np.testing.assert_allclose(max(r["ratio"] for r in got), want.max())


def test_click_in_a_quiet_end_after_a_loud_start(spark):
    x = np.r_[np.random.default_rng(2).standard_normal(30_000), 1e-5 * np.random.default_rng(3).standard_normal(5000)]
    x[33_000] = 1e-3
    found = M.clicks(signal(spark, x), 48_000).first()
    assert 32_999 in found["places"] and not any(30_200 < p < 32_900 or p > 33_100 for p in found["places"])


def test_kept_places_equal_a_greedy_loop(spark):
    rng = np.random.default_rng(5)
    places = {t: sorted(rng.choice(3000, 400, replace=False).tolist()) for t in ("a", "b")}
    d = spark.createDataFrame([(t, i) for t, p in places.items() for i in p], "track string, i long")
    for apart in (1, 5, 40):
        want = []
        for t, p in places.items():
            last = None
            for i in p:
                if last is None or i - last > apart:
                    want.append((t, i))
                    last = i
        assert sorted(map(tuple, M.kept_places(d, apart).collect())) == want


@pytest.mark.parametrize("chunk", [333, 1000, 65_536])
def test_measured_equals_whole_tracks(spark, chunk):
    rate = 1000
    rng = np.random.default_rng(7)
    t = np.arange(4100) / rate
    left = np.where(t < 0.5, 0, np.sin(2 * np.pi * 30 * t) * (0.2 + 0.1 * np.sin(t))) + 0.01
    right = 0.7 * left * np.where(t > 2, -1, 1) + 0.01 * rng.standard_normal(len(t))
    left[1234] = 0.95
    s = signal(spark, left, right)
    asked = A.Asked(rate, clip=0.9, window=256, sensitivity=2.0, short=3)
    got = A.measured(s, asked, chunk=chunk).first()
    e = L.energies(s, rate)
    assert got["lufs"] == pytest.approx(L.integrated(e).first()["lufs"], abs=0.011)
    assert got["lra"] == pytest.approx(L.loudness_range(L.short_term(e, 3)).first()["lra"], abs=0.011)
    assert got["true_peak"] == pytest.approx(L.true_peak(s).first()["true_peak_db"], abs=0.011)
    assert got["clipped"] == 1 and got["dc"] == pytest.approx(max(abs(left.mean()), abs(right.mean())), abs=1e-6)
    assert got["imbalance_db"] == pytest.approx(20 * np.log10(np.sqrt((left**2).mean() / (right**2).mean())), abs=0.006)
    windows = [np.corrcoef(left[k : k + 256], right[k : k + 256])[0, 1] for k in range(0, len(t) - 255, 256) if min(left[k : k + 256].std(), right[k : k + 256].std()) >= 1e-8]
    assert got["phase_negative_pct"] == pytest.approx(100 * np.mean(np.array(windows) < 0), abs=0.006)
    mono = np.abs(left + right) / 2 > 0.001
    assert got["head_ms"] == np.flatnonzero(mono)[0] and got["tail_sec"] == pytest.approx((len(t) - 1 - np.flatnonzero(mono)[-1]) / rate)
    assert got["n_clicks"] == M.clicks(s, rate, 2.0).first()["n_clicks"] > 0


def test_odd_tracks(spark):
    """No rows, one sample, silence, mono, and channels of different length: each has its row, and no measure fails."""
    d = signal(spark, [0.5], track="one").unionByName(signal(spark, np.zeros(300), np.zeros(300), track="silent")).unionByName(signal(spark, sine(20, 1, rate=1000), sine(20, 0.5, rate=1000), track="uneven"))
    got = {r["track"]: r for r in A.measured(d, A.Asked(1000, window=100, short=3), chunk=128).collect()}
    assert set(got) == {"one", "silent", "uneven"}
    assert got["one"]["phase_negative_pct"] is None and got["one"]["lufs"] is None and got["one"]["n_clicks"] == 0
    assert got["silent"]["head_ms"] is None and got["silent"]["imbalance_db"] is None and got["silent"]["phase_negative_pct"] == 0.0
    assert got["uneven"]["lufs"] is not None and got["uneven"]["phase_negative_pct"] == 0.0
    assert A.measured(d.filter(F.lit(False)), A.Asked(1000)).count() == 0
