"""Planted filters and shapers are found again."""

import numpy as np
import pytest

from undula.operators import deconvolution as D
from undula.operators import response as P

RATE, SECONDS, SIZE = 16_000, 1.0, 4096


def filtered(x, b, a):
    """A recursive filter of first order, plainly."""
    y = np.zeros(len(x) + 400)
    x = np.concatenate([x, np.zeros(400)])
    for n in range(len(x)):
        y[n] = b[0] * x[n] + (b[1] * x[n - 1] - a[1] * y[n - 1] if n else 0.0)
    return y


def rows(spark, tracks):
    return spark.createDataFrame([(t, 0, i, float(v)) for t, x in tracks.items() for i, v in enumerate(x)], "track string, channel int, i long, x double")


def test_sweep_and_inverse_make_an_impulse():
    ir = D.deconvolved(D.log_sweep(RATE, SECONDS, 20, 7900), D.inverse_sweep(RATE, SECONDS, 20, 7900))
    assert np.argmax(np.abs(ir)) == int(RATE * SECONDS) - 1 and abs(np.abs(ir).max() - 1) < 1e-9
    x, h = np.random.default_rng(1).normal(size=50), np.random.default_rng(2).normal(size=31)
    assert np.allclose(D.deconvolved(x, h), np.convolve(x, h))


def test_implied_phase_of_known_filters():
    w = np.exp(-2j * np.pi * np.arange(513) / 1024)
    low = 1 / (1 - 0.8 * w)
    assert np.allclose(D.implied_phase(np.abs(low)), np.angle(low), atol=1e-6)
    assert D.is_minimum_phase(np.abs(low), np.angle(low))
    allpass = (w - 0.6) / (1 - 0.6 * w)
    assert not D.is_minimum_phase(np.abs(allpass), np.unwrap(np.angle(allpass)))


def test_minimum_phase_and_all_pass_filters_are_told_apart(spark):
    sweep, inverse = D.log_sweep(RATE, SECONDS, 20, 7900), D.inverse_sweep(RATE, SECONDS, 20, 7900)
    shelf, allpass = ([1.4, -0.6], [1.0, -0.2]), ([-0.6, 1.0], [1.0, -0.6])
    made = {"bypass": np.concatenate([sweep, np.zeros(400)]), "shelf": filtered(sweep, *shelf), "allpass": filtered(sweep, *allpass), "late": np.concatenate([np.zeros(7), sweep, np.zeros(393)])}
    curve, verdict = D.equalizer_response(rows(spark, made), "bypass", RATE, inverse, SIZE)
    got = {r["track"]: r["minimum_phase"] for r in verdict.collect()}
    assert got == {"bypass": True, "shelf": True, "allpass": False, "late": False}
    c = curve.toPandas()
    inside = c[(c.freq > 300) & (c.freq < 7000)]
    w = np.exp(-2j * np.pi * inside[inside.track == "shelf"].freq.to_numpy() / RATE)
    h = (1.4 - 0.6 * w) / (1 - 0.2 * w)
    assert np.abs(inside[inside.track == "shelf"].db.to_numpy() - 20 * np.log10(np.abs(h))).max() < 0.1
    assert np.abs(inside[inside.track == "allpass"].db.to_numpy()).max() < 0.1
    assert np.abs(inside[inside.track == "late"].delay.to_numpy() - 7 / RATE * 1000).max() < 0.01
    assert np.abs(inside[inside.track == "bypass"].db.to_numpy()).max() < 1e-6


def test_difference_of_curves(spark):
    d = spark.createDataFrame([("a", 0, 1.0, 10.0), ("a", 1, 2.0, 20.0), ("b", 0, 0.5, 5.0), ("b", 1, 4.0, 20.0)], "track string, bin int, db double, phase double")
    got = P.curve_difference(d.filter("track = 'a'"), d.filter("track = 'b'")).orderBy("bin").collect()
    assert [(r["db"], r["phase"]) for r in got] == [(0.5, 5.0), (-2.0, 0.0)]


@pytest.mark.parametrize(("shape", "symmetric"), [(lambda x: np.clip(x, -0.5, 0.5), True), (lambda x: np.where(x > 0, np.minimum(x, 0.3), x), False)])
def test_a_planted_clipper_is_recovered(spark, shape, symmetric):
    """All levels together give the curve at 256 points; the first cycle, which is disturbed, and a last one that is cut off don't count."""
    rows, t = [], np.arange(0, 5 * 160 - 9)
    for level in (-24.0, -12.0, -6.0, 0.0):
        x = 10 ** (level / 20) * np.sin(2 * np.pi * t / 160)
        y = shape(x) + np.where(t < 160, 0.5, 0.0)
        rows += [("t", level, int(i), float(a), float(b)) for i, a, b in zip(t, x, y, strict=True)]
    signals = spark.createDataFrame(rows, "track string, level double, i long, x_in double, x_out double")
    curve, report = D.waveshaper(signals, 16_000, 100.0)
    c = curve.orderBy("k").toPandas()
    assert len(c) == 256 and np.abs(c.x_out.to_numpy() - shape(np.linspace(-1, 1, 256))).max() < 0.005
    r = report.first()
    assert r["coverage"] == 1.0 and r["symmetric"] == symmetric and 0.5 < r["linearity"] < 1
    few, part = D.waveshaper(signals.filter("level <= -6"), 16_000, 100.0)
    assert abs(part.first()["coverage"] - 10 ** (-6 / 20)) < 1e-3
    assert D.cycles(signals, 16_000, 100.0, settle=3).filter("level = 0").count() == 160  # the cut cycle is left out
    assert D.cycles(signals, 16_000, 100.0, settle=4).count() == 0
