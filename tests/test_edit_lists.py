"""Loudness at any rate, splices with crossfade and channel alignment, edit lists, delivery and the level follower, against plain numpy."""

import numpy as np
import pytest

from undula.functions import kernels as K
from undula.operators import edits as E
from undula.operators import loudness as L
from undula.streaming import meters as T


def frame(spark, tracks):
    rows = [(t, c, i, float(v)) for t, channels in tracks.items() for c, x in enumerate(channels) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "track long, channel int, i long, x double")


def arrays(df):
    out = {}
    for r in df.orderBy("track", "channel", "i").collect():
        out.setdefault(r["track"], {}).setdefault(r["channel"], []).append(r["x"])
    return out


def test_weighting_is_the_standard_at_48_khz_and_alike_at_other_rates():
    (b1, a1), (b2, a2) = K.derived_biquads(48_000)
    for mine, fixed in ((b1, K.K_B1), (a1, K.K_A1), (b2, K.K_B2), (a2, K.K_A2)):
        np.testing.assert_allclose(mine, fixed, atol=1e-9)
    for hz in (60, 1000, 6000):
        level = []
        for rate in (44_100, 48_000, 96_000):
            y = K.k_filtered(np.sin(2 * np.pi * hz * np.arange(rate) / rate), 0, rate)[rate // 2 :]
            level.append(10 * np.log10((y * y).mean()))
        assert max(level) - min(level) < 0.1


@pytest.mark.parametrize("rate", [8000, 16_000])
def test_loudness_of_a_sine_and_of_channels(spark, rate):
    x = 0.5 * np.sin(2 * np.pi * 1000 * np.arange(rate * 2) / rate)
    d = frame(spark, {1: [x], 2: [x, x], 3: [x] * 6})
    got = {r["track"]: r["lufs"] for r in L.integrated(L.energies(d, rate)).collect()}
    plain = K.k_filtered(x, 0, rate)
    one = -0.691 + 10 * np.log10((plain[rate // 2 :] ** 2).mean())
    assert abs(got[1] - one) < 0.1 and abs(got[2] - got[1] - 3.01) < 0.05
    assert abs(got[3] - got[1] - 10 * np.log10(3 + 2 * 1.41)) < 0.05  # the sixth channel doesn't count


def spliced(base, clip, at, mode, cf):
    at = min(max(at, 0), len(base))
    if mode != "insert":
        out = base.copy()
        part = clip[: max(0, len(base) - at)]
        out[at : at + len(part)] = part if mode == "overwrite" else out[at : at + len(part)] + part
        return out
    c1 = min(cf, at, len(clip))
    c2 = min(cf, len(base) - at, len(clip) - c1)
    out = np.zeros(len(base) + len(clip) - c1 - c2)
    up = lambda n: np.linspace(0, 1, n) if n else np.zeros(0)
    left, inside, right = base[:at].copy(), clip.copy(), base[at:].copy()
    left[at - c1 :] *= 1 - up(c1)
    inside[:c1] *= up(c1)
    inside[len(inside) - c2 :] *= 1 - up(c2)
    right[:c2] *= up(c2)
    out[:at] += left
    out[at - c1 : at - c1 + len(clip)] += inside
    out[len(out) - len(right) :] += right
    return out


@pytest.mark.parametrize("at,mode,cf", [(20, "insert", 0), (20, "insert", 6), (3, "insert", 8), (58, "insert", 8), (900, "insert", 4), (0, "insert", 1), (55, "overwrite", 0), (55, "mix", 0)])
def test_splices_equal_numpy(spark, at, mode, cf):
    rng = np.random.default_rng(at + cf)
    base, clip, other = rng.standard_normal(60), rng.standard_normal(12), rng.standard_normal(30)
    got = arrays(E.splice(frame(spark, {1: [base], 2: [other]}), frame(spark, {1: [clip]}), at, mode, cf))
    np.testing.assert_allclose(got[1][0], spliced(base, clip, at, mode, cf), atol=1e-12)
    np.testing.assert_allclose(got[2][0], other)


def test_channels_of_clips_are_aligned(spark):
    x, y = np.arange(8.0), np.arange(3.0) + 10
    stereo = arrays(E.splice(frame(spark, {1: [x, -x]}), frame(spark, {1: [y]}), 2, "overwrite"))
    assert stereo[1][0][2:5] == stereo[1][1][2:5] == y.tolist()
    mono = arrays(E.splice(frame(spark, {1: [x]}), frame(spark, {1: [y, y + 2]}), 2, "overwrite"))
    assert mono[1][0][2:5] == (y + 1).tolist()
    with pytest.raises(Exception, match="can't go into"):
        E.splice(frame(spark, {1: [x]}), frame(spark, {1: [y, y, y]}), 2, "overwrite").collect()
    with pytest.raises(ValueError):
        E.splice(frame(spark, {1: [x]}), frame(spark, {1: [y]}), 2, "over")


def test_edit_lists_splice_and_reach_a_loudness(spark):
    rate = 8000
    x = 0.05 * np.sin(2 * np.pi * 500 * np.arange(rate) / rate)
    d = frame(spark, {1: [x]})
    ops = [("splice", {"clip": "more", "position_sec": 0.5, "mode": "insert", "crossfade_ms": 5})] + E.delivery_operations(True, 50, 0.1, 10, 0.05, -20.0)
    out = E.render(d, ops, rate, clips={"more": (d, rate)})
    assert abs(L.integrated(L.energies(out, rate)).first()["lufs"] + 20) < 0.1
    assert out.count() == 2 * rate - 80 + 400 + 800
    with pytest.raises(ValueError):
        E.render(d, ops, rate, clips={"more": (d, 44_100)})


def test_the_follower_by_blocks_equals_a_loop():
    x = np.abs(np.random.default_rng(1).standard_normal(1000))
    y, want = 0.3, []
    for v in x:
        y += 0.2 * (v - y)
        want.append(y)
    np.testing.assert_allclose(T.followed(x, 0.2, 0.3), want, atol=1e-12)
    assert len(T.followed(np.zeros(0), 0.2, 0.3)) == 0
