"""Operators on planted signals, against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from undula.functions import kernels as K
from undula.operators import edits as E
from undula.operators import frames as M
from undula.operators import loudness as L
from undula.operators import regions as R
from undula.operators import screen as N
from undula.operators import spectral as S
from undula.sources import wav as W

RATE = 48_000


def signal(spark, *channels, track="t"):
    rows = [(track, c, i, float(v)) for c, x in enumerate(channels) for i, v in enumerate(x)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["track", "channel", "i", "x"]), "track string, channel int, i long, x double")


def sine(freq, seconds=1.0, level=0.5, rate=RATE):
    return level * np.sin(2 * np.pi * freq * np.arange(int(seconds * rate)) / rate)


def values(df, column="x"):
    return np.array([r[0] for r in df.orderBy("channel", "i").select(column).collect()])


def test_true_peak_of_a_sine_between_samples(spark):
    x = np.sin(2 * np.pi * 12_000 * np.arange(4800) / RATE + np.pi / 4)  # samples at 0.707, peaks at 1
    got = L.true_peak(signal(spark, x), chunk=1000).first()["true_peak_db"]
    assert abs(got) < 0.2


def test_integrated_loudness_of_a_sine_and_halo(spark):
    x = sine(1000, 2.0, 0.5)
    s = signal(spark, x)
    assert -10.5 < L.integrated(L.energies(s, RATE, hops=3)).first()["lufs"] < -7.5
    a = [r["e"] for r in L.energies(s, RATE, hops=3).orderBy("hop").collect()]
    b = [r["e"] for r in L.energies(s, RATE, hops=100).orderBy("hop").collect()]
    np.testing.assert_allclose(a, b, rtol=1e-9)


def test_k_filter_equals_the_recursion():
    x = np.random.default_rng(0).standard_normal(3000)

    def biquad(x, b, a):
        y = np.zeros(len(x))
        for n in range(len(x)):
            y[n] = sum(b[k] * x[n - k] for k in range(3) if n >= k) - sum(a[k] * y[n - k] for k in (1, 2) if n >= k)
        return y

    np.testing.assert_allclose(K.k_filtered(x, 0), biquad(biquad(x, K.K_B1, K.K_A1), K.K_B2, K.K_A2), atol=1e-8)


def test_loudness_normalized_to_target_and_ceiling(spark):
    s = signal(spark, sine(1000, 1.0, 0.1))
    out = L.normalized(s, RATE, -20.0)
    assert abs(L.integrated(L.energies(out, RATE)).first()["lufs"] + 20) < 0.1
    high = L.normalized(s, RATE, 0.0, -1.0)
    assert abs(L.true_peak(high).first()["true_peak_db"] + 1) < 0.05


def test_leveled_utterances_keep_length(spark):
    x = np.r_[sine(500, 0.6, 0.05), np.full(9600, 1e-3), sine(500, 0.6, 0.4)]
    seg = spark.createDataFrame([("t", 0, 28_800), ("t", 38_400, 67_200)], "track string, a long, b long")
    out = L.level_utterances(signal(spark, x), RATE, seg)
    y = values(out)
    assert len(y) == len(x)
    assert abs(20 * np.log10(np.std(y[5000:28_000]) / np.std(y[45_000:67_000]))) < 1.0


def test_spectrum_finds_the_tone_and_seams_are_invisible(spark):
    s = signal(spark, sine(440, 0.5, rate=8000))
    got = S.frame_spectra(s, 8000, 256, 64).orderBy("frame_no").collect()
    mag = K.spectra(sine(440, 0.5, rate=8000), 256, 64)
    c, e = K.centroid_entropy(mag, 8000, 256)
    np.testing.assert_allclose([r["centroid"] for r in got], c, rtol=1e-9)
    np.testing.assert_allclose([r["entropy"] for r in got], e, rtol=1e-9)


def test_frame_metrics_equal_numpy(spark):
    x = np.random.default_rng(1).standard_normal(1000)
    got = M.frame_metrics(signal(spark, x), 64, 16).orderBy("frame_no").collect()
    frames = [x[k : k + 64] for k in range(0, 1000 - 64 + 1, 16)]
    np.testing.assert_allclose([r["rms"] for r in got], [np.sqrt((f * f).mean()) for f in frames])
    np.testing.assert_allclose([r["zcr"] for r in got], [np.abs(np.diff(np.sign(f))).sum() / 128 for f in frames])


def test_resampling_keeps_a_low_tone(spark):
    s = signal(spark, sine(440, 0.2, rate=48_000))
    y = values(W.resampled(s, 48_000, 32_000, chunk=1000))
    want = sine(440, 0.2, rate=32_000)
    assert len(y) == len(want)
    np.testing.assert_allclose(y[100:-100], want[100:-100], atol=2e-3)


def test_wav_round_trip_and_bad_files(spark, tmp_path):
    s = signal(spark, sine(440, 0.01), sine(880, 0.01), track="a")
    W.write_wav(s, str(tmp_path), RATE).collect()
    (tmp_path / "bad.WAV").write_bytes(b"nothing")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert W.audio_files(spark, str(tmp_path)).count() == 2
    chunks = W.read_wav(files, 100)
    assert chunks.filter("error is not null").count() == 1
    np.testing.assert_allclose(values(W.samples_of(chunks)), np.r_[sine(440, 0.01), sine(880, 0.01)], atol=1e-6)
    info = W.wav_info(files).filter("error is null").first()
    assert (info["channels"], info["rate"], info["subtype"], info["bit_depth"], info["frames"]) == (2, RATE, "PCM_24", 24, 480)


def test_planted_defects(spark):
    quiet = np.random.default_rng(2).standard_normal(RATE) * 1e-3
    click = quiet.copy()
    click[24_000] = 0.95
    found = N.click_events(signal(spark, click), RATE).collect()
    assert any(abs(r["a"] - 24_000) < 300 for r in found)
    hum = N.hum_events(signal(spark, quiet + sine(60, 1.0, 0.1)), RATE).collect()
    assert len(hum) >= 1
    noise = np.random.default_rng(3).standard_normal(RATE)
    spec = np.fft.rfft(noise)
    f = np.fft.rfftfreq(RATE, 1 / RATE)
    band = np.fft.irfft(np.where((f > 5000) & (f < 9000), spec, 0), RATE) * 0.3
    x = quiet.copy()
    x[10_000:20_000] += band[10_000:20_000]
    ess = N.sibilance(signal(spark, x), RATE).collect()
    assert any(8000 < r["a"] < 12_000 and r["b"] < 23_000 for r in ess)
    tones = N.rf_tones(signal(spark, quiet + sine(8000, 1.0, 0.2) + sine(12_300, 1.0, 0.2)), RATE).collect()
    assert len(tones) == 1


def test_errors_and_empty_inputs(spark):
    s = signal(spark, sine(100, 0.01))
    with pytest.raises(ValueError):
        E.pad(s, -1, 0)
    with pytest.raises(ValueError):
        E.render(s, [("warp", {})], RATE)
    empty = s.filter("false")
    assert M.frame_metrics(empty).count() == 0
    assert E.normalize(empty).count() == 0
    assert R.complement(spark.createDataFrame([], "track string, a long, b long"), spark.createDataFrame([("t", 5)], "track string, n long")).collect()[0][1:] == (0, 5)


@pytest.mark.parametrize("chunk", [7, 64, 1000])
def test_chunks_don_t_show(spark, chunk):
    x = np.random.default_rng(4).standard_normal(200)
    s = signal(spark, x)
    before = values(E.with_neighbours(s, chunk).fillna(0.0, ["before"]), "before")
    np.testing.assert_allclose(before, np.r_[0.0, x[:-1]])
    sums = values(M.prefix_sums(s, F.col("x"), chunk), "s")
    np.testing.assert_allclose(sums, np.cumsum(x))
