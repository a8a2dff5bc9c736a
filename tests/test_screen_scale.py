"""What lets the detectors grow: takes dealt before they are made, frames read where they are, medians of few bins, clicks read once, hum from few bins."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from undula.operators import chunks as H
from undula.operators import screen as N
from undula.operators import spectral as S
from undula.plans import views as V

DATA, RATE = "/root/testdata/sf0.001", 16_000


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_takes_are_dealt_and_have_their_noise(spark):
    takes = V.takes(spark, DATA)
    assert takes.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1
    i = (F.col("chunk") * H.SIZE + F.col("k")).cast("long")
    noise = (F.pmod(F.xxhash64("track", i), F.lit(2001)) - 1000) / 1e8
    d = takes.select("track", "chunk", F.posexplode("xs").alias("k", "x")).filter("track = 0 or k in (0, 5, 8191)")
    rows = d.select("track", i.alias("i"), "x", noise.alias("e")).collect()
    for r in rows:
        if r["track"] == 0:  # no defect
            assert abs(r["x"] - 0.2 * np.sin(r["i"] * 2 * np.pi * 300 / RATE) - r["e"]) < 1e-12  # a step of the noise is 1e-8
    assert len({r["track"] for r in rows}) == spark.read.parquet(f"{DATA}/supplier.parquet").count() and max(r["i"] for r in rows) == 32_767


def chunk_table(spark, signals, size):
    rows = [(k, c, [float(v) for v in x[c * size : (c + 1) * size]]) for k, x in signals.items() for c in range(-(-len(x) // size))]
    return spark.createDataFrame(rows, "track long, chunk long, xs array<double>")


@pytest.mark.parametrize(("frame", "hop"), [(20, 8), (32, 64), (50, 7), (64, 64), (150, 30), (5, 90)])
def test_frames_inside_and_across_chunks_are_all_frames(spark, frame, hop):
    draw = np.random.default_rng(4)
    signals = {k: draw.normal(size=n) for k, n in enumerate((1, 4, 63, 64, 65, 127, 128, 300, 641))}
    got = H.by_frames(chunk_table(spark, signals, 64), frame, hop, lambda f: [f.sum(1), f[:, -1]], ["total", "last"], 64).collect()
    want = {}
    for k, x in signals.items():
        for no, a in enumerate(range(0, len(x) - frame + 1, hop)) if len(x) >= frame else [(0, 0)]:
            f = x[a : a + frame]
            want[k, no] = (a, len(f), f.sum(), f[-1])
    found = {(r["track"], r["frame_no"]): tuple(r[2:]) for r in got}
    assert len(got) == len(found) and found.keys() == want.keys()
    assert all(np.allclose(found[k], want[k]) for k in want)


def test_only_borders_of_chunks_are_shuffled_for_frames(spark, monkeypatch):
    sent, haloed = [], H.haloed

    def seen(*a, **k):
        d = haloed(*a, **k)
        sent.append(d.agg(F.sum(F.size("xs"))).first()[0])
        return d

    monkeypatch.setattr(H, "haloed", seen)
    x = np.random.default_rng(5).normal(size=40 * 512)
    assert H.by_frames(chunk_table(spark, {1: x}, 512), 32, 16, lambda f: [f.sum(1)], ["total"], 512).count() == (len(x) - 32) // 16 + 1
    assert sum(sent) < 0.15 * len(x)


def test_tones_ask_the_median_of_few_bins(monkeypatch):
    asked, median = [], np.nanmedian
    monkeypatch.setattr(np, "nanmedian", lambda a, axis: asked.append(len(a)) or median(a, axis=axis))
    t = np.arange(32_768) / RATE
    x = np.random.default_rng(6).normal(0, 1e-3, len(t)) + 0.01 * np.sin(2 * np.pi * 3000 * t) + 0.01 * np.sin(2 * np.pi * 5000 * t)
    assert [round(f, -1) for f, _ in sorted(N.tones(x, RATE, 1500.0, 18.0, 32_768, 2048))] == [3000.0, 5000.0]
    assert 0 < sum(asked) < 200  # of 13,109 bins
    # weaker limits ask more bins; what is found are all bins over the limit, 80 Hz apart
    assert len(N.tones(x, RATE, 1500.0, 3.0, 32_768, 2048)) == 8


def test_both_click_detectors_read_the_chunks_once(spark, monkeypatch):
    calls, found = [], H.click_candidates
    monkeypatch.setattr(H, "click_candidates", lambda *a, **k: calls.append(1) or found(*a, **k))
    x = 0.2 * np.sin(2 * np.pi * 300 * np.arange(20_000) / RATE)
    x[[6000, 8191, 8192, 15_000]] += [1.5, 0.9, -0.9, 0.75]
    chunks = chunk_table(spark, {1: x}, H.SIZE)
    rows = lambda d: sorted((r["type"], r["a"], r["b"]) for r in d.collect())
    both = rows(N.screened(chunks, RATE, ["click", "mouth_click"]))
    assert len(calls) == 1
    assert both == sorted(rows(N.click_events(chunks, RATE)) + rows(N.mouth_clicks(chunks, RATE))) and len({t for t, *_ in both}) == 2


def test_hum_of_few_bins_is_hum_of_all(spark):
    t = np.arange(60_000) / RATE
    noise = np.random.default_rng(7).normal(0, 1e-3, len(t))
    signals = {1: noise + 0.02 * np.sin(2 * np.pi * 50 * t), 2: noise + 0.02 * np.sin(2 * np.pi * 180 * t), 3: noise, 4: noise[:9000]}
    chunks = chunk_table(spark, signals, H.SIZE)
    rows = lambda d: sorted((r["track"], r["candidate"], round(r["snr_db"] or 0, 6), r["is_hum"]) for r in d.collect())
    some, every = (S.hum(H.long_term_spectrum(chunks, RATE, 16_384, None, 0.0, bins=b)) for b in (S.hum_bins(RATE, 16_384, S.HUM), None))
    assert rows(some) == rows(every)
    assert {(r["track"], r["detail"]["frequency_hz"]) for r in N.hum_events(chunks, RATE).collect()} >= {(1, 50.0), (2, 180.0)}
    assert len(S.hum_bins(RATE, 16_384, S.HUM)) < 300
