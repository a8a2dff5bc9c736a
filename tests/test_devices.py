"""Responses, frame detectors, fingerprints and carried state, against plain numpy or planted signals."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from undula.operators import response as P
from undula.operators import screen as N
from undula.streaming import meters as T

RATE = 48_000


def tracks(spark, **signals):
    rows = [(k, 0, i, float(v)) for k, x in signals.items() for i, v in enumerate(x)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["track", "channel", "i", "x"]), "track string, channel int, i long, x double")


def banded(lo, hi, n, seed=1):
    spec, f = np.fft.rfft(np.random.default_rng(seed).standard_normal(n)), np.fft.rfftfreq(n, 1 / RATE)
    x = np.fft.irfft(np.where((f > lo) & (f < hi), spec, 0), n)
    return x / np.abs(x).max()


def test_equalizer_over_bypass(spark):
    bypass, half = np.zeros(256), np.zeros(256)
    bypass[3], half[5] = 1.0, 0.5  # half the level, two samples late
    got = P.equalizer_response(tracks(spark, a=bypass, b=half), "a", RATE, 256).filter("track = 'b'").toPandas()
    np.testing.assert_allclose(got.db, 20 * np.log10(0.5), atol=1e-6)
    np.testing.assert_allclose(got.delay, 2 / RATE, rtol=1e-6)


def test_sweep_follows_the_tone(spark):
    n = RATE
    t = np.arange(n) / RATE
    k = np.log(8000 / 100)
    x = 0.5 * np.sin(2 * np.pi * 100 / k * (np.exp(t * k) - 1))
    got = P.sweep(tracks(spark, a=x), RATE, 100, 8000, 4096, 2048).toPandas()
    late = got[got.freq > 500]
    assert len(late) > 5 and (np.abs(late.peak_hz / late.freq - 1) < 0.1).all()


def test_breath_noise_and_mouth_clicks_are_found_where_planted(spark):
    quiet = np.random.default_rng(2).standard_normal(RATE) * 1e-5
    breath = quiet.copy()
    breath[12_000:24_000] += 0.05 * banded(1200, 7000, 12_000)
    found = N.breath(tracks(spark, t=breath), RATE).collect()
    assert len(found) == 1 and abs(found[0]["a"] - 12_000) < 2000 and abs(found[0]["b"] - 24_000) < 2500
    hiss = np.random.default_rng(3).standard_normal(RATE) * 0.005
    assert len(N.background_noise(tracks(spark, t=hiss), RATE).collect()) == 1
    assert N.breath(tracks(spark, t=quiet), RATE).count() == 0 and N.background_noise(tracks(spark, t=quiet), RATE).count() == 0
    smack = np.random.default_rng(4).standard_normal(RATE) * 0.001
    smack[30_000:30_060] += 0.2 * banded(2000, 7000, 60)
    got = N.mouth_clicks(tracks(spark, t=smack), RATE, first=None).collect()  # noise alone has over 20 clicks before it
    assert any(abs(r["a"] - 30_000) < 1500 for r in got)


def test_fingerprints_choose_loud_and_quiet_and_repeat(spark):
    x = np.concatenate([a * banded(100, 3000, 4800, s) for s, a in enumerate((0.2, 0.9, 0.05, 0.9))])
    d = tracks(spark, t=x)
    a, b = (N.fingerprints(d, RATE, 0.1).orderBy("spot").collect() for _ in "ab")
    assert a == b and {r["spot"]: r["window"] for r in a} == {"loud": int(np.argmax([np.mean(x[k * 4800 : k * 4800 + 4800] ** 2) for k in range(4)])), "quiet": 2}


def test_state_is_carried_over_files(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(minutes=k), 1, "view", float(k * 7 % 500), "{}") for k in range(60)]
    for part in range(3):  # three files, one batch each
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], T.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(T.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = stream.select("ts", F.col("user_id").alias("track"), ((F.col("value") - 250) / 250).alias("x"))
    q = T.smoothed(stream).writeStream.format("memory").queryName("carried").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    y, want = 0.0, []
    for r in rows:
        y += 0.2 * (abs((r[4] - 250) / 250) - y)
        want.append(y)
    np.testing.assert_allclose([r["y"] for r in spark.table("carried").orderBy("ts").collect()], want)
