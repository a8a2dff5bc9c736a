"""Meters in append mode: files in any order within the lateness give the batch's rows, state shrinks, late rows are counted."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from undula.streaming import meters as T

START = datetime(2024, 1, 1)
DRAW = random.Random(9)
ROWS = sorted((START + timedelta(seconds=DRAW.randrange(3 * 86_400)), t, round(DRAW.uniform(-1.2, 1.2), 3)) for t in (1, 2, 3) for _ in range(300))


def files(spark, folder, rows, parts, late_minutes):
    """rows in `parts` files, one micro-batch each, each row up to so late."""
    order = sorted(rows, key=lambda r: r[0] + timedelta(minutes=DRAW.uniform(0, late_minutes)))
    for k in range(parts):
        spark.createDataFrame(order[k * len(order) // parts : (k + 1) * len(order) // parts], T.MARK).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(T.MARK).option("maxFilesPerTrigger", 1).parquet(folder)


def same(a, b):
    key = lambda d: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect())
    assert key(a) == key(b) and a.count()


@pytest.mark.parametrize("job", [lambda s: T.block_meter(s, "6 hours"), lambda s: T.mix_meter(s, "6 hours"), lambda s: T.short_term_level(s, "3 hours", "1 hour"), lambda s: T.activity(s, 0.5, "30 minutes", "10 minutes")])
def test_shuffled_files_give_the_rows_of_the_batch(spark, tmp_path, job):
    stream = files(spark, str(tmp_path / "in"), ROWS, 4, 50)
    meter = T.Meter(stream, job).run()
    before = meter.state_rows()
    meter.close()
    same(meter.rows(), job(spark.createDataFrame(ROWS, T.MARK)))
    assert meter.late() == 0 and meter.state_rows() <= min(before, 3)  # the closing marker's own windows


def follower(rows, alpha=0.2):
    out = []
    for t in (1, 2, 3):
        y, last = 0.0, None
        for ts, _, x in sorted(r for r in rows if r[1] == t):
            if last is None or ts - last > timedelta(hours=1):
                y = 0.0
            y, last = y + alpha * (abs(x) - y), ts
            out.append((t, ts, y))
    return sorted(out)


def test_follower_keeps_the_order_over_micro_batches(spark, tmp_path):
    stream = files(spark, str(tmp_path / "in"), ROWS, 5, 50)
    meter = T.Meter(stream, T.in_order).run()
    early = meter.rows().count()
    meter.close()
    got = sorted((r["track"], r["ts"], r["y"]) for r in meter.rows().collect())
    want = follower(ROWS)
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])
    assert 0 < early < len(want) and meter.late() == 0 and meter.state_rows() <= 1


def test_rows_later_than_the_watermark_are_counted(spark, tmp_path):
    folder = str(tmp_path / "in")
    base = [(START + timedelta(hours=h), 1, 0.5) for h in range(12)]
    for part in (base[:6], base[6:], [(START + timedelta(hours=1, minutes=30), 1, 0.9)]):
        spark.createDataFrame(part, T.MARK).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(T.MARK).option("maxFilesPerTrigger", 1).parquet(folder)
    meter = T.Meter(stream, T.in_order).run().close()
    assert meter.late() == 1 and meter.rows().count() == 12


def test_no_input(spark, tmp_path):
    spark.createDataFrame([], T.MARK).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(T.MARK).parquet(str(tmp_path / "in"))
    for job in (T.block_meter, T.in_order):
        assert T.finished(stream, job).count() == 0
    assert F is not None
