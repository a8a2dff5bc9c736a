"""Chunk tables give what samples in long form give, at any chunk size, and shuffle chunks instead of samples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from undula.operators import chunks as H
from undula.operators import edits as E
from undula.operators import frames as M
from undula.operators import mix as X

SAMPLES = "track long, channel int, i long, x double"


@pytest.fixture(scope="module")
def samples(spark):
    draw = np.random.default_rng(4)
    rows = [(t, c, i, float(v)) for t, n in ((1, 301), (2, 64), (3, 5)) for c in range(2) for i, v in enumerate(np.round(draw.uniform(-1.2, 1.2, n), 3))]
    return spark.createDataFrame([r for r in rows if r[:3] not in ((1, 0, 40), (1, 1, 40), (1, 1, 130))], SAMPLES).cache()  # two places are missing, one on one side only


def rows(d, digits=9):
    return sorted((tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in d.collect()), key=repr)


@pytest.mark.parametrize("size", [8, 64, 1024])
def test_same_rows_as_the_long_form(samples, size):
    c = H.from_samples(samples, size)
    assert rows(H.to_samples(c, size)) == rows(samples)
    assert rows(H.to_samples(H.mono(c), size)) == rows(E.mono(samples))
    whole, c = samples.filter("i <> 40"), H.from_samples(samples.filter("i < 40"), size)
    assert rows(H.frame_metrics(c, 16, 4, size)) == rows(M.frame_metrics(whole.filter("i < 40"), 16, 4))
    c = H.from_samples(samples, size)
    assert rows(H.clipping(c, 1.1, 3, size)) == rows(M.clipping(samples, 1.1, 3))
    assert rows(H.correlation(c, 50, size), 6) == rows(M.correlation(samples, 50), 6)
    assert rows(H.imbalance(c), 6) == rows(M.imbalance(samples), 6)
    assert rows(H.head_tail_silence(c, 1000, 0.0, size)) == rows(M.head_tail_silence(samples, 1000, 0.0))
    assert rows(H.to_samples(H.from_mid_side(H.to_mid_side(c)), size)) == rows(E.from_mid_side(E.to_mid_side(samples)))
    assert rows(H.to_samples(H.pan(H.gain(c, -3.0), 0.3), size)) == rows(E.pan(E.gain(samples, -3.0), 0.3))


@pytest.mark.parametrize("size", [8, 64, 1024])
def test_mix(spark, samples, size):
    config = spark.createDataFrame([(7, 1, -3.0, 0.2, False, False, 5), (7, 2, 0.0, -1.0, False, False, 64), (7, 3, 6.0, 2.0, False, False, 0), (8, 1, 0.0, 0.0, True, False, 1), (8, 3, 1.0, 0.0, False, True, 1000)], "mix long, track long, gain_db double, pan double, mute boolean, solo boolean, shift int")
    got = H.to_samples(H.mixed(H.from_samples(samples, size), config, size).withColumnRenamed("mix", "track"), size)
    assert rows(got) == rows(X.mixed(samples, config))


def test_many_tracks_of_a_mix_are_merged_in_the_map_task(spark):
    """A task that may hold only one sum emits it and goes on; the sums are the same."""
    d = spark.range(400).select((F.col("id") % 3).alias("track"), F.expr("cast(0 as long)").alias("chunk"), F.array(*[F.lit(float(k)) for k in range(5)]).alias("xs")).repartition(4)
    for held in (1, 1 << 20):
        out = {r["track"]: (r["total"], r["n"]) for r in H.summed(d, ["track", "chunk"], held).collect()}
        assert out == {t: ([k * n for k in range(5)], [n] * 5) for t, n in ((0, 134), (1, 133), (2, 133))}


@pytest.mark.parametrize("size", [8, 64])
def test_neighbourhoods(spark, samples, size):
    left = samples.filter("channel = 0")
    events = spark.createDataFrame([(1, 0, "a"), (1, 39, "b"), (1, 39, "c"), (1, 150, "d"), (1, 300, "e"), (3, 2, "f"), (9, 0, "no track")], "track long, at long, name string")
    got = {r["name"]: (r["start"], r["xs"]) for r in H.neighbourhoods(events, H.from_samples(left, size), 12, 12, size).collect()}
    x = {}
    for r in left.collect():
        x.setdefault(r["track"], {})[r["i"]] = r["x"]
    for name, t, at in (("a", 1, 0), ("b", 1, 39), ("c", 1, 39), ("d", 1, 150), ("e", 1, 300), ("f", 3, 2)):
        start, xs = got[name]
        want = [x[t].get(i, float("nan")) for i in range(max(0, at - 12), min(max(x[t]) + 1, at + 12))]
        assert start == max(0, at - 12) and np.array_equal(xs, want, equal_nan=True)
    assert "no track" not in got


def test_empty_tables(spark):
    c = H.from_samples(spark.createDataFrame([], SAMPLES), 64)
    assert [d.count() for d in (H.mono(c), H.frame_metrics(c, 16, 4, 64), H.clipping(c), H.correlation(c, 50), H.imbalance(c), H.head_tail_silence(c, 1000), H.to_mid_side(c))] == [0] * 7


def exchanges(d):
    """Of each exchange of the plan the columns that it moves."""
    plan = d._jdf.queryExecution().sparkPlan().toString() if False else d._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_chunks_are_shuffled_once(spark, samples, tmp_path):
    """On a stored chunk table mono, mix and frames deal chunks by one exchange (frames their hops by one more); samples in long form take more."""
    H.from_samples(samples, 64).write.parquet(f"{tmp_path}/chunks")
    c = spark.read.parquet(f"{tmp_path}/chunks")
    assert exchanges(H.mono(c)) == 1
    config = spark.createDataFrame([(7, 1, 0.0, 0.0, False, False, 5)], "mix long, track long, gain_db double, pan double, mute boolean, solo boolean, shift int")
    text = H.mixed(c, F.broadcast(config), 64)._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in text and text.count("Exchange hashpartitioning(mix") <= 2  # one for the solo flags, one for the sums
    assert exchanges(H.frame_metrics(c, 16, 4, 64)) <= exchanges(M.frame_metrics(samples, 16, 4))
    assert " i#" not in H.mono(c)._jdf.queryExecution().executedPlan().toString()
