"""Folds, segments and meters against plain Python."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from undula.functions import columns as C
from undula.operators import catalogs as K
from undula.operators.histories import histories
from undula.operators import mix as X
from undula.operators import regions as R
from undula.streaming import meters as T


def test_histories_equal_a_plain_editor(spark):
    rng = random.Random(1)
    log = [(s, k, rng.choice(["add", "add", "undo", "redo", "clear"]), f"op{k}") for s in range(20) for k in range(30)]
    want = {}
    for s in range(20):
        past, future = [[]], []
        for _, k, action, op in [x for x in log if x[0] == s]:
            if action in ("add", "clear"):
                past.append([*past[-1], op] if action == "add" else [])
                future = []
            elif action == "undo" and len(past) >= 2:
                future.append(past.pop())
            elif action == "redo" and future:
                past.append(future.pop())
        want[s] = (past[-1], len(past) - 1, len(future))
    rng.shuffle(log)
    got = {r["source"]: (r["ops"], r["undo"], r["redo"]) for r in histories(spark.createDataFrame(log, "source long, k long, action string, op string")).collect()}
    assert got == want


def test_speech_and_noise_cover_a_track_once(spark):
    rng = random.Random(2)
    rows = [(t, a, a + rng.randint(1, 30)) for t in range(10) for a in rng.sample(range(170), rng.randint(1, 9))]
    segments = spark.createDataFrame(rows, "track long, a long, b long")
    ends = spark.createDataFrame([(t, 200) for t in range(11)], "track long, n long")
    noise = R.complement(segments, ends).collect()
    for t in range(11):
        taken = {i for x, a, b in rows if x == t for i in range(a, b)}
        free = [i for r in noise if r["track"] == t for i in range(r["a"], r["b"])]
        assert len(free) == len(set(free)) and set(free) == set(range(200)) - taken


def test_muted_beats_soloed_and_names(spark):
    rows = [(1, 1, True, True), (1, 2, False, False), (1, 3, False, True), (2, 4, False, False)]
    on = X.active(spark.createDataFrame(rows, "mix int, track int, mute boolean, solo boolean"))
    assert sorted(r["track"] for r in on.collect()) == [3, 4]
    d = spark.createDataFrame([("RX 10 Spectral De-noise",), ("FabFilter  Pro Q",), ("Plain Name",)], "name string")
    assert [r[0] for r in d.select(C.short_name(F.col("name"))).collect()] == ["spectral-de-noise", "pro-q", "plain-name"]


def test_an_ambiguous_part_resolves_to_nothing(spark):
    catalog = spark.createDataFrame([("denoise", ["dn"]), ("dehum", []), ("decrackle", [])], "short string, aliases array<string>")
    got = dict(map(tuple, K.resolved(spark.createDataFrame([("denoise",), ("dn",), ("hum",), ("hu",), ("de",), ("zz",)], "name string"), catalog).collect()))
    assert got == {"denoise": "denoise", "dn": "denoise", "hum": "dehum", "hu": "dehum", "de": None, "zz": None}


def test_streams_equal_their_batch_twins(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(minutes=37 * k), k % 3, "view", float(k % 500), "{}") for k in range(300)]
    spark.createDataFrame(rows, T.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/events.parquet")
    batch = spark.createDataFrame(rows, T.EVENTS).select("ts", F.col("user_id").alias("track"), ((F.col("value") - 250) / 250).alias("x"))
    for k, job in enumerate((T.block_meter, T.short_term_level, lambda s: T.activity(s, 0.5))):
        stream = spark.readStream.schema(T.EVENTS).parquet(f"{tmp_path}/in/events.parquet").select("ts", F.col("user_id").alias("track"), ((F.col("value") - 250) / 250).alias("x"))
        q = job(stream).writeStream.format("memory").queryName(f"twin{k}").outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination(120)
        near = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())  # noqa: E731  sums in another order
        assert near(spark.table(f"twin{k}")) == near(job(batch))
