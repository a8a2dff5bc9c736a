"""Version trees against the plain editor: long logs, streams, odd actions."""

import random
import sys
import uuid

import pytest
from pyspark.sql import functions as F

from undula.operators import histories as E

LOG = "source string, k long, action string, op string"


def editor(log):
    """Lists copied at every step, as an editor that keeps snapshots would."""
    past, future, seen = [()], [], []
    for action, op in log:
        if action in ("add", "clear"):
            past.append((*past[-1], op) if action == "add" else ())
            future = []
        elif action == "undo" and len(past) >= 2:
            future.append(past.pop())
        elif action == "redo" and future:
            past.append(future.pop())
        seen.append((len(past[-1]), len(past) - 1, len(future)))
    return list(past[-1]), seen


def made(seed, n):
    draw = random.Random(seed)
    return [(draw.choices(["add", "undo", "redo", "clear", "look"], [6, 4, 3, 0.2, 1])[0], f"op{k}") for k in range(n)]


def test_steps_and_lists_equal_the_editor(spark):
    logs = {"a": made(1, 400), "b": made(2, 90), "c": [("undo", "x"), ("redo", "y")], None: made(3, 50), "d": [("add", "p"), ("clear", "q")]}
    rows = [(s, k, *step) for s, log in logs.items() for k, step in enumerate(log)]
    random.Random(4).shuffle(rows)
    log = spark.createDataFrame(rows, LOG)
    walked = E.steps(log).orderBy("source", "k").collect()
    for s, steps in logs.items():
        assert [(r["n_ops"], r["undo"], r["redo"]) for r in walked if r["source"] == s] == editor(steps)[1]
    assert {r["source"]: r["ops"] for r in E.histories(log).collect()} == {s: editor(steps)[0] for s, steps in logs.items()}


def test_lists_of_any_version(spark):
    log = spark.createDataFrame([("a", k, action, op) for k, (action, op) in enumerate([("add", "1"), ("add", "2"), ("undo", ""), ("add", "3"), ("clear", ""), ("add", "4")])], LOG)
    wanted = spark.createDataFrame([("a", v) for v in range(6)], "source string, now long")
    got = {r["now"]: r["ops"] for r in E.lists(E.steps(log), wanted).collect()}
    assert got == {0: [], 1: ["1"], 2: ["1", "2"], 3: ["1", "3"], 4: [], 5: ["4"]}


def test_a_hundred_thousand_steps_of_one_source(spark):
    """In linear time and memory: the walk holds five numbers a version, and the list is read by 17 joins."""
    n = 100_000
    log = spark.range(n, numPartitions=4).select(F.lit("a").alias("source"), F.col("id").alias("k"), F.when(F.col("id") % 10 == 7, "undo").otherwise("add").alias("action"), F.concat(F.lit("op"), F.col("id").cast("string")).alias("op"))
    want = []
    for k in range(n):
        if k % 10 == 7:
            want.pop()
        else:
            want.append(f"op{k}")
    r = E.histories(log).first()
    assert r["ops"] == want and r["undo"] == len(want) and r["redo"] == 0
    tree = E.Tree()
    for _ in range(1000):
        tree.step("add")
    assert sum(sys.getsizeof(a) for a in (tree.parent, tree.before, tree.left, tree.length, tree.depth)) < 60_000


def test_no_log(spark):
    assert E.histories(spark.createDataFrame([], LOG)).count() == 0


def test_stream_gives_the_same_steps(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    from undula.streaming.histories import PROVIDER, stepped

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    logs = {"a": made(5, 60), "b": made(6, 25)}
    for part in range(3):  # a micro-batch each
        rows = [(s, k, *step) for s, log in logs.items() for k, step in enumerate(log) if part * 20 <= k < (part + 1) * 20]
        random.Random(part).shuffle(rows)
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    try:
        stream = stepped(spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
        out = str(tmp_path / uuid.uuid4().hex)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert before != PROVIDER
    got = {(r["source"], r["k"]): r[4:] for r in spark.read.parquet(out).collect()}
    batch = E.steps(spark.createDataFrame([(s, k, *step) for s, log in logs.items() for k, step in enumerate(log)], LOG)).collect()
    assert got == {(r["source"], r["k"]): r[4:] for r in batch}
