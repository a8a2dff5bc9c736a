"""Edit histories as version trees.

Every add or clear makes a version: its parent (the version that its list continues; of a clear the empty list, version 0), its
operation, and the version before it. Undo moves to the version before, redo to the one that was left last; no list is copied.
So a step costs the same however long the list is: the log of a source, in order, is walked once, as a stream of rows, by
three numbers a version. A list is read off the tree by pointer jumping: each round doubles how many of a version's
ancestors are known, so 100,000 operations take 17 rounds, and all lists that are asked for grow together.

Undo needs a version before the current one; redo is forgotten with the next add or clear. Other actions change nothing. Steps
with equal numbers are taken in order of action and op. Null sources are one source.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from undula.sources.shared import stored


class Tree:
    """The versions of one source: 0 is the empty list."""

    def __init__(self) -> None:
        self.parent, self.before, self.left, self.length, self.depth = array("q", [0]), array("q", [0]), array("q", [0]), array("q", [0]), array("q", [0])
        self.now, self.redo = 0, 0

    def step(self, action: str) -> int | None:
        """Do it; the number of the version that it makes, if it makes one."""
        if action in ("add", "clear"):
            made = len(self.parent)
            base = self.now if action == "add" else 0
            self.parent.append(base)
            self.before.append(self.now)
            self.left.append(0)
            self.length.append(self.length[base] + 1 if action == "add" else 0)
            self.depth.append(self.depth[self.now] + 1)
            self.now, self.redo = made, 0
            return made
        if action == "undo" and self.depth[self.now]:
            self.left[self.before[self.now]] = self.now
            self.now, self.redo = self.before[self.now], self.redo + 1
        elif action == "redo" and self.redo:
            self.now, self.redo = self.left[self.now], self.redo - 1
        return None


def steps(log: DataFrame) -> DataFrame:
    """log (source, k, action, op) with what each step leads to: made (the version it makes, else null), parent, now, n_ops, undo, redo."""
    source = log.schema["source"]
    added = StructType.fromDDL("made long, parent long, now long, n_ops long, undo long, redo long")
    schema = StructType([source, log.schema["k"], StructField("action", log.schema["action"].dataType), StructField("op", log.schema["op"].dataType), *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, tree = object(), Tree()
        for b in batches:
            out: list[tuple] = []
            for name, action in zip(b.column("source").to_pylist(), b.column("action").to_pylist(), strict=True):
                if name != of:
                    of, tree = name, Tree()
                made = tree.step(action)
                out.append((made, tree.parent[made] if made else None, tree.now, tree.length[tree.now], tree.depth[tree.now], tree.redo))
            columns = zip(*out, strict=True) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.int64()) for c in columns)], names=schema.names)

    d = log.select("source", "k", "action", "op").repartition("source").sortWithinPartitions("source", "k", "action", "op")
    return d.mapInArrow(run, schema)


def states(walked: DataFrame) -> DataFrame:
    """source, now, n_ops, undo, redo after the last step."""
    last = F.max_by(F.struct("now", "n_ops", "undo", "redo"), F.struct("k", "action", "op")).alias("s")
    return walked.groupBy("source").agg(last).select("source", "s.*")


def lists(walked: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (source, now) with `ops`, the list of that version, the first operation first."""
    tree = stored(walked.filter("made is not null").select("source", "made", "parent", "action", "op"), "versions")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    path = stored(wanted.filter("now > 0").select("source", "now", F.col("now").alias("node"), F.lit(0).cast("long").alias("place")), "paths")
    jump = tree.filter("parent > 0").select(F.col("source").alias("_s"), F.col("made").alias("_from"), F.col("parent").alias("_to"))
    far = 1
    while True:
        jump = stored(jump, "jumps")
        more = path.join(jump, same("source", "_s") & (F.col("node") == F.col("_from"))).select("source", "now", F.col("_to").alias("node"), (F.col("place") + far).alias("place"))
        more = stored(more, "paths")
        if more.isEmpty():
            break
        path, far = path.unionByName(more), 2 * far
        on = jump.select(F.col("_s").alias("_t"), F.col("_from").alias("_via"), F.col("_to").alias("_end"))
        jump = jump.join(on, same("_s", "_t") & (F.col("_to") == F.col("_via"))).select("_s", "_from", F.col("_end").alias("_to"))
    named = tree.filter("action = 'add'").select(F.col("source").alias("_s"), F.col("made").alias("_from"), "op")
    ops = path.join(named, same("source", "_s") & (F.col("node") == F.col("_from"))).groupBy("source", "now").agg(F.sort_array(F.collect_list(F.struct((-F.col("place")).alias("p"), "op"))).alias("s"))
    ops = ops.select(F.col("source").alias("_s"), F.col("now").alias("_now"), F.transform("s", lambda v: v["op"]).alias("ops"))
    out = wanted.join(ops, same("source", "_s") & (F.col("now") == F.col("_now")), "left")
    return out.select(*wanted.columns, F.coalesce("ops", F.array().cast("array<string>")).alias("ops"))


def histories(log: DataFrame) -> DataFrame:
    """source, ops (the current list), undo, redo (how many there are)."""
    walked = stored(steps(log), "steps")
    return lists(walked, states(walked)).select("source", "ops", "undo", "redo")
