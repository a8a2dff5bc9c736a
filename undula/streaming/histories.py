"""Edit histories as a stream: the version tree of a source is its state, one small entry a version, so a step reads and writes a few entries only."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

#: State in RocksDB; the session must name this provider before a stream starts.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STEPS = "source string, k long, action string, op string, made long, parent long, now long, n_ops long, undo long, redo long"


def longs(*names: str) -> StructType:
    """Built by hand: where state is opened there is no session to parse a text."""
    return StructType([StructField(n, LongType()) for n in names])


class Editor(StatefulProcessor):
    """Rows (source, k, action, op) of one micro-batch in order of k; steps come in order over micro-batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", longs("now", "redo", "made"))
        self.tree = handle.getMapState("tree", longs("version"), longs("parent", "before", "left", "n_ops", "undo"))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        now, redo, made = self.at.get() if self.at.exists() else (0, 0, 0)
        of = lambda v: self.tree.getValue((v,)) if self.tree.containsKey((v,)) else (0, 0, 0, 0, 0)
        pdf = pd.concat(list(rows)).sort_values(["k", "action", "op"])
        out = []
        for k, action, op in zip(pdf["k"], pdf["action"], pdf["op"], strict=True):
            parent, before, left, n_ops, undo = of(now)
            new = None
            if action in ("add", "clear"):
                new = made = made + 1
                base = now if action == "add" else 0
                entry = (base, now, 0, n_ops + 1 if action == "add" else 0, undo + 1)
                self.tree.updateValue((new,), entry)
                now, redo = new, 0
            elif action == "undo" and undo:
                up = of(before)
                self.tree.updateValue((before,), (up[0], up[1], now, up[3], up[4]))
                now, redo = before, redo + 1
            elif action == "redo" and redo:
                now, redo = left, redo - 1
            entry = of(now)
            out.append((key[0], k, action, op, new, entry[0] if new else None, now, entry[3], entry[4], redo))
        self.at.update((now, redo, made))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in STEPS.split(", ")]).astype({"made": "Int64", "parent": "Int64"})

    def close(self) -> None:
        pass


def stepped(log: DataFrame) -> DataFrame:
    """A stream of (source, k, action, op), source as text, to the rows of operators.histories.steps."""
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return log.groupBy("source").transformWithStateInPandas(Editor(), outputStructType=StructType.fromDDL(STEPS), outputMode="append", timeMode="none")
