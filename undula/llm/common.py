"""What the text operators share: reading tables, scratch tables in the shared folder, Arrow batches, sampling."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows in an Arrow batch. Texts are long, so batches are short: a Python worker holds one batch at a time.
BATCH_ROWS = 256
#: A key with more of all rows than this is not dealt to one task.
HOT_SHARE = 0.002
#: Labels whose counts are broadcast.
LABELS = 10_000
#: Tasks that the rows of such a key are dealt to.
PARTS = 32
#: Stretches of ranked keys (a task, a short key, two longs) that are broadcast: some 40 MB at most.
RUNS = 500_000
_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Without it only a local session, whose one machine shares all, gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _made:
        atexit.register(cleanup)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def cleanup() -> None:
    """Delete the scratch tables of this process; call it when no result is needed any more (done at exit too)."""
    while _made:
        spark, path = _made.pop()
        with contextlib.suppress(Exception):
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with short batches, so that a worker's memory doesn't depend on the number of rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def remainder(doc_id: Column | str) -> Column:
    """crc32 of doc_id as text, modulo 5; rows with 0 are held out from every training."""
    return F.crc32(F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(0)).cast("string").cast("binary")) % 5


def hashed_sample(df: DataFrame, key: str, n: int, total: int) -> DataFrame:
    """At most n rows of df, those with the least hashes of `key`, to fit a model on. total: about how many rows df has.

    An ordered limit gathers n rows of every partition; so first a bound on the hash leaves about 2 n rows of all, and
    what is gathered doesn't grow with the corpus."""
    if total > 2 * n:
        df = df.filter(F.xxhash64(key) < -(1 << 63) + (1 << 64) // total * 2 * n)
    return df.orderBy(F.xxhash64(key), key).limit(n)


def class_sample(df: DataFrame, key: str, label: str, n: int) -> DataFrame:
    """At most n rows of df, about as many of each label, those with the least hashes of `key`, to fit a model on; column
    label_rows has the label's rows in df.

    A bound on the hash, from the label's own count, leaves about twice the rows wanted; only these are ranked."""
    sizes = df.groupBy(label).agg(F.count("*").alias("label_rows"))
    labels = sizes.count()
    each = max(1, n // max(1, labels))
    sizes = F.broadcast(sizes) if labels <= LABELS else sizes
    share = (F.xxhash64(key).cast("double") / float(1 << 64) + 0.5) * F.col("label_rows")
    few = df.join(sizes.withColumnRenamed(label, "_label"), F.col(label) == F.col("_label")).drop("_label").filter(share < 2 * each + 20)
    rank = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64(key), key))
    return few.withColumn("_rank", rank).filter(F.col("_rank") <= each).drop("_rank").orderBy(F.xxhash64(key), key).limit(n)


def spread_join(rows: DataFrame, names: DataFrame, key: str, n: str = "n") -> DataFrame:
    """rows joined by `key` with names, which has a row for each key and in column n how many rows have it.

    Keys with a HOT_SHARE of all rows or more are fewer than 1 / HOT_SHARE, so they are broadcast and their rows stay where
    they are; all other keys are dealt as usual."""
    total = names.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(names.filter(F.col(n) > HOT_SHARE * total).drop(n))
    rest = names.filter(F.col(n) <= HOT_SHARE * total).drop(n)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key))


def dealt_join(rows: DataFrame, few: DataFrame, keys: list[str], by: str, hot: DataFrame | None = None, parts: int = PARTS) -> DataFrame:
    """rows joined by `keys` with few, too large to broadcast: rows of a key in hot (of all keys without it) are dealt over
    `parts` tasks by their column `by`, and that key's rows of few go to each of them. hot has fewer than 1 / HOT_SHARE keys."""
    part, every = F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"), F.sequence(F.lit(0), F.lit(parts - 1))
    if hot is not None:
        known = F.broadcast(hot.select(*keys, F.lit(True).alias("_hot")))
        rows, few = rows.join(known, keys, "left"), few.join(known, keys, "left")
        part, every = F.when(F.col("_hot"), part).otherwise(0), F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0)))
    return rows.withColumn("_part", part).join(few.withColumn("_part", F.explode(every)), [*keys, "_part"]).drop("_part", "_hot")


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys that have more than HOT_SHARE of these rows."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = rows.count()
    return n.filter(F.col("n") > HOT_SHARE * total).select(key)


def ranked(rows: DataFrame, key: str, order: list[str], deal: list[str] | None = None) -> DataFrame:
    """rows with `pos`, their place from 0 within `key` (never null) by the columns `order`, and `n`, how many rows the key has.

    Rows are dealt by ranges of key and `deal` (else `order`), so a key with a third of all rows fills many tasks; a place is
    the row's place in its task's stretch of the key, plus the counts of the stretches before. Only rows with equal `deal`
    meet in one task. The numbered rows are written before they are counted, so a lost executor can't renumber them."""
    dealt = rows.repartitionByRange(key, *(deal or order)).sortWithinPartitions(key, *order)
    numbered = stored(dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id")), "ranked")
    runs = numbered.groupBy("_part", key).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    of_key = Window.partitionBy(key)
    before = F.coalesce(F.sum("_n").over(of_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = stored(runs.select("_part", key, (before - F.col("_first")).alias("_shift"), F.sum("_n").over(of_key).alias("n")), "runs")
    runs = F.broadcast(runs) if runs.count() <= RUNS else runs
    return numbered.join(runs, ["_part", key]).select(*rows.columns, (F.col("_id") + F.col("_shift")).alias("pos"), "n")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is. ASCII texts, where lower() does just that, take the fast way."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def batch(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def splitter(pattern: str) -> Callable[[str], list[str]]:
    r"""findall of a pattern in \p{L} and \p{N}. Texts of Latin letters only, where [^\W\d_] and \d mean the same, go to re, which is faster."""
    exact = regex.compile(pattern).findall
    latin = re.compile("[\\x00-\\x1b\\x20-\\x84\\x86-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u024f]*").fullmatch
    inside = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
    if "\\p" in inside:
        return exact
    fast = re.compile(inside).findall
    return lambda text: fast(text) if latin(text) else exact(text)
