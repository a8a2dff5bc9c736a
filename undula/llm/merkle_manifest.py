"""Operator 11, a Merkle manifest of a dataset: a root over all rows, and a proof for each of them.

A leaf is the hash of a row's fields (lowercase hex SHA-256; digests enter hashes as hex text). The rows of a source, by
doc_id, make a tree: while it has several nodes, every WIDTH consecutive ones become their hash (the last run may be
shorter, even one). What remains is the source's subroot, and the subroots in order of their sources make a tree likewise.

Checkpoint and recompute: only every KEEP-th level is written to the shared folder. An aligned subtree is one node of a
stored level with its up to WIDTH ** KEEP descendants on the stored level below; a task gets one such group at a time,
hashes the levels between them again, emits what each descendant lacks on its way up, and forgets them. Going down from
the top, a node's path is its own steps followed by those of the stored node above it, so each level is read once.
No group has over WIDTH ** KEEP rows, whatever the size of a source; rows get their places by ranges (common.ranked).

A path is an array of steps from leaf to root. A step is the run's other nodes around a dot that stands for the own one,
so folding replaces the dot by the hash so far and hashes the step.

Nulls: a null field enters the leaf as `-`; null sources are one source, the first; a null doc_id is first of its source
and never tampered with. Equal doc_ids are ordered by their leaves; repeated rows are leaves of their own, with one
result for each. No rows: no root, no result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from undula.llm.common import arrow_map, ranked, stored, table

WIDTH, KEEP = 3, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(*fields: Column) -> Column:
    """The hash of the fields, each `-` if null, else its UTF-8 byte count, `:` and itself."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def tampered(doc_id: Column, text: Column) -> Column:
    """Where 2 divides the CRC of doc_id, the text without line feeds."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def regrown(nodes: list[str], n: int) -> list[list[str]]:
    """The levels from these nodes up to the top of their aligned subtree; n: how many nodes their level has in the tree."""
    levels, alone = [nodes], n <= WIDTH**KEEP
    while len(levels[-1]) > 1 if alone else len(levels) <= KEEP:
        below = levels[-1]
        levels.append([digest("".join(below[i : i + WIDTH])) for i in range(0, len(below), WIDTH)])
    return levels


def steps(levels: list[list[str]]) -> list[list[str]]:
    """Of each node of the lowest level the steps below the highest."""
    ways: list[list[str]] = [[] for _ in levels[0]]
    for below in range(len(levels) - 1):
        level, width = levels[below], WIDTH**below
        made = ["".join(level[p - p % WIDTH : p]) + "." + "".join(level[p + 1 : p - p % WIDTH + WIDTH]) for p in range(len(level))]
        for i, way in enumerate(ways):
            way.append(made[i // width])
    return ways


def gathered(level: DataFrame) -> DataFrame:
    """(tree, at, n, members): the nodes of each aligned subtree in order, with all their columns."""
    members = F.array_sort(F.collect_list(F.struct("pos", *(c for c in level.columns if c not in ("tree", "pos", "n")))))
    return level.groupBy("tree", F.floor(F.col("pos") / WIDTH**KEEP).alias("at")).agg(F.first("n").alias("n"), members.alias("members"))


def tops(level: DataFrame) -> DataFrame:
    """(tree, pos, n, node) of the next stored level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            top = [regrown(nodes, n)[-1][0] for n, nodes in zip(b.column("n").to_pylist(), b.column("nodes").to_pylist(), strict=True)]
            n = [-(-n // WIDTH**KEEP) for n in b.column("n").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("tree"), b.column("at"), pa.array(n, pa.int64()), pa.array(top, pa.string())], ["tree", "pos", "n", "node"])

    groups = gathered(level.select("tree", "pos", "n", "node")).select("tree", "at", "n", F.transform("members", lambda m: m["node"]).alias("nodes"))
    return stored(arrow_map(groups, run, "tree string, pos long, n long, node string"), "checkpoint")


def checkpoints(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The stored levels of all trees, and of each tree (tree, last, node): the last stored level before its top, and the top."""
    levels, done = [leaves], []
    while True:
        above = tops(levels[-1])
        done.append(above.filter("n = 1").select("tree", F.lit(len(levels) - 1).alias("last"), "node"))
        rest = above.filter("n > 1")
        if rest.isEmpty():
            return levels, reduce(DataFrame.unionByName, done)
        levels.append(rest)


def climbed(level: DataFrame, above: DataFrame) -> DataFrame:
    """The nodes of a level with `path` and `top`; above: (tree, at, path, top) of the subtrees' own nodes."""
    groups = gathered(level).join(above, ["tree", "at"])
    columns = [f for f in groups.schema["members"].dataType.elementType.fields]
    ways = groups.select("tree", "n", "top", "path", "members", F.transform("members", lambda m: m["node"]).alias("nodes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = [[way + path for way in steps(regrown(nodes, n))] for n, path, nodes in zip(*(b.column(c).to_pylist() for c in ("n", "path", "nodes")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("tree"), b.column("n"), b.column("top"), b.column("members"), pa.array(paths, pa.list_(pa.list_(pa.string())))], ["tree", "n", "top", "members", "paths"])

    schema = StructType([StructField("tree", StringType()), StructField("n", LongType()), StructField("top", StringType()), groups.schema["members"], StructField("paths", ArrayType(ArrayType(StringType())))])
    each = arrow_map(ways, run, schema).select("tree", "n", "top", F.explode(F.arrays_zip("members", "paths")).alias("m"))
    return each.select("tree", "n", "top", *(F.col(f"m.members.{f.name}") for f in columns), F.col("m.paths").alias("path"))


def paths(levels: list[DataFrame], ends: DataFrame) -> DataFrame:
    """The nodes of the lowest level with `path` up to the root and `top`, their tree's top; ends: (tree, last, path, top), the
    path that goes on above each tree's top."""
    found = None
    for at in reversed(range(len(levels))):
        above = ends.filter(F.col("last") == at).select("tree", F.lit(0).cast("long").alias("at"), "path", "top")
        if found is not None:
            above = above.unionByName(found.select("tree", F.col("pos").alias("at"), "path", "top"))
        found = climbed(levels[at], above)
        found = stored(found, "paths") if at else found
    return found


class Manifest:
    """root (None without rows), subroots (tree, node) and, from proofs(), doc_id, leaf, changed, subroot and path of every row."""

    def __init__(self, docs: DataFrame):
        source = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # null first, then by UTF-8 bytes
        plain = leaf(*map(F.col, FIELDS))
        other = tampered(F.col("doc_id"), F.col("text"))
        changed = F.when(other != F.col("text"), leaf(*map(F.col, FIELDS[:-1]), other))
        leaves = stored(docs.select("doc_id", source.alias("tree"), plain.alias("node"), changed.alias("changed")), "leaves")
        self.levels, self.subroots = checkpoints(ranked(leaves, "tree", ["doc_id", "node"]))
        sources = ranked(self.subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "last", "node"), "tree", ["source"])
        self.upper, tree = checkpoints(sources)
        found = tree.first()
        self.root = found["node"] if found else None
        self.ends = tree.select("tree", F.col("last"), F.array().cast("array<string>").alias("path"), F.col("node").alias("top"))

    def proofs(self) -> DataFrame:
        ends = paths(self.upper, self.ends.select("tree", "last", "path", "top"))
        ends = stored(ends.select(F.col("source").alias("tree"), F.col("last"), "path", F.col("node").alias("top")), "root-paths")
        return paths(self.levels, ends).select("doc_id", F.col("node").alias("leaf"), "changed", F.col("top").alias("subroot"), "path")


def folded(node: Column, path: Column) -> Column:
    """The root that a node and its path lead to."""
    return F.aggregate(path, node, lambda hashed, step: F.sha2(F.concat(F.substring_index(step, ".", 1), hashed, F.substring_index(step, ".", -1)), 256))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = Manifest(table(spark, sf_dir, "documents"))
    root = F.lit(manifest.root).cast("string")
    out = manifest.proofs().select(
        "doc_id", "leaf", "subroot", root.alias("root"), F.sha2(F.replace(F.array_join("path", ""), F.lit("."), F.lit("")), 256).alias("proof_sha256"),
        folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = """
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda k: list_reduce(list_prepend(k, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), d AS (
  SELECT row_number() OVER () AS r, doc_id, source, lang, n_chars, text,
    CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other
  FROM documents, tab
), hashed AS (
  SELECT r, doc_id, source, {plain} AS leaf, {other} AS changed FROM d
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM hashed
), lv AS (
  SELECT 0 AS lev, source, pos, leaf AS node, n FROM leaves
  UNION ALL
  SELECT lev + 1, source, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (n + 2) // 3 FROM lv WHERE n > 1 GROUP BY lev, source, pos // 3, n
), srcs AS (
  SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM lv WHERE n = 1
), rt AS (
  SELECT 0 AS lev, pos, subroot AS node, n FROM srcs
  UNION ALL
  SELECT lev + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (n + 2) // 3 FROM rt WHERE n > 1 GROUP BY lev, pos // 3, n
), steps AS (
  SELECT a.r, 0 AS part, l.lev, coalesce(string_agg(l.node, '' ORDER BY l.pos) FILTER (l.pos < a.pos // (3 ** l.lev)::BIGINT), '') AS lft,
    coalesce(string_agg(l.node, '' ORDER BY l.pos) FILTER (l.pos > a.pos // (3 ** l.lev)::BIGINT), '') AS rgt
  FROM leaves a JOIN lv l ON l.source IS NOT DISTINCT FROM a.source AND l.n > 1 AND l.pos // 3 = a.pos // (3 ** (l.lev + 1))::BIGINT GROUP BY a.r, l.lev
  UNION ALL
  SELECT a.r, 1, l.lev, coalesce(string_agg(l.node, '' ORDER BY l.pos) FILTER (l.pos < s.pos // (3 ** l.lev)::BIGINT), ''),
    coalesce(string_agg(l.node, '' ORDER BY l.pos) FILTER (l.pos > s.pos // (3 ** l.lev)::BIGINT), '')
  FROM leaves a JOIN srcs s ON s.source IS NOT DISTINCT FROM a.source JOIN rt l ON l.n > 1 AND l.pos // 3 = s.pos // (3 ** (l.lev + 1))::BIGINT GROUP BY a.r, l.lev
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY part, lev) AS k FROM steps
), fold AS (
  SELECT r, 0 AS k, coalesce(changed, leaf) AS x FROM leaves
  UNION ALL
  SELECT f.r, p.k, sha256(p.lft || f.x || p.rgt) FROM fold f JOIN placed p ON p.r = f.r AND p.k = f.k + 1
), proofs AS (
  SELECT r, sha256(string_agg(lft || rgt, '' ORDER BY k)) AS proof FROM placed GROUP BY r
)
SELECT l.doc_id, l.leaf, s.subroot, (SELECT node FROM rt WHERE n = 1) AS root, coalesce(p.proof, sha256('')) AS proof_sha256, f.x AS folded_root,
  f.x = (SELECT node FROM rt WHERE n = 1) AS verified
FROM leaves l JOIN srcs s ON s.source IS NOT DISTINCT FROM l.source LEFT JOIN proofs p ON p.r = l.r
JOIN (SELECT r, last(x ORDER BY k) AS x FROM fold GROUP BY r) f ON f.r = l.r
""".format(
    **{
        name: "sha256(" + " || ".join(f"coalesce(strlen({f}::VARCHAR)::VARCHAR || ':' || {f}::VARCHAR, '-')" for f in (*FIELDS[:-1], text)) + ")"
        for name, text in (("plain", "text"), ("other", "other"))
    }
)
