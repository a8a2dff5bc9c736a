r"""Operator 6, SimHash near-duplicates: shingle fingerprints, exact linking within a Hamming radius, components.

Fingerprints: whole texts, A-Z lower-cased, words `[^\x20\x09-\x0D]+`, shingles of `words` words with repeats, XXH64 with
seed 42; a bit is 1 if over half of the shingles' hashes have it. No words: fingerprint zero, linked like any other.

Linking at `radius` or fewer differing bits, over distinct fingerprints, by a pivot distance table:
- References. BLOCK_BITS bits a reference: zero, and for each block of bits the fingerprint with just these set; besides
  them PIVOTS spread ones, hashes of the numbers from 0. The table holds each fingerprint's Hamming distances to all of
  them. Half of (distance to zero - distance to a block's reference + its bits) is the number of bits set in that block;
  these 32 coordinates of 0 to 2 are kept packed in one long.
- Cells propose the pairs. Blocks don't overlap, so by the triangle inequality the block coordinates of two fingerprints
  differ by no more in sum than their bits: at most `radius` coordinates differ. The coordinates are cut in GROUPS groups;
  a pair within the radius agrees in all but `radius` groups, so it shares the cell of one choice of groups at least.
- A proposed pair is discarded if any coordinate differs by more than the radius, survivors are verified by their bits.
- Full cells. Cells of over HOT fingerprints are counted before any row is dealt by them. Their fingerprints get the finer
  references of one bit each, whose coordinates are the bits: cells of these agree in all but a choice of blocks of bits,
  and full ones are refined by the same rule on the bits that the cell leaves free, until 5 bits are free, which 32 values
  fill. So no pair is lost and no full cell meets in one task.
Components by repeated least-neighbour labels with pointer jumping, each round written in the shared folder. Fingerprints
and components of many rows are not dealt to one task (common.spread_join).

Components need no link between two fingerprints that are in one already (`linked_roots`; `links` gives all of them). Cells
of up to CROWD fingerprints give all their pairs, 7.5 a row at most. In larger ones of more than one component all are first
compared with one of them, a row each, in up to STARS turns as long as these merge components; then only pairs
of different components are left to meet, by cells or, in full ones, by the finer references. So a group of near copies gives links
in proportion to its size, and every pair is compared or in one component.

Null texts are empty ones. Repeated rows give repeated rows, in one component. Nothing is collected on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from operator import and_
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm.common import arrow_map, batch, spread_join, stored, table

SEED = 42
PIVOTS, GROUPS, HOT = 16, 5, 256
CROWD, STARS = 16, 2
#: Rows of two longs that are broadcast: some 40 MB at most.
LABEL_ROWS = 500_000
#: Steps of a round of components, where labels are few enough to be broadcast.
STEPS = 2
#: Every second bit: where blocks of two bits, and their packed coordinates, begin.
LOW_BITS = 0x5555555555555555


def fingerprint(text: str, words: int = 3) -> int:
    w = text.encode().lower().split()  # bytes: just A-Z, and just \x20 and \x09-\x0D
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    n = max(len(w) - words + 1, 1)
    return majority(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, n))


def majority(h: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for part in np.array_split(h, max(1, len(h) // 65536)):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): fp as a signed long of the same 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t or "", words) for t in b.column(1).to_pylist()], np.uint64)
            yield batch({"doc_id": (b.column(0), pa.int64()), "fp": (fp.view(np.int64), pa.int64())})

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, fp long")


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def choices(free: list[int], blocks: int, radius: int) -> list[list[int]]:
    """For each choice of `radius` of the blocks that these bits are cut into: the bits in it, which a key leaves free."""
    cut = [free[len(free) * i // blocks : len(free) * (i + 1) // blocks] for i in range(blocks)]
    return [sum((cut[i] for i in left), []) for left in combinations(range(blocks), radius)]


def keyed(df: DataFrame, frees: list[list[int]]) -> DataFrame:
    """A row for each key: `mask` has the bits it leaves free, `key` all others of the fingerprint."""
    masks = F.array(*(F.lit(signed(sum(1 << b for b in free))) for free in frees))
    return df.withColumn("mask", F.explode(masks)).withColumn("key", F.col("fp").bitwiseAND(F.bitwise_not("mask")))


def pivots(n: int) -> list[int]:
    """Reference fingerprints: hashes of the numbers 0 to n - 1, so half of the bits of each are set."""
    return [signed(xxhash.xxh64_intdigest(str(i), SEED)) for i in range(n)]


def bit_distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def df_of(like: DataFrame, rows: list, schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, schema)


def tabled(df: DataFrame) -> DataFrame:
    """df with the pivot distance table of fp: `blocks`, the packed block coordinates, and the distances d0, d1, ... to the spread references."""
    low, fp, odd = F.lit(LOW_BITS), F.col("fp"), F.shiftrightunsigned("fp", 1)
    blocks = fp.bitwiseXOR(odd).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(odd).bitwiseAND(low), 1))  # of both bits of a block, their sum
    distances = (bit_distance(F.col("fp"), F.lit(p)).cast("tinyint").alias(f"d{i}") for i, p in enumerate(pivots(PIVOTS)))
    return df.select("*", blocks.alias("blocks"), *distances)


def near(radius: int) -> Column:
    """Of two tables a and b: no coordinate differs by more than the radius, and neither do the bits."""
    within = reduce(and_, (F.abs(F.col(f"a.d{i}") - F.col(f"b.d{i}")) <= radius for i in range(PIVOTS)))
    return within & (bit_distance(F.col("a.fp"), F.col("b.fp")) <= radius)


def pairs_in(rows: DataFrame, radius: int) -> DataFrame:
    """(a, b), a < b, of the fingerprints that share (mask, key) and survive; with a column root, of different roots only."""
    rows = rows.repartition("mask", "key")
    a, b = rows.alias("a"), rows.alias("b")
    same = (F.col("a.mask") == F.col("b.mask")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))
    if "root" in rows.columns:
        same = same & (F.col("a.root") != F.col("b.root"))
    return a.join(b.hint("merge"), same & near(radius)).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def full_keys(rows: DataFrame, hot: int) -> DataFrame | None:
    full = stored(rows.groupBy("mask", "key").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("mask", "key"), "full-keys")
    return None if full.isEmpty() else full


def celled(distinct: DataFrame, radius: int, groups: int) -> DataFrame:
    """The pivot distance table with a row for each cell (mask, key) of a fingerprint."""
    table = tabled(distinct.select("fp"))
    kept = [[2 * k for k in range(32) if k not in left] for left in choices(list(range(32)), groups, radius)]
    masks = F.array(*(F.lit(signed(sum(3 << at for at in places))) for places in kept))
    return table.withColumn("mask", F.explode(masks)).withColumn("key", F.col("blocks").bitwiseAND(F.col("mask")))


def links(distinct: DataFrame, radius: int = 3, groups: int = GROUPS, hot: int = HOT) -> DataFrame:
    """(a, b), a < b, of all distinct fingerprints (column fp) with at most `radius` differing bits."""
    rows = celled(distinct, radius, groups)
    full = full_keys(rows, hot)
    if full is None:
        return pairs_in(rows, radius).distinct()
    warm = stored(rows.join(full, ["mask", "key"], "left_semi").select("fp").distinct(), "full-cells")
    return pairs_in(rows.join(full, ["mask", "key"], "left_anti"), radius).unionByName(finer_links(warm, radius, hot)).distinct()


def finer_links(distinct: DataFrame, radius: int, hot: int) -> DataFrame:
    """The same over references of one bit each, with no cell of over `hot` fingerprints that could be cut further."""
    frees = choices(list(range(64)), radius + 2, radius)
    rows, found = keyed(tabled(distinct), frees), []
    columns = [c for c in rows.columns if c not in ("mask", "key")]
    while True:
        least = min(map(len, frees))
        full = full_keys(rows, hot) if max(map(len, frees)) > 5 else None  # else a key leaves 32 values at most
        found.append(pairs_in(rows.join(full, ["mask", "key"], "left_anti") if full else rows, radius))
        if full is None:
            return reduce(DataFrame.unionByName, found)
        warm = stored(rows.join(full, ["mask", "key"], "left_semi"), "full-rows")
        finer = {signed(sum(1 << x for x in free)): choices(free, radius + 3 if least > 6 else len(free), radius) for free in frees}
        listed = [(mask, [signed(sum(1 << x for x in free)) for free in below]) for mask, below in finer.items()]  # a row for each choice of blocks
        masks = df_of(distinct, listed, "mask long, masks array<long>")
        rows = warm.join(F.broadcast(masks), "mask").select(*columns, F.explode("masks").alias("mask")).distinct().withColumn("key", F.col("fp").bitwiseAND(F.bitwise_not("mask")))
        frees = [free for below in finer.values() for free in below]


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node that can be reached. Rounds grow with the logarithm of a component's length."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    label = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "roots")
    few = label.count() <= LABEL_ROWS
    near = F.broadcast if few else lambda df: df
    while True:
        now = label
        for _ in range(STEPS if few else 1):
            heard = both.join(near(now.withColumnRenamed("node", "b")), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("heard"))
            best = now.join(heard, "node").select("node", F.least("root", "heard").alias("root"))
            beyond = now.select(F.col("node").alias("root"), F.col("root").alias("beyond"))
            if few:
                jumped = best.join(F.broadcast(beyond), "root", "left")
            else:  # many nodes have one root; a root is a node, so each has its row
                best = stored(best, "best")
                jumped = spread_join(best, best.groupBy("root").agg(F.count("*").alias("n")).join(beyond, "root", "left"), "root")
            now = jumped.select("node", F.least("root", "beyond").alias("root"))
        new = stored(now.join(near(label.withColumnRenamed("root", "was")), "node"), "roots")
        label = new.select("node", "root")
        if new.filter("root < was").isEmpty():
            return label


def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with column root, the fingerprint itself where it has no link yet."""
    roots = F.broadcast(roots) if roots.count() <= LABEL_ROWS else roots
    rows = rows.drop("root")
    return rows.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(*rows.columns, F.coalesce("root", "fp").alias("root"))


def open_cells(rows: DataFrame, turn: int) -> DataFrame:
    """Cells of more than one root: how many fingerprints they have (`size`) and one of these (`c`), another one each turn."""
    one = F.min(F.struct(F.xxhash64("fp", F.lit(turn)).alias("h"), *(c for c in rows.columns if c not in ("mask", "key"))))
    cells = rows.groupBy("mask", "key").agg(F.count("*").alias("size"), one.alias("c"), F.min("root").alias("low"), F.max("root").alias("high"))
    return stored(cells.filter("low <> high").select("mask", "key", "size", "c"), "open-cells")


def linked_roots(distinct: DataFrame, radius: int = 3, groups: int = GROUPS, hot: int = HOT, crowd: int = CROWD) -> DataFrame:
    """(node, root) of all distinct fingerprints (column fp) that have a link: components(links(...)) without the links inside components."""
    rows = celled(distinct, radius, groups)
    crowded = full_keys(rows, crowd)
    if crowded is None:
        return components(pairs_in(rows, radius).distinct())
    roots = components(pairs_in(rows.join(crowded, ["mask", "key"], "left_anti"), radius).distinct())
    rows = stored(rows.join(crowded, ["mask", "key"]), "crowded-cells")
    cell = (F.col("a.mask") == F.col("b.mask")) & (F.col("a.key") == F.col("b.key"))
    for turn in range(STARS + 1):
        rows = stored(rooted(rows, roots), "rooted-cells")
        cells = open_cells(rows, turn)
        if cells.isEmpty():
            return roots
        if turn == STARS:
            break
        met = rows.alias("a").join(cells.select("mask", "key", "c.*").alias("b"), cell & (F.col("a.root") != F.col("b.root")) & near(radius))
        more = stored(met.select(F.col("a.root").alias("a"), F.col("b.root").alias("b")).distinct(), "star-links")
        if more.isEmpty():
            break
        roots = merged(roots, more)
    full = cells.filter(F.col("size") > hot).select("mask", "key")
    more = pairs_in(rows.join(cells.filter(F.col("size") <= hot).select("mask", "key"), ["mask", "key"]), radius)
    if not full.isEmpty():
        warm = stored(rows.join(full, ["mask", "key"], "left_semi").select("fp", "root").distinct(), "full-cells")
        more = more.unionByName(finer_links(warm, radius, hot))
    return merged(roots, of_roots(more.distinct(), roots))


def of_roots(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The roots (a, b) of the distinct pairs (a, b) of nodes, if they differ."""
    roots = F.broadcast(roots) if roots.count() <= LABEL_ROWS else roots
    for c in "ab":
        pairs = pairs.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left").withColumn(f"root_{c}", F.coalesce(f"root_{c}", c))
    return stored(pairs.filter("root_a <> root_b").select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), "root-links")


def merged(roots: DataFrame, more: DataFrame) -> DataFrame:
    """(node, root) after further links between roots."""
    if more.isEmpty():
        return roots
    new = components(more)
    known = spread_join(roots, stored(roots.groupBy("root").agg(F.count("*").alias("n")).join(new.withColumnRenamed("root", "low"), F.col("root") == F.col("node"), "left").select("root", "n", "low"), "new-roots"), "root")
    known = known.select("node", F.coalesce("low", "root").alias("root"))
    return stored(known.unionByName(new.join(roots.select("node"), "node", "left_anti")), "merged-roots")


def dedup_components(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable, itself included) of every document row."""
    prints = stored(fingerprints(docs, words), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "distinct-fingerprints")
    roots = linked_roots(distinct, radius)
    named = stored(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "doc_id", F.col("n").alias("rows"), F.coalesce("root", "fp").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    of_print = stored(spread_join(named, least, "root").select("fp", F.col("rows").alias("n"), "component_id"), "components")
    return spread_join(prints, of_print, "fp").select("doc_id", "fp", "component_id")


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
