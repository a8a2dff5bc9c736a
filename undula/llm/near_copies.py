r"""Near copies by exact similarity: texts whose shingle sets have a Jaccard similarity of `least` or more are linked.

Words as in operator 6 (A-Z lower-cased, `[^\x20\x09-\x0D]+`); shingles of `words` words, as a set; a shorter text is one
shingle. Texts with equal sets, and all texts without words, are one node.

Candidates: BANDS keys of ROWS minima each (MinHash). A pair of similarity s shares a key but for a chance of
(1 - s ** ROWS) ** BANDS: 5e-8 at 0.8, less above. Operator 6's cells of pivot coordinates can't propose them: at the radius
that similar texts need, cells keep a few bits, so every pair would meet.

Then operator 6's method with that wider radius: each node has the SimHash fingerprint of its shingles and its pivot
distance table; a candidate is discarded if any coordinate, or else the bits, differ by more than RADIUS. At 0.8 about 10
of 64 bits differ; more than 26 do for 2e-7 of such pairs (1e-5 if the texts have 4 and 5 shingles), and for 0.92 of
unrelated ones. Texts that share just a passage are closer than that, so a candidate also goes if over MINIMA_OFF of its 128
minima differ, of which four bits each are kept: at 0.8 about 24 do, more than 48 for 2e-7 of such pairs, at 0.5 a fiftieth stays.
`discard=False` asks neither. Both leave most pairs a little under `least`, as many as the square of a group of edited copies; so
each node also has the parities of how many of its shingles fall into each of PARITIES * 64 buckets. Where two parities differ,
the sets differ by a shingle at least, which bounds a pair's similarity from above, exactly, and is always asked. No survivor links unverified: pairs whose set sizes rule `least` out go, all others are compared
shingle by shingle.

Verification is a tiled join. No text is stored: one of each asked node is found again by its 64-bit hash, its shingle hashes are sorted and stored once; pairs are dealt to tiles by the hashes
of their two nodes, and a node's array goes once to each tile where it has a pair, not once with each pair. Tiles are as many as
keep their pairs and arrays within TILE_PAIRS and TILE_BYTES on average; a node with many pairs is in many tiles.

Before any nodes meet, the shingles that no other node with a shared key has are counted: what a node shares with any of them is
no more than the rest, which bounds a pair's similarity from above, exactly. Nodes and pairs whose bound is under `least` go
unseen, so a group whose texts share a passage, or were edited in many places each, makes next to no candidates.

Full keys, shared by over HOT nodes: a key whose nodes are in one component already is settled. In all others the nodes
outside the key's most common component are compared with all of it, once that makes no more than HOT pairs a row; until
then (STARS turns at most, and only while they find something) all nodes are compared with one of them, which merges
components. So no pair of two components is left uncompared. HOT is low, as smaller keys give all their pairs: near copies
of one text, which share many keys, then give candidates and links in proportion to their number. What a turn merges is
counted between components, whose links of earlier turns are not read again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, sqrt
from operator import and_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.llm.common import arrow_map, batch, spread_join, stored
from undula.llm.decontamination import BROADCAST_ROWS, small
from undula.llm.simhash_dedup import SEED, components, majority, merged, near, of_roots, tabled

BANDS, ROWS = 32, 4
HOT, STARS = 16, 3
RADIUS = 26
MINIMA_OFF = 48
TILE_PAIRS, TILE_BYTES = 20_000, 64 << 20
#: Longs of parities.
PARITIES = 4
ODDS = [f"p{i}" for i in range(PARITIES)]
#: Longs that keep four bits of each minimum, and the lowest bit of each four.
KEPT = [f"m{i}" for i in range(BANDS * ROWS // 16)]
FOURS = 0x1111111111111111
_draw = np.random.default_rng(SEED)
FLIP, ODD, MIX = (_draw.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(3))


def shingles(text: str, words: int = 5) -> set[bytes]:
    w = text.encode().lower().split()  # bytes: just A-Z, and just \x20 and \x09-\x0D
    return {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def hashes(text: str, words: int = 5) -> np.ndarray:
    """The hashes of the set of shingles, in order."""
    w = text.encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(w), max(1, len(w) - words + 1)
    ends = (np.cumsum([len(x) for x in w]) + np.arange(len(w))).tolist()
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[i:j], SEED) for i, j in zip(starts, ends[-n:], strict=True)), np.uint64, n))


def parities(h: np.ndarray) -> np.ndarray:
    """Of each bucket of hashes, whether an odd number is in it, as PARITIES longs."""
    odd = np.bincount((h >> np.uint64(32)).astype(np.int64) % (64 * PARITIES), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def signature(text: str, words: int = 5) -> tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the shingle set, its size, its fingerprint, its parities, four bits of each of its minima and its keys; an empty set has no keys."""
    h = hashes(text, words)
    node = int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), SEED)).view(np.int64))
    if not len(h):
        return node, 0, 0, parities(h), np.zeros(len(KEPT), np.int64), np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for part in np.array_split(h, len(h) // 4096 + 1):
        least = np.minimum(least, ((part ^ FLIP) * ODD).min(1))
    fp = int(np.uint64(majority(h)).view(np.int64))
    mixed = least[:, None] * MIX
    fours = (mixed[:, 0] >> np.uint64(60)).astype(np.uint8)
    return node, len(h), fp, parities(h), (fours[::2] << 4 | fours[1::2]).view(np.int64), mixed.reshape(BANDS, ROWS).sum(1, dtype=np.uint64).view(np.int64)


def signatures(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, text_hash, node, n, fp, p0, p1, ..., m0, m1, ..., keys) of every document row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, n, fp, odd, minima, keys = zip(*(signature(t or "", words) for t in b.column(2).to_pylist()), strict=True) if b.num_rows else ((),) * 6
            odd = np.array(odd, np.int64).reshape(-1, PARITIES)
            kept = np.array(minima, np.int64).reshape(-1, len(KEPT))
            columns = {"doc_id": (b.column(0), pa.int64()), "text_hash": (b.column(1), pa.int64()), "node": (node, pa.int64()), "n": (n, pa.int64()), "fp": (fp, pa.int64())}
            longs = {p: (odd[:, i], pa.int64()) for i, p in enumerate(ODDS)} | {m: (kept[:, i], pa.int64()) for i, m in enumerate(KEPT)}
            yield batch(columns | longs | {"keys": (keys, pa.list_(pa.int64()))})

    longs = ", ".join(f"{c} long" for c in ODDS + KEPT)
    return arrow_map(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), run, f"doc_id long, text_hash long, node long, n long, fp long, {longs}, keys array<long>")


def alike(n: Column, m: Column, least: float) -> Column:
    """Whether sets of these sizes can be so similar."""
    return 1000 * F.least(n, m) >= round(1000 * least) * F.greatest(n, m)


def shingle_sets(docs: DataFrame, prints: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, n, hashes) of these nodes: the sorted hashes of each one's shingles."""
    asked = stored(prints.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("text_hash").alias("text_hash")), "asked")
    texts = docs.select(F.xxhash64("text").alias("text_hash"), "text").join(small(asked), "text_hash").groupBy("node").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [hashes(t or "", words).view(np.int64) for t in b.column(1).to_pylist()]
            yield batch({"node": (b.column(0), pa.int64()), "n": ([len(h) for h in sets], pa.int64()), "hashes": (sets, pa.list_(pa.int64()))})

    return stored(arrow_map(texts.select("node", "text"), run, "node long, n long, hashes array<long>"), "asked-shingles")


def linkable(rows: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """rows with `m`, how many of a node's n shingles another one of these nodes has too; nodes that are too lonely for any link go."""
    alone = sets.select("node", F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("c"), F.min("node").alias("node")).filter("c = 1")
    lonely = stored(alone.groupBy("node").agg(F.count("*").alias("alone")), "lonely")
    d = rows.join(small(lonely), "node", "left").withColumn("m", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")
    return d.filter(1000 * F.col("m") >= round(1000 * least) * F.col("n"))


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the distinct pairs (a, b) whose shingle sets have that similarity."""
    pairs = stored(pairs, "candidates")
    n = pairs.count()
    if not n:
        return pairs
    size = sets.agg(F.avg("n")).first()[0]
    side = ceil(sqrt(max(n / TILE_PAIRS, 2 * n * 8 * size / TILE_BYTES, 1)))
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(side))
    tiled = pairs.withColumn("tile", of("a") * side + of("b"))
    members = tiled.select(F.col("tile").alias("of_tile"), F.explode(F.array("a", "b")).alias("node")).distinct().join(sets.select("node", "hashes"), "node")
    share = round(1000 * least)

    def run(pairs: pa.Table, nodes: pa.Table) -> pa.Table:
        known = nodes.column("hashes").combine_chunks()
        ends = np.cumsum(known.value_lengths().to_numpy())
        sets = dict(zip(nodes.column("node").to_pylist(), np.split(known.flatten().to_numpy().view(np.uint64), ends[:-1]) if len(ends) else [], strict=True))
        out = []
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
            p, q = sorted((sets[a], sets[b]), key=len)
            same = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
            if 1000 * same >= share * (len(p) + len(q) - same):
                out.append((a, b))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return stored(tiled.groupBy("tile").cogroup(members.groupBy("of_tile")).applyInArrow(run, "a long, b long"), "similar")


def minima_off() -> Column:
    """Of nodes a and b: how many minima differ in their four bits."""
    off = []
    for m in KEPT:
        x = F.col(f"a.{m}").bitwiseXOR(F.col(f"b.{m}"))
        any_bit = reduce(lambda y, k: y.bitwiseOR(F.shiftrightunsigned(x, k)), (1, 2, 3), x)
        off.append(F.bit_count(any_bit.bitwiseAND(F.lit(FOURS))))
    return reduce(Column.__add__, off)


def differing() -> Column:
    """Of nodes a and b: how many shingles only one of them has, at least."""
    return reduce(Column.__add__, (F.bit_count(F.col(f"a.{p}").bitwiseXOR(F.col(f"b.{p}"))) for p in ODDS))


def possible(rows: DataFrame, others: DataFrame, least: float, discard: bool, *rules: Column) -> DataFrame:
    """(a, b), a < b, of nodes that share a key, are in different components and survive sizes, parities and, if asked, pivot distances, bits and minima."""
    share = round(1000 * least)
    enough = (1000 + share) * F.least("a.m", "b.m") >= share * (F.col("a.n") + F.col("b.n"))  # m: the most that two nodes can share
    close = (1000 + share) * differing() <= (1000 - share) * (F.col("a.n") + F.col("b.n"))
    other = (F.col("a.key") == F.col("b.key")) & (F.col("a.root") != F.col("b.root")) & alike(F.col("a.n"), F.col("b.n"), least) & enough & close
    if discard:
        other = other & near(RADIUS) & (minima_off() <= MINIMA_OFF)
    met = rows.alias("a").join(others.alias("b"), reduce(and_, rules, other))
    return met.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()


def pairs_of(rows: DataFrame, least: float, discard: bool) -> DataFrame:
    return possible(rows, rows, least, discard, F.col("a.node") < F.col("b.node"))


def star(rows: DataFrame, turn: int, least: float, discard: bool) -> DataFrame:
    """Each key's nodes paired with one node of it, another one each turn."""
    chosen = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), *(c for c in rows.columns if c not in ("key", "main"))))
    centre = stored(rows.groupBy("key").agg(chosen.alias("c")).select("key", "c.*"), "centres")
    return possible(rows, small(centre), least, discard)


def unsettled(rows: DataFrame, roots: DataFrame) -> tuple[DataFrame, int]:
    """The rows of keys whose nodes are in more than one component, with `main`, the key's most common one; and how many
    pairs there are of a node outside it and a node of the key."""
    rows = rows.drop("root").join(small(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = stored(rows, "full-rows")
    of_root = rows.groupBy("key", "root").agg(F.count("*").alias("n"))
    of_key = of_root.groupBy("key").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("roots")).filter("roots > 1")
    open_keys = stored(of_key.select("key", F.col("most.root").alias("main"), (F.col("n") * (F.col("n") - F.col("most.n"))).alias("pairs")), "open-keys")
    return rows.join(small(open_keys.select("key", "main")), "key"), open_keys.agg(F.sum("pairs")).first()[0] or 0


def across(rows: DataFrame, nodes: DataFrame, least: float, discard: bool) -> DataFrame:
    """All pairs of a key's nodes in different components: one of the two is always outside the key's most common one. Nodes that share
    many keys meet in the first of these only; if that isn't an open full key, they were compared before or are linked."""
    few = stored(nodes.join(small(stored(rows.select("node").distinct(), "open-nodes")), "node", "left_semi").select("node", "keys"), "open-keys-of")
    rows = rows.join(small(few), "node")
    other = rows.filter("root <> main")
    first = F.array_min(F.array_intersect("a.keys", "b.keys")) == F.col("a.key")
    once = (F.col("a.root") == F.col("a.main")) | (F.col("a.node") < F.col("b.node"))
    return possible(rows, F.broadcast(other) if other.count() <= BROADCAST_ROWS // 16 else other, least, discard, first, once)


def node_roots(docs: DataFrame, prints: DataFrame, words: int = 5, least: float = 0.8, hot: int = HOT, discard: bool = True) -> DataFrame:
    """(node, root) of every node that has a similar one."""
    one = [F.first(c).alias(c) for c in ("n", "fp", *ODDS, *KEPT, "keys")]
    nodes = stored(prints.filter("n > 0").groupBy("node").agg(*one), "nodes")
    every = nodes.select(F.explode("keys").alias("key"), "node", "n", "fp", *ODDS, *KEPT)
    shared = stored(every.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key"), "shared-keys")
    rows = stored(every.join(small(shared), "key"), "sharing")
    sets = shingle_sets(docs, prints, small(stored(rows.select("node").distinct(), "members")), words)
    rows = stored(linkable(rows, sets, least), "linkable")
    sizes = stored(rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "key-sizes")
    rows = stored(tabled(rows.join(small(sizes), "key").withColumn("root", F.col("node"))).drop("blocks"), "meeting")
    roots = components(verified(pairs_of(rows.filter(F.col("size") <= hot).drop("size"), least, discard), sets, least))
    full = rows.filter(F.col("size") > hot).drop("size")
    if full.isEmpty():
        return roots
    more = None
    for turn in range(STARS + 1):
        open_rows, n = unsettled(full, roots)
        if not n:
            break
        last = turn == STARS or n <= hot * open_rows.count() or (turn > 0 and more.isEmpty())
        more = of_roots(verified(across(open_rows, nodes, least, discard) if last else star(open_rows, turn, least, discard), sets, least), roots)
        roots = merged(roots, more)
        if last:
            break
    return roots


def near_copies(docs: DataFrame, words: int = 5, least: float = 0.8, hot: int = HOT, discard: bool = True) -> DataFrame:
    """doc_id, text_hash, component_id (the smallest doc_id reachable, itself included) and first (whether this is the row of
    its component with the smallest doc_id, of equal ones the one with the smallest text_hash) of every document row."""
    prints = stored(signatures(docs, words), "signatures")
    roots = node_roots(docs, prints, words, least, hot, discard)
    of_node = prints.groupBy("node").agg(F.count("*").alias("n")).join(roots, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root"))
    named = stored(spread_join(prints.select("doc_id", "text_hash", "node"), stored(of_node, "of-node"), "node"), "named")
    key = F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "text_hash")  # a row without doc_id stays only among such rows
    of_root = stored(named.groupBy("root").agg(F.count("*").alias("n"), F.min("doc_id").alias("component_id"), F.min(key).alias("least")), "of-root")
    return spread_join(named, of_root, "root").select("doc_id", "text_hash", "component_id", key.eqNullSafe(F.col("least")).alias("first"))
