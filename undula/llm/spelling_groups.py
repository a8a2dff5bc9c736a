r"""Operator 12, spelling variants: words of a corpus that differ by one code point, grouped under their commonest form.

Words: maximal runs `[A-Za-zÀ-ÿ]+` of whole texts, A-Z in lower case. Where 97 divides the CRC-32 of
`<doc_id>:<run>`, the run loses its code point number CRC modulo length. Results of LEAST_LEN code points or more with
LEAST_ROWS occurrences or more in all documents are the vocabulary.

Dense prefix-suffix tiling. Words of a block stand in two padded code-point matrices, from the left and from the right;
tiles of the block, pair by pair, give the lengths of the common prefix p and suffix s, and the two words are one edit
apart just if p + s reaches the longer length less one.

Blocks. Two such words, the longer of m code points, agree outside a window of their code points that holds the edit. A
window that is cut in two holds it in one half, and then the words agree in the other half too. So a word enters, for each
kind of pair (both of m code points; one of m, one of m - 1), the two blocks of words that share all but one half of it.
Blocks of over BLOCK words are not dealt: their windows are cut again, until one code point is left, where a block has no
more words than there are code points. No pair is lost or met twice: the windows of a kind don't overlap, and a
pair counts in the one where its common prefix ends. A block's pairs stay in its task; it emits a row for each word with
its number of near words and the best of them. So nothing grows with the square of a group.

form: the near word of largest n, the first in code-point order of equals, if its n is twice the word's or more. root: the end of the
chain of forms, by pointer jumping; n doubles at each step, so chains have no circles and some 40 steps at most.

Null and empty texts have no words. A null doc_id counts as an empty one in the CRC. Repeated rows count as often as they
occur. No rows: no result. Very long runs are words like others; tiles shrink with their length. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm.common import arrow_map, batch, spread_join, stored, table
from undula.llm.decontamination import small

LEAST_LEN, LEAST_ROWS, ONE_IN = 5, 3, 97
#: Words of a block that is compared; comparisons of a tile, in code points; words that a task counts before it emits them.
BLOCK, TILE, HELD = 256, 1 << 21, 200_000
RUN = re.compile("[a-zÀ-ÿ]+").findall


def variants(doc_id: int | None, text: str, one_in: int = ONE_IN) -> Iterator[tuple[str, int]]:
    """The words of a text, some with a code point deleted, and how often each run occurs."""
    start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(RUN(text.encode().lower().decode())).items():  # bytes: just A-Z
        if len(run) >= LEAST_LEN:
            h = crc32(run.encode(), start)
            at = h % len(run)
            yield (run if h % one_in else run[:at] + run[at + 1 :]), n


def vocabulary(docs: DataFrame, one_in: int = ONE_IN, least: int = LEAST_ROWS) -> DataFrame:
    """(word, n) of all words with enough occurrences. A task sums its documents' counts before they are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for word, n in variants(doc_id, text or "", one_in):
                    if len(word) >= LEAST_LEN:
                        held[word] += n
            if len(held) > HELD:
                yield batch({"word": (list(held), pa.string()), "n": (list(held.values()), pa.int64())})
                held.clear()
        yield batch({"word": (list(held), pa.string()), "n": (list(held.values()), pa.int64())})

    counted = arrow_map(docs.select("doc_id", "text"), run, "word string, n long")
    return stored(counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "vocabulary")


def padded(words: list[str], width: int, right: bool) -> np.ndarray:
    """Code points of the words, at the left or at the right of a row of zeros."""
    out = np.zeros((len(words), width), np.uint8)  # no code point of a run is over 255
    for row, w in zip(out, words, strict=True):
        row[width - len(w) if right else 0 : width if right else len(w)] = np.frombuffer(w.encode("latin-1"), np.uint8)
    return out


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many columns of each row of a equal those of each row of b before the first that differs; rows that are equal throughout count as 0."""
    return (a[:, None] == b[None]).argmin(2)


def edits(words: list[str], m: int, mixed: bool, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Places (i, j), i < j, of the words one edit apart whose edit is in the window that leaves a code points before and b behind; mixed: of two lengths."""
    rows = max(1, int((TILE / m) ** 0.5))
    parts = [words[i : i + rows] for i in range(0, len(words), rows)]
    tiles = [(padded(p, m, False), padded(p, m, True)[:, ::-1], np.array([len(w) for w in p])) for p in parts] if len(words) * m <= TILE else None
    made = lambda k: tiles[k] if tiles else (padded(parts[k], m, False), padded(parts[k], m, True)[:, ::-1], np.array([len(w) for w in parts[k]]))
    for x in range(len(parts)):
        left, right, size = made(x)
        for y in range(x, len(parts)):
            left2, right2, size2 = made(y)
            prefix, suffix = common(left, left2), common(right, right2)
            near = (prefix + suffix >= m - 1) & (prefix >= a) & (prefix < m - b) & ((size[:, None] != size2[None]) == mixed)
            for i, j in np.argwhere(near).tolist():
                if x * rows + i < y * rows + j:
                    yield x * rows + i, y * rows + j


def blocks(words: DataFrame, block: int) -> Iterator[DataFrame]:
    """(m, mixed, a, b, members) of the blocks of two words or more, by how often their windows were cut."""
    size = F.length("word")
    kinds = F.array(*(F.struct(m.alias("m"), F.lit(mixed).alias("mixed")) for m, mixed in ((size, False), (size, True), (size + 1, True))))
    rows = words.select("word", "n", F.explode(kinds).alias("k")).select("word", "n", "k.m", "k.mixed", F.lit(0).alias("a"), F.lit(0).alias("b"))
    while True:
        left = F.col("m") - F.col("a") - F.col("b")
        half = F.floor(left / 2).cast("int")
        cut = F.array(F.struct(F.col("a").alias("a"), (F.col("b") + left - half).alias("b")), F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b")))
        rows = rows.select("word", "n", "m", "mixed", F.explode(cut).alias("w")).select("word", "n", "m", "mixed", "w.a", "w.b")
        shared = F.expr("xxhash64(m, mixed, a, b, substring(word, 1, a), substring(word, length(word) - b + 1, b))")
        rows = stored(rows.withColumn("key", shared), "windows")
        keys = stored(rows.groupBy("key").agg(F.count("*").alias("rows"), F.max(F.col("m") - F.col("a") - F.col("b")).alias("left")).filter("rows > 1"), "block-sizes")
        full = keys.filter((F.col("rows") > block) & (F.col("left") > 1)).select("key", "rows")
        rest = rows.join(small(keys.filter((F.col("rows") <= block) | (F.col("left") <= 1)).select("key")), "key")
        yield rest.groupBy("key", "m", "mixed", "a", "b").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("members"))
        if full.isEmpty():
            return
        rows = spread_join(rows, full, "key", "rows").select("word", "n", "m", "mixed", "a", "b")


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best): of each word that has near words their number and the best one as (minus its n, itself)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"word": [], "n_near": [], "minus": [], "other": []}
            for m, mixed, a, z, members in zip(*(c.to_pylist() for c in b.columns), strict=True):
                texts, counts = [x["word"] for x in members], [x["n"] for x in members]
                found: dict[int, list] = {}
                for pair in edits(texts, m, mixed, a, z):
                    for i, j in (pair, pair[::-1]):
                        best = found.setdefault(i, [0, (1, "")])
                        best[0] += 1
                        best[1] = min(best[1], (-counts[j], texts[j]))
                for i, (n, (minus, other)) in found.items():
                    for name, v in zip(out, (texts[i], n, minus, other), strict=True):
                        out[name].append(v)
            yield batch({name: (v, pa.int64() if name in ("n_near", "minus") else pa.string()) for name, v in out.items()})

    met = [stored(arrow_map(b.select("m", "mixed", "a", "b", "members"), run, "word string, n_near long, minus long, other string"), "near") for b in blocks(words, block)]
    every = met[0]
    for one in met[1:]:
        every = every.unionByName(one)
    return every.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("minus", "other")).alias("best"))


def ends(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the last form of each chain. Each round doubles the steps that are seen."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        beyond = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        further = now.groupBy("root").agg(F.count("*").alias("n")).join(beyond, "root")  # roots that have a form themselves
        further = stored(further, "beyond")
        if further.isEmpty():
            return now
        moved = spread_join(now, further, "root").select("word", F.col("beyond").alias("root"))
        stay = now.join(small(further.select("root")), "root", "left_anti").select("word", "root")
        now = stored(moved.unionByName(stay), "roots")


def spelling_groups(docs: DataFrame, one_in: int = ONE_IN, least: int = LEAST_ROWS, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of the vocabulary."""
    words = vocabulary(docs, one_in, least)
    known = stored(words.join(near_words(words, block), "word", "left"), "near-words")
    good = -F.col("best.minus") >= 2 * F.col("n")
    formed = known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best.other")).alias("form"), F.when(good, -F.col("best.minus")).alias("form_n"))
    roots = ends(formed.filter("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))


ORACLE = """
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda k: list_reduce(list_prepend(k, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY ALL
), texts AS (
  SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i::INT + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS h FROM texts, tab
), changed AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed
), v AS (
  SELECT word, sum(n)::BIGINT AS n FROM changed WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), dels AS (
  SELECT word, i, left(word, i::INT) || substr(word, i::INT + 2) AS d FROM (SELECT word, unnest(range(length(word))) AS i FROM v)
), pairs AS (
  SELECT a.word, b.word AS other FROM dels a JOIN dels b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word FROM dels a JOIN v b ON a.d = b.word
  UNION SELECT b.word, a.word FROM dels a JOIN v b ON a.d = b.word
), best AS (
  SELECT p.word, count(*) AS n_near, min((-o.n, o.word)) AS b FROM pairs p JOIN v o ON o.word = p.other GROUP BY p.word
), formed AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 2 * v.n THEN b[2] END AS form, CASE WHEN -b[1] >= 2 * v.n THEN -b[1] END AS form_n
  FROM v LEFT JOIN best ON best.word = v.word
), chain AS (
  SELECT word, word AS root, form FROM formed
  UNION ALL
  SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.form
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON c.word = f.word AND c.form IS NULL
"""
