r"""Operator 8, quality rules with cross-document line frequency. DataFrame functions only.

Base, on every whole text (null: no words): words are `[^\x20\x09-\x0D]+`; code points in words; symbols; lines with a
word that equal an earlier line; words in 3-word windows that occur twice or more in the text.
Method: lines are normalised (A-Z lower-cased, digits as 0, white space as one space) and hashed; for each host (column
`source`) the distinct texts with each line are counted, copies of a text once; lines in more than `max_docs` texts of a
host are removed; a document that keeps fewer than `min_words` words or less than `min_share` of its words is rejected.

Repeated rows give repeated rows and count once. A null host is a host of its own. Three-word windows are compared by
64-bit hashes of their words, within one document. Line counts are summed before they are dealt, the frequent lines are
broadcast only up to BROADCAST_ROWS and else joined by shuffle, dealt over many tasks a line (common.dealt_join), so a line, text or host of a third of all rows meets in
no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm.common import dealt_join, lower_ascii, stored, table

SPACE = r"[\x20\x09-\x0D]+"
MAX_DOCS, MIN_WORDS, MIN_SHARE = 100, 50, 0.3
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def windows(w: Column) -> Column:
    """A hash for each window of three words; null below four words, where no window can occur twice."""
    return F.when(F.size(w) >= 4, F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1))))


def placed(grams: Column) -> Column:
    """Windows sorted by hash, then place; null where none occurs twice. A column of its own: neighbours are compared next."""
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))))


def covered(sorted_: str) -> Column:
    """Words in windows whose hash occurs twice or more: equal neighbours give places, places cover three words each."""
    n = F.size(sorted_)
    pairs = F.zip_with(F.slice(sorted_, F.lit(1), n - 1), F.slice(sorted_, F.lit(2), n - 1), lambda x, y: F.when(x["g"] == y["g"], F.array(x["i"], y["i"])))
    at = F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))
    return F.aggregate(at, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda acc, i: F.struct((acc["n"] + F.least(i - acc["last"], F.lit(3))).alias("n"), i.alias("last")), lambda acc: acc["n"])


def base(docs: DataFrame) -> DataFrame:
    """A row for each document row: the base figures, and its lines as (hash, words)."""
    d = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("source").cast("string").alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("w", words(F.col("text"))).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    normal = lambda x: F.regexp_replace(F.regexp_replace(F.trim(lower_ascii(x)), r"[0-9]", "0"), SPACE, " ")
    d = d.select(
        "row", "doc_id", "host", F.xxhash64("text").alias("copy"), F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows(F.col("w")).alias("grams"), F.transform("lines", lambda x: F.struct(F.xxhash64(normal(x)).alias("line"), F.size(words(x)).alias("words"))).alias("lines"),
    )
    d = d.withColumn("grams", placed(F.col("grams")))
    return d.select("row", "doc_id", "host", "copy", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.when(F.col("grams").isNull(), F.lit(0).cast("long")).otherwise(covered("grams")).alias("n_repeat_words"), "lines")


def quality(docs: DataFrame, max_docs: int = MAX_DOCS, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, the base figures, base_failed, kept_words (of lines within the limit) and kept."""
    d = stored(base(docs), "quality-base")
    texts = d.groupBy("host", "copy").agg(F.first("lines").alias("lines"))
    counts = texts.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    frequent = stored(counts.filter(F.col("n") > max_docs).select(F.coalesce("host", F.lit("\x00")).alias("host"), "line"), "frequent-lines")
    lines = d.select("row", F.coalesce("host", F.lit("\x00")).alias("host"), F.explode("lines").alias("x")).select("row", "host", "x.line", "x.words")
    met = lines.join(F.broadcast(frequent), ["host", "line"]) if frequent.count() <= BROADCAST_ROWS else dealt_join(lines, frequent, ["host", "line"], "row")
    lost = met.groupBy("row").agg(F.sum("words").alias("lost"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("lost", F.lit(0))
    out = d.join(lost, "row", "left").withColumn("base_failed", failed).withColumn("kept_words", left)
    kept = ~F.col("base_failed") & (F.col("kept_words") >= min_words) & (F.col("kept_words") >= min_share * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept_words", kept.alias("kept"))


def without_frequent_lines(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(doc_id, text) of every document row, lines beyond the limit removed from the text."""
    d = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("source").cast("string").alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    d = stored(d, "numbered")  # the numbers are joined back, so they are made once
    normal = F.regexp_replace(F.regexp_replace(F.trim(lower_ascii(F.col("part"))), r"[0-9]", "0"), SPACE, " ")
    lines = d.select("row", "doc_id", "host", F.xxhash64("text").alias("copy"), F.posexplode(F.split("text", "\n")).alias("pos", "part")).withColumn("line", F.xxhash64(normal))
    worded = lines.filter(F.col("part").rlike(r"[^\x20\x09-\x0D]"))
    counts = worded.select("host", "copy", "line").distinct().groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") > max_docs)
    frequent = counts.select(F.coalesce("host", F.lit("\x00")).alias("h"), "line", F.lit(True).alias("out"))
    kept = lines.withColumn("h", F.coalesce("host", F.lit("\x00"))).join(frequent, ["h", "line"], "left").filter(F.col("out").isNull())
    texts = kept.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "\n").alias("text"))
    return d.select("row", "doc_id").join(texts, "row", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


ORACLE = r"""
with d as (select row_number() over () rid, doc_id, source, coalesce(text, '') text from documents),
b as (select *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from d),
g as (select rid, s, array_to_string(w[s:s+2], ' ') g from (select rid, w, unnest(range(1, greatest(len(w) - 1, 1))) s from b)),
tw as (select rid, g from g group by all having count(*) > 1),
rep as (select rid, count(distinct p) n from (select g.rid, unnest(range(s, s + 3)) p from g join tw on g.rid = tw.rid and g.g = tw.g) group by rid),
l as (select rid, source, text, regexp_replace(regexp_replace(trim(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' '), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g') line, len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) n from (select rid, source, text, unnest(ls) x from b)),
f as (select source, line from l group by all having count(distinct text) > 100),
lost as (select rid, sum(n) n from l where exists (from f where f.line = l.line and f.source is not distinct from l.source) group by rid),
m as (select doc_id, cast(len(w) as bigint) n_words, cast(length(array_to_string(w, '')) as bigint) word_chars, cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) n_symbols,
  cast(len(ls) - len(list_distinct(ls)) as bigint) n_dup_lines, cast(coalesce(rep.n, 0) as bigint) n_repeat_words, cast(len(w) - coalesce(lost.n, 0) as bigint) kept_words from b left join rep using (rid) left join lost using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed, kept_words,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and kept_words >= 50 and kept_words >= 0.3 * n_words kept from m
"""
