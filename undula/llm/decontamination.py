r"""Operator 2, benchmark decontamination with a distributed positional inverted index. DataFrame functions only.

1. Index: every document word that any benchmark item uses becomes a posting (term, row, position), written once in the
   shared folder; one more posting per document, of a term no text can have, keeps its length and its doc_id.
2. Windows: `window` consecutive item words (a shorter item is one window), each distinct one once, with its terms in
   order of their number of postings.
3. Intersection: postings of a window's rarest term, moved back by its offset, are candidate starts; they are kept if
   the second rarest term stands at its own offset, and then if all other terms do. Hits are exact phrases. near_matches
   finds passages whose terms stand within `slop` words of their places, one term of longer windows missing or changed.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z is lower-cased. Null and empty texts have no words and no hits;
repeated rows give repeated rows; an empty benchmark hits nothing. No posting is capped or left out, and no list of one
term meets in one task: postings are dealt by (row, position), and counts are summed before they are dealt.

What is broadcast: the benchmark's distinct words, and its windows, only up to BROADCAST_ROWS; beyond that the same
joins are shuffled, and rows of frequent words, terms and windows are dealt over many tasks (common.dealt_join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from undula.llm.common import HOT_SHARE, dealt_join, hot_keys, lower_ascii, stored, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of (long, long or short string) that a broadcast may have: some 40 MB at most.
BROADCAST_ROWS = 500_000
END = "\x00"
#: Words that a window needs before a term of it may be missing from a near match.
MISS_LEN = 5


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NO_WORD), "")


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its counted rows allow it; else Spark shuffles the join."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def fits(df: DataFrame) -> bool:
    return df.count() <= BROADCAST_ROWS


class Index:
    """Postings of a corpus for the terms of a benchmark, and the benchmark's windows."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, window: int = 10):
        self.items = stored(benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).filter(F.size("w") > 0).distinct(), "items")
        vocabulary = self.items.select(F.explode("w").alias("word")).distinct().select("word", F.xxhash64("word").alias("term"))
        vocabulary = stored(vocabulary.unionByName(docs.sparkSession.createDataFrame([(END, 0)], "word string, term long")), "terms")
        numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
        placed = numbered.select("row", "doc_id", F.posexplode(F.concat(words(F.col("text")), F.array(F.lit(END)))).alias("pos", "word"))
        met = placed.join(F.broadcast(vocabulary), "word") if fits(vocabulary) else dealt_join(placed, vocabulary, ["word"], "row")
        self.postings = stored(met.select("term", "row", "pos", F.when(F.col("word") == END, F.col("doc_id")).alias("doc_id")), "postings")
        self.ends = self.postings.filter("term = 0").select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
        counts = stored(self.postings.filter("term <> 0").groupBy("term").agg(F.count("*").alias("n")), "counts")
        self.counts = counts
        starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
        spans = self.items.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", F.slice("w", F.col("at") + 1, window).alias("w"))
        self.of_item = spans.select("item_id", F.xxhash64(F.array_join("w", " ")).alias("wid")).distinct()
        terms = spans.select(F.xxhash64(F.array_join("w", " ")).alias("wid"), "w").dropDuplicates(["wid"]).select("wid", F.size("w").alias("len"), F.posexplode("w").alias("off", "word"))
        self.ranked = terms.withColumn("term", F.xxhash64("word")).join(counts, "term", "left")
        ranked = self.ranked.withColumn("least", F.min(F.coalesce("n", F.lit(0))).over(Window.partitionBy("wid"))).filter("least > 0")  # a term nobody uses: no hit
        self.windows = stored(ranked.select("wid", "len", "off", "term", F.row_number().over(Window.partitionBy("wid").orderBy("n", "off")).alias("nth")), "windows")

    def at(self, nth: int) -> DataFrame:
        """Starts that the nth rarest terms of the windows propose: their postings moved back by their offsets."""
        asked = self.windows.filter(F.col("nth") == nth)
        if fits(asked):
            met = self.postings.join(F.broadcast(asked), "term")
        else:
            total = self.counts.agg(F.sum("n")).first()[0] or 0
            met = dealt_join(self.postings, asked, ["term"], "row", self.counts.filter(F.col("n") > HOT_SHARE * total))
        return met.select("wid", "len", "row", (F.col("pos") - F.col("off")).alias("at"))

    @staticmethod
    def by_window(starts: DataFrame, of_window: DataFrame) -> DataFrame:
        """starts joined with rows of windows; a passage that many documents have is no single task's."""
        return starts.join(F.broadcast(of_window), "wid") if fits(of_window) else dealt_join(starts, of_window, ["wid"], "row", hot_keys(starts, "wid"))

    def exact(self) -> DataFrame:
        """(wid, len, row, at) of every occurrence of every window."""
        first = self.at(1).filter("at >= 0")
        both = first.filter("len > 1").join(self.at(2).select("wid", "row", "at"), ["wid", "row", "at"])
        both = stored(both.select("wid", "len", "row", "at").unionByName(first.filter("len = 1")), "starts")
        rows = both.filter("len > 2").select("row").distinct()
        near = self.postings.join(small(rows), "row", "left_semi").filter("term <> 0").select("term", "row", "pos")
        asked = self.by_window(both.filter("len > 2"), self.windows.filter("nth > 2").select("wid", "off", "term")).select("wid", "len", "row", "at", "term", (F.col("at") + F.col("off")).alias("pos"))
        whole = asked.join(near, ["term", "row", "pos"]).groupBy("wid", "len", "row", "at").agg(F.count("*").alias("n")).filter("n = len - 2")
        return whole.select("wid", "len", "row", "at").unionByName(both.filter("len <= 2").select("wid", "len", "row", "at"))

    def near_matches(self, slop: int = 3, miss: int = 1) -> DataFrame:
        """(doc_id, item_id, at) where all terms of a window stand within `slop` words of their places, those of an exact hit
        left out. Of windows of MISS_LEN words or more, `miss` terms may be missing. `at` is the start that a term proposes.

        So two of the miss + 2 rarest terms agree on a start within `slop`; these starts are candidates, and all terms are
        then looked up around them."""
        may = F.when(F.col("len") >= MISS_LEN, F.lit(miss)).otherwise(F.lit(0))
        by_window = Window.partitionBy("wid")
        seen = self.ranked.filter("n > 0").withColumn("nth", F.row_number().over(by_window.orderBy("n", "off"))).withColumn("n_seen", F.count("*").over(by_window))
        seen = stored(seen.withColumn("need", F.col("len") - may).filter("len > 1 and n_seen >= need").select("wid", "len", "need", "off", "term", "nth"), "near-windows")
        rare = small(seen.filter(F.col("nth") <= F.col("len") - F.col("need") + 2))
        starts = stored(self.postings.join(rare, "term").select("wid", "len", "need", "nth", "row", (F.col("pos") - F.col("off")).alias("at")), "near-starts")
        cells = F.sequence(F.floor((F.col("at") - slop) / (slop + 1)), F.floor((F.col("at") + slop) / (slop + 1)))
        first = starts.withColumn("cell", F.explode(cells))
        second = starts.select("wid", "row", F.col("nth").alias("nth2"), F.col("at").alias("at2"), F.floor(F.col("at") / (slop + 1)).alias("cell"))
        agreed = first.join(second, ["wid", "row", "cell"]).filter((F.col("nth") != F.col("nth2")) & (F.abs(F.col("at") - F.col("at2")) <= slop))
        agreed = stored(agreed.select("wid", "need", "row", "at").distinct(), "near-agreed")
        asked = agreed.join(small(seen.select("wid", "off", "term")), "wid").withColumn("pos", F.explode(F.sequence(F.col("at") + F.col("off") - slop, F.col("at") + F.col("off") + slop)))
        postings = self.postings.join(small(agreed.select("row").distinct()), "row", "left_semi").filter("term <> 0").select("term", "row", "pos")
        found = asked.join(postings, ["term", "row", "pos"]).groupBy("wid", "need", "row", "at", "off").agg(F.count("*").alias("places")).groupBy("wid", "need", "row", "at").agg(F.count("*").alias("n")).filter("n >= need")
        hits = self.exact().select("wid", "row", F.col("at").alias("hit"))
        other = found.join(hits, (found.wid == hits.wid) & (found.row == hits.row) & (F.abs(found.at - hits.hit) <= slop), "left_anti")
        return other.join(self.ends, "row").join(small(self.of_item), "wid").select("doc_id", "item_id", F.col("at").cast("long").alias("at")).distinct()

    def report(self) -> DataFrame:
        """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document row."""
        hits = stored(self.exact(), "hits")
        covered = hits.select("row", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("len") - 1)).alias("pos")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
        items = self.by_window(hits.select("row", "wid").distinct(), self.of_item).groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
        out = self.ends.join(covered, "row", "left").join(items, "row", "left")
        listed = F.coalesce(F.col("items"), F.array().cast("array<string>"))
        return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Index(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).report()


def op2_near_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_near: the places of near matches of every document that has any."""
    index = Index(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return index.near_matches().groupBy("doc_id").agg(F.countDistinct("at").alias("n_near"), F.countDistinct("item_id").alias("n_items"))


ORACLE = r"""
with dw as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from documents),
iw as (select cast(item_id as varchar) item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from benchmark),
win as (select distinct item_id, array_to_string(w[s:s+9], ' ') g, least(len(w), 10) n from (select item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) s from iw where len(w) > 0)),
sizes as (select distinct n from win),
grams as (select doc_id, s, n, array_to_string(w[s:s+n-1], ' ') g from (select doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) s from dw, sizes)),
hits as (select doc_id, s, n, item_id from grams join win using (g, n)),
hit as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(s, s + n)) p from hits) group by doc_id),
its as (select doc_id, count(distinct item_id) n_items, string_agg(distinct item_id, ',' order by item_id) l from hits group by doc_id)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(l, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from dw left join hit using (doc_id) left join its using (doc_id)
"""
