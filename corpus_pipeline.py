"""A corpus pipeline of five stages over documents; each takes what the one before kept.

toxicity: documents that the grammar scores 0.5 or more go. near_duplicates: of documents linked by an exact
similarity of five-word shingles of 0.8 or more one stays, the one with the smallest doc_id. decontamination: documents with
a benchmark window go. secrets: spans are replaced by a mark, no document goes. encoding: doc_id and the BPE ids, their number and digests, of what is left.

Nulls: a null or empty text is not toxic, not contaminated and has no secrets; all such texts are copies of each other.
Rows that repeat a doc_id and its text stay one row after near_duplicates, rows with one doc_id and different texts stay
both unless the texts are near; the other stages drop by doc_id. An empty table passes through. Extra columns of documents
are kept by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm.bpe_codec import encode_documents
from undula.llm.common import stored, table
from undula.llm.decontamination import Index, small
from undula.llm.near_copies import near_copies
from undula.llm.secrets import redact
from undula.llm.toxicity import fit, toxicity


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the doc_ids in gone; rows whose doc_id is null stay. Up to a counted size the ids are broadcast, so no text is shuffled."""
    return docs.join(small(gone.select("doc_id").distinct()), "doc_id", "left_anti").select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Labels are learned from the documents as they came in, held-out rows not used."""
    scored = toxicity(docs, fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return without(docs, stored(scored.filter("predicted = 1").select("doc_id"), "toxic"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are told apart by doc_id and text, so different texts under one doc_id are linked and dropped each for itself. Rows
    with the same doc_id and text become one, the least of their other columns."""
    found = stored(near_copies(docs, words=5, least=0.8), "members")
    row, hashed = ["doc_id", "text_hash"], docs.withColumn("text_hash", F.xxhash64("text"))
    same = lambda of: F.col("doc_id").eqNullSafe(of["_id"]) & (F.col("text_hash") == of["_hash"])
    named = lambda d: small(d.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    gone = named(found.filter(~F.col("first")))
    kept = hashed.join(gone, same(gone), "left_anti")
    repeated = stored(found.filter("first").groupBy(*row).count().filter("count > 1"), "repeated")
    if repeated.isEmpty():
        return kept.select(docs.columns)
    repeated = named(repeated)
    rest = F.struct(*(c for c in docs.columns if c not in row))
    again = kept.join(repeated, same(repeated), "left_semi").groupBy(*row).agg(F.min(rest).alias("r")).select("doc_id", "r.*")
    return kept.join(repeated, same(repeated), "left_anti").select(docs.columns).unionByName(again.select(docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    report = Index(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).report()
    return without(docs, stored(report.filter("contaminated").select("doc_id"), "contaminated"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("encoding", encode),
]
#: Scores, fingerprints, automata and BPE ids have no SQL form; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each one's rows written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids")
