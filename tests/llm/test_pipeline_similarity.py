"""The pipeline's rows against a plain version whose near copies are texts with an exact five-word similarity of 0.8 or more; recall of planted copies; empty tables."""

import base64
import os
import random
import re

import duckdb
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tests.llm.test_near_copies import similarity  # noqa: E402
from tests.llm.test_text_operators import plain_secrets, sentence, words_of  # noqa: E402
from undula.llm import toxicity  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_pipeline_equals_plain_stages_with_similar_texts(spark):
    import public_tokenizers as P

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    grammar = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{DATA}/labels.parquet"))
    left = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    left = {i: t for i, t in left.items() if grammar.score(t) < 0.5}
    root, linked = {i: i for i in left}, True
    pairs = [(a, b) for a in left for b in left if a < b and (left[a].split() == left[b].split() or left[a].split() and left[b].split() and similarity(left[a], left[b]) >= 0.8)]
    while linked:
        linked = False
        for a, b in pairs:
            linked |= root[a] != root[b]
            root[a] = root[b] = min(root[a], root[b])
    assert pairs
    left = {i: t for i, t in left.items() if root[i] == i}
    windows = set()
    for (text,) in duckdb.sql(f"select text from '{DATA}/benchmark.parquet'").fetchall():
        w = words_of(text)
        windows |= {" ".join(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x.split()) for x in windows}
    bad = lambda w: any(" ".join(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))
    left = {i: t for i, t in left.items() if not bad(words_of(t))}
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert set(out) == set(left)
    plain = {int(b): base64.b64decode(a) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    for i, r in out.items():
        text = b"".join(plain[t] for t in r["token_ids"]).decode()
        assert len(r["token_ids"]) == r["n_tokens"] and not plain_secrets(text)
        parts = [re.escape(p) for p in text.split("[secret]")]
        assert re.fullmatch(".*?".join(parts), left[i], re.S)  # nothing but secrets is gone


def test_recall_of_planted_near_copies(spark):
    rng = random.Random(21)
    rows, copies = [], []
    for k in range(40):
        w = sentence(rng, 150).split() + [f"u{k}x{j}" for j in range(60)]
        rng.shuffle(w)
        near = list(w)
        for at in rng.sample(range(len(w)), 4):
            near[at] = "edited"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(near))]
        copies += [2 * k + 1] * (similarity(" ".join(w), " ".join(near)) >= 0.8)
    assert len(copies) > 30
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert kept == {i for i, _ in rows} - set(copies)


def test_stages_of_empty_documents(spark, tmp_path):
    base = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    assert corpus_pipeline.run(spark, base).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, spark.read.parquet(f"{base}/documents.parquet"), base).columns == ["doc_id", "text", "lang", "source", "n_chars"]
