"""The pipeline's stages and what odd rows become in them (test_pipeline_similarity.py holds its rows to a plain version)."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "encoding"]


def test_stages_keep_odd_rows(spark, tmp_path):
    """Null and empty texts, null ids, repeated rows and extra columns pass; copies leave one row."""
    base = str(tmp_path)
    rows = [(1, "one fine text about stones and rivers in the garden", "en", "a", 5, "x"), (2, None, "en", "a", 0, "y"), (3, "", None, None, 0, "z"), (4, "another text with other words altogether here today", "en", "b", 9, "w"), (4, "another text with other words altogether here today", "en", "b", 9, "w")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, "fine text about stones and rivers in the garden near here")], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    out = sorted(r["doc_id"] for r in corpus_pipeline.run(spark, base).collect())
    assert out == [1, 2, 4]


def test_one_doc_id_with_different_texts_loses_none(spark):
    """(1, A) stands for (5, A); (5, B) is near to nothing and stays; of repeated rows the one with the least other columns."""
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(30)) for k in "abcd")
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "y"), (5, b, "w"), (6, c, "x"), (None, b + " more", "x"), (None, d, None), (None, d, None)]
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "")
    assert sorted((tuple(r) for r in kept.collect()), key=repr) == sorted([(1, a, "x"), (5, b, "w"), (6, c, "x"), (None, d, None)], key=repr)
