"""Near copies: planted at 0.8 or more, against brute force, with and without full keys."""

import random

import corpus_pipeline
import pytest

from undula.llm import near_copies


def similarity(a, b):
    w = [x.lower().split() for x in (a, b)]
    p, q = ({tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} for x in w)
    return len(p & q) / len(p | q)


def planted(rng):
    """Distinct texts, each with three copies: two with edits apart, one with so many that it is another text."""
    rows = []
    for k in range(30):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 300))]
        for edits in (0, len(w) // 60, len(w) // 55, len(w) // 12):
            copy = list(w)
            for at in rng.sample(range(len(w)), edits):
                copy[at] = f"x{rng.randrange(5000)}"
            rows.append(" ".join(copy))
    return rows


@pytest.mark.parametrize("hot", [1, 64])
def test_components_equal_brute_force(spark, hot):
    texts = planted(random.Random(3))
    root = list(range(len(texts)))
    linked = True
    pairs = [(a, b) for b in range(len(texts)) for a in range(b) if similarity(texts[a], texts[b]) >= 0.8]
    while linked:
        linked = False
        for a, b in pairs:
            low = min(root[a], root[b])
            linked |= root[a] != root[b]
            root[a] = root[b] = low
    assert 30 < len(pairs) and len(set(root)) > 45
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(d, hot=hot).collect()}
    assert got == dict(enumerate(root))


def test_stage_drops_planted_near_copies(spark):
    rng = random.Random(8)
    w = [f"w{rng.randrange(5000)}" for _ in range(200)]
    near, far = list(w), list(w)
    for at in (20, 90, 160):
        near[at] = "edited"
    for at in range(5, 200, 12):
        far[at] = "edited"
    texts = [" ".join(w), " ".join(near), " ".join(far), None, ""]
    assert similarity(texts[0], texts[1]) >= 0.8 > similarity(texts[0], texts[2])
    d = spark.createDataFrame([(i + 1, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    kept = corpus_pipeline.drop_near_duplicates(spark, d, "")
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]


def test_empty_table(spark):
    assert near_copies.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_discarding_loses_no_planted_copy(spark):
    """With and without bits and minima the components are the same."""
    d = spark.createDataFrame(list(enumerate(planted(random.Random(11)))), "doc_id long, text string")
    a, b = ({(r["doc_id"], r["component_id"]) for r in near_copies.near_copies(d, discard=how).collect()} for how in (True, False))
    assert a == b and len({c for _, c in a}) < len(a)


def test_texts_that_share_a_passage_are_no_candidates(spark):
    """A group of texts that share half of their words: all meet in full keys, next to none is compared, and none is linked but the copy."""
    rng = random.Random(5)
    shared = [f"s{i}" for i in range(150)]
    texts = [" ".join(shared + [f"w{rng.randrange(10**6)}" for _ in range(150)]) for _ in range(120)]
    texts.append(texts[0] + " end")
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["component_id"], r["first"]) for r in near_copies.near_copies(d).collect()}
    assert got == {i: (0 if i == 120 else i, i != 120) for i in range(121)}
    prints = near_copies.signatures(d)
    rows = prints.drop("keys").withColumn("key", near_copies.F.lit(0)).withColumn("root", near_copies.F.col("node"))
    sets = near_copies.shingle_sets(d, prints, rows.select("node"), 5)
    left = near_copies.linkable(near_copies.tabled(rows), sets, 0.8)
    assert left.count() == 2 and near_copies.pairs_of(left, 0.8, False).count() == 1  # only the copy and its source may be linked


def test_edited_copies_make_few_candidates(spark, monkeypatch):
    """Copies of one text, each edited elsewhere and more and more: those near to it are linked, all others are not compared with each other."""
    rng = random.Random(15)
    base = [f"b{i}" for i in range(200)]
    texts = [" ".join(base)]
    for k in range(150):
        w = list(base)
        for at in rng.sample(range(0, 200, 6), 1 + k // 10):
            w[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    asked = []
    plain = near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda pairs, sets, least: asked.append(pairs.count()) or plain(pairs, sets, least))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(d, hot=20).collect()}
    near = {i for i, t in enumerate(texts) if similarity(texts[0], t) >= 0.8}
    assert {i for i, c in got.items() if c == 0} == near and 20 < len(near) < 130
    assert sum(asked) < 151 * 150 / 2 / 3


def test_very_long_texts_and_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "TILE_PAIRS", 2)
    rng = random.Random(6)
    long = [f"w{rng.randrange(10**6)}" for _ in range(30_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:-40])), (3, " ".join(long[15_000:])), (4, "a b"), (5, "a b"), (6, None)]
    rows += [(10 + i, " ".join(f"{i // 4}v{j}" for j in range(100 + i % 4))) for i in range(40)]
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6} | {10 + i: 10 + i // 4 * 4 for i in range(40)}


def test_links_grow_with_the_number_of_near_copies(spark, monkeypatch):
    """150 copies of one text, each with one other word: nearly all 11,175 pairs are similar, but few are needed to link them."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(200)]
    texts = [" ".join([*base[:at], f"x{rng.randrange(10**6)}", *base[at + 1 :]]) for at in rng.sample(range(200), 150)]
    asked = []
    plain = near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda pairs, sets, least: asked.append(pairs.count()) or plain(pairs, sets, least))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["component_id"] for r in near_copies.near_copies(d).collect()} == {0}
    assert 149 <= sum(asked) < 11_175 / 3
