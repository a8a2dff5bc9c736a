"""Parities bound the similarity of near copies exactly."""

import random

import numpy as np

from tests.llm.test_near_copies import similarity
from undula.llm import near_copies


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(2)
    for n in (0, 1, 40, 900):
        h = rng.integers(0, 1 << 63, 2 * n + 5, np.uint64)
        a, b = h[: n + 3], h[n // 2 :]
        off = sum(bin(int(x) & (1 << 64) - 1).count("1") for x in near_copies.parities(a) ^ near_copies.parities(b))
        assert off <= len(np.setxor1d(a, b))


def test_copies_edited_a_little_too_much_are_no_candidates(spark):
    """200 copies of one text, 2 of 120 words changed in each: most pairs are between 0.7 and 0.8, few of these are compared and no similar pair is lost."""
    rng = random.Random(21)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for _ in range(200):
        w = list(base)
        for at in rng.sample(range(5, 115, 10), 2):
            w[at] = f"x{rng.randrange(10)}"
        texts.append(" ".join(w))
    texts = sorted(set(texts))
    similar = {(a, b) for b in range(len(texts)) for a in range(b) if similarity(texts[a], texts[b]) >= 0.8}
    prints = near_copies.signatures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    rows = near_copies.tabled(prints.drop("keys").selectExpr("*", "0 as key", "node as root", "n as m"))
    ids = {r["node"]: r["doc_id"] for r in prints.collect()}
    asked = {tuple(sorted((ids[r["a"]], ids[r["b"]]))) for r in near_copies.pairs_of(rows, 0.8, False).collect()}
    assert 100 < len(similar) and similar <= asked
    assert len(asked) < 200 * 199 / 2 / 3
