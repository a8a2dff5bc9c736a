"""Operator 6's components without the links inside components: the same as by brute force, from few links."""

import numpy as np
import pytest

from undula.llm import simhash_dedup


@pytest.mark.parametrize("hot", [20, 256])
def test_a_dense_group_is_linked_by_few_links(spark, monkeypatch, hot):
    rng = np.random.default_rng(hot)
    fps = set()
    for b in rng.integers(0, 1 << 62, 3).tolist():  # clouds, each with a part that no one link reaches
        for far in (0, 0b111111 << 40):
            fps |= {b ^ far ^ sum(1 << int(k) for k in rng.choice(10, 2, replace=False)) for _ in range(400)} | {b ^ far}
        fps |= {b ^ 0b111 << 40}
    fps |= set(rng.integers(0, 1 << 62, 200).tolist())
    fps = sorted(fps)
    pairs = [(a, b) for k, a in enumerate(fps) for b in fps[k + 1 :] if (a ^ b).bit_count() <= 3]
    root, changed = {f: f for f in fps}, True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            changed |= root[a] != root[b]
            root[a] = root[b] = low
    given = []
    plain = simhash_dedup.components
    monkeypatch.setattr(simhash_dedup, "components", lambda edges: given.append(edges.count()) or plain(edges))
    monkeypatch.setattr(simhash_dedup, "HOT", hot)
    got = {r["node"]: r["root"] for r in simhash_dedup.linked_roots(spark.createDataFrame([(f,) for f in fps], "fp long"), hot=hot).collect()}
    assert {f: got.get(f, f) for f in fps} == root
    assert sum(given) < len(pairs) / 2


def test_components_of_documents_need_few_links(spark, monkeypatch):
    """The operator itself: 45 fingerprints within two bits of one another, each of 990 pairs a link."""
    fps = [sum(1 << int(k) for k in pair) for pair in zip(*np.triu_indices(10, 1), strict=True)]
    given = []
    plain = simhash_dedup.components
    monkeypatch.setattr(simhash_dedup, "components", lambda edges: given.append(edges.count()) or plain(edges))
    monkeypatch.setattr(simhash_dedup, "fingerprints", lambda docs, words: spark.createDataFrame(list(enumerate(fps + [0])), "doc_id long, fp long"))
    out = simhash_dedup.dedup_components(None).collect()
    assert len(out) == 46 and {r["component_id"] for r in out} == {0}
    assert 0 < sum(given) < 200
