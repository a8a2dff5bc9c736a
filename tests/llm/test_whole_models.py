"""Models and thresholds are fitted on all rows: against plain counts."""

import random
from collections import Counter

import pytest

from undula.llm import secrets, toxicity


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(31)
    pick = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    rows = [f'token = "{pick("0123456789abcdef", 24)}" and' for _ in range(900)] + [f'token = "ghp_{pick("GHIJKLMNOPghijklmnop0123456789", 30)}" or' for _ in range(900)]
    return rows + [f"see {'-'.join(pick('ghijklmnop', 6) for _ in range(4))}{i % 10} and" for i in range(3000)]


def test_every_credential_and_every_ordinary_run_counts(spark, texts):
    """More than the 400 credentials and 2,000 runs that were sampled once."""
    scans = secrets.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).cache()
    held = {r["w"]: r["held"] for r in scans.selectExpr("explode(labelled) as w").selectExpr("w", "pmod(xxhash64(w), 5) = 0 as held").collect()}
    runs = {x.split(":", 2)[2] for r in scans.collect() for x in r["found"]}
    assert len(held) > 1700 and len(runs) > 2500
    (found,) = secrets.fit(scans)
    assert sum(found.lengths.values()) == sum(not h for h in held.values())
    low = sorted(found.bits(w) for w, h in held.items() if h)
    ordinary = sorted(found.bits(w) for w in runs)
    low, top, tenth = low[len(low) // 20], ordinary[len(ordinary) * 99 // 100], ordinary[len(ordinary) * 9 // 10]
    assert low > tenth and found.least == (low + max(0.0, top if top < low else tenth)) / 2


def test_arcs_equal_a_plain_count(spark, texts):
    words = sorted({secrets.sealed(t.split('"')[1]) for t in texts if t.startswith("token")})
    got = secrets.arcs(spark.createDataFrame([("assign", w) for w in words], "kind string, word string"))["assign"]
    into, out = Counter(), Counter()
    for a, _, b, n in got:
        out[a] += n
        into[b] += n
    assert out[0] == len(words) and sum(n for *_, n in got) == sum(map(len, words))
    ends = {s: into[s] - out[s] for s in into if into[s] > out[s]}
    assert sum(ends.values()) == len(words) and all(into[s] >= out[s] for s in out if s)
    after = {(a, x): b for a, x, b, _ in got}
    assert len(after) == len(got)
    walked = Counter()
    for w in words:
        state = 0
        for at, c in enumerate(w):
            symbol = f"={c}" if at < secrets.LITERAL and (state, f"={c}") in after else secrets.Automaton.symbol(c, at)
            walked[state, symbol] += 1
            state = after[state, symbol]
    assert walked == {(a, x): n for a, x, _, n in got} and (0, "=g") in after


def test_toxicity_learns_from_long_texts_and_counts_every_stem(spark):
    """Texts of over 20,000 characters were left out of training once."""
    rng = random.Random(17)
    rows = []
    for i in range(160):
        w = [rng.choice("river stone cloud maple lantern harbor window garden".split()) + "".join(rng.choices("abcdefghij", k=3)) for _ in range(2600)]
        w[rng.randrange(2600)] = "grobnak" if i % 4 == 0 else "meadow"
        rows.append((i, " ".join(w), i % 4 == 0, i % 2 == 0))
    assert min(len(t) for _, t, *_ in rows) > 20_000
    d = spark.createDataFrame(rows, "doc_id long, text string, bad boolean, half boolean").repartition(5)
    grammar = toxicity.fit(d, d.selectExpr("doc_id", "int(bad) as toxic"))
    assert any("grobnak".startswith(p) for p in grammar.stems)
    plain = [toxicity.stems_of(t, toxicity.Wanted(None)) for _, t, *_ in rows]
    got = {r["stem"]: (r["n"], r["n_half"]) for r in toxicity.stem_counts(d).collect()}
    both = Counter(p for own in plain for p in own), Counter(p for own, r in zip(plain, rows, strict=True) if r[3] for p in own)
    assert got == {p: (n, both[1][p]) for p, n in both[0].items()} and got["riv+"] == (160, 80)


def test_copies_of_a_toxic_text_count_once(spark):
    texts = ["you are a grobnak and a fool today", "well you are a grobnak and a fool today ok", "another grobnak text of some words", "short one", "short one"]
    d = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, half boolean")
    kept = sorted(r["text"] for r in toxicity.without_copies(d).collect())
    assert len(kept) == 4 and kept[:1] == texts[2:3] and kept[1:3] == texts[3:]
