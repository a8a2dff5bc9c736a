"""Cases of hot keys, calibration, formats, transducers, broken pages and odd columns, each against brute force or planted truth."""

import random
import time

import numpy as np
import pytest

from tests.llm.test_text_operators import WORDS, sentence, words_of
from undula.llm import bpe_codec, common, decontamination, html_text, language_id, pii, quality_rules, secrets, simhash_dedup, token_counts, toxicity

ODD = "doc_id long, text string, lang string, source string, n_chars long, row string, word string, pos int, node long, key string, fp string, base string, symbol string, held_out string"


def odd(rows):
    return [(i, t, "en", "s", 0, *["clash"] * 2, 1, 2, *["clash"] * 5) for i, t in rows]


def test_shuffled_branches_equal_broadcast_ones(spark, monkeypatch):
    rng = random.Random(11)
    passage = sentence(rng, 14)
    docs = spark.createDataFrame([(i, sentence(rng, 30) + " " + (passage if i % 3 == 0 else sentence(rng, 3)) + "\nmenu line", "a") for i in range(60)], "doc_id long, text string, source string")
    bench = spark.createDataFrame([(1, passage), (2, sentence(rng, 3)), (3, WORDS[0])], "item_id long, text string")
    want = sorted(map(tuple, decontamination.Index(docs, bench).report().collect()))
    frequent = sorted(map(tuple, quality_rules.quality(docs, max_docs=20).collect()))
    assert sum(r[5] for r in want) >= 20 and any(r[7] < r[1] for r in frequent)
    for module in (decontamination, quality_rules):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    for module in (common, decontamination):
        monkeypatch.setattr(module, "HOT_SHARE", 0.02)
    assert sorted(map(tuple, decontamination.Index(docs, bench).report().collect())) == want
    assert sorted(map(tuple, quality_rules.quality(docs, max_docs=20).collect())) == frequent


@pytest.mark.parametrize("share", [0.002, 0.2])
def test_spread_join_keeps_every_row(spark, monkeypatch, share):
    monkeypatch.setattr(common, "HOT_SHARE", share)
    rows = spark.createDataFrame([(i, 0 if i % 3 else i) for i in range(300)], "id long, k long")
    names = rows.groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "k * 2 name")
    got = sorted(map(tuple, common.spread_join(rows, names, "k").select("id", "k", "name").collect()))
    assert got == [(i, 0 if i % 3 else i, 0 if i % 3 else 2 * i) for i in range(300)]


def test_pairs_come_from_pivot_cells_and_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    fps = set()
    for b in rng.integers(0, 1 << 63, 40).tolist():
        fps.add(b)
        for _ in range(10):
            fps.add(b ^ sum(1 << int(k) for k in rng.choice(63, int(rng.integers(1, 6)), replace=False)))
    fps = sorted(fps)
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 3}
    d = spark.createDataFrame([(f,) for f in fps], "fp long")
    assert len(want) > 50 and {(r["a"], r["b"]) for r in simhash_dedup.links(d).collect()} == want
    for r in simhash_dedup.tabled(d).collect():  # the packed coordinates are what the distances say
        for k in range(32):
            c = (r["fp"].bit_count() - (r["fp"] ^ 3 << 2 * k).bit_count() + 2) // 2
            assert (r["blocks"] >> 2 * k) & 3 == c


def test_adjacent_tokens_equal_plain_merging():
    import public_tokenizers as P

    codec = bpe_codec.Codec(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read(), P.PATTERN)
    rng, ids = random.Random(1), list(codec.bytes_of)
    for _ in range(5000):
        a, b = rng.choice(ids), rng.choice(ids)
        x, y = codec.bytes_of[a], codec.bytes_of[b]
        assert codec.separate(a, b) == (codec.merged(x + y) == [x, y])
    small = codec.encode(["abc", "", "river stone " * 50])
    assert [len(g) for g in bpe_codec.groups(["x" * 5, "y" * 5, "z" * 50, "w"], 10)] == [2, 1, 1] and small[1][1] == small[1][2]


def test_temperature_is_inside_the_range_and_calibrates():
    rng = np.random.default_rng(4)
    y = rng.integers(0, 3, 4000)
    z = rng.standard_normal((4000, 3))
    z[np.arange(4000), y] += 1.5
    for scale in (0.01, 1.0, 300.0):  # the same logits on any scale, over- or underconfident
        p = language_id.softmax(z * scale / language_id.temperature(z * scale, y))
        right = p.argmax(1) == y
        assert abs(p.max(1).mean() - right.mean()) < 0.02
    sure = np.eye(3)[y] * 8.0
    confidence = language_id.softmax(sure / language_id.temperature(sure, y)).max(1).mean()
    assert 0.99 < confidence < 1.0


def test_class_sample_keeps_rare_labels(spark):
    d = spark.range(3000).selectExpr("id", "case when id < 12 then 'rare' when id < 1000 then 'mid' else 'most' end label")
    got = common.class_sample(d, "id", "label", 90).toPandas()
    assert got.label.value_counts().to_dict() == {"mid": 30, "most": 30, "rare": 12}
    assert dict(zip(got.label, got.label_rows)) == {"rare": 12, "mid": 988, "most": 2000}


def formats(rng):
    pick = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    low = "abcdefghijklmnopqrstuvwxyz"
    letters = low + low.upper() + "0123456789"
    return {"git": lambda: "ghp_" + pick(letters, 36), "pay": lambda: "sk-live-" + pick(low + "0123456789", 24), "map": lambda: "AIza" + pick(letters + "_", 35)}


def test_three_formats_are_recalled_with_precision(spark):
    rng = random.Random(12)
    make = formats(rng)
    ordinary = lambda: rng.choice("_-/").join(rng.choice(WORDS) for _ in range(6)) + str(rng.randint(0, 99))
    rows, planted = [], {}
    for i in range(360):
        rows.append((i, f"token = {make[['git', 'pay', 'map'][i % 3]]()} end"))
    for i in range(1000, 1900):
        rows.append((i, f"see {ordinary()} and {ordinary()} there"))
    for i, kind in enumerate(["git", "pay", "map"] * 30, 2000):
        secret = make[kind]()
        rows.append((i, f"found {secret} here"))
        planted[i] = f"format:6:{6 + len(secret)}"
    d = spark.createDataFrame(odd(rows), ODD)
    got = {r["doc_id"]: r["spans"] for r in secrets.secret_spans(d).collect()}
    added = {(i, s) for i, spans in got.items() for s in spans if s.startswith("format")}
    right = added & set(planted.items())
    assert len(right) >= 0.9 * len(planted) and len(right) >= 0.99 * len(added)


def test_sealed_words_keep_no_secret():
    assert secrets.sealed("ghp_ab12XYzf9") == "ghp_ab" + "dd" + "UU" + "l" + "h" + "d"


def test_each_transducer_changes_the_ranking():
    texts = {"target": ("You are an idiot", "Some idiot came"), "negation": ("You are an idiot", "You are not an idiot"), "report": ("He is an idiot", "She said he is an idiot"), "threat": ("I will kill you", "kill the process")}
    whole = toxicity.Grammar()
    for name, (bad, mild) in texts.items():
        without = toxicity.Grammar(parts=tuple(p for p in toxicity.TRANSDUCERS if p != name))
        assert whole.score(bad) > 0.5 > whole.score(mild)
        assert abs(without.score(bad) - without.score(mild)) < 0.05
    assert whole.score("the trash is full") < 0.5 < whole.score("what an idiot you are")
    assert whole.score('He said "x" you idiot') > 0.5 > whole.score('"You are an idiot"')


def test_composition_equals_reading_one_after_the_other():
    rng = random.Random(3)
    parts = list(toxicity.TRANSDUCERS.values())
    table = toxicity.machine()
    for _ in range(300):
        word, state, own = [rng.choice(toxicity.SYMBOLS) for _ in range(12)], 0, []
        states = [next(iter(p)) for p in parts]
        for x in word:
            state, out, weight = table[state][x]
            total = 0.0
            for k, p in enumerate(parts):
                states[k], x, w = toxicity.taken(p, states[k], x)
                total += w
            own.append((out, round(weight, 9)) == (x, round(total, 9)))
        assert all(own)


BROKEN = ['<a "' * 1_200_000, '<a "' * 1_200_000 + '">', "<div>a" * 300_000, "<div>" * 400_000 + "</p>" * 400_000, "<" * 5_000_000, "<!--" * 1_200_000, "<script>" * 600_000, "<script></script " * 300_000, "&#" + "9" * 5_000_000 + ";", '<p class=" ' * 400_000 + ">"]


@pytest.mark.parametrize("k", range(len(BROKEN)))
def test_broken_pages_of_megabytes_take_linear_time(k):
    began = time.time()
    html_text.blocks(BROKEN[k])
    assert time.time() - began < 30


def test_nothing_but_markup_is_lost_inside_a_block():
    page = "<article><p>Let <math><mi>x</mi></math> be 3 <noscript>no <b>js</b></noscript> <object>obj</object> <canvas>c</canvas> <x-y>own</x-y> &#0000000065; &#99999999999; 1 < 2</p><select><option>a</select><p title='a>b'>q</p><template><div>x</div></template></article>"
    assert [t for _, t, _ in html_text.blocks(page)] == ["Let x be 3 no js obj c own A � 1 < 2", "q"]


def test_long_pages_are_read_in_parts_alike():
    net = html_text.Labeller()
    page = html_text.blocks("<div class=ad>buy now</div><article><p>hello there you</p><div>some words</div></article>" * 30)
    whole = net.read(html_text.features(page)[None], np.array([len(page)]))[0]
    np.testing.assert_allclose(whole, net.read_long(page, 7), atol=1e-5)
    assert (net.label([page], room=7)[0] == (whole >= 0.5)).all()


def test_context_is_whole_words_on_both_sides():
    at = lambda t, x: (t, "phone", t.index(x), t.index(x) + len(x))
    plain = pii.score(*at("at +1 555 0100 200 now", "+1 555 0100 200"))
    assert pii.score(*at("hotel +1 555 0100 200 now", "+1 555 0100 200")) == plain and pii.score(*at("border +1 555 0100 200", "+1 555 0100 200")) == plain
    assert pii.score(*at("tel +1 555 0100 200", "+1 555 0100 200")) > plain and pii.score(*at("+1 555 0100 200 is my phone", "+1 555 0100 200")) > plain
    assert pii.score(*at("order +1 555 0100 200", "+1 555 0100 200")) < plain


def test_clashing_columns_long_texts_and_repeated_rows(spark):
    """Rows with columns named like the operators' own, a text of a million characters, nulls and rows twice."""
    import public_tokenizers as P

    texts = [None, "", "You are an idiot. token = abcdefgh12345678 a.b@c.de", "river stone " * 90_000, sentence(random.Random(1), 60)]
    rows = odd(list(enumerate(texts)))
    d = spark.createDataFrame(rows + rows[2:3] + [(None, "no id at all", *rows[0][2:])], ODD)
    labels = spark.createDataFrame([(2, 1, "x"), (2, 1, "x"), (4, 0, "y"), (None, 1, "z")], "doc_id long, toxic int, text string")
    n = len(rows) + 2
    assert token_counts.token_counts(d, P.path("byte_bpe_50k.json"), P.PATTERN).count() == n
    coded = bpe_codec.encode_documents(d, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()
    assert len(coded) == n and sum(r["n_tokens"] == 0 for r in coded) == 2
    scored = toxicity.toxicity(d, toxicity.fit(d, labels)).collect()
    assert len(scored) == n and len({r["score"] for r in scored if r["doc_id"] == 2}) == 1
    assert language_id.identify(d, language_id.fit(d)).count() == n
    assert quality_rules.quality(d).count() == n and simhash_dedup.dedup_components(d.filter("doc_id is not null")).count() == n - 1
    found = secrets.secret_spans(d).collect()
    assert len(found) == n and sum(r["base"] == ["assign:18:42"] for r in found) == 2
    assert pii.personal_data(d).count() == n
    report = decontamination.Index(d, spark.createDataFrame([(1, "you are an", "q")], "item_id long, text string, term string")).report().collect()
    assert len(report) == n and sum(r["contaminated"] for r in report) == 2
    assert len(words_of(texts[3])) == max(r["n_words"] for r in report)


def test_empty_tables_of_codec_and_language(spark):
    import public_tokenizers as P

    d = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert bpe_codec.encode_documents(d, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, with_ids=True).count() == 0
    assert language_id.identify(d, language_id.fit(d)).count() == 0
