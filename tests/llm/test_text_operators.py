"""Text operators on small fixtures with odd rows, against the public libraries or brute force."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from undula.llm import bpe_codec, decontamination, html_text, language_id, pii, quality_rules, secrets, simhash_dedup, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string"
WORDS = "the of and to in river stone cloud maple lantern copper signal window garden table".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ly", "ing"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    odd = [None, "", " ", "\n\n", "ß" * 40, "日本語 😀 text", "a" * 30_000, "<|endoftext|> in text", "ABC abc Abc " * 30, "x\x00y\x1cz", "I'll don't  's\t\n q"]
    return odd + [sentence(rng, rng.randint(1, 120)) + "\n" + sentence(rng, 5) for _ in range(40)] + ["x\x00y\x1cz"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", None][i % 7 == 0], f"src{i % 2}", 0, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [rows[-1]], SCHEMA).repartition(3)  # the last row twice


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_token_counts_equal_the_library(docs, texts):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    out = token_counts.token_counts(docs, P.path("byte_bpe_50k.json"), P.PATTERN)
    assert out.count() == len(texts) + 1
    for i, r in by_id(out).items():
        text = texts[i] or ""
        n = len(t.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 512)


def test_bpe_ids_equal_the_library_and_decode_back(docs, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = bpe_codec.encode_documents(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, with_ids=True)
    for i, r in by_id(out).items():
        ids = e.encode_ordinary(texts[i] or "")
        assert r["token_ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[i] or "").encode()).hexdigest()


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_decontamination_equals_brute_force(spark, docs, texts):
    rng = random.Random(2)
    items = [(k, " ".join(words_of(rng.choice(texts[11:]))[a : a + n])) for k, (a, n) in enumerate([(0, 12), (3, 4), (0, 30), (0, 1), (2, 2), (1, 11)])] + [(90, None), (91, "?!"), (92, "nowhere to be found"), (0, "river stone")]
    out = by_id(decontamination.Index(docs, spark.createDataFrame(items, "item_id long, text string")).report())
    for i, r in out.items():
        w, hit, found = words_of(texts[i]), set(), set()
        for item, text in items:
            q = words_of(text)
            for win in [q[k : k + 10] for k in range(max(1, len(q) - 9))] if q else []:
                for at in range(len(w) - len(win) + 1):
                    if w[at : at + len(win)] == win:
                        hit.update(range(at, at + len(win)))
                        found.add(str(item))
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(found), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    empty = decontamination.Index(docs, spark.createDataFrame([], "item_id long, text string"))
    assert empty.report().filter("contaminated").count() == 0


def test_near_phrases(spark):
    d = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, "alpha x y beta gamma delta epsilon zeta"), (3, "zeta alpha")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    index = decontamination.Index(d, b)
    assert {r["doc_id"] for r in index.near_matches(3).collect()} <= {2}
    assert index.report().filter("contaminated").first()["doc_id"] == 1


def test_near_matches_find_edits_anywhere(spark):
    texts = ["alpha beta gamma delta epsilon zeta", "alpha x y beta gamma delta epsilon zeta", "zeta alpha", "alpha beta gamma delta epsilon x zeta", "alpha beta q delta epsilon zeta", "alpha beta q delta q zeta", "alpha beta x x x x gamma delta epsilon zeta", None]
    d = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    near = lambda item: {r["doc_id"] for r in decontamination.Index(d, spark.createDataFrame([(7, item)], "item_id long, text string")).near_matches(3).collect()}
    assert near("alpha beta gamma delta epsilon zeta") == {2, 4, 5}
    assert near("alpha beta gamma unheard epsilon zeta") == {1, 2, 4}  # a term that the corpus lacks


def test_fingerprints_equal_the_definition(docs, texts):
    for i, r in by_id(simhash_dedup.fingerprints(docs)).items():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), texts[i] or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
        assert r["fp"] % (1 << 64) == want


@pytest.mark.parametrize("hot", [4, 256])
def test_links_and_components_equal_brute_force(spark, hot):
    rng = np.random.default_rng(hot)
    base = rng.integers(0, 1 << 63, 20)
    fps = {int(b) for b in base}
    for b in base[:8]:
        x = int(b)
        for _ in range(25):  # chains and dense clouds
            x ^= 1 << int(rng.integers(0, 64 if hot > 10 else 20))
            fps.add(x if x < 1 << 63 else x - (1 << 64))
    fps = sorted(fps)
    root = {f: f for f in fps}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for k, a in enumerate(fps):
        for b in fps[k + 1 :]:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    links = simhash_dedup.links(spark.createDataFrame([(f,) for f in fps], "fp long"), hot=hot)
    got = {r["node"]: r["root"] for r in simhash_dedup.components(links).collect()}
    assert {f: got.get(f, f) for f in fps} == {f: find(f) for f in fps}


def test_copies_share_a_component(docs, texts):
    out = simhash_dedup.dedup_components(docs).collect()
    assert len(out) == len(texts) + 1
    ids = {r["doc_id"]: r["component_id"] for r in out}
    assert ids[0] == ids[1] == ids[2] == ids[3] == 0 and ids[len(texts) - 1] == 9


def test_quality_figures_equal_brute_force(docs, texts):
    out = by_id(quality_rules.quality(docs))
    for i, r in out.items():
        text = texts[i] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(again))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(again) > 50 * len(w))


def test_frequent_lines_go_and_copies_count_once(spark):
    rng = random.Random(5)
    rows = [(i, f"menu home about {rng.randint(0, 9)}\n" + sentence(rng, 60), "a") for i in range(8)]
    rows += [(100 + i, "copied text " + "word " * 30 + sentence(random.Random(9), 60), "a") for i in range(8)]
    rows += [(200, "\n".join(["menu home about 1"] * 40), "a"), (201, None, None), (202, "menu home about 2", "b")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = by_id(quality_rules.quality(d, max_docs=5))
    assert all(out[i]["kept_words"] == out[i]["n_words"] - 4 for i in range(8)) and all(out[i]["kept"] for i in range(8))
    assert all(out[100 + i]["kept_words"] == out[100 + i]["n_words"] for i in range(8))
    assert out[200]["kept_words"] == 0 and not out[200]["kept"] and out[202]["kept_words"] == 4
    clean = by_id(quality_rules.without_frequent_lines(d, 5))
    assert "menu" not in clean[0]["text"] and clean[202]["text"] == "menu home about 2" and clean[201]["text"] == ""


SECRET_TEXTS = [None, "", 'a token = "' + "ab12" * 10 + '" b', "PASSWORD: short", "Api_Key=LONGENOUGH1 and api-key", "AKIA" + "Z" * 12 + " AKIAX", "f" * 31, "0123456789abcdef" * 2 + "g", "secret token=abcdefgh", "ſecret=abcdefgh1"]


def plain_secrets(text):
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [(m.start(), 0, "assign", m.end())] * (len(m[2]) >= 8)
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def test_base_secrets_and_inferred_formats(spark):
    rng = random.Random(3)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    rows = list(enumerate(SECRET_TEXTS + [f'x token = "{h}" y' for h in hexes]))
    planted = "".join(rng.choice("0123456789abcdef") for _ in range(28))  # too short for the base pattern
    rows += [(900, f"see {planted} here"), (901, "Donaudampfschifffahrtsgesellschaft2 abcdefghijklmnopqrstuvw1"), (902, "x" * 50_000 + "1")]
    out = by_id(secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")))
    for i, text in rows:
        assert out[i]["base"] == plain_secrets(text or "")
        assert set(out[i]["base"]) <= set(out[i]["spans"])
    assert out[900]["spans"] == ["format:4:32"]
    assert out[901]["spans"] == [] and out[902]["spans"] == []


def test_redaction_keeps_rows_and_columns(spark):
    d = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(SECRET_TEXTS)], "doc_id long, text string, n_chars long")
    out = secrets.redact(d)
    assert out.columns == d.columns and out.count() == d.count()
    got = by_id(out)
    assert got[2]["text"] == 'a [secret]" b' and got[2]["n_chars"] == len(got[2]["text"]) and got[3]["text"] == SECRET_TEXTS[3] and got[0]["text"] is None


PII_TEXTS = [
    None, "", "a.b+c@x-y.example.com, z@q", "a@b.c_x@d.ef @no.start", "at 1.2.3.4.5 and 256.1.1.1 and 0255.01.1.1", "card 4111 1111-1111 1111 or 4111111111111112 or 12345678901234567890", "+1 (017) 555-7713. +12 +1234567",
    "iban DE89 3704 0044 0532 0130 00 end", "ssn 123-45-6789; order 123-45-6789", "9" * 20_000, "x" * 20_000 + "@", "a@b@c.de", "tel +49.30.1234567)",
]


def plain_pii(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)] if len(text) < 1000 else []
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))] if len(text) < 1000 else []
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]


def test_base_pii_equals_the_patterns(spark):
    rng = random.Random(8)
    more = ["".join(rng.choice("ab1 2.34@-+5(") for _ in range(200)) for _ in range(200)]
    rows = list(enumerate(PII_TEXTS + more))
    out = by_id(pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")))
    for i, text in rows:
        assert out[i]["base"] == [f"{k}:{s}:{e}" for k, s, e in plain_pii(text or "")]
    kinds = lambda i: [s.split(":")[0] for s in out[i]["spans"]]
    assert "iban" in kinds(7) and kinds(8).count("ssn") == 1 and pii.luhn("4111111111111111") and not pii.mod97("DE00370400440532013000")


def test_ibans_before_words_and_context_after_a_span():
    spans = lambda t: [t[s:e] for _, s, e in pii.further_spans(t)]
    assert spans("IBAN DE89370400440532013000 BIC COBADEFFXXX") == ["DE89370400440532013000"]
    assert spans("GB82 WEST 1234 5698 7654 32 BIC X") == ["GB82 WEST 1234 5698 7654 32"]
    assert spans("DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32 2024") == ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"]
    assert spans("NR 12 AB12 DE89370400440532013000") == ["DE89370400440532013000"]
    assert spans("DE00370400440532013000 BIC") == [] and spans("DE893704004405320130001 X") == []
    assert spans("here 123-45-6789 is my SSN") == ["123-45-6789"] and spans("here 123-45-6789 is a part") == []


def test_grammar_weakens_denied_and_quoted_insults():
    g = toxicity.Grammar()
    assert g.score("You are an idiot") > 0.5 > g.score("You are not an idiot")
    assert g.score('She said he is an idiot') < 0.5 and g.score("I will kill you") > 0.5
    assert g.score("") < 0.5 and g.score("a fine day") < 0.5 and g.score("kill the process") < 0.5


def test_toxicity_learns_stems_and_holds_rows_out(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        rows.append((i, sentence(rng, 40) + (" grobnak grobnakish " if bad else " ") + sentence(rng, 20)))
        labels.append((i, int(bad)))
    d = spark.createDataFrame(rows + [(9000, None), (9001, "")], "doc_id long, text string")
    out = toxicity.toxicity(d, toxicity.fit(d, spark.createDataFrame(labels + labels[:3], "doc_id long, toxic int"))).toPandas()
    held = out[out.held_out & (out.doc_id < 600)]
    assert len(held) > 50 and ((held.doc_id % 4 == 0) == (held.predicted == 1)).mean() > 0.95
    assert out.score.between(0, 1).all() and len(out) == 602
    plain = toxicity.fit(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert not plain.stems


def test_language_model_on_held_out_rows(spark):
    rng = random.Random(6)
    sets = {"aa": "river stone cloud maple lantern".split(), "bb": "größe straße über müller wäre".split(), "cc": "café élève forêt garçon naïve".split()}
    rows = [(i, " ".join(rng.choice(sets[lang]) for _ in range(30)), lang) for i in range(400) for lang in [list(sets)[i % 3]]]
    d = spark.createDataFrame(rows + [(900, None, "aa"), (901, "12 !", None), (902, "stone river", None)], "doc_id long, text string, lang string")
    out = language_id.identify(d, language_id.fit(d)).toPandas().set_index("doc_id")
    held = [i for i, _, _ in rows if out.held_out[i]]
    assert held and all(out.lang_pred[i] == rows[i][2] for i in held)
    assert out.lang_pred[900] == out.lang_pred[901] == "und" and out.lang_pred[902] == "aa"
    none = language_id.identify(d, language_id.fit(d.filter("false"))).toPandas()
    assert set(none.lang_pred) == {"und"}


def test_counts_don_t_depend_on_parts(monkeypatch):
    text = sentence(random.Random(1), 400)
    whole = language_id.counts(text)
    monkeypatch.setattr(language_id, "PART", 37)
    np.testing.assert_array_equal(whole, language_id.counts(text))


def page(rng, k, extra=""):
    body = "".join(f"<p>{sentence(rng, rng.randint(2, 40))} &amp; more<br></p>" for _ in range(rng.randint(1, 6)))
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>Menu {k}</a></li></ul></nav><div class=\"ad\">Buy this now.</div><article><h1>Head {k}</h1>{body}{extra}</article><footer>&copy; {k}</footer>"


def expected(html):
    inner = re.search(r"<article>(.*)</article>", html, re.S)[1]
    return [" ".join(re.sub("<[^>]+>", " ", x).replace("&amp;", "&").split()) for x in re.findall(r"<(?:h1|p)>(.*?)</(?:h1|p)>", inner)]


def test_main_text_of_pages(spark):
    rng = random.Random(7)
    pages = [(i, f"u{i}", page(rng, i)) for i in range(60)]
    odd = [(100, "u", None), (101, "u", ""), (102, "u", "<p"), (103, "u", "<script>x"), (104, "u", page(rng, 104, "<aside class='related'>Read also: other stories you may like</aside>") + "<section class='comments'><p>I think that this is wrong, said a reader.</p></section>"), (100, "u", None)]
    d = spark.createDataFrame(pages + odd, "page_id long, url string, html string")
    out = html_text.main_text(d, html_text.fit(d)).toPandas()
    got = dict(zip(out.page_id, out.text))
    assert len(out) == len(pages) + len(odd) and (out.n_chars == out.text.str.len()).all()
    for i, _, h in pages:
        assert got[i].split("\n") == expected(h)
    assert got[100] == got[101] == got[103] == ""
    assert "said a reader" not in got[104] and "Read also" not in got[104]


def test_lstm_slopes_are_right():
    rng = np.random.default_rng(0)
    net = html_text.Labeller()
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x, lengths, y = rng.standard_normal((3, 5, html_text.INPUT)) * 0.3, np.array([5, 3, 1]), rng.integers(0, 2, (3, 5)).astype(float)
    real = np.arange(5)[None] < lengths[:, None]

    def loss():
        p = net.read(x, lengths)
        return -(np.log(np.where(y == 1, p, 1 - p)) * real).sum() / real.sum()

    slopes = net.slopes(x, lengths, y)
    for name in ("wf", "ub", "bf", "o"):
        at = (0,) * net.weights[name].ndim
        old = net.weights[name][at]
        net.weights[name][at] = old + 1e-3
        up = loss()
        net.weights[name][at] = old - 1e-3
        down = loss()
        net.weights[name][at] = old
        assert abs((up - down) / 2e-3 - slopes[name][at]) < 1e-3


@pytest.mark.parametrize("kind", ["documents", "pages"])
def test_empty_tables(spark, kind):
    d = spark.createDataFrame([], SCHEMA)
    if kind == "pages":
        p = spark.createDataFrame([], "page_id long, url string, html string")
        assert html_text.main_text(p, html_text.fit(p)).count() == 0
        return
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert token_counts.token_counts(d, P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0
    assert toxicity.toxicity(d, toxicity.fit(d, labels)).count() == 0
    assert simhash_dedup.dedup_components(d).count() == 0
    assert quality_rules.quality(d).count() == 0
    assert secrets.secret_spans(d).count() == 0 and pii.personal_data(d).count() == 0
    assert decontamination.Index(d, spark.createDataFrame([(1, "a b")], "item_id long, text string")).report().count() == 0
