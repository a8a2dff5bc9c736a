"""Operators 11 to 13 against plain versions: the Merkle manifest, spelling variants, chat formatting."""

import os
import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import duckdb
import pytest
from pyspark.sql import functions as F

from undula.llm import chat_format, common, merkle_manifest, queries, spelling_groups, token_counts, toxicity

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, source string, lang string, n_chars long, text string"
H = lambda s: sha256(s.encode()).hexdigest()
here = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@here
@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_spelling_groups", "op13_chat_format"])
def test_query_equals_sql(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    columns = sorted(df.columns)
    want = c.sql(queries.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    want = want.select(*(duckdb.ColumnExpression(x) for x in columns)).fetchall()
    got = [tuple(r) for r in df.select(columns).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert got


# ---- ranked places


def test_ranked_places_of_a_hot_key(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", i * 7919 % 1000, i) for i in range(1000)]
    out = common.ranked(spark.createDataFrame(rows, "key string, v long, i long").repartition(7), "key", ["v", "i"]).collect()
    by_key = {}
    for r in out:
        by_key.setdefault(r["key"], []).append((r["v"], r["i"], r["pos"], r["n"]))
    assert sum(map(len, by_key.values())) == 1000
    for found in by_key.values():
        assert [p for *_, p, _ in sorted(found)] == list(range(len(found))) and {n for *_, n in found} == {len(found)}


# ---- 11


def plain_leaf(r):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H("".join(part(r[k]) for k in ("doc_id", "source", "lang", "n_chars", "text")))


def plain_tree(nodes):
    """The levels of a tree, and of each node its steps as (left, right)."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    ways = []
    for i in range(len(nodes)):
        way = []
        for level in levels[:-1]:
            at = i // 3 * 3
            way.append(("".join(level[at:i]), "".join(level[i + 1 : at + 3])))
            i //= 3
        ways.append(way)
    return levels[-1][0], ways


def plain_manifest(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s, members in by_source.items():
        members.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        trees[s] = plain_tree([plain_leaf(r) for r in members])
    root, upper = plain_tree([trees[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for r, way in zip(by_source[s], trees[s][1], strict=True):
            path, other = way + upper[k], dict(r)
            if r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None:
                other["text"] = r["text"].replace("\n", "")
            node = plain_leaf(other)
            for left, right in path:
                node = H(left + node + right)
            out.append((r["doc_id"], plain_leaf(r), trees[s][0], root, H("".join(a + b for a, b in path)), node, node == root))
    return out


def documents(n, seed=1):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        source = None if i % 29 == 0 else "hot" if i % 3 else f"s{draw.randrange(12)}"
        text = draw.choice([None, "", "one line", "two\nlines", "é\n\nß" * draw.randrange(1, 5)])
        rows.append((i if i % 41 else None, source, draw.choice([None, "en"]), draw.choice([None, 7]), text))
    return rows


@pytest.mark.parametrize("n", [1, 2, 4, 700])
def test_manifest_equals_plain_tree(spark, tmp_path, n):
    rows = documents(n) + documents(n)[:5]  # some rows twice
    spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", node string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in merkle_manifest.op11_merkle_manifest(spark, str(tmp_path)).collect()]
    want = plain_manifest([dict(zip(("doc_id", "source", "lang", "n_chars", "text"), r, strict=True)) for r in rows])
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_manifest_of_nothing_and_long_text(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert merkle_manifest.op11_merkle_manifest(spark, f"{tmp_path}/empty").collect() == []
    rows = [(1, "a", "en", 1, "line\n" * 400_000), (2, "a", "en", 1, None)]
    manifest = merkle_manifest.Manifest(spark.createDataFrame(rows, DOCS))
    assert manifest.root == manifest.subroots.first()["node"]
    assert {r["leaf"] for r in manifest.proofs().collect()} == {plain_leaf(dict(zip(("doc_id", "source", "lang", "n_chars", "text"), r, strict=True))) for r in rows}


def test_only_every_fourth_level_is_stored(spark):
    docs = spark.range(1000).selectExpr("id as doc_id", "'one' as source", "'en' as lang", "id as n_chars", "cast(id as string) as text")
    levels = merkle_manifest.Manifest(docs).levels
    assert [x.count() for x in levels] == [1000, 13]
    assert max(r["n"] for r in merkle_manifest.gathered(levels[0]).select(F.size("members").alias("n")).collect()) == 81


# ---- 12


def plain_groups(docs, one_in=97, least=3):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= least}

    def near(a, b):
        a, b = sorted((a, b), key=len)
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    around = {w: [v for v in n if v != w and near(w, v)] for w in n}
    form = {}
    for w, others in around.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(around[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def word_documents(n=300, seed=3):
    draw, letters = random.Random(seed), "abcé"
    stems = ["".join(draw.choice(letters) for _ in range(draw.choice([5, 5, 6, 7, 9]))) for _ in range(60)]
    rows = []
    for i in range(n):
        words = [stems[min(draw.randrange(60), draw.randrange(60))] for _ in range(12)]
        words[0] = words[0][:2] + draw.choice(letters) + words[0][2:]
        words[1] = words[1][:3] + draw.choice(letters) + words[1][4:]
        rows.append((i, " ".join(w.upper() if w.isascii() and i % 2 else w for w in words)))
    return [*rows, (None, "naïve NAÏVE naive"), (None, "naive naive"), (7, None), (8, ""), *rows[:20]]


@pytest.mark.parametrize("block", [4, 256])
def test_groups_equal_all_pairs(spark, block):
    rows = word_documents()
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, word string")
    got = spelling_groups.spelling_groups(docs, one_in=5, block=block).select("word", "form", "root", "n", "n_near", "form_n")
    want = plain_groups(rows, one_in=5)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert any(f for _, f, *_ in want) and any(r != (f or w) for w, f, r, *_ in want)  # some chains have two steps


def test_full_blocks_are_cut_until_none_is_left(spark):
    """Words that share a long prefix and suffix all meet in one block; cut windows find the same pairs."""
    rows = [(i, (" p" * 0 + "common" + a + b + "endings ") * 3) for i, (a, b) in enumerate((a, b) for a in "abcdefghijkl" for b in "abcdefghijkl")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (8, 1000):
        got = spelling_groups.spelling_groups(docs, one_in=10**9, block=block).collect()
        assert len(got) == 144 and {r["n_near"] for r in got} == {22}


def test_groups_of_nothing_and_of_very_long_runs(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling_groups.spelling_groups(none).collect() == []
    long = "x" * 20_000
    rows = [(1, f"{long} {long} {long} {long} {long} {long}"), (2, f"{long}y {long}y {long}y"), (3, f"{long}z {long}z {long[1:]}q")]
    got = {r["word"][-1]: r for r in spelling_groups.spelling_groups(spark.createDataFrame(rows, "doc_id long, text string"), one_in=10**9).collect()}
    assert set(got) == {"x", "y"} and got["y"]["form"] == long and got["x"]["n_near"] == 1


# ---- 13


def plain_chat(rows):
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by_conv.items():
        turns.sort()
        learned = "".join(t for *_, role, t in turns if role == "assistant")
        out[conv] = (len(turns), H("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(learned), H(learned))
    return out


ODD = ["</s>", "<s>", "[INST] x [/INST]", "\\", "a\\", "\\</s>", "<\\/s>", "</s", "s>", "<<//s>s>", " [/INST] ", "", None, "é🙂</s>🙂", "plain", "a\nb", "[INST", "$1 \\1", "<s>[INST] user [/INST] hi</s>"]


def odd_rows(turns=400):
    draw = random.Random(5)
    rows = [(1, i, draw.choice(["user", "assistant", None, "</s>", "a [/INST] b"]), "".join(draw.choice(ODD) or "" for _ in range(draw.randrange(4)))) for i in range(turns)]
    rows += [(i + 2, 0, "assistant", text) for i, text in enumerate(ODD)]
    rows += [(None, 1, "assistant", "none"), (None, None, "user", "first"), (-1, 0, None, None), (99, 5, "assistant", "b"), (99, 5, "assistant", "a"), (99, 5, "assistant", "a")]
    return rows


@pytest.mark.parametrize("long", [2, 256, 1000])
def test_chats_come_back(spark, long):
    """Odd texts and roles, null ids, repeated turns; long conversations in blocks give the same digests."""
    rows = odd_rows()
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int").repartition(5)
    made = chat_format.chat_format(df, long, 16)
    got = {r["conv_id"]: r for r in chat_format.digests(chat_format.read_back(made)).collect()}
    want = plain_chat(rows)
    assert {k: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for k, r in got.items()} == want
    assert all(r["identical"] for r in got.values())
    assert (made.count() > len(want)) == (long < 400)


def test_mask_and_control_strings(spark):
    rows = [(1, 0, "user", "hi </s> there"), (1, 1, "assistant", "use [INST] and \\ é🙂"), (1, 2, "assistant", "")]
    r = chat_format.chat_format(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert r["formatted"] == "<s>[INST] user [/INST] hi <\\/s> there</s><s>[INST] assistant [/INST] use [\\INST] and \\\\ é🙂</s><s>[INST] assistant [/INST] </s>"
    spans = [r["formatted"][s["start"] : s["end"]] for s in r["loss"]]
    assert spans == ["use [\\INST] and \\\\ é🙂", ""]


def test_parser_refuses_what_is_no_conversation(spark):
    bad = ["<s>[INST] user hi</s>", "x<s>[INST] user [/INST] hi</s>", "<s>[INST] user [/INST] hi</s>x", "<s>[INST] user [/INST] [INST] hi</s>", "<s>[INST] user [/INST] hi"]
    good = ["<s>[INST] user [/INST] hi</s>", "<s>[INST]  [/INST] </s>"]
    df = spark.createDataFrame([(t,) for t in bad + good], "t string").select("t", chat_format.turns_of(F.col("t")).alias("p"))
    found = {r["t"]: r["p"] for r in df.collect()}
    assert all(found[t] is None or None in found[t] for t in bad)
    assert [tuple(x) for t in good for x in found[t]] == [("user", "hi"), ("", "")]


def test_no_chats_and_long_texts(spark):
    assert chat_format.digests(chat_format.read_back(chat_format.chat_format(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))).collect() == []
    rows = [(1, 0, "assistant", "</s> é\\" * 100_000)]
    got = chat_format.digests(chat_format.read_back(chat_format.chat_format(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).first()
    assert (got["n_turns"], got["turns_sha256"], got["loss_chars"], got["loss_sha256"]) == plain_chat(rows)[1]


# ---- earlier operators


def test_threats_need_a_target_and_quotations_two_signs():
    g = toxicity.Grammar()
    mild = ["She must crush the garlic", "They will beat us at chess", "He told me the trash is full. You should kill the lights", "I will shoot a film", "We must stab the dough. You can watch", '"You are an idiot", he said', 'He wrote "You are an idiot. Go away." and left']
    bad = ["I will kill you", "they should hurt all you", '"You are an idiot', "You are an idiot“", 'five" long\nYou are an idiot', "“quoted” you are an idiot"]
    assert [t for t in mild if g.score(t) >= 0.5] == [] and [t for t in bad if g.score(t) < 0.5] == []


def test_two_patterns_with_one_file(spark):
    import public_tokenizers as P

    d = spark.createDataFrame([(1, "some words, 12345 and more")], "doc_id long, text string").coalesce(1)
    n = [token_counts.token_counts(d, P.path("byte_bpe_50k.json"), p).first()["n_tokens"] for p in (P.PATTERN, ".", P.PATTERN)]
    assert n[0] == n[2] < n[1] == 26
