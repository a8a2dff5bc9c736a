r"""Operator 3, toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, hint, threat, intent, target, negation, report, quotation signs, clause ends, other). Five
weighted transducers, tables of arcs (symbol: next state, output, weight), read them one after the other:
- target: an insult within reach after a word that addresses somebody comes out as aimed;
- threat: a harmful act within reach after an intention comes out as menace, any other as an ordinary word;
- negation: what it reaches comes out as denied;
- report: what follows a verb of reporting, or stands inside quotation signs, comes out as quoted. A closing sign and the
  end of the clause end both. Signs count in pairs on one line, and a quotation has no clause ends in it; a sign without its
  partner is an ordinary word;
- insult: turns what is left into matches; a lone insult is a weak one, unless a target follows within reach, and a menace is
  one only if its target follows within ARMED words: you crush garlic, but threaten somebody.
`composed` makes one deterministic machine of them, whose weights are the sums along the arcs. A document's score is a
logistic function of its matches' weights by type, so an insult that is denied or quoted weighs less than a lone one and a
lone one less than one thrown at somebody.

Learned from labels, held-out rows never used: stems (word beginnings, so inflected forms count) that stand in at least
MIN_SHARE of the toxic training texts and much more rarely in others, added to the insult transducer as strong insults or,
where clean texts have them at times, as hints, which weigh by repetition; and the weights of the match types, kept near
the grammar's own by a Gaussian prior. Training uses all labelled rows and their whole texts: Spark counts the stems of
toxic texts, then those that are frequent enough in others, and sums up the gradients of the weights; copies of a toxic
text count once for the stems.

Null, empty and wordless texts score as a text without matches. Without labels the grammar's own weights hold. Repeated
rows give repeated rows; a document that is labelled twice counts once. Whole texts are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm.common import arrow_map, batch, remainder, spread_join, stored, table
from undula.llm.decontamination import small

MIN_SHARE, MIN_TEXTS, MIN_RATIO, STRONG_RATIO, STEMS = 0.02, 6, 8, 60, 200
#: Stems and words that a task keeps before it hands on what it has counted.
KEPT = 200_000
#: The grammar's words.
WORDS = {
    "insult": "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown imbecile jerk idiota estúpido imbécil basura idiote débile ordure connard dummkopf abschaum",
    "threat": "kill hurt destroy stab shoot strangle beat crush murder matar töten tuer",
    "intent": "will shall gonna going want must should werde voy vais",
    "target": "you your you're youre yourself he she they them him her everyone du dich ihr tu tú usted vous",
    "negation": "not never no isn't aren't wasn't don't doesn't didn't nicht kein keine pas jamais nunca",
    "report": "said says wrote writes called calls claimed quoted told alleged sagte schrieb dijo dit",
}
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;\n\"“”]")
TYPES = ("insult", "aimed", "denied", "quoted", "menace", "hint")
MATCHES, SIGNS = frozenset(TYPES), frozenset('"“”')
SYMBOLS = ("other", "end", "open", "close", "sign", *WORDS, "hint")
#: How far each type's weight counts, of repeated hints and hints in 100 words, and the score's offset, before anything is learned.
PRIOR, OFFSET = np.array([1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.5]), -3.0
ARMED = 2
REACH = 3  # words over which a negation or an intention carries; a target carries two more

Arcs = dict[object, dict[str, tuple[object, str, float]]]  # state: symbol: (next state, output, weight); * is any other symbol, passed on


def reaching(source: str, words: int, turned: dict[str, str], weight: float, else_: dict[str, str] | None = None) -> Arcs:
    """States 0 to `words`: over how many more words `source` carries. There, symbols in `turned` are replaced, at that weight; out of reach those in `else_` are."""
    out: Arcs = {}
    for left in range(words + 1):
        arcs = {x: (max(0, left - 1), y, weight if left else 0.0) for x, y in (turned if left else else_ or {}).items()}
        out[left] = arcs | {source: (words, source, 0.0), "end": (0, "end", 0.0), "*": (max(0, left - 1), "", 0.0)}
    return out


def reporting(weight: float) -> Arcs:
    marked = {x: "quoted" for x in ("insult", "aimed", "menace")} | {"hint": "other"}
    inside = lambda state: {x: (state, y, weight) for x, y in marked.items()}
    signs = {"open": ("quote", "other", 0.0), "close": ("plain", "other", 0.0), "end": ("plain", "end", 0.0)}
    return {
        "plain": signs | {"report": ("told", "other", 0.0), "sign": ("quote", "other", 0.0), "*": ("plain", "", 0.0)},
        "told": signs | inside("told") | {"sign": ("quote", "other", 0.0), "*": ("told", "", 0.0)},
        "quote": signs | inside("quote") | {"sign": ("plain", "other", 0.0), "*": ("quote", "", 0.0)},
    }


def matching(words: int, armed: int) -> Arcs:
    """States (over how many more words a lone insult may still find its target, over how many a menace may)."""
    own = {"aimed": 5.0, "denied": 4.0, "quoted": 4.0, "hint": 0.5}
    out: Arcs = {}
    for left in range(words + 1):
        for menace in range(armed + 1):
            on = (max(0, left - 1), max(0, menace - 1))
            target = ((0, 0), "menace", 5.0) if menace else ((0, 0), "aimed", 5.0) if left else ((0, 0), "none", 0.0)
            arcs = {t: (on, t, w) for t, w in own.items()} | {"insult": ((words, on[1]), "insult", 2.0), "menace": ((on[0], armed), "none", 0.0)}
            out[left, menace] = arcs | {"target": target, "end": ((0, 0), "none", 0.0), "*": (on, "none", 0.0)}
    return out


def paired(words: list[str], symbols: list[str]) -> list[str]:
    """symbols in which quotation signs stand in pairs on one line: others are ordinary words, and so are clause ends between two."""
    opened = None
    for i, x in enumerate(symbols):
        if words[i] == "\n" or x == "open":
            if opened is not None:
                symbols[opened] = "other"
            opened = i if x == "open" else None
        elif x in ("sign", "close"):
            if opened is not None:
                symbols[opened + 1 : i] = ["other" if y == "end" else y for y in symbols[opened + 1 : i]]
                symbols[opened], symbols[i], opened = "open", "close", None
            elif x == "sign":
                opened = i
            else:
                symbols[i] = "other"
    if opened is not None:
        symbols[opened] = "other"
    return symbols


TRANSDUCERS: dict[str, Arcs] = {
    "target": reaching("target", REACH + 2, {"insult": "aimed"}, 1.0),
    "threat": reaching("intent", REACH, {"threat": "menace"}, 1.0, {"threat": "other"}),
    "negation": reaching("negation", REACH, {"insult": "denied", "aimed": "denied", "menace": "denied", "hint": "other"}, -4.5),
    "report": reporting(-4.5),
    "insult": matching(REACH, ARMED),
}


def taken(arcs: Arcs, state: object, symbol: str) -> tuple[object, str, float]:
    after, out, weight = arcs[state].get(symbol) or arcs[state]["*"]
    return after, out or symbol, weight


def composed(first: Arcs, second: Arcs) -> Arcs:
    """One transducer that reads as `first` and hands what it puts out to `second`; states are the pairs that can be reached, weights add up."""
    out: Arcs = {}
    waiting = [(next(iter(first)), next(iter(second)))]
    while waiting:
        p, q = pair = waiting.pop()
        if pair in out:
            continue
        out[pair] = {}
        for symbol in SYMBOLS:
            p_next, given, w = taken(first, p, symbol)
            q_next, shown, v = taken(second, q, given)
            out[pair][symbol] = ((p_next, q_next), shown, w + v)
            waiting.append((p_next, q_next))
    return out


@cache
def machine(parts: tuple[str, ...] = tuple(TRANSDUCERS)) -> list[dict[str, tuple[int, str, float]]]:
    """The composition of these transducers, states numbered from the start on."""
    arcs = reduce(composed, (TRANSDUCERS[p] for p in parts))
    number = {state: i for i, state in enumerate(arcs)}
    return [{x: (number[after], out, w) for x, (after, out, w) in own.items()} for own in arcs.values()]


class Grammar:
    """Fixed words and learned stems (stem: insult or hint), weights by type, offset."""

    def __init__(self, stems: dict[str, str] | None = None, weights: np.ndarray = PRIOR, offset: float = OFFSET, parts: tuple[str, ...] = tuple(TRANSDUCERS)):
        self.stems, self.weights, self.offset, self.machine = stems or {}, weights, offset, machine(parts)
        self.symbol = {w: kind for kind, words in WORDS.items() for w in words.split()}
        self.symbol |= {c: "end" for c in ".!?;\n"} | {'"': "sign", "“": "open", "”": "close"}
        self.heads = {w[:3] for w, k in self.symbol.items() if k in ("insult", "threat")} | {x[:3] for x in self.stems}
        self.sizes = sorted({len(x) for x in self.stems})

    def read(self, word: str) -> str:
        if (known := self.symbol.get(word)) or word[:3] not in self.heads:
            return known or "other"
        return next((k for n in self.sizes if (k := self.stems.get(word[:n]))), "other")

    def matches(self, words: list[str]) -> list[tuple[int, str, float]]:
        """(place, type, weight) of every match in a text's words and signs."""
        heads, symbol, read = self.heads, self.symbol, self.read
        if not any(w[:3] in heads for w in words):
            return []
        symbols = [symbol.get(w) or (read(w) if w[:3] in heads else "other") for w in words]
        if not SIGNS.isdisjoint(words):
            symbols = paired(words, symbols)
        state, out = self.machine[0], []
        for i, x in enumerate(symbols):
            after, match, weight = state[x]
            state = self.machine[after]
            if match in MATCHES:
                out.append((i, match, weight))
        return out

    def features(self, text: str) -> np.ndarray:
        """By type, the mean weight of its matches times log(1 + their number); repeated hints; hints in 100 words."""
        words = TOKEN.findall(text.lower())
        n, total = np.zeros(len(TYPES)), np.zeros(len(TYPES))
        for _, kind, weight in self.matches(words):
            n[TYPES.index(kind)] += 1
            total[TYPES.index(kind)] += weight
        return np.r_[total / np.maximum(n, 1) * np.log1p(n), n[-1] >= 2, np.log1p(100 * n[-1] / max(len(words), 1))]

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.offset + self.features(text) @ self.weights, -30, 30))))


def marks(text: str) -> list[int]:
    """The least two hashes of three words; copies and near copies share one at least."""
    words = TOKEN.findall(text.lower())
    return sorted({zlib.crc32(" ".join(x).encode()) for x in zip(words, words[1:], words[2:])})[:2]


def stems_of(text: str, wanted: Wanted) -> set[str]:
    """The wanted beginnings of 3 to 8 characters of a text's words, those that occur again also with +."""
    once: set[str] = set()
    again: set[str] = set()
    for word in TOKEN.findall(text.lower()):
        if own := wanted.get(word):
            again.update(p for p in own if p in once)
            once.update(own)
    return once | {f"{p}+" for p in again}


class Wanted(dict):
    """The beginnings of a word that are among these stems; all without any."""

    def __init__(self, stems: set[str] | None):
        self.stems = stems

    def get(self, word: str) -> tuple[str, ...]:
        if (own := super().get(word)) is None:
            if len(self) > KEPT:
                self.clear()
            own = self[word] = tuple(p for k in range(3, min(len(word), 8) + 1) if (p := word[:k]) and (self.stems is None or p in self.stems))
        return own


def stem_counts(texts: DataFrame, stems: set[str] | None = None) -> DataFrame:
    """(stem, n, n_half): in how many of the texts (text, half), and of those of one half, a stem occurs; of these stems only, if given."""
    known = texts.sparkSession.sparkContext.broadcast(stems)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, counts = Wanted(known.value), (Counter(), Counter())

        def counted() -> pa.RecordBatch:
            names = list(counts[0])
            out = batch({"stem": (names, pa.string()), "n": ([counts[0][p] for p in names], pa.int64()), "n_half": ([counts[1][p] for p in names], pa.int64())})
            for c in counts:
                c.clear()
            return out

        for b in batches:
            for text, half in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = stems_of(text, wanted)
                counts[0].update(found)
                if half:
                    counts[1].update(found)
            if len(counts[0]) > KEPT:
                yield counted()
        yield counted()

    return arrow_map(texts.select("text", "half"), run, "stem string, n long, n_half long").groupBy("stem").agg(F.sum("n").alias("n"), F.sum("n_half").alias("n_half"))


def telling(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, str]:
    """Word beginnings that tell toxic texts from others by occurring, or by occurring again; the most telling first, none within another."""
    ratio = lambda p: (toxic.get(p, 0) / max(n_toxic, 1)) / ((clean.get(p, 0) + 0.5) / (n_clean + 1))
    open_ = {p: n * np.log(r) + 0.01 * len(p) for p, n in toxic.items() if n >= max(MIN_TEXTS, MIN_SHARE * n_toxic) and (r := ratio(p)) >= MIN_RATIO}
    out: dict[str, str] = {}
    for p in sorted(open_, key=lambda p: (-open_[p], p)):
        stem = p.rstrip("+")
        if len(out) < STEMS and not any(stem.startswith(q) or q.startswith(stem) for q in out):
            out[stem] = "insult" if ratio(stem) >= STRONG_RATIO else "hint"
    return out


def without_copies(texts: DataFrame) -> DataFrame:
    """(text, half) of toxic texts (doc_id, text, half), of texts that share a mark only the one with the least hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch({"at": (b.column(0), pa.int64()), "marks": ([marks(t) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))})

    texts = texts.withColumn("at", F.xxhash64("doc_id", "text"))
    marked = stored(arrow_map(texts.select("at", "text"), run, "at long, marks array<long>").distinct(), "marks")
    each = stored(marked.select("at", F.explode("marks").alias("mark")), "each-mark")
    least = stored(each.groupBy("mark").agg(F.min("at").alias("least"), F.count("*").alias("n")), "least-of-mark")
    gone = stored(spread_join(each, least, "mark").filter("at > least").select("at").distinct(), "copies")
    return texts.join(small(gone), "at", "left_anti").select("text", "half")


def weighed(grammar: Grammar, texts: DataFrame) -> tuple[np.ndarray, float]:
    """The grammar's weights and offset, learned from all texts (text, toxic) by Newton's method for the posterior's mode."""
    model = texts.sparkSession.sparkContext.broadcast(grammar.stems)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(model.value)
        for b in batches:
            yield batch({"x": ([[*own.features(t), 1.0] for t in b.column(0).to_pylist()], pa.list_(pa.float64())), "y": (b.column(1), pa.int32())})

    rows = arrow_map(texts.select("text", "toxic"), features, "x array<double>, y int").groupBy("x", "y").agg(F.count("*").alias("n"))
    rows, prior = stored(rows, "features"), np.r_[PRIOR, OFFSET]
    w = prior.copy()
    for _ in range(30):
        at = w.copy()

        def slopes(batches: Iterator[pa.RecordBatch], at: np.ndarray = at) -> Iterator[pa.RecordBatch]:
            slope, bend = np.zeros(len(at)), np.zeros((len(at), len(at)))
            for b in batches:
                x, y, n = np.array(b.column(0).to_pylist()).reshape(-1, len(at)), b.column(1).to_numpy(), b.column(2).to_numpy()
                p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
                slope += x.T @ (n * (p - y))
                bend += (x * (n * p * (1 - p))[:, None]).T @ x
            yield batch({"slope": ([slope], pa.list_(pa.float64())), "bend": ([bend.ravel()], pa.list_(pa.float64()))})

        got = arrow_map(rows, slopes, "slope array<double>, bend array<double>").collect()
        slope = sum((np.array(r.slope) for r in got), w - prior)
        step = np.linalg.solve(sum((np.array(r.bend).reshape(len(w), -1) for r in got), np.eye(len(w))), slope)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    w = np.round(w, 8)  # whatever the order of the sums
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame) -> Grammar:
    """The grammar with learned stems and weights, from all training rows; counts of frequent stems and sums of slopes reach the driver."""
    rows = labels.filter("toxic is not null").filter(remainder("doc_id") != 0).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = stored(rows.select("doc_id", F.greatest(F.lit(0), F.least(F.lit(1), "toxic")).alias("toxic"), (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("half")), "labelled")
    texts = docs.select("doc_id", "text").filter("text <> ''")
    of_class = [texts.join(small(rows.filter(F.col("toxic") == y)), "doc_id") for y in (0, 1)]
    bad = stored(without_copies(of_class[1]), "toxic-texts")
    n, n_half = (bad.count(), bad.filter("half").count())
    clean = of_class[0].agg(F.count("*").alias("n"), F.count_if("half").alias("n_half")).first()
    if not n or not clean.n:
        return Grammar()
    enough = (F.col("n") >= max(MIN_TEXTS, MIN_SHARE * n)) | (F.col("n_half") >= max(MIN_TEXTS, MIN_SHARE * n_half))
    toxic = {r.stem: (r.n, r.n_half) for r in stem_counts(bad).filter(enough).collect()}
    also = {r.stem: (r.n, r.n_half) for r in stem_counts(of_class[0], {*toxic, *(p.rstrip("+") for p in toxic)}).collect()} if toxic else {}
    pick = lambda counts, i: {p: x[i] for p, x in counts.items()}
    # stems come from one half and weights from the other, so that the weights see how stems do on new texts; then the
    # stems of all rows are used
    grammar = Grammar(telling(pick(toxic, 1), pick(also, 1), n_half, clean.n_half))
    weights, offset = weighed(grammar, texts.join(small(rows), "doc_id").filter("not half"))
    return Grammar(telling(pick(toxic, 0), pick(also, 0), n, clean.n), weights, offset)


def toxicity(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, held_out, score, predicted of every document row."""
    model = docs.sparkSession.sparkContext.broadcast((grammar.stems, grammar.weights, grammar.offset))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(*model.value)
        for b in batches:
            scores = [own.score(t or "") for t in b.column(2).to_pylist()]
            yield batch({"doc_id": (b.column(0), pa.int64()), "held_out": (b.column(1), pa.bool_()), "score": (scores, pa.float64()), "predicted": ([int(s >= 0.5) for s in scores], pa.int32())})

    return arrow_map(docs.select("doc_id", (remainder("doc_id") == 0).alias("held_out"), "text"), run, "doc_id long, held_out boolean, score double, predicted int")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
