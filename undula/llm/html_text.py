r"""Operator 4, main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks in page order; each has the path of block tags above it, with class and id
words, and its text. A numpy bidirectional LSTM reads, for every block, its hashed tag path, the mean of its words'
hashed vectors and a few sizes, and labels each block as main text or not with the whole page as context.

Training: at most SAMPLE pages, those with the least hashes of page_id, of at most SAMPLE_CHARS characters. There are no
labelled pages, so what a tag or class says by itself (nav, footer, aside, comments, ... against article, main) is the
teacher, and boilerplate blocks of the same pages are put again under other boilerplate paths and at other places, so that
the network knows kinds and places that these pages lack. Scripts, styles, templates, embedded pages, head and comments
are markup and controls are part of a form: they never become blocks. All other text stays, formulas and what stands in
object, canvas, video or noscript elements included; elements unknown or inline do not end a block.

Character references are decoded, white space inside a block (and <br>) becomes one space, blocks are joined by \n.
A null or empty page, or one without main text, gives an empty text; broken markup is read as far as it goes, in linear
time: a tag that never ends outside quotes ends at its first >, and after BROKEN_TAGS of these quotes no longer count; a
"<" after which no ">" comes is text. Pages of many blocks are read in parts that hand on the network's memory, so memory
does not grow with a square or with the inputs of a whole page; nothing is capped. Repeated rows give repeated rows; without pages to train on, the teacher's rule alone decides.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm.common import arrow_map, batch, hashed_sample, table

SAMPLE, SAMPLE_CHARS = 300, 20_000
PATH_DIM, WORD_DIM, HIDDEN, STEPS, RATE = 128, 8, 12, 200, 0.02
#: Tags by role. What is hidden is never shown as text or is a control of a form.
RAW = "script style template textarea title iframe"
HIDDEN_TAGS = "head select button"
BREAKING = "body p div article section main h1 h2 h3 h4 h5 h6 nav footer aside table ul ol"
BLOCK_TAGS = "html body address article aside blockquote caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul"
VOID = "col frame hr"
SELF_CLOSING = "p li dt dd tr td th h1 h2 h3 h4 h5 h6"
BAD_TAGS = "nav footer aside form header menu dialog fieldset"
BAD_WORDS = "ad ads advert adverts advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead cookie cookies consent notice notification alert popup modal subscribe newsletter signup login comment comments reply replies disqus discussion share sharing social related recommended widget copyright"
GOOD_TAGS = "article main"
NEUTRAL_TAGS, ROOT_TAGS = "html body div section", "html body article main"
RAW, HIDDEN_TAGS, BREAKING, BLOCK_TAGS, VOID, SELF_CLOSING, BAD_TAGS, BAD_WORDS, GOOD_TAGS, NEUTRAL_TAGS, ROOT_TAGS = (
    frozenset(x.split()) for x in (RAW, HIDDEN_TAGS, BREAKING, BLOCK_TAGS, VOID, SELF_CLOSING, BAD_TAGS, BAD_WORDS, GOOD_TAGS, NEUTRAL_TAGS, ROOT_TAGS)
)
#: Boilerplate paths that training puts blocks under besides those of the pages.
OTHER_PATHS = [(("aside", ()),), (("header", ()),), (("form", ()),), (("nav", ()), ("ul", ()), ("li", ())), (("footer", ()), ("p", ())), (("aside", ()), ("p", ()))] + [
    ((tag, (word,)), ("p", ())) if k % 2 else ((tag, (word,)),) for k, word in enumerate(sorted(BAD_WORDS)) for tag in ("div", "section")
]
#: Paths below an article that training puts main text under besides those of the pages.
GOOD_ENDS = [tuple((t, ()) for t in x.split()) for x in ("ul li", "ol li", "blockquote p", "h2", "h3", "section p", "div p", "pre", "table tr td", "figure figcaption", "div", "dl dd")]
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
PLAIN_END = re.compile(r"[^>\"']*+>")
QUOTED_END = re.compile(r"[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+>")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}
#: Tags of a page that never end outside quotes, after which quotes no longer count; so a page is read in linear time.
BROKEN_TAGS = 8
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NUMBER = re.compile(r"&#([0-9]{8,}|[xX][0-9a-fA-F]{8,});?")


def slot(word: str, n: int) -> int:
    return zlib.crc32(word.encode()) % n


class Place:
    """An element and those above it. bits: the hashed tags and names of the path; bad and good: what the path says by itself."""

    __slots__ = ("above", "tag", "depth", "bits", "bad", "good")

    def __init__(self, above: Place | None, tag: str, names: tuple[str, ...] = ()):
        self.above, self.tag = above, tag
        self.depth, bits, bad, good = (above.depth + 1, above.bits, above.bad, above.good) if above else (1, 0, False, False)
        if tag not in NEUTRAL_TAGS:
            bits |= 1 << slot(tag, PATH_DIM)
        if names:
            if not BAD_WORDS.isdisjoint(names):
                bits |= 1 << slot("class:boilerplate", PATH_DIM)
                bad |= tag not in ROOT_TAGS
            for name in names:
                bits |= 1 << slot(f".{name}", PATH_DIM)
        self.bits = bits
        self.bad = bad or (tag in BAD_TAGS and not (tag == "header" and good))
        self.good = good or tag in GOOD_TAGS


Block = tuple[Place | None, str, float]  # where it stands, text, share of its characters inside links


def below(place: Place | None, path: tuple[tuple[str, tuple[str, ...]], ...]) -> Place | None:
    for tag, names in path:
        place = Place(place, tag, names)
    return place


def unescaped(text: str) -> str:
    """Character references decoded; numbers of many digits, which html.unescape can't take, too."""

    def long_number(m: re.Match) -> str:
        digits, base = (m[1][1:], 16) if m[1][0] in "xX" else (m[1], 10)
        digits = digits.lstrip("0")
        return html.unescape(f"&#{int(digits or '0', base)};") if len(digits) <= 7 else "\ufffd"

    return html.unescape(NUMBER.sub(long_number, text) if "&#" in text else text)


def pieces(page: str) -> Iterator[tuple[str, str, str]]:
    """(tag, attributes, "") of each start tag, (/tag, "", "") of each end tag and ("", "", text), in page order, each character read a bounded number of times."""
    at, n, last, broken = 0, len(page), page.rfind(">"), 0
    while at < n:
        start = page.find("<", at)
        if start < 0:
            start = n
        if start > at:
            yield "", "", page[at:start]
        if start == n:
            return
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else n
            continue
        if start > last:  # nothing closes from here on
            yield "", "", page[start:]
            return
        if page[start + 1] in "!?":
            at = page.find(">", start) + 1
            continue
        m = NAME.match(page, start)
        if not m:
            yield "", "", "<"
            at = start + 1
            continue
        e = PLAIN_END.match(page, m.end()) or (QUOTED_END.match(page, m.end()) if broken < BROKEN_TAGS else None)
        if not e:
            broken += 1
        end = e.end() if e else page.find(">", m.end()) + 1
        tag, at = m[1].lower(), end
        if page[start + 1] == "/":
            yield f"/{tag}", "", ""
            continue
        yield tag, page[m.end() : end - 1], ""
        if tag in RAW:
            e = RAW_END[tag].search(page, end)
            at = e.end() if e else n


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page with text, in page order."""
    out: list[Block] = []
    place: Place | None = None
    open_: dict[str, int] = {}
    parts: list[str] = []
    linked = depth = 0  # characters inside links; open links
    hidden = ""  # the element, never shown, that is open

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescaped("".join(parts)).split())
            if text:
                out.append((place, text, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    for tag, attributes, text in pieces(page):
        if not tag:
            if not hidden:
                parts.append(text)
                linked += len(text) * (depth > 0)
            continue
        end = tag[0] == "/"
        tag = tag.lstrip("/")
        if tag in RAW:
            continue
        if hidden:
            if end and tag == hidden or tag == "body" or hidden != "head" and tag in BREAKING:
                hidden = ""
            if tag not in BREAKING:
                continue
        elif tag in HIDDEN_TAGS:
            hidden = "" if end or attributes.rstrip().endswith("/") else tag
            continue
        if tag not in BLOCK_TAGS:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                depth = max(0, depth + (-1 if end else 1))
            continue
        close()
        if tag in VOID:
            continue
        depth = 0
        if end:
            if open_.get(tag):
                while place:
                    open_[place.tag] -= 1
                    found, place = place.tag == tag, place.above
                    if found:
                        break
            continue
        if tag in SELF_CLOSING and place and place.tag in (tag, "p"):
            open_[place.tag] -= 1
            place = place.above
        names = tuple(w.lower() for a in ATTRIBUTE.finditer(attributes) for w in re.split(r"[^A-Za-z0-9]+", a[1] or a[2] or a[3] or "") if w) if attributes.strip() else ()
        place = Place(place, tag, names)
        open_[tag] = open_.get(tag, 0) + 1
    close()
    return out


def teacher(block: Block) -> int:
    place, text, linked = block
    if place and place.bad:
        return 0
    if place and place.good:
        return 1
    return int(linked < 0.5 and len(text.split()) >= 8)


VECTORS = np.random.default_rng(7).standard_normal((2048, WORD_DIM)).astype(np.float32)
INPUT = PATH_DIM + WORD_DIM + 6


def features(page: list[Block], start: int = 0, end: int | None = None) -> np.ndarray:
    """The network's inputs of the page's blocks from start to end."""
    end = len(page) if end is None else end
    x = np.zeros((end - start, INPUT), np.float32)
    bits = b"".join((place.bits if place else 0).to_bytes(PATH_DIM // 8, "little") for place, _, _ in page[start:end])
    x[:, :PATH_DIM] = np.unpackbits(np.frombuffer(bits, np.uint8).reshape(-1, PATH_DIM // 8), axis=1, bitorder="little")
    for i, (place, text, linked) in enumerate(page[start:end]):
        words = text.split()
        x[i, PATH_DIM : PATH_DIM + WORD_DIM] = VECTORS[[slot(w, 2048) for w in words]].mean(0)
        x[i, PATH_DIM + WORD_DIM :] = (np.log1p(len(text)) / 8, np.log1p(len(words)) / 6, linked, text[-1] in ".!?", min(place.depth if place else 0, 64) / 8, (start + i) / len(page))
    return x


class Labeller:
    """A bidirectional LSTM with a logistic output. Weights by name: w, u, b of each direction, and o."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None):
        rng = np.random.default_rng(3)
        size = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.weights = weights or {f"{k}{d}": v for d in "fb" for k, v in (("w", size(INPUT, 4 * HIDDEN)), ("u", size(HIDDEN, 4 * HIDDEN)), ("b", np.zeros(4 * HIDDEN, np.float32)))} | {"o": size(2 * HIDDEN + 1, 1)}

    def states(self, x: np.ndarray, way: str, keep: list | None = None, memory: list | None = None) -> np.ndarray:
        """Hidden states of pages x (pages, blocks, inputs). Backward pages are reversed within their own length. memory: what an earlier part of the page left, replaced by what this one leaves."""
        pages, steps = x.shape[:2]
        z_in = x @ self.weights[f"w{way}"] + self.weights[f"b{way}"]
        h, c = memory or (np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32))
        out = np.zeros((pages, steps, HIDDEN), np.float32)
        for t in range(steps):
            z = z_in[:, t] + h @ self.weights[f"u{way}"]
            gates = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -20, 20)))
            i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            before, past = c, h
            c = f * c + i * g
            h = o * np.tanh(c)
            if keep is not None:
                keep.append((i, f, o, g, before, c, past))
            out[:, t] = h
        if memory is not None:
            memory[:] = h, c
        return out

    @staticmethod
    def turned(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        at = lengths[:, None] - 1 - np.arange(x.shape[1])[None]
        return np.take_along_axis(x, np.where(at < 0, np.arange(x.shape[1])[None], at)[:, :, None], 1)

    def read(self, x: np.ndarray, lengths: np.ndarray, kept: dict | None = None) -> np.ndarray:
        """Probability of main text for each block."""
        kf, kb = ([], []) if kept is not None else (None, None)
        forward = self.states(x, "f", kf)
        backward = self.turned(self.states(self.turned(x, lengths), "b", kb), lengths)
        top = np.concatenate([forward, backward, np.ones((*x.shape[:2], 1), np.float32)], 2)
        if kept is not None:
            kept.update(f=kf, b=kb, top=top)
        return 1 / (1 + np.exp(-np.clip((top @ self.weights["o"])[..., 0], -20, 20)))

    def read_long(self, page: list[Block], room: int) -> np.ndarray:
        """The same for one page of any length, `room` blocks at a time in both directions."""
        top = np.ones((len(page), 2 * HIDDEN + 1), np.float32)
        forward: list = []
        backward: list = []
        for start in range(0, len(page), room):
            x = features(page, start, min(start + room, len(page)))
            top[start : start + len(x), :HIDDEN] = self.states(x[None], "f", memory=forward)[0]
        for end in range(len(page), 0, -room):
            x = features(page, max(0, end - room), end)
            top[end - len(x) : end, HIDDEN : 2 * HIDDEN] = self.states(x[None, ::-1], "b", memory=backward)[0, ::-1]
        return 1 / (1 + np.exp(-np.clip((top @ self.weights["o"])[:, 0], -20, 20)))

    def slopes(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss, by backpropagation through time."""
        kept: dict = {}
        p = self.read(x, lengths, kept)
        real = np.arange(x.shape[1])[None] < lengths[:, None]
        d = ((p - y) * real / real.sum())[..., None].astype(np.float32)
        out = {"o": np.einsum("pth,pto->ho", kept["top"], d)}
        d_top = d @ self.weights["o"].T
        for way, d_h in (("f", d_top[..., :HIDDEN]), ("b", self.turned(d_top[..., HIDDEN : 2 * HIDDEN], lengths))):
            xs = x if way == "f" else self.turned(x, lengths)
            u = self.weights[f"u{way}"]
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            du = np.zeros_like(u)
            dh, dc = np.zeros_like(d_h[:, 0]), np.zeros_like(d_h[:, 0])
            for t in reversed(range(x.shape[1])):
                i, f, o, g, before, c, past = kept[way][t]
                dh = dh + d_h[:, t]
                th = np.tanh(c)
                dc = dc + dh * o * (1 - th * th)
                dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], 1)
                dz_all[:, t] = dz
                du += past.T @ dz
                dh, dc = dz @ u.T, dc * f
            out |= {f"w{way}": np.einsum("pti,ptz->iz", xs, dz_all), f"u{way}": du, f"b{way}": dz_all.sum((0, 1))}
        return out

    def train(self, pages: list[list[Block]], steps: int = STEPS) -> Labeller:
        """Adam on pages labelled by the teacher, each time with boilerplate put elsewhere and under other paths."""
        rng = np.random.default_rng(5)
        first, second = ({k: np.zeros_like(v) for k, v in self.weights.items()} for _ in "ab")
        for step in range(1, steps + 1):
            group = []
            for k in rng.integers(0, len(pages), 16):
                page = [(b, teacher(b)) for b in pages[k]]
                page = [(retagged(rng, b) if y and rng.random() < 0.3 else b, y) for b, y in page]
                bad = [b for b, y in page if not y] or [(None, "Home", 1.0)]
                good = [b for b, y in page if y] or bad
                for _ in range(rng.integers(1, 6)):
                    own, other = pick(rng, bad, good), OTHER_PATHS[rng.integers(0, len(OTHER_PATHS))]
                    at = int(rng.integers(0, len(page) + 1))
                    before = page[at - 1][0][0] if at and rng.random() < 0.5 else None
                    inside = before.above if before else below(None, (("html", ()), ("body", ())))
                    page.insert(at, ((below(inside, other), own[1], own[2]), 0))
                group.append(page)
            lengths = np.array(list(map(len, group)))
            x, y = np.zeros((len(group), lengths.max(), INPUT), np.float32), np.zeros((len(group), lengths.max()), np.float32)
            for j, page in enumerate(group):
                x[j, : len(page)], y[j, : len(page)] = features([b for b, _ in page]), [v for _, v in page]
            for k, g in self.slopes(x, lengths, y).items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.weights[k] = self.weights[k] - (RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def label(self, pages: list[list[Block]], room: int = 20_000) -> list[np.ndarray]:
        """Which blocks are main text. Pages of like length are read together, up to `room` blocks at a time."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        while order:
            if len(pages[order[-1]]) > room:
                k = order.pop()
                out[k] = self.read_long(pages[k], room) >= 0.5
                continue
            n = max(1, min(len(order), room // len(pages[order[-1]])))
            group, order = order[-n:], order[:-n]
            lengths = np.array([len(pages[k]) for k in group])
            x = np.zeros((n, lengths.max(), INPUT), np.float32)
            for j, k in enumerate(group):
                x[j, : len(pages[k])] = features(pages[k])
            for p, k in zip(self.read(x, lengths), group, strict=True):
                out[k] = p[: len(pages[k])] >= 0.5
        return out


def retagged(rng: np.random.Generator, block: Block) -> Block:
    """The same main text in another kind of block, as long as it stands below an article or main element."""
    place, text, linked = block
    above = place
    while above and above.above and above.above.good:
        above = above.above
    return (below(above, GOOD_ENDS[int(rng.integers(0, len(GOOD_ENDS)))]) if above is not place else place, text, linked)


def pick(rng: np.random.Generator, bad: list[Block], good: list[Block]) -> Block:
    """A text to put under a boilerplate path: mostly boilerplate, at times text that reads like an article."""
    own = bad if rng.random() < 0.5 else good
    return own[int(rng.integers(0, len(own)))]


def fit(pages: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Labeller | None:
    rows = pages.select("page_id", "html").filter(F.length("html").between(1, sample_chars))
    got = hashed_sample(rows, "page_id", sample, rows.count()).collect()
    read = [b for b in (blocks(r.html) for r in sorted(got, key=lambda r: (r.page_id is None, r.page_id or 0))) if b]
    return Labeller().train(read) if read else None


def main_text(pages: DataFrame, labeller: Labeller | None) -> DataFrame:
    """page_id, url, text, n_chars of every page row."""
    shared = pages.sparkSession.sparkContext.broadcast(labeller.weights if labeller else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Labeller(shared.value) if shared.value else None
        for b in batches:
            read = [blocks(h or "") for h in b.column(2).to_pylist()]
            labels = own.label(read) if own else [[teacher(x) for x in page] for page in read]
            texts = ["\n".join(x[1] for x, main in zip(page, y, strict=True) if main) for page, y in zip(read, labels, strict=True)]
            yield batch({"page_id": (b.column(0), pa.int64()), "url": (b.column(1), pa.string()), "text": (texts, pa.string()), "n_chars": (list(map(len, texts)), pa.int64())})

    return arrow_map(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return main_text(pages, fit(pages))
