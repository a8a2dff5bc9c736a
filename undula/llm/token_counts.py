"""Operator 1, token counts by rank-synchronous array merging.

Texts are cut into pre-tokens by the published pattern. The distinct new pre-tokens of an Arrow batch become one ragged
numpy array of byte symbols; in each round every pre-token merges all places of its own lowest-rank pair at once, and
finished ones leave the array. A pre-token's count is the number of symbols left. A document's count is the sum over its
pre-tokens, with a bounded cache of known ones.

Nulls and empty texts count 0 tokens. Repeated rows give repeated rows. Very long texts and pre-tokens are handled whole.
Special tokens' strings inside a text count as that one token, as the tokenizers library does by default.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from undula.llm.common import arrow_map, batch, splitter, table

CACHE_ROWS = 600_000
_ready: dict[int, PairTable] = {}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or one from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class PairTable:
    """Merge ranks as sorted arrays, and the merging of many byte strings at once."""

    def __init__(self, spec: str, pattern: str):
        model = json.loads(spec)
        vocab, merges = model["model"]["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        self.size = max(vocab.values()) + 1
        left, right = (np.array([vocab[m[i]] for m in merges], np.int64) for i in (0, 1))
        order = np.argsort(left * self.size + right, kind="stable")
        self.keys = (left * self.size + right)[order]
        self.ranks = order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)[order]
        self.of_byte = np.array([vocab[c] for c in byte_symbols()], np.int64)
        self.special = [t["content"] for t in model["added_tokens"]]
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.findall = splitter(pattern)
        self.cache: dict[str, int] = {}

    def merged(self, pieces: list[bytes]) -> np.ndarray:
        """How many symbols each non-empty piece has when no pair can be merged any more."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = np.ones(len(pieces), np.int64)
        sym = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        seq = np.repeat(np.arange(len(pieces)), sizes)
        none = len(self.keys)
        rank, row = self.ranked(sym, seq, np.arange(len(sym)))
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            lengths = np.diff(np.r_[starts, len(sym)])
            best = np.minimum.reduceat(rank, starts)
            out[seq[starts]] = lengths
            open_ = best < none
            chosen = np.flatnonzero((rank == np.repeat(best, lengths)) & (rank < none))
            if not len(chosen):
                break
            run = np.r_[True, np.diff(chosen) != 1]  # of overlapping places, as in aaa, every second one merges
            first = np.maximum.accumulate(np.where(run, np.arange(len(chosen)), 0))
            chosen = chosen[(np.arange(len(chosen)) - first) % 2 == 0]
            sym[chosen] = self.made[row[chosen]]
            keep = np.repeat(open_, lengths)
            keep[chosen + 1] = False
            sym, seq, rank, row = sym[keep], seq[keep], rank[keep], row[keep]
            at = np.cumsum(keep)[chosen] - 1  # only pairs beside a merged symbol are new
            at = np.unique(np.r_[at, np.maximum(at - 1, 0)])
            rank[at], row[at] = self.ranked(sym, seq, at)
        return out

    def ranked(self, sym: np.ndarray, seq: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the pairs that begin at these places: rank (beyond all ranks if there is none) and row in the table."""
        after = np.minimum(at + 1, len(sym) - 1)
        key = sym[at] * self.size + sym[after]
        row = np.searchsorted(self.keys, key)
        row[row == len(self.keys)] = 0
        known = (self.keys[row] == key) & (seq[after] == seq[at]) & (after > at)
        return np.where(known, self.ranks[row], len(self.keys)), row

    def counts(self, texts: list[str]) -> list[int]:
        cache, pieces, extra = self.cache, [], []
        for text in texts:
            parts = self.split.split(text) if self.split and any(s in text for s in self.special) else [text]
            extra.append(len(parts) - 1)
            pieces.append(self.findall(text) if len(parts) == 1 else list(chain.from_iterable(map(self.findall, parts))))
        if len(cache) > CACHE_ROWS:
            cache.clear()
        if new := [p for p in set(chain.from_iterable(pieces)) if p not in cache]:
            cache.update(zip(new, self.merged([p.encode() for p in new]).tolist(), strict=True))
        return [n + sum(map(cache.__getitem__, own)) for n, own in zip(extra, pieces, strict=True)]


def token_counts(docs: DataFrame, tokenizer_path: str, pattern: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every document.

    The tokenizer file is read on the driver and broadcast; its size is that of one vocabulary, whatever the corpus.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _ready.get(key := hash((spec.value, pattern))) or _ready.setdefault(key, PairTable(spec.value, pattern))
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = pairs.counts(texts)
            yield batch({"doc_id": (b.column(0), pa.int64()), "n_bytes": ([len(t.encode()) for t in texts], pa.int64()), "n_tokens": (n, pa.int64()), "over_limit": ([x > limit for x in n], pa.bool_())})

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
