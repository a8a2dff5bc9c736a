"""Operator 7, byte-level BPE encoding and decoding by Aho-Corasick matches and backtracking.

The vocabulary's byte strings, mapped to Latin-1, form one pyahocorasick automaton. It gives the longest token at each
place of a pre-token; each token knows the next shorter token that begins it. From the left the longest match is taken
whose neighbour before it is compatible, with backtracking and a mark on places that no valid encoding reaches, so the
work is linear in the length. Two adjacent tokens are compatible when merging their joined bytes by rank gives just these
two; that is memoised. A sequence whose neighbours are all compatible is the one that rank merging yields.

Each distinct pre-token of a group of texts is looked up once; ids, their decimal texts and the decoded bytes of whole
documents are then gathered by numpy and Arrow. A group has at most GROUP_CHARS characters, or is one longer text.

Nulls and empty texts have no ids. Repeated rows give repeated rows. No text or pre-token is cut.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from undula.llm.common import arrow_map, batch, splitter, table

CACHE_ROWS, PAIR_ROWS, GROUP_CHARS = 600_000, 1_000_000, 1 << 22
NO_RANK = 1 << 30
_ready: dict[tuple[bytes, str], Codec] = {}


class Codec:
    def __init__(self, ranks_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        every = range(max(self.bytes_of, default=-1) + 1)
        self.size = [len(self.bytes_of.get(i, b"")) for i in every]
        self.plain = pa.array([self.bytes_of.get(i, b"") for i in every], pa.large_binary())
        self.names = pa.array(list(map(str, every)), pa.large_string())
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ranks.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter = [-1] * len(every)  # of each token, the longest shorter one that begins it
        for t, i in self.ranks.items():
            self.shorter[i] = next((self.ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ranks), -1)
        self.findall = splitter(pattern)
        self.cache: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        self.edges: dict[int, tuple[list[int], list[int]] | None] = {}

    def merged(self, data: bytes, below: int = NO_RANK) -> list[bytes]:
        """Plain merging by ranks less than `below`; used on the bytes of one or two tokens only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], NO_RANK), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def grown(self, token: int) -> tuple[list[int], list[int]] | None:
        """How a token's first and last part grow from a byte to the token as its bytes are merged, as ids in order.

        None for a token that merging doesn't make, or not by rising ranks."""
        if token not in self.edges:
            data = self.bytes_of[token]
            out = ([token], [token]) if len(data) == 1 else None
            parts = self.merged(data, token)
            if len(data) > 1 and len(parts) == 2:
                a, b = self.ranks[parts[0]], self.ranks[parts[1]]
                first, last = self.grown(a), self.grown(b)
                if first and last and (len(parts[0]) == 1 or a < token) and (len(parts[1]) == 1 or b < token):
                    out = (first[0] + [token], last[1] + [token])
            self.edges[token] = out
        return self.edges[token]

    def separate(self, a: int, b: int) -> bool:
        """Do the joined bytes of two tokens merge to just these two? Both sides grow by rank; a pair across the border that ranks before both sides' next step (at equal ranks the place further left goes first) would join them."""
        x, y = self.grown(a), self.grown(b)
        if not x or not y:
            return self.merged(self.bytes_of[a] + self.bytes_of[b]) == [self.bytes_of[a], self.bytes_of[b]]
        left, right, i, j = x[1], y[0], 0, 0
        while True:
            next_left = left[i + 1] if i + 1 < len(left) else NO_RANK
            next_right = right[j + 1] if j + 1 < len(right) else NO_RANK
            across = self.ranks.get(self.bytes_of[left[i]] + self.bytes_of[right[j]], NO_RANK)
            if across < next_left and across <= next_right and across < NO_RANK:
                return False
            if next_left == next_right == NO_RANK:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def compatible(self, a: int, b: int) -> bool:
        """Worked out once for each pair."""
        if len(self.pairs) > PAIR_ROWS:
            self.pairs.clear()
        known = self.pairs[a << 20 | b] = self.separate(a, b)
        return known

    def piece(self, data: bytes) -> tuple[int, ...]:
        """The ids of one pre-token."""
        if (whole := self.ranks.get(data)) is not None:
            return (whole,)
        size, pairs, shorter = self.size, self.pairs, self.shorter
        longest = [-1] * len(data)
        for end, token in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - size[token]] = token  # longer ones come later
        # A place is entered once: the valid encoding of what stands before it is unique.
        dead: set[int] = set()
        ids: list[int] = []
        at, last, token = 0, -1, longest[0] if data else -1
        while at < len(data):
            while token >= 0:
                if at + size[token] not in dead:
                    if last < 0:
                        break
                    fits = pairs.get(last << 20 | token)
                    if fits or (fits is None and self.compatible(last, token)):
                        break
                token = shorter[token]
            else:
                if not ids:
                    raise ValueError("the vocabulary cannot spell these bytes")
                dead.add(at)
                back = ids.pop()
                at -= size[back]
                last, token = ids[-1] if ids else -1, shorter[back]
                continue
            ids.append(token)
            at += size[token]
            last, token = token, longest[at] if at < len(data) else -1
        return tuple(ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all these texts in a row, and where each text's begin (one more: the end)."""
        found = list(map(self.findall, texts))
        pieces = list(chain.from_iterable(found))
        distinct = list(dict.fromkeys(pieces))
        place = dict(zip(distinct, range(len(distinct)), strict=True))
        at = np.fromiter(map(place.__getitem__, pieces), np.int64, len(pieces))
        cache = self.cache
        if len(cache) > CACHE_ROWS:
            cache.clear()
        own = list(map(cache.get, distinct))
        for i, known in enumerate(own):
            if known is None:
                own[i] = cache[distinct[i]] = self.piece(distinct[i].encode())
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        values = np.fromiter(chain.from_iterable(own), np.int32, int(sizes.sum()))
        begin = np.cumsum(sizes) - sizes
        n = sizes[at]
        before = np.r_[0, np.cumsum(n)]
        ids = values[np.repeat(begin[at] - before[:-1], n) + np.arange(before[-1])]
        ends = np.cumsum([0, *map(len, found)])
        return ids, before[ends]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def digests(values: pa.Array, offsets: np.ndarray, mark: str | bytes) -> list[str]:
    """sha256 of each list's values, joined by `mark`."""
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), values), pa.scalar(mark, values.type))
    at = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1)
    data = memoryview(joined.buffers()[2] or b"")
    return [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def groups(texts: list[str], most: int) -> Iterator[list[str]]:
    own: list[str] = []
    room = most
    for t in texts:
        if own and len(t) > room:
            yield own
            own, room = [], most
        own.append(t)
        room -= len(t)
    if own:
        yield own


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, token_ids of every document.

    The rank file is read on the driver and broadcast; its size is that of one vocabulary, whatever the corpus.
    """
    with open(ranks_path, "rb") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (hashlib.sha256(spec.value).digest(), pattern)
        codec = _ready.get(key) or _ready.setdefault(key, Codec(spec.value, pattern))
        for b in batches:
            done = 0
            for texts in groups([t or "" for t in b.column(1).to_pylist()], GROUP_CHARS):
                ids, offsets = codec.encode(texts)
                of_id = pa.array(ids, pa.int32())
                coded = digests(codec.names.take(of_id), offsets, ",")
                plain = digests(codec.plain.take(of_id), offsets, b"")
                out = batch({"doc_id": (b.column(0).slice(done, len(texts)), pa.int64()), "n_tokens": (np.diff(offsets), pa.int64()), "ids_sha256": (coded, pa.string()), "decoded_sha256": (plain, pa.string())})
                if with_ids:
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), of_id)
                    out = pa.RecordBatch.from_arrays([*out.columns, lists], names=[*out.schema.names, "token_ids"])
                yield out
                done += len(texts)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    return arrow_map(docs.select("doc_id", "text"), run, schema)


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
