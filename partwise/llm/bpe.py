"""Byte-level BPE with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is a vocabulary entry gets its id without any
merging. Tier two merges the bytes of the rest: nodes linked by their start and end offsets, and a heap of candidate
merges by rank, so a pre-token of n bytes takes O(n log n) whatever its length.

Defined results: a null text is the empty text (no ids; the digests of nothing); any text, of any length, is encoded
whole; decoding the ids gives the text's UTF-8 bytes; repeated rows give repeated results; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from partwise.llm.common import column, slices, with_columns

MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)  # fixed values: the multipliers of splitmix64
ALL = (1 << 64) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    h = h + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & ALL)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX[0])
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX[1])
    return h ^ (h >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of fixed keys, by levels of bit arrays: a key rests on the first level where no other key
    shares its position, and its slot is the number of set bits before it."""

    def __init__(self, keys: list[bytes], spread: float = 2.0):
        left = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
        if len(set(left.tolist())) != len(keys):
            raise ValueError("two keys share a 64-bit hash")
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        below = 0
        while len(left):
            size = max(8, int(len(left) * spread))
            at = _mixed(left, len(self.levels)) % np.uint64(size)
            bits = np.bincount(at.astype(np.int64), minlength=size) == 1
            before = np.cumsum(bits) - bits + below
            self.levels.append((size, bits, before))
            below += int(bits.sum())
            left = left[~bits[at.astype(np.int64)]]
        self.keys: list[bytes] = [b""] * len(keys)
        for key, slot in zip(keys, self.slots(keys), strict=True):
            self.keys[slot] = key

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """A slot for each key; those that aren't among the fixed keys get any slot or -1, so compare self.keys."""
        h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (size, bits, before) in enumerate(self.levels):
            at = (_mixed(h[left], level) % np.uint64(size)).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = before[at[hit]]
            left = left[~hit]
        return out


def first_ranks(ranks: dict[bytes, int]) -> list[int]:
    """The rank of each pair of bytes, by 256 * the first + the second; -1 for pairs that aren't merged."""
    return [ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]


def merge_bytes(piece: bytes, ranks: dict[bytes, int], first: list[int] | None = None) -> tuple[int, ...]:
    """The ids of one pre-token: the pair of neighbours with the lowest rank is merged first, the leftmost on a tie. first: first_ranks of ranks."""
    n = len(piece)
    m = n + 1
    end = [*range(1, m)]  # of the node that starts here; 0: no node starts here any more
    start = [-1, *range(n)]  # of the node that ends here
    first = first_ranks(ranks) if first is None else first
    # a merge as one number: its rank, where it starts, where it ends
    heap = [(r * m + i) * m + i + 2 for i, (a, b) in enumerate(zip(piece, piece[1:], strict=False)) if (r := first[a << 8 | b]) >= 0]
    heapify(heap)
    rank = ranks.get
    while heap:
        x, e = divmod(heappop(heap), m)
        i = x % m
        j = end[i]
        if not j or j >= n or end[j] != e:
            continue
        end[j], end[i], start[e] = 0, e, i
        if i and (r := rank(piece[(p := start[i]) : e])) is not None:
            heappush(heap, (r * m + p) * m + e)
        if e < n and (r := rank(piece[i : (q := end[e])])) is not None:
            heappush(heap, (r * m + i) * m + q)
    out, i = [], 0
    while i < n:
        j = end[i]
        out.append(ranks[piece[i:j]])
        i = j
    return tuple(out)


class Encoder(dict):
    """pre-token -> ids: a memo of what the two tiers give. When it is full it becomes the older one of two, from which what is still used comes back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = 200_000):
        super().__init__()
        self.ranks, self.memo, self.older = ranks, memo, {}
        self.first = first_ranks(ranks)
        self.table = PerfectHash([*ranks])
        self.slot_ids = [ranks[k] for k in self.table.keys]
        self.find = regex.compile(pattern).findall
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, i in ranks.items():
            self.bytes[i] = k
        self.words = [str(i) for i in range(len(self.bytes))]

    def learn(self, pieces: set[str]) -> None:
        older, missing = self.older, []
        for p in pieces.difference(self):
            if (ids := older.get(p)) is not None:
                self[p] = ids
            else:
                missing.append(p)
        keys = [p.encode("utf-8", "surrogatepass") for p in missing]
        known, ids, ranks, first = self.table.keys, self.slot_ids, self.ranks, self.first
        for p, key, slot in zip(missing, keys, self.table.slots(keys).tolist(), strict=True):
            self[p] = (ids[slot],) if slot >= 0 and known[slot] == key else merge_bytes(key, ranks, first)

    def encode_all(self, texts: list[str], most: int = 1 << 20) -> Iterator[list[int]]:
        """The ids of each text. The new pre-tokens of texts of up to `most` characters together are looked up at once."""
        at = 0
        while at < len(texts):
            if len(self) > self.memo:
                self.older = dict(self)
                self.clear()
            pieces, size = [], 0
            while at < len(texts) and (not pieces or size + len(texts[at]) <= most):
                pieces.append(self.find(texts[at]))
                size += len(texts[at])
                at += 1
            self.learn(set().union(*pieces))
            for own in pieces:
                yield [*chain.from_iterable(map(self.__getitem__, own))]

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


_encoders: dict[str, Encoder] = {}


def _encoder(key: str, ranks, pattern: str) -> Encoder:
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ranks.value, pattern)
    return _encoders[key]


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with_ids, ids (array of int) of each row's text.

    The vocabulary (its size doesn't grow with the data) is broadcast; each Python worker builds the perfect hash once.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    key = hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(key, shared, pattern)
        sha = hashlib.sha256
        for batch in slices(batches, 512):
            n, a, b, all_ids = [], [], [], []
            for ids in own.encode_all([t or "" for t in column(batch, "text")]):
                n.append(len(ids))
                a.append(sha(" ".join(map(own.words.__getitem__, ids)).encode()).hexdigest())
                b.append(sha(own.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(ids)
            more = {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a), "decoded_sha256": pa.array(b)}
            if with_ids:
                more["ids"] = pa.array(all_ids, pa.list_(pa.int32()))
            yield with_columns(batch, ["doc_id"], more)

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)
