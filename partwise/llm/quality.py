"""Quality by nearest-neighbour voting in a latent-semantic space.

A text becomes counts of terms: shapes of its words (letters by case, digits and signs, runs collapsed), shapes of the ends of
its lines, hashed words, and terms for what repeats. Terms are weighted by tf-idf, and a truncated singular value
decomposition of a bounded labelled sample gives the latent space. The labelled vectors are broadcast; every document's
exact cosines with all of them are computed by blocks, and its nearest neighbours vote with their similarity as weight.

Defined results: a null or empty text has no terms; it gets the share of label 1 in the sample's classes as evened (0.5). Texts are
read whole. doc_id may be null or repeated (each row gets its own score). Without labels every score is 0.5.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from partwise.llm.common import column, labelled_sample, slices, with_columns

SHAPES, WORDS = 1536, 512
TERMS = SHAPES + WORDS
#: How much hashed words count beside shapes.
WORD_WEIGHT = 0.25


def _shape(word: str) -> str:
    return "".join(k for k, _ in groupby("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word))


class Terms:
    """text -> sparse term counts (ids, values)."""

    def __init__(self, memo: int = 100_000):
        self.memo, self.size = {}, memo

    def _ids(self, word: str) -> tuple[int, int]:
        return crc32(_shape(word).encode()) % SHAPES, SHAPES + crc32(word.lower().encode()) % WORDS

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = (text or "").split()
        if not words:
            return np.empty(0, np.int32), np.empty(0, np.float32)
        if len(self.memo) > self.size:
            self.memo.clear()
        memo, n = self.memo, len(words)
        counts = Counter(words)
        shapes: dict[int, float] = {}
        lexical: dict[int, float] = {}
        for w, k in counts.items():
            if (ids := memo.get(w)) is None:
                ids = memo[w] = self._ids(w)
            shapes[ids[0]] = shapes.get(ids[0], 0) + k
            lexical[ids[1]] = lexical.get(ids[1], 0) + k
        lines = [x for x in text.split("\n") if x.strip()]
        ends = Counter("^" + _shape(x.strip()[:1]) + "$" + _shape(x.strip()[-1:]) for x in lines)
        told = {
            f"again{int(20 * sum(map(eq, words, words[1:])) / n)}": n / 4,
            f"top{int(10 * counts.most_common(1)[0][1] / n) if n >= 20 else -1}": n / 8,
            f"kinds{int(10 * len(counts) / n) if n >= 20 else -1}": n / 16,
            f"lines{int(10 * (1 - len(set(lines)) / max(1, len(lines))))}": n / 8,
        }
        for t, k in ends.items():
            told[t] = k * n / len(lines) / 4
        for t, k in told.items():
            i = crc32(t.encode()) % SHAPES
            shapes[i] = shapes.get(i, 0) + k
        ids = np.fromiter((*shapes, *lexical), np.int32, len(shapes) + len(lexical))
        values = np.fromiter((*shapes.values(), *lexical.values()), np.float32, len(ids)) / n
        return ids, np.log1p(100 * values)


class Space:
    """The latent space and the labelled vectors in it. Its size is bounded by the sample and the number of terms."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], dims: int = 48, seed: int = 7):
        x = np.zeros((len(rows), TERMS), np.float32)
        for r, (ids, values) in enumerate(rows):
            x[r, ids] = values
        self.idf = (np.log((1 + len(rows)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
        self.idf[SHAPES:] *= WORD_WEIGHT
        x *= self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        rng = np.random.default_rng(seed)
        dims = max(1, min(dims, *x.shape)) if len(rows) else 1
        q = rng.standard_normal((TERMS, dims + 8)).astype(np.float32)
        for _ in range(4):  # randomised subspace iteration
            q, _ = np.linalg.qr(x.T @ (x @ q)) if len(rows) else (q, None)
        self.basis = np.ascontiguousarray((q @ np.linalg.svd(x @ q, full_matrices=False)[2].T)[:, :dims]) if len(rows) else q[:, :dims]
        self.labels = np.array(labels, np.float32)
        self.vectors = self._normal(x @ self.basis)

    @staticmethod
    def _normal(z: np.ndarray) -> np.ndarray:
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]], k: int = 15, prior: float = 0.5) -> np.ndarray:
        """Similarity-weighted share of label 1 among the k nearest labelled vectors."""
        x = np.zeros((len(rows), TERMS), np.float32)
        for r, (ids, values) in enumerate(rows):
            x[r, ids] = values * self.idf[ids]
        z = self._normal(x @ self.basis)
        if not len(self.labels):
            return np.full(len(rows), prior)
        k = min(k, len(self.labels))
        near = z @ self.vectors.T
        at = np.argpartition(near, -k, axis=1)[:, -k:]
        weight = np.maximum(np.take_along_axis(near, at, 1), 0).astype(np.float64) ** 4
        return ((weight * self.labels[at]).sum(1) + 1e-3 * prior) / (weight.sum(1) + 1e-3)


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms = Terms()
    for batch in slices(batches, 256):
        each = [terms.of(t) for t in column(batch, "text")]
        ids, values = pa.array([a.tolist() for a, _ in each], pa.list_(pa.int32())), pa.array([b.tolist() for _, b in each], pa.list_(pa.float32()))
        yield with_columns(batch, ["doc_id", "label"], {"ids": ids, "vals": values})


def learn(docs: DataFrame, labels: DataFrame, where, per_class: int = 1500) -> Space:
    """The space of at most per_class labelled documents of each class that fulfil `where`. What reaches the driver for
    each of them is at most one value for each of the TERMS terms."""
    sample = labelled_sample(docs, labels, "quality", where, per_class)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sample.mapInArrow(_term_rows, f"doc_id {kind}, label int, ids array<int>, vals array<float>").collect()
    rows.sort(key=lambda r: r.doc_id)
    return Space([(np.array(r.ids, np.int32), np.array(r.vals, np.float32)) for r in rows], [r.label for r in rows])


def score(docs: DataFrame, space: Space, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The named columns and score (double, 0 to 1) of each row's text."""
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, terms = shared.value, Terms()
        for batch in slices(batches, 512):
            scores = own.score([terms.of(t) for t in column(batch, "text")])
            yield with_columns(batch, [*columns], {"score": pa.array(scores, pa.float64())})

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(run, f"{fields}, score double")
