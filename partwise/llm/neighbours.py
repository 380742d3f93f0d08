"""Approximate nearest neighbours by a hash-prefix forest.

Vectors get one long hash string for each tree. Its first symbol names the axis of a random rotation to which the vector is nearest,
with its sign (a cross-polytope hash); each further symbol is one bit, the sign of a random projection. Rows are dealt into shards of bounded size; in
each shard every tree is an array of its rows' strings in sorted order, so the rows that share a prefix with a query are one range of
it. A query descends to its longest prefix match in each tree, and all trees then ascend together, one symbol at a time, until the
candidates suffice: first until there are `least` of them, whose kth score tells how near a neighbour must be, then until a
neighbour as near as that would be missed by all trees with a probability below `miss`. So the prefixes get as short as the
data need: on vectors without clusters they are short. Only candidates are scored: exactly, in double precision, on the original vectors.

The largest inner product becomes the smallest angle by one more coordinate, sqrt(most norm squared - norm squared).
Equal vectors fold into one with its least ids, as many as a result may need (an exact shortcut for hot vectors).

A shard's rows and then the queries reach one task in order; the forest is built once, the queries are read by blocks. Every query is
looked up in every shard. To route queries by prefix instead, each tree's strings would have to be dealt over the cluster by prefix: 128
strings and ids a row, eight times the vectors, which is more to shuffle than the queries are.

Defined results: vectors null, empty, zero, of another length than most rows' or with null or non-finite components take no part, neither as
query nor as candidate; ties go to the smaller vec_id; with fewer than k candidates all are returned; an empty table
gives none. Rows with the same vec_id and vector are one; with a null vec_id they take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partwise.llm.common import staged

TREES, BITS, SHARD_ROWS, BLOCK_QUERIES = 128, 24, 32768, 1024


@cache
def agreement(dims: int, pairs: int = 4000) -> np.ndarray:
    """The probability that vectors of the cosine i / 50 agree in a string's first symbol."""
    a, b = np.random.default_rng(5).standard_normal((2, pairs, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)
    out = [(symbol(a) == symbol(i / 50 * a + math.sqrt(1 - (i / 50) ** 2) * b)).mean() for i in range(51)]
    return np.maximum.accumulate(np.maximum(out, 1e-6))


def symbol(y: np.ndarray) -> np.ndarray:
    """The axis to which each row is nearest, with its sign."""
    axis = np.abs(y).argmax(-1)
    return 2 * axis + (np.take_along_axis(y, axis[..., None], -1)[..., 0] > 0)


class Forest:
    """Sorted arrays of the hash strings of one shard's vectors. most: the largest norm of all vectors, of all shards."""

    def __init__(self, vectors: np.ndarray, most: float, trees: int = TREES, bits: int = BITS, seed: int = 11):
        self.x, self.most, self.trees, self.bits = vectors, most, trees, bits
        self.dims = vectors.shape[1] + 1
        rng = np.random.default_rng(seed)
        self.turns = [np.linalg.qr(rng.standard_normal((self.dims, self.dims)))[0].astype(np.float32) for _ in range(trees)]
        self.sides = rng.standard_normal((trees, self.dims, bits)).astype(np.float32)
        strings = self.strings(vectors, np.sqrt(np.maximum(0, most**2 - (vectors**2).sum(1))))
        self.order = np.argsort(strings, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(strings, self.order, 1)

    def strings(self, x: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """(tree, row): the first symbol, then the bits."""
        own = np.concatenate([x, rest[:, None]], 1).astype(np.float32)
        out = np.empty((self.trees, len(x)), np.int64)
        for t in range(self.trees):
            more = np.packbits(np.pad(own @ self.sides[t] > 0, ((0, 0), (32 - self.bits, 0))), axis=1).view(">u4")[:, 0]
            out[t] = (symbol(own @ self.turns[t]) << self.bits) | more
        return out

    def ranges(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each query's prefix of each length (0: the empty one) begins and ends in each tree: (query, length, tree)."""
        s = self.strings(q, np.zeros(len(q)))
        low = np.zeros((len(q), self.bits + 2, self.trees), np.int32)
        high = np.full_like(low, len(self.x))
        for length in range(1, self.bits + 2):
            rest = self.bits + 1 - length
            first = s >> rest << rest
            for t in range(self.trees):
                low[:, length, t] = np.searchsorted(self.sorted[t], first[t])
                high[:, length, t] = np.searchsorted(self.sorted[t], first[t] + (1 << rest))
        return low, high

    def length_for(self, near: float, miss: float) -> int:
        """The longest prefix by which a neighbour of this cosine is missed by all trees with at most this probability."""
        near = max(-1.0, min(1.0, near))
        first, bit, share = agreement(self.dims)[max(0, int(near * 50))], 1 - math.acos(near) / math.pi, 1 - miss ** (1 / self.trees)
        if first < share:
            return 0
        return 1 + min(self.bits, int(math.log(share / first) / math.log(bit))) if bit < 1 else 1 + self.bits

    def search(self, q: np.ndarray, k: int, least: int, miss: float) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """For each query: the indices and exact scores of its k best candidates, and the number of candidates."""
        low, high = self.ranges(q)
        counts = (high - low).sum(2)  # by query and length; falls with the length
        norms = np.sqrt((q**2).sum(1)) * max(self.most, 1e-300)
        rough, asked = self.x.astype(np.float32), q.astype(np.float32)
        for i in range(len(q)):
            length = max(0, int((counts[i] >= least).sum()) - 1)
            seen = self.members(low[i, length], high[i, length])
            scores = rough[seen] @ asked[i]
            if len(seen) < len(self.x):
                near = np.partition(scores, -k)[-k] / norms[i] if len(seen) >= k else -1.0
                if (shorter := min(length, self.length_for(near, miss) if len(seen) >= k else 0)) < length:
                    seen = self.members(low[i, shorter], high[i, shorter])
                    scores = rough[seen] @ asked[i]
            n = len(seen)
            if n > k:
                seen = seen[scores >= np.partition(scores, -k)[-k] - 1e-5 * norms[i]]
            yield seen, np.einsum("ij,j->i", self.x[seen], q[i]), n

    def members(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The rows that share the prefix in any tree."""
        mark = np.zeros(len(self.x), bool)
        for t in np.flatnonzero(high > low):
            mark[self.order[t, low[t] : high[t]]] = True
        return np.flatnonzero(mark)


def _by_shard(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[int, bool, list[list[int]], np.ndarray]]:
    """(shard, asked, ids, vectors) of a shard's rows in one piece, then of its queries by blocks, from rows in the order of shard and asked."""
    key, ids, parts, n = None, [], [], 0
    for batch in batches:
        shards, kinds = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "asked"))
        change = np.flatnonzero((shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1])) + 1
        for a, b in zip([0, *change], [*change, batch.num_rows], strict=True):
            while a < b:
                if key is not None and (key != (shards[a], kinds[a]) or key[1] and n >= block):
                    yield *key, ids, np.concatenate(parts)
                    ids, parts, n = [], [], 0
                key = (shards[a], kinds[a])
                take = min(b - a, block - n) if key[1] else b - a
                own = batch.slice(a, take)
                ids += own.column("ids").to_pylist()
                parts.append(np.asarray(own.column("vec").flatten()).reshape(take, -1))
                n, a = n + take, a + take
    if n:
        yield *key, ids, np.concatenate(parts)


def nearest(
    vectors: DataFrame, is_query, k: int = 20, least: int = 256, miss: float = 0.2,
    trees: int = TREES, bits: int = BITS, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows found for each row of vectors (vec_id, embedding) that fulfils is_query."""
    one = F.col("embedding").cast("array<double>")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select("vec_id", one.alias("vec")).where(F.col("vec_id").isNotNull() & (F.size("vec") > 0) & fine & F.exists("vec", lambda x: x != 0))
    # equal vectors are one, with the k + 1 least ids (partial limits come before the shuffle)
    at = Window.partitionBy("vec").orderBy("vec_id")
    few = rows.distinct().withColumn("_n", F.row_number().over(at)).where(F.col("_n") <= k + 1)
    distinct = staged(few.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    told = distinct.agg(F.count("*").alias("n"), F.mode(F.size("vec"), deterministic=True).alias("d"), F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)).alias("m")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not told.n:
        return vectors.sparkSession.createDataFrame([], schema)
    d, most = told.d, math.sqrt(told.m)
    shards = max(1, -(-told.n // shard_rows))
    items = distinct.where(F.size("vec") == d).select(F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asked"), "ids", "vec")
    own = rows.where(is_query & (F.size("vec") == d)).distinct()
    asked = own.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asked"), F.array("vec_id").alias("ids"), "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held, lists = None, None, []
        for shard, is_asked, ids, x in _by_shard(batches, block_queries):
            if not is_asked:
                forest, held, lists = Forest(x, most, trees, bits), shard, ids
                continue
            if held != shard:  # no row of the table fell into this shard
                continue
            found: list[tuple] = []
            for (query,), (seen, scores, _) in zip(ids, forest.search(x, k + 1, least, miss), strict=True):
                order = np.lexsort(([lists[j][0] for j in seen], -scores))[: k + 1]
                got = [(-scores[o], v) for o in order.tolist() for v in lists[seen[o]] if v != query]
                found += [(query, v, -s) for s, v in sorted(got)[:k]]
            if found:
                a, b, c = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=["query_id", "vec_id", "score"])

    met = items.unionByName(asked).repartition(4 * shards, "shard").sortWithinPartitions("shard", "asked")
    hits = met.mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
