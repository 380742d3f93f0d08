"""Near-duplicate classes by DartMinHash and banded joining.

A text is the multiset of its shingles of five words (lower case, split at white space). Each unit of a shingle's weight is a
region at which darts are thrown: a Poisson process of ranks whose gaps are hashes of region and number. A dart's hash
names its coordinate; each coordinate keeps its earliest dart, so two texts agree in a coordinate with the probability
of their weighted Jaccard similarity. Only darts up to a rank that leaves about k ln k + 2k of them are thrown; if
a coordinate stays empty, the rank is doubled.

Exact copies fold into one node first. Bands of 7 coordinates name buckets. A node's score is the number of other members of its buckets, so
of copies of one text the text that they vary scores most. The members of a bucket are compared with its member of the highest score,
the centre. Then each bucket's members outside of its largest component of the links so far meet all its members of other components: in buckets of
up to 64 members pair by pair, but for pairs whose numbers of shingles alone keep them below the threshold; in larger ones by blocks of about a thousand
members, where a product of incidence matrices (members by regions) gives the exact similarities, and a block tells no more links than join its components. So the pairs that are
rows are bounded by the members, and no task holds more than two blocks. A pair counts if its exact weighted Jaccard similarity is at least the threshold. Classes
are the connected components of the links.

So the classes are those that comparing all pairs of all buckets would give: a pair that isn't compared has its ends in one component. What banding itself
can lose: with 32 bands a pair of similarity 0.8 shares no bucket with probability 0.0005, one of 0.85 with 0.000005. Blocks are no work where a bucket is one class; in a
bucket of unlike texts their number is the square of the number of its thousands.

Hot groups: counts and minima are pre-aggregated; joins read staged tables, so AQE splits a hot copy, bucket or centre.

Defined results: a null text, or one without words, is a class by itself; a text of fewer than five words is one shingle;
texts are read whole; repeated rows are exact copies (also if doc_id is the same or null); empty tables give empty
results; further columns don't matter unless they are asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from partwise.llm.common import column, discard, put_back, set_aside, slices, staged, with_columns

WIDTH, THRESHOLD, BANDS, ROWS = 5, 0.8, 32, 7
#: Buckets of up to so many members are compared by pairs, larger ones by blocks of about so many members and shingles.
SMALL, BLOCK_NODES, BLOCK_SHINGLES = 64, 1024, 1 << 20
U = np.uint64
STEP = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Words(dict):
    """word -> hash."""

    def __missing__(self, word: str) -> int:
        self[word] = h = xxh3_64_intdigest(word)
        return h


class Sketcher:
    def __init__(self, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH, memo: int = 100_000):
        self.bands, self.rows, self.k, self.width, self.memo = bands, rows, bands * rows, width, memo
        self.words = Words()
        self.throws = self.k * (math.log(self.k) + 2)

    def shingles(self, words: list[str]) -> np.ndarray:
        """The hashes of the shingles, sorted, with repeats."""
        if len(self.words) > self.memo:
            self.words.clear()
        h = np.fromiter(map(self.words.__getitem__, words), U, len(words))
        n = len(words) - self.width + 1
        if n < 1:
            return mix((h * np.arange(3, 2 * len(words) + 3, 2, dtype=U)).sum(keepdims=True) + U(len(words)))
        out = np.zeros(n, U)
        for i in range(self.width):
            out += mix(h[i : i + n] + STEP[0]) * STEP[i % 5] * U(2 * (i // 5) + 1)
        out = mix(out)
        out.sort()
        return out

    def regions(self, shingles: np.ndarray) -> np.ndarray:
        """One hash for each unit of weight: the n-th occurrence of a shingle is its n-th region."""
        new = np.ones(len(shingles), bool)
        new[1:] = shingles[1:] != shingles[:-1]
        if new.all():
            return mix(shingles)
        at = np.arange(len(shingles))
        nth = at - np.maximum.accumulate(np.where(new, at, 0))
        return mix(shingles + nth.astype(U) * STEP[1])

    @staticmethod
    def _gaps(dart: np.ndarray) -> np.ndarray:
        return -np.log(((mix(dart + STEP[3]) >> U(11)).astype(np.float64) + 0.5) * 2.0**-53)

    def darts(self, regions: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and ranks of all darts of rank up to most."""
        if most > 1.5:  # many darts a region: all at once
            n = int(most + 6 * math.sqrt(most) + 12)
            dart = mix(regions[:, None] + np.arange(1, n + 1, dtype=U)[None, :] * STEP[2])
            rank = np.cumsum(self._gaps(dart), axis=1)
            keep = rank <= most
            if not keep[:, -1].any():
                return dart[keep], rank[keep]
        all_darts, all_ranks, n = [], [], 0
        rank = np.zeros(len(regions))
        while len(regions):
            n += 1
            dart = mix(regions + U(n) * STEP[2])
            rank = rank + self._gaps(dart)
            keep = rank <= most
            regions, rank, dart = regions[keep], rank[keep], dart[keep]
            all_darts.append(dart)
            all_ranks.append(rank)
        return np.concatenate(all_darts), np.concatenate(all_ranks)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        regions, factor = self.regions(shingles), 1.0
        while True:
            dart, rank = self.darts(regions, factor * self.throws / len(regions))
            order = np.argsort(rank)[::-1]
            dart = dart[order]
            out, full = np.zeros(self.k, U), np.zeros(self.k, bool)
            at = (mix(dart ^ STEP[4]) % U(self.k)).astype(np.int64)
            out[at] = dart  # the last to be written is the earliest
            full[at] = True
            if full.all():
                return out
            factor *= 2

    def band_keys(self, signature: np.ndarray) -> np.ndarray:
        """A key for each band."""
        parts = signature.reshape(self.bands, self.rows) * (np.arange(self.rows, dtype=U) * U(2) + U(1))
        return mix(parts.sum(1) + np.arange(1, self.bands + 1, dtype=U) * STEP[1]).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted arrays of shingles with repeats."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / (len(a) + len(b) - both)


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _sketch(docs: DataFrame, bands: int, rows: int, width: int) -> DataFrame:
    """docs with uid (unique), digest (of the words; uid's bytes if there are none), keys (a long for each band), n_shingles."""
    keep = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Sketcher(bands, rows, width)
        for batch in slices(batches, 256):
            digests, keys, counts = [], [], []
            for uid, text in zip(column(batch, "uid"), column(batch, "text"), strict=True):
                words = words_of(text)
                digests.append(blake2b("\n".join(words).encode(), digest_size=16).digest() if words else uid.to_bytes(8))
                shingles = own.shingles(words) if words else ()
                counts.append(len(shingles))
                keys.append(own.band_keys(own.signature(shingles)) if words else [])
            yield with_columns(batch, [*keep, "uid"], {"digest": pa.array(digests, pa.binary()), "keys": pa.array(keys, pa.list_(pa.int64())), "n_shingles": pa.array(counts, pa.int64())})

    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(run, f"{fields}, uid long, digest binary, keys array<long>, n_shingles long")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float, width: int) -> DataFrame:
    """pairs (a, b) with ok: whether the texts' similarity is at least the threshold."""
    both = (
        pairs.join(texts.select(F.col("uid").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("uid").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighed = Weighed(width)
        for batch in slices(batches, 4096):
            yield with_columns(batch, ["a", "b"], {"ok": pa.array(weighed.similarities(batch) >= threshold, pa.bool_())})

    return both.mapInArrow(run, "a long, b long, ok boolean")


class Weighed:
    """Shingles and counts of texts by their uid, kept until there are too many of them."""

    def __init__(self, width: int, most: int = 1_000_000):
        self.sketcher, self.most, self.held, self.size = Sketcher(width=width), most, {}, 0

    def of(self, uid: int, text) -> tuple[np.ndarray, np.ndarray]:
        if (own := self.held.get(uid)) is None:
            if self.size > self.most:
                self.held, self.size = {}, 0
            own = self.held[uid] = np.unique(self.sketcher.shingles(words_of(text.as_py())), return_counts=True)
            self.size += len(own[0])
        return own

    def similarities(self, batch: pa.RecordBatch) -> np.ndarray:
        """The weighted Jaccard similarity of each row's texts; all texts that meet the same b are looked up in it at once."""
        ids = [batch.column(c).to_numpy() for c in ("a", "b")]
        texts = [batch.column(c) for c in ("text_a", "text_b")]
        out, order = np.empty(batch.num_rows), np.argsort(ids[1], kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(ids[1][order])) + 1):
            x, n = self.of(int(ids[1][rows[0]]), texts[1][int(rows[0])])
            others = [self.of(int(ids[0][r]), texts[0][int(r)]) for r in rows]
            starts = np.cumsum([0, *(len(y) for y, _ in others)])
            y, m = (np.concatenate(z) for z in zip(*others, strict=True))
            at = np.minimum(np.searchsorted(x, y), len(x) - 1)
            both = np.add.reduceat(np.where(x[at] == y, np.minimum(n[at], m), 0), starts[:-1])
            out[rows] = both / (np.add.reduceat(m, starts[:-1]) + n.sum() - both)
        return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of edges (a, b): root is the least node of its component. Large-star and small-star steps
    alternate until nothing changes; each step's minima are pre-aggregated and staged."""
    e = staged(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    told = None
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == told or not now.n:
            return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        told = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = staged(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("root")))
        large = staged(both.join(first, "u").where("v > u").select(F.col("v").alias("u"), F.col("root").alias("v")).distinct())
        least = staged(large.groupBy("u").agg(F.min("v").alias("root")))
        small = large.join(least, "u").where("v != root").select(F.col("v").alias("u"), F.col("root").alias("v"))
        before, e = e, staged(small.unionByName(least.select("u", F.col("root").alias("v"))).distinct())
        discard(before, first, large, least)


def _texts_of(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """texts (uid, text) of nodes (uid, once each).

    All texts are shuffled once to find the needed ones, at every size: a plan that broadcasts the ids where they are few would
    hide what it takes where they aren't.
    """
    return staged(texts.join(nodes.hint("merge"), "uid", "left_semi"))


def _small_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of members in different components of buckets of rows (key, node, n_shingles, root, largest): each has an end outside its
    bucket's largest component. Pairs that differ so much in the number of shingles that they can't reach the threshold are left out."""
    rest = rows.where("root != largest").select("key", F.col("node").alias("other"), F.col("root").alias("root_o"), F.col("n_shingles").alias("n_o"))
    near = F.least("n_shingles", "n_o") >= F.greatest("n_shingles", "n_o") * F.lit(threshold - 1e-9)
    once = (F.col("root") == F.col("largest")) | (F.col("node") > F.col("other"))
    met = rest.join(rows, "key").where((F.col("root") != F.col("root_o")) & once & near)
    return met.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()


def joining(rest: list[tuple[int, np.ndarray]], every: list[tuple[int, np.ndarray]], threshold: float, columns: int = 2048) -> list[tuple[int, int]]:
    """Links (index in rest, index in every) that join the components of two lists of (component, sorted regions) as all their links would."""
    both = [*rest, *every]
    sizes = np.array([len(x) for _, x in both])
    of = np.repeat(np.arange(len(both)), sizes)
    regions, column_of, count = np.unique(np.concatenate([x for _, x in both]), return_inverse=True, return_counts=True)
    shared = count > 1  # a region of one text alone is in no overlap
    number = np.cumsum(shared) - 1
    keep = shared[column_of]
    of, column_of = of[keep], number[column_of[keep]]
    order = np.argsort(column_of, kind="stable")
    of, column_of = of[order], column_of[order]
    overlap = np.zeros((len(rest), len(every)), np.float32)
    for low in range(0, int(shared.sum()), columns):
        a, b = np.searchsorted(column_of, (low, low + columns))
        has = np.zeros((len(both), columns), np.float32)
        has[of[a:b], column_of[a:b] - low] = 1
        overlap += has[: len(rest)] @ has[len(rest) :].T
    overlap = np.rint(overlap).astype(np.int64)
    n, m = sizes[: len(rest), None], sizes[None, len(rest) :]
    roots, root_of = np.unique([r for r, _ in both], return_inverse=True)
    x, y = root_of[: len(rest), None], root_of[None, len(rest) :]
    i, j = np.nonzero((overlap / (n + m - overlap) >= threshold) & (x != y))
    _, first = np.unique(x[i, 0] * len(roots) + y[0, j], return_index=True)
    up = [*range(len(roots))]

    def find(r: int) -> int:
        while up[r] != r:
            up[r] = r = up[up[r]]
        return r

    out = []
    for at in first.tolist():
        p, q = find(int(x[i[at], 0])), find(int(y[0, j[at]]))
        if p != q:
            up[p] = q
            out.append((int(i[at]), int(j[at])))
    return out


def _block_links(rows: DataFrame, texts: DataFrame, threshold: float, width: int) -> DataFrame:
    """Links (a, b) between members in different components of buckets of rows (key, node, n_shingles, root, largest), by blocks."""
    outside = F.col("root") != F.col("largest")
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK_NODES), F.ceil(size / BLOCK_SHINGLES)).cast("int")
    told = rows.groupBy("key").agg(
        blocks(F.count("*"), F.sum("n_shingles")).alias("blocks"), blocks(F.count_if(outside), F.sum(F.when(outside, F.col("n_shingles")))).alias("rest_blocks")
    )
    own = rows.join(staged(told), "key")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    block = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    rest = own.where(outside).select("key", block("rest_blocks").alias("i"), upto("blocks").alias("j"), F.lit(0).alias("side"), "node", "root")
    every = own.select("key", upto("rest_blocks").alias("i"), block("blocks").alias("j"), F.lit(1).alias("side"), "node", "root")
    sent = rest.unionByName(every).join(texts.withColumnRenamed("uid", "node"), "node").select("key", "i", "j", "side", "node", "root", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(width=width)

        def found(sides) -> pa.RecordBatch:
            pairs = joining(*[[(r, x) for _, r, x in own] for own in sides], threshold) if all(sides) else []
            ends = [(sides[0][i][0], sides[1][j][0]) for i, j in pairs]
            return pa.RecordBatch.from_arrays([pa.array([f(e) for e in ends], pa.int64()) for f in (max, min)], names=["a", "b"])

        at, sides = None, ([], [])
        for batch in slices(batches, 256):
            for key, i, j, side, node, root, text in zip(*(column(batch, c) for c in batch.schema.names), strict=True):
                if at != (key, i, j):
                    if at is not None:
                        yield found(sides)
                    at, sides = (key, i, j), ([], [])
                sides[side].append((node, root, np.sort(sketcher.regions(sketcher.shingles(words_of(text))))))
        if at is not None:
            yield found(sides)

    return sent.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side").mapInArrow(run, "a long, b long").distinct()


def links(nodes: DataFrame, sketches: DataFrame, threshold: float, width: int, small: int = SMALL) -> DataFrame:
    """Links (a, b) between nodes (node) of sketches (uid, text, keys, n_shingles), or the nodes' roots: see above.
    small: above this size a bucket is compared by blocks; the classes don't depend on it."""
    own = sketches.select(F.col("uid").alias("node"), "keys").join(nodes.hint("merge"), "node")
    all_rows = staged(own.select(F.explode("keys").alias("key"), "node"))
    sizes = staged(all_rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    sized = staged(all_rows.join(sizes, "key"))
    scores = staged(sized.groupBy("node").agg(F.sum(F.col("n") - 1).alias("score")))
    rows = staged(sized.join(scores, "node"))
    discard(all_rows, sizes, sized)
    centres = staged(rows.groupBy("key").agg(F.max(F.struct("score", "node")).alias("most")).select("key", F.col("most.node").alias("other")))
    texts = _texts_of(scores.select(F.col("node").alias("uid")), sketches.select("uid", "text"))
    first = rows.join(centres, "key").where("node != other").select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b"))
    known = staged(_verified(staged(first.distinct()), texts, threshold, width))
    found = staged(components(known.where("ok")))
    counts = sketches.select(F.col("uid").alias("node"), "n_shingles").join(scores.select("node"), "node", "left_semi")
    counts = staged(counts.join(found, "node", "left").select("node", "n_shingles", F.coalesce("root", "node").alias("root")))
    open_ = staged(rows.select("key", "node", "n").join(counts, "node"))
    parts = open_.groupBy("key", "root").agg(F.count("*").alias("m"))
    most = parts.groupBy("key").agg(F.max(F.struct("m", "root")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    open_ = staged(open_.join(staged(most.select("key", F.col("most.root").alias("largest"))), "key"))
    pairs = staged(_small_pairs(open_.where(F.col("n") <= small), threshold).join(known.select("a", "b"), ["a", "b"], "left_anti"))
    needed = pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
    last = _verified(pairs, _texts_of(needed, texts), threshold, width).where("ok").select("a", "b")
    by_blocks = _block_links(open_.where(F.col("n") > small), texts, threshold, width)
    return found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(last).unionByName(by_blocks)


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH
) -> DataFrame:
    """docs with class_id (doc_id of the class's kept row), class_size, kept (true for one row of each class); columns of docs with
    these names are replaced."""
    docs, names = set_aside(docs, "doc_id", "text")
    sketches = staged(_sketch(docs, bands, rows, width))
    exact = staged(sketches.groupBy("digest").agg(F.min("uid").alias("node"), F.count("*").alias("n")))
    found = links(exact.select("node"), sketches, threshold, width)
    roots = staged(components(found))
    nodes = staged(exact.join(roots, "node", "left").select("digest", "node", "n", F.coalesce("root", "node").alias("root")))
    classes = (
        nodes.groupBy("root")
        .agg(F.sum("n").alias("class_size"))
        .join(sketches.select(F.col("uid").alias("root"), F.col("doc_id").alias("class_id")), "root")
    )
    told = staged(nodes.join(staged(classes), "root").select("digest", "root", "class_id", "class_size"))
    found = sketches.join(told, "digest").withColumn("kept", F.col("uid") == F.col("root"))
    return put_back(found, names, "class_id", "class_size", "kept")
