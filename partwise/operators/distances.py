"""Distances by blocks: vectors are packed into blocks of bounded size, pairs of blocks are compared by a matrix kernel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwise.functions.vectors import is_binary, zeros

BLOCK_ROWS = 2048


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """euclidean, cosine or tanimoto distances of all rows of a to all rows of b."""
    if metric == "euclidean":
        return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * (a @ b.T), 0))
    both = a @ b.T
    if metric == "cosine":
        return 1 - both / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :])
    any_ = a.sum(1)[:, None] + b.sum(1)[None, :] - both
    return np.where(any_ > 0, 1 - both / np.maximum(any_, 1), 1.0)


def exact_nearest(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Each row of a's distance to its nearest row of b. Products find who may be nearest; euclidean distances of these come from differences,
    and equal rows have distance 0 by either metric, so that leaked copies are counted."""
    d = distances(a, b, metric)
    low = d.min(1)
    if metric == "tanimoto":
        return low
    scale = np.sqrt((a**2).sum(1) + (b**2).sum(1).max()) if metric == "euclidean" else np.ones(len(a))
    out = low.copy()
    rows, others = np.nonzero(d <= (low + 1e-6 * scale)[:, None])
    gaps = np.sqrt(((a[rows] - b[others]) ** 2).sum(1))
    if metric == "euclidean":
        out[:] = np.inf
        np.minimum.at(out, rows, gaps)
    else:
        out[rows[gaps == 0]] = 0.0
    return out


def blocks(vectors: DataFrame, key: str, vector: str, rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """(block, ids, x) and the number of blocks."""
    n = max(1, -(-vectors.count() // rows))
    own = vectors.select(F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("block"), F.struct(F.col(key).alias("id"), F.col(vector).alias("x")).alias("r"))
    return own.groupBy("block").agg(F.collect_list("r").alias("rows")), n


def _matrix(rows: pa.Array) -> tuple[list, np.ndarray]:
    return rows.field("id").to_pylist(), np.asarray(rows.field("x").flatten(), dtype=float).reshape(len(rows), -1)


def block_pairs(left: DataFrame, n_left: int, right: DataFrame) -> DataFrame:
    """Every block of right (block, rows) with every block of left, joined by left's number."""
    sent = right.select(F.explode(F.sequence(F.lit(0), F.lit(n_left - 1))).alias("block"), F.col("block").alias("other_block"), F.col("rows").alias("other"))
    return left.join(sent, "block").select("rows", "other")


def nearest_distance(tests: DataFrame, trains: DataFrame, key: str, vector: str, metric: str) -> DataFrame:
    """key, distance of each test row to its nearest train row."""
    left, n = blocks(tests, key, vector)
    right, _ = blocks(trains, key, vector)
    kind = tests.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (ids, a), (_, b) = (_matrix(batch.column(c).slice(i, 1).flatten()) for c in ("rows", "other"))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(exact_nearest(a, b, metric))], names=[key, "distance"])

    return block_pairs(left, n, right).mapInArrow(run, f"{key} {kind}, distance double").groupBy(key).agg(F.min("distance").alias("distance"))


def pairwise_summary(vectors: DataFrame, key: str, vector: str, metric: str) -> DataFrame:
    """key, n, nearest, furthest, mean of each row's distances to all other rows: the square matrix, reduced where it is made."""
    own, n = blocks(vectors, key, vector)
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (ids, a), (others, b) = (_matrix(batch.column(c).slice(i, 1).flatten()) for c in ("rows", "other"))
                d = distances(a, b, metric)
                same = np.array(ids, dtype=object)[:, None] == np.array(others, dtype=object)[None, :]
                count = (~same).sum(1)
                low, high = np.where(same, np.inf, d).min(1), np.where(same, -np.inf, d).max(1)
                keep = count > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for x, k in zip(ids, keep, strict=True) if k]), pa.array(count[keep]), pa.array(low[keep]), pa.array(high[keep]), pa.array(np.where(same, 0, d).sum(1)[keep])],
                    names=[key, "n", "low", "high", "s"],
                )

    made = block_pairs(own, n, own).mapInArrow(run, f"{key} {kind}, n long, low double, high double, s double")
    return made.groupBy(key).agg(F.sum("n").alias("n"), F.min("low").alias("nearest"), F.max("high").alias("furthest"), (F.sum("s") / F.sum("n")).alias("mean"))


def sparsity(vectors: DataFrame, vector: str) -> DataFrame:
    return vectors.agg((F.sum(zeros(F.col(vector))) / F.sum(F.size(vector))).alias("sparsity"))


def choose_metric(sparse: float, binary: bool, pca: bool = False) -> tuple[str, bool]:
    """(metric, whether to reduce by PCA first). pca: reduction is wanted for very sparse vectors: on one axis, and on two with C2."""
    if binary:
        return "tanimoto", False
    if sparse > 0.9 and pca:
        return "euclidean", True
    return ("cosine" if sparse > 0.5 else "euclidean"), False


def standardised(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Each component less its mean, over its population deviation (a deviation of 0 counts as 1)."""
    each = vectors.select(key, F.posexplode(vector).alias("i", "v"))
    told = each.groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    scale = told.agg(F.array_sort(F.collect_list(F.struct("i", "m", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("s")))).alias("_t"))
    return vectors.join(F.broadcast(scale)).select(key, F.zip_with(vector, "_t", lambda x, t: (x - t["m"]) / t["s"]).alias(vector))


def binary(vectors: DataFrame, vector: str) -> bool:
    """Whether all vectors are fingerprints: 128 components or more, all 0 or 1."""
    return bool(vectors.agg(F.bool_and(is_binary(F.col(vector))).alias("b")).first().b)


def normalised(distances_: DataFrame, columns: list[str]) -> DataFrame:
    """Distance columns over the largest distance of all (unchanged if that is 0)."""
    most = distances_.agg(F.max(F.greatest(*columns, F.lit(0.0))).alias("_most"))
    return distances_.join(F.broadcast(most)).select(*[(F.when(F.col("_most") > 0, F.col(c) / F.col("_most")).otherwise(F.col(c))).alias(c) if c in columns else F.col(c) for c in distances_.columns])


def components_for(n: int, dims: int, k: int = 20) -> int:
    """How many principal components vectors are reduced to; as many as dims if they have few."""
    return min(k, n - 1, dims) if dims > k else dims


def coordinates(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key, x, y: the first two principal components of standardised vectors, to be drawn."""
    own = reduced(standardised(vectors, key, vector), key, vector, 2)
    return own.select(key, F.col(vector)[0].alias("x"), F.get(vector, F.lit(1)).alias("y"))


def reduced(vectors: DataFrame, key: str, vector: str, k: int = 20) -> DataFrame:
    """Principal components of centred vectors."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    own = vectors.select(key, array_to_vector(F.col(vector)).alias("raw"))
    centred = StandardScaler(inputCol="raw", outputCol="centred", withMean=True, withStd=False).fit(own).transform(own)
    out = PCA(k=k, inputCol="centred", outputCol="pc").fit(centred).transform(centred)
    return out.select(key, vector_to_array("pc").alias(vector))
