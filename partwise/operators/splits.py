"""Split assignment: random, identity, group and cluster, on one axis or two.

Orders are those of md5(value | seed), so they don't depend on partitions. Exact ranks come from counts of hash prefixes
and row numbers within a prefix: no sort puts all rows into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NOT_SELECTED = "not selected"


def hash_order(c: str | Column, seed: int = 42) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.md5(F.concat(c.cast("string"), F.lit(f"|{seed}")))


def ranked(df: DataFrame, key: str, order: Column, weight: Column | None = None) -> DataFrame:
    """df with _rank (from 1) in the order of a hex hash and then key; with a weight, _rank is the running sum of weights.
    _n is the total."""
    weight = F.lit(1).cast("long") if weight is None else weight.cast("long")
    own = df.withColumn("_h", order).withColumn("_w", weight).withColumn("_p", F.substring("_h", 1, 4))
    sizes = own.groupBy("_p").agg(F.sum("_w").alias("_s"))
    whole = Window.partitionBy()
    sizes = sizes.select(
        "_p", (F.sum("_s").over(Window.orderBy("_p")) - F.col("_s")).alias("_before"), F.sum("_s").over(whole).alias("_n")
    )  # 65,536 rows at most
    within = Window.partitionBy("_p").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, 0)
    out = own.withColumn("_r", F.sum("_w").over(within)).join(F.broadcast(sizes), "_p")
    return out.withColumn("_rank", F.col("_before") + F.col("_r")).drop("_h", "_w", "_p", "_r", "_before")


def by_cuts(rank: Column, n: Column, names: Sequence[str], ratios: Sequence[int]) -> Column:
    """The name whose cut, round(n * cumulated / total) in whole numbers, isn't passed."""
    total, run, out = sum(ratios), 0, None
    for name, r in zip(names[:-1], ratios[:-1], strict=True):
        run += r
        cut = F.floor((n * (2 * run) + total) / (2 * total))
        out = F.when(rank <= cut, name) if out is None else out.when(rank <= cut, name)
    return out.otherwise(names[-1])


def random_split(entities: DataFrame, key: str, names: Sequence[str], ratios: Sequence[int], seed: int = 42) -> DataFrame:
    """key, split: exact shares of entities."""
    own = ranked(entities.select(key).distinct(), key, hash_order(key, seed))
    return own.select(key, by_cuts(F.col("_rank"), F.col("_n"), names, ratios).alias("split"))


def identity_split(rows: DataFrame, key: str, names: Sequence[str], ratios: Sequence[int], seed: int = 42) -> DataFrame:
    """key, split: no entity in two splits; shares are of rows."""
    own = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_rows"))
    own = ranked(own, key, hash_order(key, seed), F.col("_rows"))
    return own.select(key, by_cuts(F.col("_rank"), F.col("_n"), names, ratios).alias("split"))


def both_axes(pairs: DataFrame, e1: str, e2: str, split1: DataFrame, split2: DataFrame) -> DataFrame:
    """e1, e2, split of distinct pairs: the axes' split where they agree, else not selected."""
    own = pairs.select(e1, e2).distinct().join(split1.withColumnRenamed("split", "_s1"), e1).join(split2.withColumnRenamed("split", "_s2"), e2)
    return own.select(e1, e2, F.when(F.col("_s1") == F.col("_s2"), F.col("_s1")).otherwise(NOT_SELECTED).alias("split"))


def _dealt(open_: Column, size: Column, count: Column) -> Column:
    """How many of `count` groups of one size each split gets, if each goes to the split that is furthest below its target (the first on a tie).

    A split's places are open, open - size, open - 2 size, ...; the highest `count` of all are taken. The lowest level that is taken whole is
    searched by halving; what is left over goes to the next places in order.
    """
    above = lambda level: F.transform(open_, lambda x: F.greatest(F.lit(0).cast("long"), F.floor((x - level) / size).cast("long") + 1))
    whole = lambda counts: F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
    start = F.struct((F.array_min(open_) - size * (count + 1)).alias("low"), (F.array_max(open_) + 1).alias("high"))  # low takes enough, high none

    def halve(s: Column, _: Column) -> Column:
        middle = s["low"] + F.floor((s["high"] - s["low"]) / 2).cast("long")
        enough = whole(above(middle)) >= count
        return F.struct(F.when(enough & (s["high"] - s["low"] > 1), middle).otherwise(s["low"]).alias("low"), F.when(enough, s["high"]).otherwise(middle).alias("high"))

    level = F.aggregate(F.sequence(F.lit(1), F.lit(62)), start, halve)["low"] + 1  # places at this level or above are taken, and fewer than count
    taken = above(level)
    left = count - whole(taken)
    nearest = F.array_sort(F.transform(F.arrays_zip(open_.alias("o"), taken.alias("t")), lambda x, j: F.struct((x["t"] * size - x["o"]).alias("gap"), j.alias("j"))))
    more = F.transform(F.slice(nearest, F.lit(1), F.greatest(left, F.lit(0).cast("long")).cast("int")), lambda x: x["j"])
    return F.transform(taken, lambda t, j: t + F.array_contains(more, j).cast("int"))


def greedy_groups(groups: DataFrame, key: str, names: Sequence[str], ratios: Sequence[int], piece: int = 64) -> DataFrame:
    """key, n, split: groups (key, n) by falling size (in the order of a hash among equals), each to the split furthest below its target; ties to the first name.

    Groups of one size are dealt at once, so one fold runs over the distinct sizes alone, of which N rows have at most sqrt(2 N); each group's
    split then comes from its rank among those of its size. All numbers are whole: in units of one row over the sum of the ratios.
    """
    total = sum(ratios)
    sizes = groups.groupBy("n").agg(F.count("*").alias("c"))
    listed = sizes.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "c"))).alias("g"), F.sum(F.col("n") * F.col("c")).alias("rows")).where(F.size("g") > 0)
    targets = F.array(*[F.col("rows") * F.lit(r).cast("long") for r in ratios])

    def one(state: Column, g: Column) -> Column:
        size = -g["m"] * total
        return F.struct(
            F.transform(F.arrays_zip(state["open"].alias("o"), _dealt(state["open"], size, g["c"]).alias("t")), lambda x: x["o"] - x["t"] * size).alias("open"),
            F.concat(state["before"], F.array(state["open"])).alias("before"),
        )

    def pieces(state: Column, at: Column) -> Column:
        begun = F.struct(state["open"].alias("open"), F.array().cast("array<array<bigint>>").alias("before"))
        done = F.aggregate(F.slice("g", at, F.lit(piece)), begun, one)
        return F.transform(F.array(done), lambda d: F.struct(d["open"].alias("open"), F.concat(state["all"], F.array(d["before"])).alias("all")))[0]

    start = F.struct(targets.alias("open"), F.array().cast("array<array<array<bigint>>>").alias("all"))
    fold = F.aggregate(F.sequence(F.lit(1), F.size("g"), F.lit(piece)), start, pieces, lambda s: F.flatten(s["all"]))
    states = listed.select(F.explode(F.arrays_zip(F.col("g"), fold.alias("open"))).alias("x")).select((-F.col("x.g.m")).alias("n"), F.col("x.open").alias("_open"))
    # ranks among the groups of one size: counts of hash prefixes, then row numbers within a prefix
    own = groups.select(key, "n", hash_order(key).alias("_h")).withColumn("_p", F.substring("_h", 1, 4))
    parts = own.groupBy("n", "_p").agg(F.count("*").alias("_s"))
    before = F.sum("_s").over(Window.partitionBy("n").orderBy("_p")) - F.col("_s")  # 65,536 rows of a size at most
    ranks = own.withColumn("_r", F.row_number().over(Window.partitionBy("n", "_p").orderBy("_h", key)))
    ranked_ = ranks.join(parts.select("n", "_p", before.alias("_before")), ["n", "_p"]).withColumn("_r", F.col("_before") + F.col("_r")).join(states, "n")
    size = F.col("n") * total
    change = F.arrays_zip(_dealt(F.col("_open"), size, F.col("_r")).alias("a"), _dealt(F.col("_open"), size, F.col("_r") - 1).alias("b"))
    index = F.array_position(F.transform(change, lambda x: x["a"] > x["b"]), True).cast("int")
    return ranked_.select(key, "n", F.element_at(F.array(*[F.lit(x) for x in names]), index).alias("split"))


def cluster_count(n: int, sparsity: float = 0.0, second: bool = False, e2_clusters: int = 30, c2: bool = False) -> int:
    """How many clusters an axis of n entities gets. sparsity: of the second axis's features. c2: C2 is among the techniques; on a sparse second
    axis the first then has few clusters, so that blocks of both stay large."""
    if not second:
        if c2 and sparsity > 0.5:
            return max(1, min(max(2, min(3, n // 3)), n))
        return max(1, min(max(9, n // 20), n))
    if sparsity <= 0.5:
        return max(1, min(e2_clusters, n))
    return max(1, min(20, n // 20)) if sparsity <= 0.9 else max(5, min(10, n // 50))


def clusters(vectors: DataFrame, key: str, vector: str, k: int, cosine: bool = False, seed: int = 42) -> DataFrame:
    """key, cluster by bisecting k-means over vectors (cosine: over unit vectors)."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    own = vectors.select(key, array_to_vector(F.col(vector)).alias("features"))
    if cosine:
        from pyspark.ml.feature import Normalizer

        own = Normalizer(inputCol="features", outputCol="unit").transform(own).select(key, F.col("unit").alias("features"))
    model = BisectingKMeans(k=k, seed=seed, maxIter=10).fit(own)
    return model.transform(own).select(key, F.col("prediction").alias("cluster"))


def cluster_split(vectors: DataFrame, key: str, vector: str, names: Sequence[str], ratios: Sequence[int], k: int, cosine: bool = False) -> DataFrame:
    """key, split: no cluster in two splits."""
    own = clusters(vectors, key, vector, k, cosine)
    placed = greedy_groups(own.groupBy("cluster").agg(F.count("*").alias("n")), "cluster", names, ratios)
    return own.join(placed.select("cluster", "split"), "cluster").select(key, "split")


def assigned(rows: DataFrame, assignment: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with split: looked up by keys, else not selected."""
    return rows.join(assignment.select(*keys, "split"), [*keys], "left").withColumn("split", F.coalesce("split", F.lit(NOT_SELECTED)))
