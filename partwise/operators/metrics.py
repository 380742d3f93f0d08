"""Quality of a split: sizes, coverage, overlap, nearest-neighbour leakage, distribution shift, comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partwise.operators.distances import nearest_distance
from partwise.operators.splits import NOT_SELECTED


def split_counts(assignment: DataFrame, names: Sequence[str]) -> DataFrame:
    """split, n, fraction (of assigned ones, 4 places) for each name; names without entities have 0."""
    own = assignment.where(F.col("split").isin(*names)).groupBy("split").agg(F.count("*").alias("n"))
    listed = assignment.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in names])).alias("split"))
    n = F.coalesce("n", F.lit(0))
    return listed.join(own, "split", "left").select("split", n.alias("n")).withColumn(
        "fraction", F.coalesce(F.round(F.col("n") / F.nullif(F.sum("n").over(Window.partitionBy()), F.lit(0)), 4), F.lit(0.0))
    )


def coverage(assignment: DataFrame, names: Sequence[str]) -> DataFrame:
    return assignment.agg(F.coalesce(F.round(F.avg(F.col("split").isin(*names).cast("double")), 4), F.lit(0.0)).alias("coverage"))


def entity_overlap(rows: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """overlap, total: entities in both of the first two splits, and in either."""
    has = lambda n: F.max((F.col("split") == n).cast("int"))
    own = rows.where(F.col(key).isNotNull()).groupBy(key).agg(has(names[0]).alias("a"), has(names[1]).alias("b"))
    return own.agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("overlap"), F.coalesce(F.sum(F.greatest("a", "b")), F.lit(0)).alias("total"))


def majority_split(pairs: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """key, split: the most frequent split of the key's distinct pairs; not selected is a vote; ties go by the order of names."""
    order = [*names, NOT_SELECTED]
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("split"))
    votes = pairs.groupBy(key, "split").agg(F.count("*").alias("n"))
    best = Window.partitionBy(key).orderBy(F.desc("n"), place)
    return votes.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(key, "split")


def nn_leakage(vectors: DataFrame, assignment: DataFrame, key: str, vector: str, names: Sequence[str], metric: str = "euclidean") -> DataFrame:
    """Distances of test rows to their nearest train row: mean, median, min, max, zeros (exact copies), zero_fraction."""
    own = vectors.select(key, vector).join(assignment.select(key, "split"), key)
    test = "test" if "test" in names else names[-1]
    near = nearest_distance(own.where(F.col("split") == test), own.where("split = 'train'"), key, vector, metric)
    d = F.col("distance")
    return near.agg(
        F.round(F.avg(d), 6).alias("mean_nn_dist"), F.round(F.percentile(d, 0.5), 6).alias("median_nn_dist"),
        F.round(F.min(d), 6).alias("min_nn_dist"), F.round(F.max(d), 6).alias("max_nn_dist"),
        F.count_if(d == 0).alias("zero_dist_count"), F.round(F.avg((d == 0).cast("double")), 4).alias("zero_dist_fraction"),
    )


def leakage_metric(dims: int, has_zero_vector: bool) -> str:
    return "cosine" if dims > 100 and not has_zero_vector else "euclidean"


def row_counts(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """split, rows, percent (of all rows, 1 place) for each name and for rows that aren't selected."""
    own = rows.groupBy("split").agg(F.count("*").alias("rows"))
    listed = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in [*names, NOT_SELECTED]])).alias("split"))
    n = F.coalesce("rows", F.lit(0))
    return listed.join(own, "split", "left").select("split", n.alias("rows")).withColumn(
        "percent", F.coalesce(F.round(100 * F.col("rows") / F.nullif(F.sum("rows").over(Window.partitionBy()), F.lit(0)), 1), F.lit(0.0))
    )


def distribution_shift(vectors: DataFrame, assignment: DataFrame, key: str, vector: str, names: Sequence[str]) -> DataFrame:
    """Mean and largest difference of the first and last split's means, in deviations of all rows; 4 places."""
    own = vectors.join(assignment, key, "left").select("split", F.posexplode(vector).alias("i", "v"))
    of = lambda n: F.avg(F.when(F.col("split") == n, F.col("v")))
    each = own.groupBy("i").agg(of(names[0]).alias("a"), of(names[-1]).alias("b"), F.stddev_pop("v").alias("s"))
    shift = F.abs(F.col("a") - F.col("b")) / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)
    return each.agg(F.round(F.avg(shift), 4).alias("mean_normalized_shift"), F.round(F.max(shift), 4).alias("max_normalized_shift"), F.count("*").alias("num_features"))


def comparison_long(metrics: DataFrame) -> DataFrame:
    """metric, technique, value, higher_is_better, best, from compared(): the metrics that aren't 0 for every technique, as a chart shows them."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    kinds = [("Coverage %", zero("coverage") * 100, True), ("Entity Overlap", zero("entity_overlap"), False), ("NN Separation (mean dist)", zero("nn_separation"), True), ("Distribution Shift", zero("dist_shift"), False)]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), c.alias("value"), F.lit(up).alias("higher_is_better")) for k, c, up in kinds]))
    of = Window.partitionBy("metric")  # one row for each technique
    order = of.orderBy(F.when(F.col("higher_is_better"), -F.col("value")).otherwise(F.col("value")), "technique")
    own = metrics.select("technique", each.alias("x")).select("x.metric", "technique", "x.value", "x.higher_is_better")
    shown = own.withColumn("most", F.max(F.abs("value")).over(of)).where("most > 0").drop("most")
    return shown.withColumn("best", F.row_number().over(order) == 1)


def compared(metrics: DataFrame) -> DataFrame:
    """technique, coverage, nn_separation, dist_shift, entity_overlap, score, recommended from (technique, coverage, mean_nn_dist,
    e1_overlap, mean_normalized_shift). The highest score is recommended, the first by name on a tie."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = zero("mean_nn_dist") * 100 - zero("e1_overlap") * 10 - zero("mean_normalized_shift") * 5 + zero("coverage") * 10
    own = metrics.withColumn("score", score)
    best = F.row_number().over(Window.orderBy(F.desc("score"), "technique")) == 1  # one row for each technique
    return own.select(
        "technique", F.round(zero("coverage"), 4).alias("coverage"), F.round(F.nullif(F.col("mean_nn_dist"), F.lit(0.0)), 6).alias("nn_separation"),
        F.round(F.nullif(F.col("mean_normalized_shift"), F.lit(0.0)), 4).alias("dist_shift"), zero("e1_overlap").alias("entity_overlap"),
        F.round("score", 6).alias("score"), best.alias("recommended"),
    )
