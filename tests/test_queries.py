"""Every query with SQL equals that SQL on the small tables."""

import math

import duckdb
import pytest

from partwise.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


def plain(x):
    if isinstance(x, list):
        return tuple(map(plain, x))
    if type(x).__name__ in ("Decimal", "float"):
        return None if math.isnan(x) else round(float(x), 6) + 0.0
    return x


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    own = [tuple(map(plain, r)) for r in df.select(*sorted(df.columns)).collect()]
    got = duck.execute(SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(range(len(names)), key=lambda i: names[i])
    other = [tuple(plain(r[i]) for i in order) for r in got.fetchall()]
    assert sorted(own, key=str) == sorted(other, key=str)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_clusters_are_in_one_split_each(spark):
    from pyspark.sql import functions as F

    from partwise.operators import splits

    vectors = spark.range(200).select(F.col("id").cast("string").alias("k"), F.array(*[(F.col("id") % 10 * 10 + F.rand(i)).alias("x") for i in range(3)]).alias("v"))
    own = splits.clusters(vectors, "k", "v", 10)
    placed = splits.cluster_split(vectors, "k", "v", ["train", "test"], [8, 2], 10)
    assert own.join(placed, "k").groupBy("cluster").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
