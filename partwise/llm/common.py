"""What the operators of this subpackage share: tables, the shared folder, Arrow helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table, so that further columns can't clash with ours."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Only where all of Spark is on this machine, a temporary one
    is set if there is none; a cluster must name its own."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="partwise-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: it cuts lineage, survives lost executors, and
    claims no partitioning, so that joins on it are shuffled on both sides and AQE can split a hot key."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/partwise-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.partwise_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        _written.remove((df.sparkSession, df.partwise_path))
        _delete(df.sparkSession, df.partwise_path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _delete_written() -> None:
    for spark, path in _written:
        if getattr(spark.sparkContext, "_jsc", None) is not None:
            _delete(spark, path)


def remainder(doc_id: str, n: int):
    """crc32(doc_id as text) mod n, as a column; 0 where doc_id is null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % n, F.lit(0))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn, per_class: int) -> DataFrame:
    """Texts of at most per_class labelled rows of each class (text, label), in the order of a hash of doc_id.

    learn is a condition on doc_id. At most 2 * per_class ids are broadcast, so their size is bounded.
    """
    from pyspark.sql import Window

    at = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = (
        labels.where(learn & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).alias("label"))
        .withColumn("_n", F.row_number().over(at))
        .where(F.col("_n") <= per_class)
        .select("doc_id", "label")
    )
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label")


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(name).to_pylist()


def with_columns(batch: pa.RecordBatch, keep: list[str], more: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *more.values()], names=[*keep, *more])


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def set_aside(df: DataFrame, *used: str) -> tuple[DataFrame, dict[str, str]]:
    """df with all columns but the used ones under names that nothing else has, and those names by the true ones."""
    names = {c: c if c in used else f"_carried{i}" for i, c in enumerate(df.columns)}
    return df.select(*[df[c].alias(n) for c, n in names.items()]), names


def put_back(df: DataFrame, names: dict[str, str], *more: str) -> DataFrame:
    """The columns under their true names, then `more`; a carried column with the name of one of these is replaced by it."""
    return df.select(*[df[n].alias(c) for c, n in names.items() if c not in more], *more)
