"""Features and distances kept in a folder between runs, by their content."""

from __future__ import annotations

import hashlib
import json
import logging
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)
#: Part of each key: to be raised when features change, so that older ones aren't found.
VERSION = "1"


def content_key(entities: DataFrame, kind: str, sets: Sequence[str], options: dict | None = None) -> str:
    """16 hex digits of the distinct entities (whatever their order), their type, the feature sets and all options.

    The entities are digested by sums of their hashes, pre-aggregated where they are; nothing but three numbers reaches the driver.
    """
    part = lambda at: F.sum(F.conv(F.substring(F.md5("entity"), at, 15), 16, 10).cast("decimal(38,0)"))
    told = entities.select("entity").distinct().agg(F.count("*"), part(1), part(16)).first()
    what = json.dumps([VERSION, kind, sorted(sets), sorted((options or {}).items()), [str(x) for x in told]])
    return hashlib.sha256(what.encode()).hexdigest()[:16]


def _complete(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def cached(spark: SparkSession, folder: str | None, name: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make gives, from folder/name_key if it was written there whole, else made and written. Without a folder it is made.
    What can't be written or read is made again, with a warning."""
    if not folder:
        return make()
    path = f"{folder.rstrip('/')}/{name}_{key}"
    try:
        if not _complete(spark, path):
            make().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
    except Exception as e:
        log.warning("no cache at %s: %s", path, e)
        return make()
