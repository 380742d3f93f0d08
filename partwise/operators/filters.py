"""Row filters, entities, previews and counts. A null cell passes both filters."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, NumericType, StringType


@dataclass(frozen=True)
class Filter:
    column: str
    not_equal: str | float | bool | None = None
    not_empty: bool = False


def _comparable(value: object, kind: DataType) -> bool:
    """Whether a cell of this type can equal the value: a text never equals a number."""
    if isinstance(value, str):
        return isinstance(kind, StringType)
    return isinstance(kind, BooleanType if isinstance(value, bool) else NumericType)


def condition(f: Filter, kind: DataType) -> Column:
    """kind: the column's type."""
    c, out = F.col(f.column), F.lit(True)
    if f.not_equal is not None and _comparable(f.not_equal, kind):
        out = out & (c.isNull() | (c != F.lit(f.not_equal)))
    if f.not_empty:
        out = out & (c.isNull() | (F.trim(c.cast("string")) != ""))
    return out


def filtered(df: DataFrame, filters: Iterable[Filter]) -> DataFrame:
    for f in filters:
        df = df.where(condition(f, df.schema[f.column].dataType))
    return df


def visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_")]


def entities(df: DataFrame, column: str) -> DataFrame:
    """Distinct values as text; nulls are no entities."""
    return df.select(F.col(column).cast("string").alias("entity")).where("entity is not null").distinct()


def pairs(df: DataFrame, e1: str, e2: str) -> DataFrame:
    """Distinct pairs with their numbers of rows."""
    own = df.select(F.col(e1).cast("string").alias("e1"), F.col(e2).cast("string").alias("e2"))
    return own.where("e1 is not null and e2 is not null").groupBy("e1", "e2").agg(F.count("*").alias("n_rows"))


def preview(df: DataFrame, order: str, rows: int = 10, width: int = 80) -> DataFrame:
    """The first rows, texts cut to a width."""
    cut = [F.substring(c, 1, width).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes if not c.startswith("_")]
    return df.orderBy(order).limit(rows).select(*cut)


def stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, visible columns, and distinct values of some columns, in one pass."""
    return df.agg(
        F.count("*").alias("total_rows"),
        F.lit(len(visible(df))).cast("long").alias("total_columns"),
        *[F.countDistinct(c).alias(f"unique_{c}") for c in columns],
    )
