"""Writers: one output for each split in the input's own format; rows that aren't selected go nowhere."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partwise.sources.readers import ROW_NUMBER, numbered


def with_split(rows: DataFrame, assignment: DataFrame) -> DataFrame:
    return rows.join(assignment.select("_row_id", "split"), "_row_id", "left")


def _documents(rows: DataFrame, keyed: bool) -> DataFrame:
    """One text for each row, so that every part is a JSON document by itself: an object by `_row_id`, or a list."""
    shown = [c for c in rows.columns if not c.startswith("_")]
    scalar = keyed and shown == ["value"]
    cell = F.to_json(F.struct("value")) if scalar else F.to_json(F.struct(*shown), {"ignoreNullFields": "false"})
    own = rows.select(F.to_json(F.struct("_row_id")).alias("k"), cell.alias("v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def items() -> Iterator[str]:
            for b in batches:
                for k, v in zip(b["k"], b["v"], strict=True):
                    if scalar:
                        v = json.dumps(json.loads(v).get("value"))
                    yield f"{json.dumps(json.loads(k)['_row_id'])}: {v}" if keyed else v

        held = None
        for item in items():
            yield pd.DataFrame({"value": [("{" if keyed else "[") if held is None else held + ","]})
            held = item
        if held is not None:
            yield pd.DataFrame({"value": [held, "}" if keyed else "]"]})

    return own.mapInPandas(run, "value string")


def copy_files(files: DataFrame, to: str) -> int:
    """Copy files (_source_file) into a folder, each by the task that has its name; how many. Folders may be of any file system that Arrow knows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(_uri(to))
        system.create_dir(folder, recursive=True)
        for b in batches:
            for path in b["_source_file"]:
                source, name = fs.FileSystem.from_uri(_uri(path))
                fs.copy_files(name, f"{folder}/{name.rsplit('/', 1)[-1]}", source_filesystem=source, destination_filesystem=system)
            yield pd.DataFrame({"n": [len(b)]})

    return files.select("_source_file").distinct().mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _uri(path: str) -> str:
    if "://" in path:
        return path
    return "file://" + os.path.abspath(path.removeprefix("file:"))


def write_splits(rows: DataFrame, assignment: DataFrame, names: Sequence[str], fmt: str, path: str, keyed: bool = False) -> None:
    """Folder path/name for each split, in the input's format; keyed: a JSON input was an object by `_row_id`, not a list. Files stay as many as
    Spark makes them, each complete by itself; formats of one file for each structure or molecule get copies of their files."""
    joined = with_split(rows, assignment)
    for name in names:
        own = joined.where(F.col("split") == name).drop("split")
        shown = own.select(*[c for c in own.columns if not c.startswith("_")])
        out, to = shown.write.mode("overwrite"), f"{path}/{name}"
        if fmt in ("csv", "tsv", "ase_db"):
            out.csv(to, header=True, sep="\t" if fmt == "tsv" else ",", escape='"')
        elif fmt == "json":
            _documents(own, keyed).write.mode("overwrite").text(to)
        elif fmt == "parquet":
            out.parquet(to)
        elif fmt == "smiles":
            own.select(F.concat_ws(" ", "smiles", "_row_id")).write.mode("overwrite").text(to)
        elif fmt == "fasta":
            wrapped = F.regexp_replace("sequence", "(.{80})(?=.)", "$1\n")
            own.select(F.concat(F.lit(">"), "_header" if "_header" in own.columns else "_row_id", F.lit("\n"), wrapped)).write.mode("overwrite").text(to)
        elif fmt == "sdf":
            own.select(F.concat(F.rtrim("_block"), F.lit("\n\n$$$$"))).write.mode("overwrite").text(to)
        else:
            copy_files(own, to)


def indices(rows: DataFrame, assignment: DataFrame, names: Sequence[str], position: str | None = None, piece: int = 1 << 16) -> DataFrame:
    """(split, position) of each row in a split, in the order of both. position: the column that numbers the rows, where the input has one;
    else they are counted from 0 after filters, in the order of their numbers, or as they are if `_row_id` is a name."""
    if position:
        at = rows.select(F.col(position).cast("long").alias("position"), "_row_id")
    elif rows.schema["_row_id"].metadata.get(ROW_NUMBER):
        own = rows.select("_row_id", F.col("_row_id").cast("long").alias("_at")).withColumn("_piece", F.floor(F.col("_at") / piece))
        sizes = own.groupBy("_piece").agg(F.count("*").alias("_n"))  # one row for each piece
        sizes = sizes.select("_piece", (F.sum("_n").over(Window.orderBy("_piece")) - F.col("_n") - 1).alias("_before"))
        nth = F.row_number().over(Window.partitionBy("_piece").orderBy("_at"))
        at = own.withColumn("_nth", nth).join(sizes, "_piece").select((F.col("_before") + F.col("_nth")).alias("position"), "_row_id")
    else:
        at = numbered(rows.select(F.col("_row_id").alias("_own"))).select(F.col("_row_id").cast("long").alias("position"), F.col("_own").alias("_row_id"))
    return with_split(at, assignment).where(F.col("split").isin(*names)).select("split", "position").orderBy("split", "position")


def fold_column(rows: DataFrame, assignment: DataFrame) -> DataFrame:
    """Visible columns and split, rows that aren't selected included."""
    joined = with_split(rows, assignment)
    return joined.select(*[c for c in joined.columns if not c.startswith("_")])


def features_csv(features: DataFrame, key: str, vector: str, names: Sequence[str], path: str) -> None:
    columns = [F.get(vector, F.lit(i)).alias(n) for i, n in enumerate(names)]
    features.select(F.col(key).alias("entity_id"), *columns).write.mode("overwrite").csv(path, header=True)
