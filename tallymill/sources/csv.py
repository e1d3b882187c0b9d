"""Delimited text: batch scans and the direct training loader."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallymill.config import Roles
from tallymill.functions import expr as E
from tallymill.sources import store


def text_schema(columns) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names from a file's header, read by Spark's own reader."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns


def scan(spark: SparkSession, paths: str | list[str], columns=None) -> DataFrame:
    """All cells as text, with ``source_path`` and ``row_number`` (from 1 in each file).

    A multi-line file is read by one task from start to end, so rows are counted as they
    pass: no shuffle, no sort.
    """
    rows = _cells(spark, paths, columns)
    return rows.mapInArrow(_numbered, StructType([*rows.schema.fields, StructField("row_number", LongType())]))


def _cells(spark: SparkSession, paths: str | list[str], columns=None) -> DataFrame:
    paths = [paths] if isinstance(paths, str) else list(paths)
    names = list(columns or header_of(spark, paths[0]))
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(text_schema(names)).csv(paths)
    return rows.withColumn("source_path", F.input_file_name())


@contextmanager
def landed(spark: SparkSession, paths: str | list[str], columns=None) -> Iterator[DataFrame]:
    """The rows of ``scan``, parsed once and kept as Parquet for several readers.

    Numbers come from a running id of the reading task less the first one of the file
    (a row a file), so no cell goes through Python.
    """
    cells = _cells(spark, paths, columns)
    run = "__run" + "_" * max(map(len, cells.columns))  # longer than any column's name
    with store.landed(cells.withColumn(run, F.monotonically_increasing_id())) as rows:
        first = rows.groupBy("source_path").agg(F.min(run).alias(f"{run}0"))
        number = F.col(run) - F.col(f"{run}0") + 1
        yield rows.join(F.broadcast(first), "source_path").select(*map(E.col, cells.columns), number.alias("row_number"))


def _numbered(batches):
    """Each row's number within its file; a task reads one file after another."""
    last, seen = None, 0
    for batch in batches:
        runs = pa.compute.run_end_encode(batch.column("source_path").cast("string"))
        numbers, at = np.empty(batch.num_rows, dtype=np.int64), 0
        for end, path in zip(runs.run_ends.to_pylist(), runs.values.to_pylist()):
            seen = seen if path == last else 0
            numbers[at:end] = np.arange(seen + 1, seen + 1 + end - at)
            last, seen, at = path, seen + end - at, end
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers)], names=[*batch.schema.names, "row_number"])


def first_batches(rows: DataFrame, batch_size: int, max_batches: int | None) -> DataFrame:
    """The rows of each file's first ``max_batches`` batches (all without a limit)."""
    return rows if max_batches is None else rows.where(F.col("row_number") <= batch_size * max_batches)


def load_training(spark: SparkSession, paths: str | list[str], roles: Roles, strict: bool = True) -> DataFrame:
    """Features as text and the target as a number; rows with an empty cell are dropped.

    A target that is no number fails the query when ``strict``, else the row goes.
    """
    needed = [*roles.features, roles.target]
    rows = scan(spark, paths).where(E.all_of(~E.missing_in_csv(c) for c in needed))
    target = E.py_float(roles.target)
    if strict:
        target = F.coalesce(target, F.raise_error(F.concat(F.lit("target is no number: "), E.col(roles.target))).cast("double"))
        return rows.select(*map(E.col, roles.features), target.cast("float").alias(roles.target))
    return rows.select(*map(E.col, roles.features), target.cast("float").alias(roles.target)).where(E.col(roles.target).isNotNull())


def load(spark: SparkSession, path: str | None, roles: Roles) -> DataFrame:
    if not path:
        raise ValueError("a path to a CSV file is needed")
    return load_training(spark, path, roles)
