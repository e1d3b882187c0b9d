"""The append-only store of raw events, as Parquet.

Columns: source_path, row_number, event_date, raw_json, loaded_at, load_seq. The pair
(load_seq, row_number) orders rows as they came; no global counter is needed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions import expr as E

SCHEMA = "source_path string, row_number long, event_date date, raw_json string, loaded_at timestamp, load_seq long"


def _jpath(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, partitions as they are."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared(spark))
    return df.checkpoint()


def shared(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a temporary one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="tallymill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


@contextmanager
def landed(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` computed once, as Parquet in the shared folder, for readers of a few columns each; removed at the end."""
    spark = df.sparkSession
    path = f"{shared(spark).rstrip('/')}/landed-{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        reset(spark, path)


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _jpath(spark, path)
    return bool(fs.exists(p))


def init(spark: SparkSession, path: str) -> None:
    """Create the store with its schema if it isn't there."""
    if not exists(spark, path):
        spark.createDataFrame([], SCHEMA).write.parquet(path)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def to_events(rows: DataFrame, datetime: str | None, fmt: str, columns: list[str], load_seq: int = 0) -> DataFrame:
    """Rows of a scan as rows of the store."""
    date = E.parse_date(datetime, fmt) if datetime else F.lit(None).cast("date")
    return rows.select(
        "source_path", "row_number", date.alias("event_date"), E.encode_row(columns).alias("raw_json"),
        F.current_timestamp().alias("loaded_at"), F.lit(load_seq).cast("long").alias("load_seq"),
    )


def append(events: DataFrame, path: str) -> None:
    """Add rows; loading a file twice adds it twice."""
    events.write.mode("append").parquet(path)


def in_range(events: DataFrame, date_ge: str | None = None, date_le: str | None = None, shift_days: int = 0, date: str = "event_date") -> DataFrame:
    """Rows between two dates, the lower bound moved by ``shift_days``.

    Rows without a date stay only when there is no bound at all.
    """
    if date_ge is not None:
        events = events.where(F.col(date) >= F.date_add(F.lit(date_ge).cast("date"), shift_days))
    if date_le is not None:
        events = events.where(F.col(date) <= F.lit(date_le).cast("date"))
    return events


def ordered(events: DataFrame, *order: str | Column) -> DataFrame:
    """By date, then as loaded; rows without a date come first. Only where order shows."""
    return events.orderBy("event_date", *(order or ("load_seq", "source_path", "row_number")))


def decoded(events: DataFrame, columns: list[str]) -> DataFrame:
    """The payload as text columns; only the named keys are taken out of the document."""
    cells = F.json_tuple("raw_json", *columns)
    return events.select("event_date", cells.alias(*columns))


def reset(spark: SparkSession, *paths: str) -> list[str]:
    """Delete the store and reports that are there; what went is returned."""
    gone = []
    for path in paths:
        p, fs = _jpath(spark, path)
        if fs.exists(p) and fs.delete(p, True):
            gone.append(path)
    return gone


def write_report(report: DataFrame, path: str, append_rows: bool = False) -> None:
    """A report as JSON rows; a history grows by appending."""
    report.write.mode("append" if append_rows else "overwrite").json(path)


def write_yaml(spark: SparkSession, value: object, path: str) -> None:
    """A small driver-side document as YAML, through Spark's file systems."""
    import yaml

    p, fs = _jpath(spark, path)
    out = fs.create(p, True)
    try:
        out.write(yaml.safe_dump(value, allow_unicode=True, sort_keys=False).encode())
    finally:
        out.close()


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    return spark.read.schema(schema).json(path) if exists(spark, path) else None
