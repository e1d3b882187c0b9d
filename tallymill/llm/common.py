"""What several operators share: the shared folder, Arrow batches, hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    (tests in local mode) a temporary folder stands in for it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallymill-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found if "://" in found else f"file://{found}"


def bounded(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of 1,000 rows where it has Spark's default of 10,000.

    A batch of texts is held several times over, by the JVM and by Python.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")
    return spark


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def gathered(df: DataFrame, rows: int, each: int = 8_000) -> DataFrame:
    """``df``, of at most ``rows`` short rows, in no more partitions than ``each`` rows a partition call for."""
    return df.coalesce(max(1, -(-rows // each)))


def saved(df: DataFrame, name: str, rows: int | None = None, each: int = 8_000) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends here.

    Where it is known to have at most ``rows`` short rows, it isn't written in more files than they need.
    """
    spark = df.sparkSession
    df = df if rows is None else gathered(df, rows, each)
    path = fresh_dir(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def open_fs(uri: str):
    """(file system, path) of a URI, for plain files that Spark has no writer for."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def spare(taken: list[str], name: str) -> str:
    """``name``, or the first longer one that no column has (column names ignore case)."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


_held: dict = {}


def only(key: tuple, make):
    """What a worker last loaded, under ``key``; what another operator left there is let go.

    Workers live on from stage to stage, so models and caches of all stages would add up.
    """
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def give_back() -> None:
    """Return freed memory to the system; workers live on from task to task."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc here
        pass


def pieces(batches: Iterator[pa.RecordBatch], chars: int = 1 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``chars`` bytes of text, whole rows each."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = batch.column(column).cast(pa.binary())
        sizes = np.array([0 if x is None else x for x in pa.compute.binary_length(lengths).to_pylist()], dtype=np.int64)
        group = np.cumsum(sizes) // chars
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
    give_back()


def blocks(batches: Iterator[pa.RecordBatch], chars: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of up to ``chars`` bytes of text, small ones put together; a longer text stands alone."""
    held, size = [], 0
    for piece in pieces(batches, chars // 8, column):
        if held and size + piece.nbytes > chars:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(piece)
        size += piece.nbytes
    if held:
        yield pa.concat_batches(held)


def bitmap(keys: DataFrame, most_bits: int = 1 << 29) -> bytes:
    """A filter over the low bits of ``key``: 16 bits a key, rounded up to a power of two, 64 MB at most.

    Past 2^25 keys it lets more rows through, and loses none.
    """
    import numpy as np

    bits = min(max(1 << 20, 1 << max(0, 16 * keys.count() - 1).bit_length()), most_bits)
    place = F.col("key").bitwiseAND(F.lit(bits - 1))
    blocks = keys.select(F.shiftright(place, 20).cast("int").alias("block"), place.bitwiseAND(F.lit((1 << 20) - 1)).cast("int").alias("bit")).distinct()

    def pack(group: pa.Table) -> pa.Table:
        on = np.zeros(1 << 20, dtype=bool)
        on[group["bit"].to_numpy()] = True
        return pa.table({"block": group["block"].slice(0, 1), "bits": pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())})

    out = bytearray(bits // 8)
    for row in blocks.groupBy("block").applyInArrow(pack, "block int, bits binary").toLocalIterator():  # 512 rows at most
        out[row["block"] << 17 : (row["block"] + 1) << 17] = row["bits"]
    return bytes(out)
