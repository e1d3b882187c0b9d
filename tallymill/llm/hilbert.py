"""Sharding along a Hilbert curve, with DataFrame functions only.

Each metadata dimension is quantised to ``bits`` bits (strings by hash, numbers
on a linear or a logarithmic scale), the cells are numbered along the curve, and
the rows, sorted by curve index, are cut into runs of equal row count. Files of a
run cover a small box in every dimension, so a reader can prune by any of them.

Law ``rows``: shard counts differ by one at most. Rows of one cell are ordered by
a hash of the row, so a cell that holds a third of all rows splits over slices, whose
number follows the row count. Global ranks come from counts a (cell, slice),
prefix-summed in two levels; no window spans the table. Equal rows are counted before
any of this and are dealt out again at the end, in pieces of ``PIECE``, so that
repeats of one row spread over the slices too.

Nulls: a null text has no bytes, a null dimension falls into quantum 0, a null
``doc_id`` is a value like any other. A linear dimension that isn't numeric is hashed.
Repeated rows each keep a slot. An empty table gives an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tallymill.llm.common import fresh_dir, saved, text_or_empty

SHARDS = 40
PIECE = 1 << 16  # equal rows dealt out at once
SLICE_ROWS = 1_000_000  # rows that one task should rank
#: (column, scale); "size" is the row's own size in bytes.
DIMENSIONS = (("source", "hash"), ("lang", "hash"), ("doc_id", "linear"), ("size", "log"))


def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """(next state, output digit) by state * 2**dims + input digit.

    A state is (entry corner, direction); the rule is the Gray code walk of a
    hypercube, rotated and reflected into each sub-cube.
    """
    size, mask = 1 << dims, (1 << dims) - 1
    gray = lambda i: i ^ (i >> 1)
    inverse = {gray(i): i for i in range(size)}
    turn = lambda x, k: ((x << k % dims) | (x >> (dims - k % dims))) & mask
    trailing = lambda i: (~i & (i + 1)).bit_length() - 1
    follow, digit = [], []
    for entry in range(size):
        for direction in range(dims):
            for point in range(size):
                w = inverse[turn(point ^ entry, dims - (direction + 1) % dims)]
                start = 0 if w == 0 else gray(2 * ((w - 1) // 2))
                axis = 0 if w == 0 else trailing(w - 1 if w % 2 == 0 else w) % dims
                to = entry ^ turn(start, direction + 1)
                follow.append(to * dims + (direction + axis + 1) % dims)
                digit.append(w)
    return follow, digit


def curve_index(axes: list[Column], bits: int) -> Column:
    """Hilbert index of integer axes of ``bits`` bits each."""
    dims = len(axes)
    follow, digit = curve_tables(dims)
    nexts, digits = F.array(*map(F.lit, follow)), F.array(*map(F.lit, digit))

    def step(acc: Column, level: Column) -> Column:
        point = F.lit(0)
        for j, axis in enumerate(axes):
            point = point + F.call_function("shiftleft", F.call_function("shiftright", axis, level).bitwiseAND(F.lit(1)), F.lit(j))
        at = acc["state"] * F.lit(1 << dims) + point
        return F.struct(F.get(nexts, at).alias("state"), (acc["index"] * F.lit(1 << dims) + F.get(digits, at)).alias("index"))

    zero = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("index"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), zero, step, lambda acc: acc["index"])


def quantum(column: Column, scale: str, bits: int, low: float | None, high: float | None) -> Column:
    top = (1 << bits) - 1
    if scale == "hash":
        out = F.pmod(F.xxhash64(column.cast("string")), F.lit(top + 1))
    elif scale == "log":
        out = F.floor(F.log2(F.greatest(column, F.lit(16)).cast("double"))) - 4
    else:
        low, high = low or 0, high or 0
        out = F.floor((column - F.lit(low)).cast("double") * F.lit((top + 1) / (high - low + 1)))
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(top), out.cast("int"))), F.lit(0))


def assign(docs: DataFrame, shards: int = SHARDS, dimensions=DIMENSIONS, bits: int = 4, slices: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, curve, shard, slot, and ``axis_<i>`` of each dimension).

    ``slices`` of a cell are a power of two: 64, or as many as leave SLICE_ROWS rows if all are in one cell.
    """
    body = text_or_empty()
    numeric = {f.name for f in docs.schema if isinstance(f.dataType, NumericType)}
    dimensions = [(n, "hash" if scale == "linear" and n != "size" and n not in numeric else scale) for n, scale in dimensions]
    source = {name: F.col("__size") if name == "size" else F.col(name) for name, _ in dimensions}
    linear = [name for name, scale in dimensions if scale == "linear"]
    ends = docs.agg(F.count("*").alias("n"), *(f(name).alias(f"{k}_{name}") for name in linear for k, f in (("low", F.min), ("high", F.max)))).first()
    total = ends["n"]
    slices = slices or max(64, 1 << (total // SLICE_ROWS).bit_length())
    axes = [
        quantum(source[n], scale, bits, ends[f"low_{n}"] if scale == "linear" else None, ends[f"high_{n}"] if scale == "linear" else None).alias(f"axis_{i}")
        for i, (n, scale) in enumerate(dimensions)
    ]
    size = F.octet_length(body).cast("long") + 16
    meta = docs.withColumn("__size", size).select("doc_id", F.col("__size").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), *axes)
    names = [f"axis_{i}" for i in range(len(dimensions))]
    meta = meta.groupBy("doc_id", "size", "text_crc32", *names).agg(F.count("*").alias("__copies"))
    meta = meta.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies") - 1, F.lit(PIECE).cast("long"))))
    digest = F.xxhash64("doc_id", "text_crc32", "size", "__from")
    step = max(0, slices - 1).bit_length()
    meta = meta.select(
        "doc_id", "size", "text_crc32", *names, F.least(F.col("__copies") - F.col("__from"), F.lit(PIECE)).alias("__copies"),
        curve_index([F.col(n) for n in names], bits).alias("curve"),
        F.shiftrightunsigned(digest, 1).alias("__order"),
        F.shiftrightunsigned(digest, 64 - step).cast("int").alias("__slice") if step else F.lit(0).alias("__slice"),
    )
    meta = saved(meta, "hilbert")

    counts = meta.groupBy("curve", "__slice").agg(F.sum("__copies").alias("__n")).withColumn("__head", F.shiftright("curve", max(0, bits * len(dimensions) - 8)))
    heads = counts.groupBy("__head").agg(F.sum("__n").alias("__all")).collect()  # 256 rows at most
    before, at = {}, 0
    for row in sorted(heads, key=lambda r: r["__head"]):
        before[row["__head"]] = at
        at += row["__all"]
    within = Window.partitionBy("__head").orderBy("curve", "__slice").rowsBetween(Window.unboundedPreceding, -1)
    # Named apart from meta's columns, so that the join keeps one of each.
    start = F.get(F.array(*(F.lit(before.get(i, 0)).cast("long") for i in range(max(before, default=0) + 1))), F.col("__head").cast("int"))
    offsets = counts.select("curve", "__slice", (start + F.coalesce(F.sum("__n").over(within), F.lit(0))).alias("__before"))
    place = Window.partitionBy("curve", "__slice").orderBy("__order", "doc_id", "text_crc32", "size", *names).rowsBetween(Window.unboundedPreceding, -1)
    ranked = meta.join(offsets, ["curve", "__slice"]).withColumn("__first", F.col("__before") + F.coalesce(F.sum("__copies").over(place), F.lit(0)))
    ranked = ranked.withColumn("__rank", F.explode(F.sequence(F.col("__first"), F.col("__first") + F.col("__copies") - 1)))
    shard = F.expr(f"(__rank * {shards}L) div {max(total, 1)}L").cast("int")
    out = ranked.withColumn("shard", shard)
    first = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    return out.select("doc_id", "size", "text_crc32", "curve", "shard", (F.col("__rank") - first).alias("slot"), *names)


def manifest(assigned: DataFrame) -> DataFrame:
    """One row a shard: rows, bytes and the box it covers, for pruning."""
    axes = [c for c in assigned.columns if c.startswith("axis_")]
    box = [f(c).alias(f"{k}_{c}") for c in axes for k, f in (("low", F.min), ("high", F.max))]
    return assigned.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.min("curve").alias("low_curve"), F.max("curve").alias("high_curve"), *box)


def write_shards(docs: DataFrame, path: str | None = None, **options) -> tuple[str, DataFrame]:
    """Write the rows of ``docs`` in shard order; (folder, manifest).

    Texts meet their shard by (doc_id, size, checksum); equal rows share a text.
    """
    spark = docs.sparkSession
    path = path or fresh_dir(spark, "shards")
    assigned = saved(assign(docs, **options), "assigned")
    body = text_or_empty()
    key = ["__id", "__size", "__crc"]
    left = docs.select(
        F.struct(*docs.columns).alias("row"), F.xxhash64("doc_id").alias("__id"), (F.octet_length(body).cast("long") + 16).alias("__size"), F.crc32(body.cast("binary")).alias("__crc")
    ).withColumn("__copy", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("row"))))
    right = assigned.select(F.xxhash64("doc_id").alias("__id"), F.col("size").alias("__size"), F.col("text_crc32").alias("__crc"), "shard", "slot")
    right = right.withColumn("__copy", F.row_number().over(Window.partitionBy(*key).orderBy("shard", "slot")))
    joined = left.join(right, [*key, "__copy"]).select("shard", "slot", "row.*") if not {"shard", "slot"} & set(docs.columns) else left.join(right, [*key, "__copy"]).select("shard", "slot", "row")
    joined.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return path, manifest(assigned)
