"""Mergeable column statistics and dataset metadata.

One aggregate computes the state of all columns (no unpivoting of rows); states of
batches merge by sums and the parallel variance formula; reports are projections of
a state. A NaN cell counts as not valid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.functions import expr as E

STATE = ("count", "sum", "min", "max", "mean", "m2", "zero_count", "missing", "nonvalid")


def _number(df: DataFrame, c: str) -> Column:
    v = E.number(df, c)
    return F.when(~F.isnan(v), v)


def numeric_state(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, count, sum, min, max, mean, m2, zero_count, missing, nonvalid): one scan, one row a column."""
    # Parsed once: a projection that several aggregates read isn't folded into them.
    df = df.select(*(E.col(c) for c in dict.fromkeys(columns)), *(_number(df, c).alias(f"_v{i}") for i, c in enumerate(columns)))
    aggs = []
    for i, c in enumerate(columns):
        v = F.col(f"_v{i}")
        aggs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(v).alias("count"),
                F.coalesce(F.sum(v), F.lit(0.0)).alias("sum"),
                F.min(v).alias("min"),
                F.max(v).alias("max"),
                F.avg(v).alias("mean"),
                F.coalesce(F.var_pop(v) * F.count(v), F.lit(0.0)).alias("m2"),
                F.count_if(v == 0).alias("zero_count"),
                F.count_if(E.missing_exact(c)).alias("missing"),
                F.count_if(~E.missing_exact(c) & v.isNull()).alias("nonvalid"),
            ).alias(f"s{i}")
        )
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*(f"s{i}" for i in range(len(columns))))).alias("s")).select("s.*")


def merge_numeric(states: DataFrame) -> DataFrame:
    """States of disjoint batches as the state of their union."""
    w = Window.partitionBy("column")
    total = F.sum("count").over(w)
    mean = F.when(total > 0, F.sum(F.col("count") * F.coalesce("mean", F.lit(0.0))).over(w) / total)
    shifted = states.withColumn("_mean", mean).withColumn(
        "_m2", F.col("m2") + F.when(F.col("count") > 0, F.col("count") * F.pow(F.col("mean") - F.col("_mean"), 2)).otherwise(0.0)
    )
    return shifted.groupBy("column").agg(
        F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"), F.max("_mean").alias("mean"),
        F.sum("_m2").alias("m2"), F.sum("zero_count").alias("zero_count"), F.sum("missing").alias("missing"), F.sum("nonvalid").alias("nonvalid"),
    )


def numeric_report(state: DataFrame, precision: int = 3) -> DataFrame:
    """Mean, sample deviation and frequencies from a state.

    Zeros are a share of valid cells, missing and not valid ones of all; a column
    without rows counts as wholly missing.
    """
    total = F.col("count") + F.col("missing") + F.col("nonvalid")
    share = lambda a, b, empty: F.round(F.when(b > 0, a / b).otherwise(F.lit(empty)), precision)
    std = F.when(F.col("count") > 1, F.sqrt(F.greatest(F.col("m2"), F.lit(0.0)) / (F.col("count") - 1))).otherwise(F.lit(0.0))
    return state.select(
        "column", "count", "missing", "nonvalid", "zero_count",
        *(F.round(c, precision).alias(c) for c in ("sum", "min", "max", "mean")),
        F.round(std, precision).alias("std"),
        share(F.col("zero_count"), F.col("count"), 0.0).alias("zero_frequency"),
        share(F.col("missing"), total, 1.0).alias("missing_frequency"),
        share(F.col("nonvalid"), total, 0.0).alias("nonvalid_frequency"),
    )


def level_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, level, count) of trimmed categorical cells; a NULL level stands for missing cells."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.when(~E.missing_trimmed(c), E.strip(c)).alias("level")) for c in columns))
    return df.select(F.explode(cells).alias("c")).select("c.*").groupBy("column", "level").agg(F.count("*").alias("count"))


def merge_levels(counts: DataFrame) -> DataFrame:
    return counts.groupBy("column", "level").agg(F.sum("count").alias("count"))


def categorical_report(counts: DataFrame, precision: int = 3) -> DataFrame:
    """(column, level, count, share, missing, missing_frequency) of the levels that occur."""
    missing = F.coalesce(F.sum(F.when(F.col("level").isNull(), F.col("count"))), F.lit(0))
    totals = counts.groupBy("column").agg(missing.alias("missing"), F.sum("count").alias("_total"))
    out = counts.where(F.col("level").isNotNull()).join(F.broadcast(totals), "column")  # a row a column
    return out.select(
        "column", "level", "count", F.round(F.col("count") / (F.col("_total") - F.col("missing")), precision).alias("share"), "missing",
        F.round(F.col("missing") / F.col("_total"), precision).alias("missing_frequency"),
    )


def meta_state(df: DataFrame, columns: list[str], date: Column | None) -> DataFrame:
    """One row that merges with those of other loads: rows, missing cells over all columns, months, date range."""
    empty = [E.missing_exact(c) for c in columns]
    cells = sum((e.cast("long") for e in empty), F.lit(0).cast("long"))
    month = F.date_format(date, "yyyy-MM") if date is not None else F.lit(None).cast("string")
    day = date if date is not None else F.lit(None).cast("date")
    marked = df.select(cells.alias("_m"), day.alias("_d"), month.alias("_month"))
    return marked.agg(
        F.count("*").alias("total_rows"), F.coalesce(F.sum("_m"), F.lit(0)).alias("total_missing"), F.count_if(F.col("_m") > 0).alias("rows_with_any_missing"),
        F.sort_array(F.collect_set("_month")).alias("unique_months"), F.min("_d").alias("min_date"), F.max("_d").alias("max_date"), F.current_timestamp().alias("loaded_at"),
    )


def id_state(df: DataFrame, id_column: str) -> DataFrame:
    """(id): the distinct ids of a load; those of many loads are counted together."""
    return df.select(F.when(~E.missing_exact(id_column), E.strip(id_column)).alias("id")).where("id is not null").distinct()


def merge_meta(states: DataFrame) -> DataFrame:
    """States of disjoint loads as the state of their union; months are few."""
    return states.agg(
        *(F.sum(c).alias(c) for c in ("total_rows", "total_missing", "rows_with_any_missing")), F.sort_array(F.array_distinct(F.flatten(F.collect_list("unique_months")))).alias("unique_months"),
        F.min("min_date").alias("min_date"), F.max("max_date").alias("max_date"), F.max("loaded_at").alias("loaded_at"),
    )


def meta_report(state: DataFrame, ids: DataFrame | None, id_column: str | None, precision: int = 3) -> DataFrame:
    """The state with its frequencies, the number of months, and of distinct ids (``ids`` of all loads)."""
    share = F.when(F.col("total_rows") > 0, F.col("rows_with_any_missing") / F.col("total_rows")).otherwise(0.0)
    out = state.withColumn("n_unique_ids", F.lit(0).cast("long"))
    if ids is not None:  # two rows into one
        both = out.unionByName(ids.agg(F.count_distinct("id").alias("n_unique_ids")), allowMissingColumns=True)
        out = both.agg(*(F.max(c).alias(c) for c in both.columns))
    return out.select(
        "total_rows", "total_missing", "rows_with_any_missing", F.round(share, precision).alias("row_any_missing_frequency"), "n_unique_ids", F.lit(id_column).alias("id_column"),
        F.size("unique_months").cast("long").alias("n_unique_months"), "unique_months", "min_date", "max_date", "loaded_at",
    )


def dataset_meta(df: DataFrame, columns: list[str], id_column: str | None, date: Column | None, precision: int = 3) -> DataFrame:
    """One row of all this for one set of rows."""
    ids = id_state(df, id_column) if id_column else None
    return meta_report(meta_state(df, columns, date), ids, id_column, precision)


def id_sketch(df: DataFrame, id_column: str) -> DataFrame:
    """A mergeable sketch of distinct ids, where an estimate is enough; ``merge_ids`` unites those of many loads."""
    return df.agg(F.hll_sketch_agg(F.when(~E.missing_exact(id_column), E.strip(id_column))).alias("ids"))


def merge_ids(sketches: DataFrame) -> DataFrame:
    return sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("ids")).alias("n_unique_ids"))
