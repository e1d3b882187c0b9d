"""Descriptions, correlations, histograms and a profile page."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.config import Roles
from tallymill.functions import expr as E
from tallymill.operators import quantiles


def projection(df: DataFrame, roles: Roles, rows: int | None = None, order: list[str] = ()) -> DataFrame:
    """Features, target and date, numerics read as numbers; the first ``rows`` in order if asked."""
    if rows is not None:
        df = df.orderBy(*order).limit(rows)
    numbers = {*roles.numeric, roles.target}
    names = [c for c in (*roles.features, roles.target, roles.datetime) if c and c in df.columns]
    return df.select(*(E.py_float(c).alias(c) if c in numbers else E.col(c) for c in names))


def describe(df: DataFrame, columns: list[str], precision: int = 4) -> DataFrame:
    """(column, count, mean, std, min, p25, p50, p75, max); quartiles are exact."""
    df = df.select(*(F.when(~F.isnan(v), v).alias(c) for c, v in ((c, E.number(df, c)) for c in columns)))
    quartiles = quantiles.exact(df, [E.col(c) for c in columns], [0.25, 0.5, 0.75])
    parts = []
    for i, c in enumerate(columns):
        v = E.col(c)
        q = [F.lit(x).cast("double") for x in quartiles[i] or [None] * 3]
        r = lambda x: F.round(x, precision)
        parts.append(
            F.struct(
                F.lit(c).alias("column"), F.count(v).alias("count"), r(F.avg(v)).alias("mean"), r(F.stddev_samp(v)).alias("std"), r(F.min(v)).alias("min"),
                r(q[0]).alias("p25"), r(q[1]).alias("p50"), r(q[2]).alias("p75"), r(F.max(v)).alias("max"),
            ).alias(f"s{i}")
        )
    return df.agg(*parts).select(F.explode(F.array(*(f"s{i}" for i in range(len(columns))))).alias("s")).select("s.*")


def describe_levels(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, count, unique, top, freq)."""
    from tallymill.operators.stats import level_counts

    return level_counts(df, columns).where("level is not null").groupBy("column").agg(
        F.sum("count").alias("count"), F.count("*").alias("unique"), F.min_by("level", F.struct((-F.col("count")).alias("n"), "level")).alias("top"), F.max("count").alias("freq")
    )


def correlations(df: DataFrame, columns: list[str], precision: int = 4) -> DataFrame:
    """(a, b, corr) of all pairs in one aggregate, over rows where both are numbers."""
    v = {c: E.number(df, c) for c in columns}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    parts = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr(v[a], v[b]), precision).alias("corr")).alias(f"s{i}") for i, (a, b) in enumerate(pairs)]
    return df.agg(*parts).select(F.explode(F.array(*(f"s{i}" for i in range(len(pairs))))).alias("s")).select("s.*")


def histogram(df: DataFrame, columns: dict[str, tuple[float, float]], bins: int = 10) -> DataFrame:
    """(column, bin, lo, hi, count) of equal-width bins over given ranges; the top edge is inside."""
    cells = []
    for c, (low, high) in columns.items():
        v = E.number(df, c)
        at = F.least(F.floor((v - low) * bins / ((high - low) or 1.0)), F.lit(bins - 1)).cast("long")
        cells.append(F.struct(F.lit(c).alias("column"), F.when((v >= low) & (v <= high), at).alias("bin"), F.lit(low).alias("_lo"), F.lit((high - low) / bins).alias("_w")))
    out = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where(F.col("bin").isNotNull())
    out = out.groupBy("column", "bin", "_lo", "_w").agg(F.count("*").alias("count"))
    return out.select("column", "bin", F.round(F.col("_lo") + F.col("bin") * F.col("_w"), 4).alias("lo"), F.round(F.col("_lo") + (F.col("bin") + 1) * F.col("_w"), 4).alias("hi"), "count")


def page(title: str, *frames: tuple[str, DataFrame], most: int = 10_000) -> str:
    """An HTML page of small frames (each a row a column, pair or bin); past ``most`` rows it says that more are left out."""
    out = [f"<html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>"]
    for name, df in frames:
        rows = df.limit(most + 1).toPandas()
        out.append(f"<h2>{escape(name)}</h2>{rows[:most].to_html(index=False)}" + (f"<p>only the first {most} rows</p>" if len(rows) > most else ""))
    return "".join(out) + "</body></html>"


def profile(df: DataFrame, roles: Roles, path: str | None = None, title: str = "Profile") -> str:
    numbers = [c for c in (*roles.numeric, roles.target) if c in df.columns]
    ranges = {r["column"]: (r["min"], r["max"]) for r in describe(df, numbers, 12).collect() if r["count"]}
    frames = [("numbers", describe(df, numbers)), ("correlations", correlations(df, numbers)), ("histograms", histogram(df, ranges).orderBy("column", "bin"))]
    if roles.categorical:
        frames.append(("levels", describe_levels(df, list(roles.categorical))))
    html = page(title, *frames)
    if path:
        from pathlib import Path

        Path(path).write_text(html)
    return html
