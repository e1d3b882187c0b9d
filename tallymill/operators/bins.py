"""Binning, bin labels and rows as item sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions import expr as E
from tallymill.operators import quantiles
from tallymill.sources.store import checkpointed


def equal_width(low: float, high: float, bins: int, precision: int = 3) -> list[float]:
    return [round(low + (high - low) * i / bins, precision) for i in range(bins + 1)]


def settled(edges: list[float], low: float | None = None, high: float | None = None, bins: int = 6, precision: int = 3) -> list[float]:
    """Distinct ascending edges; no data gives [0, 1], a constant a hair's width."""
    edges = sorted(dict.fromkeys(round(e, precision) for e in edges))
    if len(edges) >= 2:
        return edges
    if low is not None and high is not None and high > low:
        spread = sorted(dict.fromkeys(equal_width(low, high, bins, precision)))
        if len(spread) >= 2:
            return spread
    if not edges:
        return [0.0, 1.0]
    return [edges[0], edges[0] + 1e-9]


def fit_edges(df: DataFrame, columns: list[str], bins: int = 6, method: str = "quantile", precision: int = 3, cap: int | None = None, seed: int = 0) -> dict[str, list[float]]:
    """Edges of all columns: exact interpolated quantiles or equal widths.

    ``cap`` learns from that many rows only, chosen by hash and so repeatable.
    """
    if cap is not None:
        df = df.orderBy(F.xxhash64(*map(E.col, columns), F.lit(seed))).limit(cap)
    parsed = [E.number(df, c) for c in columns]
    df = df.select(*(F.when(~F.isnan(v), v).alias(f"_v{i}") for i, v in enumerate(parsed)))
    aggs = []
    for i, c in enumerate(columns):
        v = F.col(f"_v{i}")
        aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    if method == "quantile":
        inner = quantiles.exact(df, [F.col(f"_v{i}") for i in range(len(columns))], [j / bins for j in range(bins + 1)])
        return {c: settled(own or [], own[0] if own else None, own[-1] if own else None, bins, precision) for c, own in zip(columns, inner)}
    row = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(columns):
        low, high = row[f"lo{i}"], row[f"hi{i}"]
        out[c] = [0.0, 1.0] if low is None else settled(equal_width(low, high, bins, precision), low, high, bins, precision)
    return out


def label(column: str, edges: list[float], value: Column | None = None) -> Column:
    """The bin's text; NULL for a cell that is no number.

    Bins are half-open, the last one closed; empty ones are passed over. NaN compares
    false with everything and so falls above the last edge. Literals are written by
    the driver, so the text doesn't depend on an engine's number format.
    """
    v = E.py_float(column) if value is None else value
    below = v < F.lit(edges[0])
    out = F.when(v.isNull(), F.lit(None).cast("string")).when(F.isnan(v), f"({column} > {edges[-1]})").when(below, f"({column} < {edges[0]})")
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        if hi <= lo:
            continue
        last = i == len(edges) - 2
        inside = (v >= F.lit(lo)) & ((v <= F.lit(hi)) if last else (v < F.lit(hi)))
        out = out.when(inside, f"({lo} <= {column} {'<=' if last else '<'} {hi})")
    return out.otherwise(f"({column} > {edges[-1]})")


def collapsed(column: str, top: list[str] | None) -> Column:
    """A category's level, rare ones as ``__OTHER__``."""
    level = E.strip(column)
    return level if top is None else F.when(level.isin(top), level).otherwise("__OTHER__")


def items(edges: dict[str, list[float]], categories: dict[str, list[str] | None]) -> Column:
    """A row as an array of items; exactly missing cells give none."""
    parts = [F.when(~E.missing_exact(c), label(c, e)) for c, e in edges.items()]
    parts += [F.when(~E.missing_exact(c), F.concat(F.lit(f"{c} = "), collapsed(c, top))) for c, top in categories.items()]
    return F.array_compact(F.array(*parts))


def with_items(df: DataFrame, edges: dict[str, list[float]], categories: dict[str, list[str] | None], name: str = "items") -> DataFrame:
    """``df`` with its rows' items; each number is parsed once, before the labels look at it."""
    parsed = df.select("*", *(E.number(df, c).alias(f"_n{i}") for i, c in enumerate(edges)))
    parts = [F.when(~E.missing_exact(c), label(c, e, F.col(f"_n{i}"))) for i, (c, e) in enumerate(edges.items())]
    parts += [F.when(~E.missing_exact(c), F.concat(F.lit(f"{c} = "), collapsed(c, top))) for c, top in categories.items()]
    return parsed.select(*map(E.col, df.columns), F.array_compact(F.array(*parts)).alias(name))


def top_levels(counts: DataFrame, k: int) -> dict[str, list[str]]:
    """The k most frequent levels of each column (ties by level); k rows a column."""
    levels = checkpointed(counts.where(F.col("level").isNotNull()))
    out: dict[str, list[str]] = {}
    for r in first_levels(levels, k).collect():
        out.setdefault(r["column"], []).append(r["level"])
    return out


def first_levels(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent rows (column, level, count) of each column, in order: a top-k a column, so that
    no task sorts all levels of one."""
    names = [r["column"] for r in counts.select("column").distinct().orderBy("column").collect()]
    parts = [counts.where(F.col("column") == c).orderBy(F.desc("count"), "level").limit(k) for c in names]
    out = counts.limit(0) if not parts else parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
