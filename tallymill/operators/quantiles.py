"""Exact quantiles of many columns without a task that holds a column.

A first pass brackets every wanted rank by approximate percentiles, whose buffers are
bounded. A second one counts what lies below each bracket and at its ends, and lists the
values between them. Where a bracket would hold more than ``MOST`` rows it is
narrowed by further passes over its own rows; each narrows by some thousands.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000
MOST = 200_000  # rows that a bracket may hold when its values are collected


def exact(df: DataFrame, columns: list[Column], shares: list[float]) -> list[list[float] | None]:
    """For each column of doubles its interpolated quantiles at ``shares``; None without values.

    NULL cells are passed over; NaN must have been made NULL.
    """
    if not columns:
        return []
    values = df.select(*(c.alias(f"_q{i}") for i, c in enumerate(columns)))
    counts = values.agg(*(F.count(f"_q{i}").alias(f"n{i}") for i in range(len(columns))), *(_approximate(f"_q{i}", _spread(shares)).alias(f"a{i}") for i in range(len(columns)))).first()
    wanted = {}  # (column, place of the share) -> ranks
    brackets: dict[tuple[int, int], tuple[float, float, float]] = {}  # with the share of the column's rows that may lie inside
    for i in range(len(columns)):
        n = counts[f"n{i}"]
        for j, share in enumerate(shares):
            if n:
                at = share * (n - 1)
                wanted[i, j] = (math.floor(at), math.ceil(at), at - math.floor(at))
                low, high = counts[f"a{i}"][2 * j : 2 * j + 2]
                # Under ACCURACY rows the gap around a share can be less than a rank.
                brackets[i, j] = (low, high, n * 6 / ACCURACY + 1) if n >= ACCURACY else (-math.inf, math.inf, n)
    below = dict.fromkeys(brackets, 0)
    while any(rows > MOST and low < high for low, high, rows in brackets.values()):
        brackets = _narrowed(values, brackets, wanted)
    first: dict = {}
    same = {k: first.setdefault((k[0], low, high), k) for k, (low, high, _) in brackets.items()}
    found = _inside(values, {k: brackets[k] for k in set(same.values())}, below)
    out: list[list[float] | None] = []
    for i in range(len(columns)):
        if not counts[f"n{i}"]:
            out.append(None)
            continue
        own = []
        for j in range(len(shares)):
            low, high, part = wanted[i, j]
            key = same[i, j]
            a, b = _at(found[key], low, below[key]), _at(found[key], high, below[key])
            own.append(a if part == 0 else a + (b - a) * part)
        out.append(own)
    return out


def _spread(shares: list[float]) -> list[float]:
    """A lower and an upper share around each, further apart than the approximation errs."""
    gap = 3 / ACCURACY
    return [x for s in shares for x in (max(0.0, s - gap), min(1.0, s + gap))]


def _approximate(name: str, shares: list[float]) -> Column:
    return F.percentile_approx(name, [float(s) for s in shares], F.lit(ACCURACY))


def _holds(key: tuple[int, int], bracket: tuple[float, float, float]) -> Column:
    low, high, _ = bracket
    return (F.col(f"_q{key[0]}") >= F.lit(low)) & (F.col(f"_q{key[0]}") <= F.lit(high))


def _below(key: tuple[int, int], bracket: tuple[float, float, float]) -> Column:
    return F.count_if(F.col(f"_q{key[0]}") < F.lit(bracket[0]))


def _narrowed(values: DataFrame, brackets: dict, wanted: dict) -> dict:
    """The brackets, narrowed around the wanted ranks of those that hold too much."""
    sizes = values.agg(*(x.alias(f"{k}{a}_{b}") for (a, b), br in brackets.items() for k, x in (("u", _below((a, b), br)), ("n", F.count_if(_holds((a, b), br)))))).first()
    shares = {}
    for key, (low, high, rows) in brackets.items():
        under, n = sizes[f"u{key[0]}_{key[1]}"], sizes[f"n{key[0]}_{key[1]}"]
        if rows > MOST and low < high and n:
            gap = 3 / ACCURACY
            shares[key] = (max(0.0, (wanted[key][0] - under) / n - gap), min(1.0, (wanted[key][1] - under + 1) / n + gap), n)
    if not shares:
        return {k: (low, high, 0) for k, (low, high, _) in brackets.items()}
    row = values.agg(*(F.percentile_approx(F.when(_holds(k, brackets[k]), F.col(f"_q{k[0]}")), [s[0], s[1]], F.lit(ACCURACY)).alias(f"p{k[0]}_{k[1]}") for k, s in shares.items())).first()
    out = {}
    for key, (low, high, _) in brackets.items():
        if key in shares:
            low, high = row[f"p{key[0]}_{key[1]}"]
            out[key] = (low, high, shares[key][2] * 6 / ACCURACY + 1)
        else:
            out[key] = (low, high, 0)
    return out


def _inside(values: DataFrame, brackets: dict, below: dict) -> dict:
    """Sorted (value, count) of each bracket; the counts below them go to ``below``, from the same pass.

    The ends are counted, however often they occur; only what lies between them is listed.
    """
    if not brackets:
        return {}
    aggs = []
    for key, bracket in brackets.items():
        v, name = F.col(f"_q{key[0]}"), f"{key[0]}_{key[1]}"
        low, high = F.lit(bracket[0]), F.lit(bracket[1])
        aggs += [_below(key, bracket).alias(f"u{name}"), F.count_if(v == low).alias(f"l{name}"), F.count_if(v == high).alias(f"h{name}"), F.collect_list(F.when((v > low) & (v < high), v)).alias(f"v{name}")]
    row = values.agg(*aggs).first()  # MOST values a bracket at most
    found: dict = {}
    for key, (low, high, _) in brackets.items():
        name = f"{key[0]}_{key[1]}"
        below[key] = row[f"u{name}"]
        found[key] = [(low, row[f"l{name}"]), *sorted(Counter(row[f"v{name}"]).items())]
        if high > low:
            found[key].append((high, row[f"h{name}"]))
    return found


def _at(values: list[tuple[float, int]], rank: int, below: int) -> float:
    at = below
    if rank < below:
        raise ArithmeticError("a bracket missed its rank")
    for value, n in values:
        at += n
        if rank < at:
            return value
    raise ArithmeticError("a bracket missed its rank")
