"""Data drift between two states of column statistics, and its policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.config import DriftLimits

RANKS = {"ok": 0, "warn": 1, "critical": 2}
EPS = 1e-9


class DataDriftPolicyError(RuntimeError):
    """The drift is at least as severe as the policy allows."""


def severity(rank: Column) -> Column:
    return F.when(rank == 2, "critical").when(rank == 1, "warn").otherwise("ok")


def _over(value: Column, limits: tuple[float, float]) -> Column:
    return F.when(value >= limits[1], 2).when(value >= limits[0], 1).otherwise(0)


def numeric_drift(reference: DataFrame, current: DataFrame, limits: DriftLimits, target: str | None = None, precision: int = 6) -> DataFrame:
    """(column, mean_shift_sigmas, std_ratio, missing_frequency_delta, severity).

    Both sides are numeric reports, a row a column. The ratio is 1 where neither side
    spreads and NULL (infinite) where only the reference doesn't.
    """
    skip = [c for c in (target, *limits.exclude) if c]
    pick = lambda df, s: df.where(~F.col("column").isin(skip) if skip else F.lit(True)).select("column", *(F.col(c).alias(f"{s}_{c}") for c in ("mean", "std", "missing_frequency")))
    both = pick(reference, "r").join(F.broadcast(pick(current, "c")), "column")  # a row a column
    shift = F.abs(F.col("c_mean") - F.col("r_mean")) / F.greatest(F.col("r_std"), F.lit(EPS))
    ratio = F.when(F.col("r_std") > EPS, F.col("c_std") / F.col("r_std")).when(F.col("c_std") <= EPS, F.lit(1.0)).otherwise(F.lit(float("inf")))
    delta = F.abs(F.col("c_missing_frequency") - F.col("r_missing_frequency"))
    low = F.when(ratio <= limits.std_low[1], 2).when(ratio <= limits.std_low[0], 1).otherwise(0)
    rank = F.greatest(_over(shift, limits.mean_shift), _over(ratio, limits.std_high), low, _over(delta, limits.missing_delta))
    return both.select(
        "column", F.round(shift, precision).alias("mean_shift_sigmas"), F.when(ratio != float("inf"), F.round(ratio, precision)).alias("std_ratio"),
        F.round(delta, precision).alias("missing_frequency_delta"), severity(rank).alias("severity"),
    )


def divergence(reference: DataFrame, current: DataFrame) -> DataFrame:
    """(column, js_divergence): Jensen-Shannon over (column, level, count) on both sides.

    Natural logarithm, 0 where either side has no levels.
    """
    share = lambda df, name: df.where(F.col("level").isNotNull()).select("column", "level", F.col("count").alias(name))
    both = share(reference, "r").join(share(current, "c"), ["column", "level"], "full").fillna(0, ["r", "c"])
    sums = both.groupBy("column").agg(F.sum("r").alias("r_all"), F.sum("c").alias("c_all"))
    both = both.join(sums, "column")
    p = F.when(F.col("r_all") > 0, F.col("r") / F.col("r_all")).otherwise(0.0)
    q = F.when(F.col("c_all") > 0, F.col("c") / F.col("c_all")).otherwise(0.0)
    m = (p + q) / 2
    term = 0.5 * p * F.ln((p + EPS) / (m + EPS)) + 0.5 * q * F.ln((q + EPS) / (m + EPS))
    none = (F.min("r_all") == 0) | (F.min("c_all") == 0)
    return both.withColumn("_t", term).groupBy("column").agg(F.when(none, F.lit(0.0)).otherwise(F.greatest(F.sum("_t"), F.lit(0.0))).alias("js_divergence"))


def categorical_drift(reference: DataFrame, current: DataFrame, limits: DriftLimits, precision: int = 6) -> DataFrame:
    """(column, js_divergence, missing_frequency_delta, severity) from level counts."""
    miss = lambda df, name: df.groupBy("column").agg((F.coalesce(F.sum(F.when(F.col("level").isNull(), F.col("count"))), F.lit(0)) / F.sum("count")).alias(name))
    skip = list(limits.exclude)
    both = divergence(reference, current).join(miss(reference, "r"), "column").join(miss(current, "c"), "column")
    if skip:
        both = both.where(~F.col("column").isin(skip))
    delta = F.abs(F.col("c") - F.col("r"))
    rank = F.greatest(_over(F.col("js_divergence"), limits.divergence), _over(delta, limits.missing_delta))
    return both.select("column", F.round("js_divergence", precision).alias("js_divergence"), F.round(delta, precision).alias("missing_frequency_delta"), severity(rank).alias("severity"))


def status(*parts: DataFrame) -> DataFrame:
    """(status, n_ok, n_warn, n_critical): the worst severity of all columns."""
    every = parts[0].select("severity")
    for p in parts[1:]:
        every = every.unionByName(p.select("severity"))
    rank = F.max(F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "warn", 1).otherwise(0))
    counts = [F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in RANKS]
    return every.agg(severity(F.coalesce(rank, F.lit(0))).alias("status"), *counts)


def actions(status: str, numeric: list = (), categorical: list = ()) -> list[str]:
    """What to do about the report as a whole, then about the columns that drifted."""
    whole = {
        "no_reference": "freeze a reference from trusted data", "no_current": "load data: there are no current statistics",
        "critical": "retrain or recalibrate: the distribution shifted strongly", "warn": "review features and segments: the distribution shifted", "ok": "none: within tolerance",
    }
    out = [whole[status]]
    if any(r["severity"] != "ok" for r in numeric):
        out.append("refresh statistics and rules")
    if any(r["severity"] != "ok" for r in categorical):
        out.append("review the encoding of levels")
    for r in [*numeric, *categorical]:
        if r["severity"] == "critical":
            out.append(f"retrain without or repair {r['column']}")
        elif r["severity"] == "warn":
            out.append(f"watch {r['column']}")
    return out


def normal_fail_on(value: object) -> str:
    """off, warn or critical; anything else is off."""
    text = str(value).strip().lower() if value is not None else "off"
    return text if text in ("warn", "critical") else "off"


def monitor(reference: tuple[DataFrame, DataFrame] | None, current: tuple[DataFrame, DataFrame] | None, limits: DriftLimits, target: str | None = None) -> dict:
    """The drift report; ``no_reference`` or ``no_current`` where a side is missing."""
    if reference is None or current is None:
        state = "no_reference" if reference is None else "no_current"
        return {"status": state, "numeric": [], "categorical": [], "actions": actions(state)}
    from tallymill.operators.stats import numeric_report

    numeric = [r.asDict() for r in numeric_drift(numeric_report(reference[0]), numeric_report(current[0]), limits, target).orderBy("column").collect()]
    categorical = [r.asDict() for r in categorical_drift(reference[1], current[1], limits).orderBy("column").collect()]
    worst = max((RANKS[r["severity"]] for r in [*numeric, *categorical]), default=0)
    return {"status": list(RANKS)[worst], "numeric": numeric, "categorical": categorical, "actions": actions(list(RANKS)[worst], numeric, categorical)}


def enforce(report: dict, limits: DriftLimits) -> None:
    """Raise where the report is as severe as the policy names; call it after writing the report."""
    if report["status"] not in RANKS:
        if limits.fail_on_incomplete:
            raise DataDriftPolicyError(f"drift can't be judged: {report['status']}")
        return
    level = normal_fail_on(limits.fail_on)
    if level != "off" and RANKS[report["status"]] >= RANKS[level]:
        raise DataDriftPolicyError(f"data drift is {report['status']}")
