"""Threshold findings, the column policy and the row cleaner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.config import Config, Engineered, QualityLimits, Roles
from tallymill.functions import expr as E


def _finding(bucket: str, check: str, value: str | Column, limit: float, column: str | Column = "column") -> list[Column]:
    value = F.col(value) if isinstance(value, str) else value
    column = F.col(column) if isinstance(column, str) else column
    return [F.lit(bucket).alias("bucket"), column.alias("column"), F.lit(check).alias("check"), value.cast("double").alias("value"), F.lit(float(limit)).alias("threshold")]


def findings(numeric: DataFrame, categorical: DataFrame, meta: DataFrame, roles: Roles, limits: QualityLimits, precision: int = 3) -> DataFrame:
    """(bucket, column, check, value, threshold): what is strictly over its limit.

    The target is left out of the numeric checks.
    """
    own = numeric.where(F.col("column") != roles.target)
    cats = categorical.select("column", "missing_frequency").distinct()
    parts = [
        own.where(F.col("missing_frequency") > limits.missing).select(*_finding("numeric", "missing_frequency", "missing_frequency", limits.missing)),
        own.where(F.col("nonvalid_frequency") > limits.nonvalid).select(*_finding("numeric", "nonvalid_frequency", "nonvalid_frequency", limits.nonvalid)),
        cats.where(F.col("missing_frequency") > limits.missing).select(*_finding("categorical", "missing_frequency", "missing_frequency", limits.missing)),
    ]
    if limits.zero_warn is not None:
        skip = [roles.target, *limits.zero_skip]
        over = numeric.where(~F.col("column").isin(skip) & (F.col("zero_frequency") > limits.zero_warn))
        parts.append(over.select(*_finding("numeric", "zero_frequency", "zero_frequency", limits.zero_warn)))
    if limits.cv_warn is not None:
        mean = F.col("sum") / F.col("count")
        spread = own.where((F.col("count") > 0) & (F.abs(mean) >= limits.cv_min_mean)).withColumn("_cv", F.round(F.col("std") / F.abs(mean), precision))
        parts.append(spread.where(F.col("_cv") > limits.cv_warn).select(*_finding("numeric", "coefficient_of_variation", "_cv", limits.cv_warn)))
    if limits.dominance_warn is not None:
        top = categorical.groupBy("column").agg(F.round(F.max("count") / F.sum("count"), precision).alias("_top"))
        parts.append(top.where(F.col("_top") > limits.dominance_warn).select(*_finding("categorical", "dominance", "_top", limits.dominance_warn)))
    if limits.row_missing is not None:
        over = meta.where(F.col("row_any_missing_frequency") > limits.row_missing)
        parts.append(over.select(*_finding("meta", "row_any_missing_frequency", "row_any_missing_frequency", limits.row_missing, F.lit("*"))))
    if limits.id_uniqueness is not None and roles.id:
        unique = F.round(F.col("n_unique_ids") / F.col("total_rows"), precision)
        under = meta.where((F.col("total_rows") > 0) & (unique < limits.id_uniqueness))
        parts.append(under.select(*_finding("meta", "id_uniqueness", unique, limits.id_uniqueness, F.lit(roles.id))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def column_policy(numeric: DataFrame, categorical: DataFrame, roles: Roles, limits: QualityLimits) -> DataFrame:
    """(column, kept, reason) of the configured features; the target is never dropped."""
    zero = F.lit(False) if limits.zero_drop is None else F.col("zero_frequency") > limits.zero_drop
    reason = (
        F.when(F.col("missing_frequency") > limits.missing, "missing_frequency")
        .when(F.col("nonvalid_frequency") > limits.nonvalid, "nonvalid_frequency")
        .when(zero, "zero_frequency")
        .otherwise("")
    )
    nums = numeric.where(F.col("column").isin(list(roles.numeric))).select("column", reason.alias("reason"))
    seen = categorical.select("column", "missing_frequency").distinct().where(F.col("column").isin(list(roles.categorical)))
    cats = seen.select("column", F.when(F.col("missing_frequency") > limits.missing, "missing_frequency").otherwise("").alias("reason"))
    return nums.unionByName(cats).select("column", (F.col("reason") == "").alias("kept"), "reason")


def kept_features(policy: DataFrame, roles: Roles) -> Roles:
    """The roles without dropped features; as many rows as there are columns."""
    dropped = {r["column"] for r in policy.where(~F.col("kept")).collect()}
    keep = lambda names: tuple(c for c in names if c not in dropped)
    return Roles(roles.target, roles.datetime, roles.datetime_format, roles.id, keep(roles.numeric), keep(roles.categorical), roles.drop)


def keep_row(roles: Roles) -> Column:
    """Target and kept numerics readable (a blank cell isn't), kept categories not blank."""
    numbers = [E.is_number(c) for c in (roles.target, *roles.numeric)]
    return E.all_of([*numbers, *(~E.missing_trimmed(c) for c in roles.categorical)])


def clean_rows(rows: DataFrame, roles: Roles, flags: list[Column] = (), keep: list[str] = ()) -> DataFrame:
    """Valid rows, projected to features, target, id and date; flags are of the raw row."""
    names = [c for c in (*keep, *roles.features, roles.target, roles.id, roles.datetime) if c and c in rows.columns]
    return rows.where(keep_row(roles)).select(*map(E.col, dict.fromkeys(names)), *flags)


def feature_contract(roles: Roles, rules: list[str] = (), engineered: Engineered = Engineered()) -> dict[str, list[str]]:
    """The matrix columns in order: numerics, rule flags, derived features, categories."""
    return {"numeric": [*roles.numeric, *rules, *engineered.names], "categorical": list(roles.categorical)}


def cleaning_summary(config: Config, policy: DataFrame, rules: list[str] = ()) -> dict:
    rows = policy.collect()  # a row a column
    roles = kept_features(policy, config.roles)
    return {
        "kept": [c for c in config.roles.features if c in roles.features],
        "dropped": {r["column"]: r["reason"] for r in sorted(rows) if not r["kept"]},
        "feature_matrix_columns": feature_contract(roles, rules, config.engineered),
    }
