"""Fitted preprocessing as plain parameters and column expressions; targets."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions import expr as E
from tallymill.operators import quantiles

#: The preprocessing variants by name.
VARIANTS = {
    "tree": {"impute": "median", "scale": False, "encode": "ordinal", "categorical_impute": "most_frequent"},
    "tree_mean": {"impute": "mean", "scale": False, "encode": "ordinal", "categorical_impute": "most_frequent"},
    "mlp_ohe": {"impute": "median", "scale": True, "encode": "onehot", "categorical_impute": "most_frequent"},
    "mlp_ordinal": {"impute": "median", "scale": True, "encode": "ordinal", "categorical_impute": "most_frequent"},
}
FAMILY_DEFAULT = {"tree": "tree", "mlp": "mlp_ohe"}
OTHER = "__OTHER__"
#: Columns with more levels than this are looked up by a join, others in an array within the projection.
ARRAY_LEVELS = 1000


def resolve_variant(name: str | None, family: str) -> str:
    """The variant's key; a default of the other family falls back to the family's own."""
    if name is None or (name in FAMILY_DEFAULT.values() and not name.startswith(family)):
        return FAMILY_DEFAULT[family]
    if name in VARIANTS:
        return name
    if (full := f"{family}_{name}") in VARIANTS:
        return full
    raise ValueError(f"unknown preprocessing variant: {name}")


@dataclass
class Preprocessor:
    """What was learned: fills, means and deviations of numerics, levels of categories."""

    numeric: list[str]
    categorical: list[str]
    variant: str = "tree"
    fill: dict[str, float] = field(default_factory=dict)
    mean: dict[str, float] = field(default_factory=dict)
    std: dict[str, float] = field(default_factory=dict)
    level_fill: dict[str, str] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)
    constant_filled: list[str] = field(default_factory=list)
    #: Trained levels without an indicator of their own (one-hot); they share one.
    tail: dict[str, list[str]] = field(default_factory=dict)

    @property
    def output(self) -> list[str]:
        if VARIANTS[self.variant]["encode"] == "ordinal":
            return [*self.numeric, *self.categorical]
        return [*self.numeric, *(name for c in self.categorical for name in self.indicators(c))]

    def indicators(self, c: str) -> list[str]:
        return [*(f"{c}={v}" for v in self.levels[c]), *([f"{c}:{OTHER}"] if self.tail.get(c) else [])]

    def looked_up(self, c: str) -> list[str]:
        """The levels whose positions the encoding needs."""
        return self.levels[c] if VARIANTS[self.variant]["encode"] == "ordinal" else self.tail.get(c, [])

    def at(self, c: str, present: bool = True) -> Column:
        """Position of the cell's level among ``looked_up``, from 0; null or negative if it isn't there."""
        if len(self.looked_up(c)) > ARRAY_LEVELS:
            return F.col(f"__at{self.categorical.index(c)}")  # joined by ``placed``
        return F.array_position(F.array(*map(F.lit, self.looked_up(c))), self.level(c, present)) - 1

    def number(self, c: str, present: bool = True) -> Column:
        v = E.py_float(c) if present else F.lit(None).cast("double")
        out = F.coalesce(F.when(~F.isnan(v), v), F.lit(self.fill[c]))
        if VARIANTS[self.variant]["scale"]:
            out = (out - F.lit(self.mean[c])) / F.lit(self.std[c] or 1.0)
        return out

    def level(self, c: str, present: bool = True) -> Column:
        cell = F.when(~E.missing_trimmed(c), E.strip(c)) if present else F.lit(None).cast("string")
        return F.coalesce(cell, F.lit(self.level_fill[c]))

    def ordinal(self, c: str, present: bool = True) -> Column:
        """Position among the sorted levels; a level never seen is -1."""
        return F.coalesce(self.at(c, present), F.lit(-1)).cast("long")

    def onehot(self, c: str, present: bool = True) -> list[Column]:
        """An indicator a level, all zero for a level never seen; the tail shares one."""
        level, seen = self.level(c, present), self.levels[c]
        own = [(level == F.lit(v)).cast("double") for v in seen]
        if self.tail.get(c):
            own.append(F.coalesce(self.at(c, present) >= 0, F.lit(False)).cast("double"))
        return [x.alias(name) for x, name in zip(own, self.indicators(c))]

    def columns(self, present: set[str]) -> list[Column]:
        out = [self.number(c, c in present).alias(c) for c in self.numeric]
        for c in self.categorical:
            out += [self.ordinal(c, c in present).alias(c)] if VARIANTS[self.variant]["encode"] == "ordinal" else self.onehot(c, c in present)
        return out

    def placed(self, df: DataFrame) -> DataFrame:
        """``df`` with the positions that ``columns`` takes from a join, for columns of many levels."""
        present = set(df.columns)
        for i, c in enumerate(self.categorical):
            if len(levels := self.looked_up(c)) > ARRAY_LEVELS:
                table = df.sparkSession.createDataFrame(list(zip(levels, range(len(levels)))), f"__level{i} string, __at{i} long")
                df = df.join(table, self.level(c, c in present) == F.col(f"__level{i}"), "left")
        return df

    def transform(self, df: DataFrame, keep: list[str | Column] = ()) -> DataFrame:
        """The matrix; columns that ``df`` lacks are filled, others dropped."""
        return self.placed(df).select(*keep, *self.columns(set(df.columns)))

    def to_dict(self) -> dict:
        return asdict(self)


def fit(df: DataFrame, numeric: list[str], categorical: list[str], variant: str = "tree", max_levels: int = 50, fit_rows: int | None = None, order: list[str] = ()) -> Preprocessor:
    """Learn from all rows, or from the first ``fit_rows`` in ``order`` for parity with batch fits.

    A column without any number is kept and filled with 0. One-hot gives ``max_levels``
    columns at most: over that, the last stands for all but the most frequent levels.
    Ordinals have no limit. The driver holds every level of the categorical columns.
    """
    if fit_rows is not None:
        df = df.orderBy(*order).limit(fit_rows)
    how = VARIANTS[variant]
    aggs = []
    parsed = [E.number(df, c) for c in numeric]
    cells = df
    df = df.select(*map(E.col, dict.fromkeys(categorical)), *(F.when(~F.isnan(v), v).alias(f"_v{i}") for i, v in enumerate(parsed)))
    for i, c in enumerate(numeric):
        v = F.col(f"_v{i}")
        aggs += [F.count(v).alias(f"n{i}"), F.sum(v).alias(f"s{i}"), F.sum(v * v).alias(f"q{i}"), F.count("*").alias(f"a{i}"), F.var_pop(v).alias(f"v{i}"), F.avg(v).alias(f"g{i}")]
    row = df.agg(*aggs).first() if aggs else {}
    middles: list = [row[f"g{i}"] for i in range(len(numeric))]
    if how["impute"] == "median":
        middles = [own and own[0] for own in quantiles.exact(df, [F.col(f"_v{i}") for i in range(len(numeric))], [0.5])]
    p = Preprocessor(list(numeric), list(categorical), variant)
    for i, c in enumerate(numeric):
        n, rows = row[f"n{i}"], row[f"a{i}"]
        if not n:
            p.constant_filled.append(c)
        fill = float(middles[i]) if n else 0.0
        p.fill[c] = fill
        # Moments after imputation: the fill joins the valid cells.
        gap, mean = rows - n, float(row[f"g{i}"] or 0.0)
        full = (mean * n + fill * gap) / rows if rows else 0.0
        square = (float(row[f"v{i}"] or 0.0) * n + n * (mean - full) ** 2 + gap * (fill - full) ** 2) / rows if rows else 0.0
        p.mean[c], p.std[c] = full, square**0.5
    if categorical:
        from tallymill.operators.stats import level_counts

        counts = level_counts(cells, list(categorical)).where("level is not null")
        found: dict[str, list[str]] = {}
        for r in counts.orderBy("column", F.desc("count"), "level").collect():
            found.setdefault(r["column"], []).append(r["level"])
        for i, c in enumerate(categorical):
            every = found.get(c, [])
            p.level_fill[c] = every[0] if every else "missing"
            own = len(every) if how["encode"] == "ordinal" or len(every) <= max_levels else max_levels - 1
            p.levels[c], p.tail[c] = sorted(every[:own]), sorted(every[own:])
    return p


def numeric_only(df: DataFrame, columns: list[str]) -> list[str]:
    """The columns whose every cell is a number, in one aggregate."""
    row = df.agg(*(F.coalesce(F.every(E.py_float(c).isNotNull()), F.lit(False)).alias(str(i)) for i, c in enumerate(columns))).first()
    return [c for i, c in enumerate(columns) if row[str(i)]]


def numeric_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(E.py_float(c).cast("float").alias(c) for c in numeric_only(df, columns)))


def log_target(c: str | Column) -> Column:
    return F.log1p(c if isinstance(c, Column) else F.col(c))


def from_log(prediction: str | Column, residual_variance: float = 0.0) -> Column:
    p = prediction if isinstance(prediction, Column) else F.col(prediction)
    return F.expm1(p + F.lit(residual_variance / 2))
