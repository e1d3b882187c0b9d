"""Declarative configuration: column roles, limits and paths."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Roles:
    """What each column of a source means. Every column is text until it is used."""

    target: str
    datetime: str | None = None
    datetime_format: str = "%d-%b-%y"
    id: str | None = None
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    drop: tuple[str, ...] = ()

    @property
    def features(self) -> tuple[str, ...]:
        return (*self.numeric, *self.categorical)

    @property
    def all(self) -> tuple[str, ...]:
        extra = [c for c in (self.id, self.datetime) if c]
        return tuple(dict.fromkeys((*self.features, self.target, *extra, *self.drop)))


@dataclass(frozen=True)
class QualityLimits:
    """The defaults of the quality report (None: the check is off)."""

    missing: float = 0.3
    nonvalid: float = 0.2
    zero_warn: float | None = 0.95
    zero_skip: tuple[str, ...] = ()
    zero_drop: float | None = None
    cv_warn: float | None = 80.0
    cv_min_mean: float = 0.001
    dominance_warn: float | None = 0.995
    row_missing: float | None = None
    id_uniqueness: float | None = None


@dataclass(frozen=True)
class RuleSettings:
    """The defaults of rule mining."""

    bins: int = 6
    binning: str = "quantile"
    levels: int = 18
    min_support: float = 0.14
    min_confidence: float = 0.5
    min_lift: float = 1.05
    top_k: int = 5
    max_features: int = 5
    strong_confidence: float = 0.8
    interesting_lift: float = 1.2
    max_items: int = 2500
    max_transactions: int | None = None
    exclude_target: bool = True

    def __post_init__(self):
        object.__setattr__(self, "levels", max(2, self.levels))
        if self.max_transactions is not None:
            object.__setattr__(self, "max_transactions", max(5000, self.max_transactions))


@dataclass(frozen=True)
class DriftLimits:
    """The defaults of the drift monitor (warning, critical)."""

    mean_shift: tuple[float, float] = (2.0, 4.0)
    std_low: tuple[float, float] = (0.5, 0.25)
    std_high: tuple[float, float] = (2.0, 4.0)
    missing_delta: tuple[float, float] = (0.08, 0.15)
    divergence: tuple[float, float] = (0.12, 0.22)
    exclude: tuple[str, ...] = ()
    fail_on: str = "off"
    fail_on_incomplete: bool = False


@dataclass(frozen=True)
class Engineered:
    """The default derived features."""

    log1p: tuple[str, ...] = ()
    ratios: tuple[tuple[str, str, str], ...] = ()  # (name, numerator, denominator)
    differences: tuple[tuple[str, str, str], ...] = ()
    eps: float = 1e-6

    @property
    def names(self) -> tuple[str, ...]:
        return (*(f"log1p_{c}" for c in self.log1p), *(r[0] for r in self.ratios), *(d[0] for d in self.differences))


@dataclass(frozen=True)
class Validation:
    mode: str = "holdout"  # holdout, kfold or time_series
    test_share: float = 0.2
    seed: int = 42
    splits: int = 5
    shuffle: bool = True


@dataclass(frozen=True)
class ModelDriftLimits:
    enabled: bool = False
    metric: str = "RMSE"
    warn_ratio: float = 1.1
    critical_ratio: float = 1.25
    fail_on: str = "off"


@dataclass(frozen=True)
class AutoSettings:
    min_rows: int = 8000
    missing_share: float = 0.4
    outlier_share: float = 0.3
    iqr_factor: float = 4.0
    default: str = "mlp"


@dataclass(frozen=True)
class Config:
    roles: Roles
    sources: tuple[str, ...] = ()
    store: str = "store"
    reports: str = "reports"
    batch_size: int = 32_768
    max_batches: int | None = None
    precision: int = 3
    quality: QualityLimits = field(default_factory=QualityLimits)
    rules: RuleSettings = field(default_factory=RuleSettings)
    drift: DriftLimits = field(default_factory=DriftLimits)
    engineered: Engineered = field(default_factory=Engineered)
    validation: Validation = field(default_factory=Validation)
    model_drift: ModelDriftLimits = field(default_factory=ModelDriftLimits)
    auto: AutoSettings = field(default_factory=AutoSettings)
    eda_rows: int = 30_000
    #: Rules are mined when none are there and on request; here, after every load.
    mine_each_load: bool = False


def _made(kind, values: dict | None):
    known = {f.name for f in fields(kind)}
    tupled = {k: tuple(map(lambda x: tuple(x) if isinstance(x, list) else x, v)) if isinstance(v, list) else v for k, v in (values or {}).items()}
    if extra := set(tupled) - known:
        raise ValueError(f"unknown settings for {kind.__name__}: {', '.join(sorted(extra))}")
    return kind(**tupled)


_BLOCKS = {
    "roles": Roles, "quality": QualityLimits, "rules": RuleSettings, "drift": DriftLimits, "engineered": Engineered,
    "validation": Validation, "model_drift": ModelDriftLimits, "auto": AutoSettings,
}


def from_dict(values: dict) -> Config:
    out = {k: _made(_BLOCKS[k], v) if k in _BLOCKS else (tuple(v) if isinstance(v, list) else v) for k, v in values.items()}
    return Config(**out)


def load_config(path: str) -> Config:
    """A configuration from a YAML file; relative paths are taken from the file's folder."""
    import yaml

    where = Path(path)
    config = from_dict(yaml.safe_load(where.read_text()))
    base = where.resolve().parent
    here = lambda p: p if "://" in p or Path(p).is_absolute() else str(base / p)
    return replace(config, sources=tuple(map(here, config.sources)), store=here(config.store), reports=here(config.reports))
