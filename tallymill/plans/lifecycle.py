"""The life of a dataset: load, judge, clean, train, validate, update."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.config import Config
from tallymill.functions import expr as E
from tallymill.operators import bins, drift, eda, models, monitor, prep, quality, rules, stats
from tallymill.sources import csv, store

#: What a reset removes besides the store; models, the drift reference and history stay.
REPORTS = ("loads", "numeric", "levels", "meta_state", "ids", "meta", "findings", "policy", "rules", "drift")


def _write_json(spark: SparkSession, value: object, path: str) -> None:
    spark.createDataFrame([(json.dumps(value, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_json(spark: SparkSession, path: str):
    return json.loads(spark.read.text(path).first()[0]) if store.exists(spark, path) else None


def add_data(spark: SparkSession, config: Config, paths: list[str], judge: bool = True, seq: int | None = None) -> None:
    """Load files into the store, with a state of statistics a load; judge quality and drift after.

    Rows and states of a load count once its mark is written, which comes last: what a
    crashed load left behind is never read, and the next one takes another number.
    """
    roles = config.roles
    store.init(spark, config.store)
    load = seq if seq is not None else int(store.open_store(spark, config.store).agg(F.coalesce(F.max("load_seq") + 1, F.lit(0))).first()[0])
    columns = csv.header_of(spark, paths[0])
    where = f"load_seq={load}"
    with csv.landed(spark, paths, columns) as scanned:  # the store and every state read what they need of it
        rows = csv.first_batches(scanned, config.batch_size, config.max_batches)
        store.append(store.to_events(rows, roles.datetime, roles.datetime_format, columns, load), config.store)
        stats.numeric_state(rows, [*roles.numeric, roles.target]).coalesce(1).write.mode("overwrite").parquet(f"{config.reports}/numeric/{where}")
        if roles.categorical:
            stats.level_counts(rows, list(roles.categorical)).write.mode("overwrite").parquet(f"{config.reports}/levels/{where}")
        date = E.parse_date(roles.datetime, roles.datetime_format, iso=False) if roles.datetime else None
        stats.meta_state(rows, list(roles.all), date).coalesce(1).write.mode("overwrite").parquet(f"{config.reports}/meta_state/{where}")
        if roles.id:
            stats.id_state(rows, roles.id).write.mode("overwrite").parquet(f"{config.reports}/ids/{where}")
    store.write_report(spark.createDataFrame([(load,)], "load long"), f"{config.reports}/loads", append_rows=True)
    if judge:
        refresh_quality(spark, config, mine=config.mine_each_load or not store.exists(spark, f"{config.reports}/rules"))
        check_drift(spark, config)


def loads(spark: SparkSession, config: Config) -> list[int] | None:
    """The numbers of finished loads; None where the store was filled without marks."""
    marks = store.read_report(spark, f"{config.reports}/loads", "load long")
    return None if marks is None else sorted(r["load"] for r in marks.distinct().collect())  # a row a load


def _state(spark: SparkSession, config: Config, name: str) -> DataFrame | None:
    """The states of finished loads under that name."""
    if not store.exists(spark, f"{config.reports}/{name}"):
        return None
    found, done = spark.read.parquet(f"{config.reports}/{name}"), loads(spark, config)
    return (found if done is None else found.where(F.col("load_seq").isin(done))).drop("load_seq")


def ensure_data(spark: SparkSession, config: Config) -> None:
    """Bootstrap an empty store from the configured files."""
    store.init(spark, config.store)
    if store.open_store(spark, config.store).isEmpty() and config.sources:
        add_data(spark, config, list(config.sources))


def current_state(spark: SparkSession, config: Config) -> tuple[DataFrame, DataFrame] | None:
    numeric, levels = _state(spark, config, "numeric"), _state(spark, config, "levels")
    if numeric is None:
        return None
    return stats.merge_numeric(numeric), stats.merge_levels(levels) if levels is not None else spark.createDataFrame([], "column string, level string, count long")


def source_rows(spark: SparkSession, config: Config, date_ge: str | None = None, date_le: str | None = None, shift_days: int = 0) -> DataFrame:
    """The store's payload columns within a date range."""
    wanted, done = [c for c in config.roles.all], loads(spark, config)
    events = store.open_store(spark, config.store)
    events = events if done is None else events.where(F.col("load_seq").isin(done))
    return store.decoded(store.in_range(events, date_ge, date_le, shift_days), wanted)


def refresh_quality(spark: SparkSession, config: Config, mine: bool = True) -> dict:
    """Findings, column policy, rules and the feature contract, written as reports.

    All but the rules come from the loads' states; only ``mine`` reads the store.
    """
    state = current_state(spark, config)
    if state is None:
        return {}
    roles, p = config.roles, config.precision
    numeric, levels = stats.numeric_report(state[0], p), stats.categorical_report(state[1], p)
    meta = stats.meta_report(stats.merge_meta(_state(spark, config, "meta_state")), _state(spark, config, "ids"), roles.id, p)
    store.write_report(quality.findings(numeric, levels, meta, roles, config.quality, p), f"{config.reports}/findings")
    store.write_report(meta, f"{config.reports}/meta")
    policy = quality.column_policy(numeric, levels, roles, config.quality)
    store.write_report(policy, f"{config.reports}/policy")
    if mine:
        _write_json(spark, mine_rules(config, source_rows(spark, config), state[1]), f"{config.reports}/rules")
    mined = _read_json(spark, f"{config.reports}/rules") or {"specs": []}
    summary = quality.cleaning_summary(config, policy, [s["name"] for s in mined["specs"]])
    _write_json(spark, summary, f"{config.reports}/contract")
    return summary


def mine_rules(config: Config, rows: DataFrame, levels: DataFrame) -> dict:
    """Edges, top levels, the rule report and feature specs: all that flags need later."""
    s, roles = config.rules, config.roles
    numbers = [*roles.numeric, *([] if s.exclude_target else [roles.target])]
    edges = bins.fit_edges(rows, numbers, s.bins, s.binning, config.precision) if numbers else {}
    top = bins.top_levels(levels, s.levels)
    categories = {c: top.get(c, []) for c in roles.categorical}
    transactions = bins.with_items(rows, edges, categories).select("items")
    slim, n = rules.compressed(transactions, s)
    if s.max_transactions is not None and n > s.max_transactions:
        slim, n = rules.sample(slim.withColumn("_key", F.xxhash64("items")), s, "_key").drop("_key"), s.max_transactions
    report = []
    if n:
        slim = slim.persist()
        sets = rules.frequent_sets(slim, n, s.min_support)
        report = rules.rule_report(rules.top_rules(rules.all_rules(sets, n, s.min_confidence), s), s, config.precision)
        slim.unpersist()
    return {"edges": edges, "categories": categories, "rules": report, "specs": rules.feature_specs(report, s)}


def check_drift(spark: SparkSession, config: Config) -> dict:
    """Compare with the frozen reference; the report is written before a policy can raise."""
    at = f"{config.reports}/drift_reference"
    reference = (spark.read.parquet(f"{at}/numeric"), spark.read.parquet(f"{at}/levels")) if store.exists(spark, at) else None
    report = drift.monitor(reference, current_state(spark, config), config.drift, config.roles.target)
    _write_json(spark, report, f"{config.reports}/drift")
    drift.enforce(report, config.drift)
    return report


def freeze_reference(spark: SparkSession, config: Config) -> None:
    state = current_state(spark, config)
    if state is None:
        raise ValueError("there are no statistics to freeze")
    for name, part in zip(("numeric", "levels"), state):
        part.write.mode("overwrite").parquet(f"{config.reports}/drift_reference/{name}")


def build_reference(spark: SparkSession, config: Config) -> None:
    """Load the configured files on their own, freeze their statistics, clear again."""
    clear(spark, config)
    add_data(spark, config, list(config.sources), judge=False)
    freeze_reference(spark, config)
    clear(spark, config)


def clear(spark: SparkSession, config: Config) -> list[str]:
    return store.reset(spark, config.store, *(f"{config.reports}/{r}" for r in (*REPORTS, "contract")))


def profile(spark: SparkSession, config: Config, path: str) -> str:
    rows = source_rows(spark, config)
    return eda.profile(eda.projection(rows, config.roles, config.eda_rows, ["event_date"] if "event_date" in rows.columns else []), config.roles, path)


def training_rows(spark: SparkSession, config: Config, path_csv: str | None, date_until: str | None) -> tuple[DataFrame, list[str], list[str]]:
    """(cleaned rows with flags, derived features, target and key; numeric names; categorical names)."""
    mined = _read_json(spark, f"{config.reports}/rules") or {"edges": {}, "categories": {}, "specs": []}
    roles, flagged = config.roles, []
    if path_csv:
        rows = csv.scan(spark, path_csv)
        rows = rows.where(E.all_of(~E.missing_in_csv(c) for c in (*roles.features, roles.target)))
    else:
        rows = source_rows(spark, config, date_le=date_until)
        contract = _read_json(spark, f"{config.reports}/contract")
        if contract:
            keep = lambda names: tuple(c for c in names if c in contract["kept"])
            roles = type(roles)(roles.target, roles.datetime, roles.datetime_format, roles.id, keep(roles.numeric), keep(roles.categorical), roles.drop)
    if mined["specs"]:
        rows = bins.with_items(rows, mined["edges"], mined["categories"], "_items")
        flagged = rules.flags(F.col("_items"), mined["specs"])
    raw = rows.select("*", *E.engineered(config.engineered), *flagged)
    raw = raw.where(quality.keep_row(roles)) if not path_csv else raw
    numeric = [*roles.numeric, *(s["name"] for s in mined["specs"]), *config.engineered.names]
    keyed = raw.withColumn("_key", F.xxhash64(*(E.col(c) for c in roles.all if c in raw.columns)))
    return keyed, numeric, list(roles.categorical)


def train(spark: SparkSession, config: Config, kind: str, bundle: str, path_csv: str | None = None, date_until: str | None = None, variants: list[str] = (), **options) -> dict:
    """Fit the named family (or ``auto``) and save a bundle; its metrics."""
    rows, numeric, categorical = training_rows(spark, config, path_csv, date_until)
    rows = rows.persist()
    if kind == "auto":
        kind = models.row_rates(rows, numeric, categorical, config.auto.iqr_factor).select(models.family(config.auto)).first()[0]
    target = E.scalar_target(config.roles.target)
    tried = {}
    variant = prep.resolve_variant(None, kind)
    if variants:
        variant, tried = models.sweep(rows, numeric, categorical, [prep.resolve_variant(v, kind) for v in variants], kind, target, "_key", config.validation, **options)
    p = prep.fit(rows, numeric, categorical, variant)
    data, names = models.matrix(rows, p, target, "_key")
    model, metrics = models.train(kind, data, names, config.validation, "_key", **options)
    models.save_bundle(spark, bundle, model, p, metrics)
    rows.unpersist()
    return {"kind": kind, "variant": variant, "metrics": metrics, "tried": tried}


def validate(spark: SparkSession, config: Config, bundle: str, path_csv: str | None = None, date_until: str | None = None) -> dict:
    """Metrics of a saved model on rows, and how they compare with its own."""
    model, p, saved = models.load_bundle(spark, bundle)
    rows, _, _ = training_rows(spark, config, path_csv, date_until)
    data, _ = models.matrix(rows, p, E.scalar_target(config.roles.target), "_key")
    metrics = models.evaluate(model, data)
    report = monitor.assess(spark, metrics, saved["metrics"], config.model_drift)
    monitor.record(spark, report, f"{config.reports}/model_history")
    monitor.enforce(report, config.model_drift)
    return {"metrics": metrics, "drift": report}


def update(spark: SparkSession, config: Config, bundle: str, new_bundle: str, path_csv: str | None = None, date_until: str | None = None) -> dict:
    """Go on training a saved model on rows; metrics are of the same rows."""
    model, p, _ = models.load_bundle(spark, bundle)
    rows, _, _ = training_rows(spark, config, path_csv, date_until)
    data, _ = models.matrix(rows, p, E.scalar_target(config.roles.target), "_key")
    data = data.persist()
    metrics = models.evaluate(model.update(data), data)
    models.save_bundle(spark, new_bundle, model, p, metrics, parent=bundle)
    data.unpersist()
    return metrics
