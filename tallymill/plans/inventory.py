"""Queries of sources, lifecycle, models and text labs, each beside its SQL.

Where a result is a fitted model, the query returns the properties that it must have
(orthonormal components, folds of even size, an error that never grows) for all rows,
and the SQL says what they are.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill import __main__ as cli
from tallymill import config as C
from tallymill.functions import expr as E
from tallymill.operators import bins, drift, eda, models, monitor, prep, quality, rules, stats, text
from tallymill.plans import lifecycle as life
from tallymill.plans import tabular as T
from tallymill.sources import csv, store
from tallymill.streaming import ingest

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(fn):
        QUERIES[name], ORACLE_SQL[name] = fn, sql
        return fn

    return keep


def _values(columns: str, *rows: tuple) -> str:
    """SQL of a small fixed table."""
    show = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else f"CAST({v} AS {'DOUBLE' if isinstance(v, float) else 'BIGINT'})"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) t({columns})"


# ---- a dataset's life, over lineitem as two files

_LIFE = C.Roles("l_extendedprice", "l_shipdate", "%d-%b-%y", "l_orderkey", ("l_quantity", "l_discount", "l_tax"), ("l_returnflag", "l_linestatus"))
_COLUMNS = ["l_orderkey", "l_linenumber", "l_shipdate", *T.NUMERIC, *T.CATEGORICAL]


def _life(spark: SparkSession, sf_dir: str, **settings) -> tuple[C.Config, str, str]:
    """(configuration, first folder, second folder): the dirty rows before and from T.CUT, each in as many files as tasks wrote."""
    folder = T.scratch(spark, "life")
    rows = T.dirty(spark, sf_dir).withColumn("_early", F.col("l_shipdate") < F.lit(T.CUT).cast("date")).withColumn("l_shipdate", F.date_format("l_shipdate", "dd-MMM-yy")).select(*_COLUMNS, "_early")
    paths = []
    for early in (True, False):
        paths.append(f"{folder}/{'early' if early else 'late'}")
        part = rows.where(F.col("_early") == early).drop("_early")
        part.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(paths[-1])
    config = C.Config(_LIFE, sources=(paths[0],), store=f"{folder}/store", reports=f"{folder}/reports", quality=T.LIMITS, **settings)
    return config, *paths


_EARLY = f"early AS (SELECT * FROM dirty WHERE l_shipdate < DATE '{T.CUT}')"


@query("store_create", _values("n_rows, columns", (0, "event_date,load_seq,loaded_at,raw_json,row_number,source_path")))
def store_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = T.scratch(spark, "store")
    store.init(spark, path)
    store.init(spark, path)
    events = store.open_store(spark, path)
    return events.agg(F.count("*").alias("n_rows")).withColumn("columns", F.lit(",".join(sorted(events.columns))))


@query("loader_facade", f"WITH {T.DIRTY_SQL}, {_EARLY} SELECT count(*) AS n, count(DISTINCT l_returnflag) AS n_levels FROM early WHERE l_quantity <> '' AND l_returnflag <> '' AND l_orderkey IS NOT NULL")
def loader_facade(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, early, _ = _life(spark, sf_dir)
    rows = csv.load(spark, early, C.Roles("l_orderkey", numeric=("l_quantity",), categorical=("l_returnflag",)))
    return rows.agg(F.count("*").alias("n"), F.count_distinct("l_returnflag").alias("n_levels"))


@query("bootstrap_store", f"WITH {T.DIRTY_SQL}, {_EARLY} SELECT count(*) AS n, CAST(1 AS BIGINT) AS n_loads, min(l_shipdate) AS first_day FROM early")
def bootstrap_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    config, _, _ = _life(spark, sf_dir)
    for _ in range(2):  # the second call finds data and loads nothing
        life.ensure_data(spark, config)
    return store.open_store(spark, config.store).agg(F.count("*").alias("n"), F.count_distinct("load_seq").alias("n_loads"), F.min("event_date").alias("first_day"))


@query("reset_store", _values("name, gone, left_there", ("store", True, False), ("reports/numeric", True, False), ("reports/drift_reference", False, True)))
def reset_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    config, early, _ = _life(spark, sf_dir)
    life.add_data(spark, config, [early], judge=False)
    life.freeze_reference(spark, config)
    gone = life.clear(spark, config)
    names = {"store": config.store, "reports/numeric": f"{config.reports}/numeric", "reports/drift_reference": f"{config.reports}/drift_reference"}
    return spark.createDataFrame([(n, p in gone, store.exists(spark, p)) for n, p in names.items()], "name string, gone boolean, left_there boolean")


@query("yaml_config", _values("setting, value", ("levels", "2"), ("max_transactions", "5000"), ("missing", "0.3"), ("sources", "1"), ("target", "y"), ("unknown", "refused")))
def yaml_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathlib import Path

    path = Path(tempfile.mkdtemp(prefix="tallymill-")) / "config.yaml"  # read by the driver alone
    path.write_text("roles: {target: y, numeric: [a]}\nsources: [x.csv]\nrules: {levels: 1, max_transactions: 10}\n")
    c = C.load_config(str(path))
    try:
        C.from_dict({"roles": {"target": "y", "no_such": 1}})
        refused = "taken"
    except ValueError:
        refused = "refused"
    found = {"target": c.roles.target, "levels": c.rules.levels, "max_transactions": c.rules.max_transactions, "missing": c.quality.missing, "sources": len(c.sources), "unknown": refused}
    return spark.createDataFrame([(k, str(v)) for k, v in found.items()], "setting string, value string")


@query("report_history", "SELECT metric, count(*) AS n, max(value) AS last FROM (VALUES ('RMSE', CAST(1.5 AS DOUBLE)), ('RMSE', 2.5)) t(metric, value) GROUP BY metric")
def report_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = T.scratch(spark, "history")
    for value in (1.5, 2.5):
        monitor.record(spark, {"metric": "RMSE", "current": value, "status": "ok"}, path)
    return store.read_report(spark, path, monitor.HISTORY).groupBy("metric").agg(F.count("*").alias("n"), F.max("value").alias("last"))


_CLEAN_SQL = (
    " AND ".join(f"TRY_CAST({c} AS DOUBLE) IS NOT NULL" for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice")) + " AND " + " AND ".join(f"coalesce(trim({c}), '') <> ''" for c in T.CATEGORICAL)
)


@query("cleaned_range", f"WITH {T.DIRTY_SQL}, {_EARLY} SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_extendedprice FROM early WHERE l_shipdate <= DATE '1996-12-31' AND {_CLEAN_SQL}")
def cleaned_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    config, early, _ = _life(spark, sf_dir)
    life.add_data(spark, config, [early], judge=False)
    return quality.clean_rows(life.source_rows(spark, config, date_le="1996-12-31"), config.roles).drop("l_shipdate")


@query("cleaned_after_refresh", f"WITH {T.DIRTY_SQL} SELECT count(*) AS n, count(*) FILTER (l_shipdate >= DATE '{T.CUT}') AS late FROM dirty WHERE {_CLEAN_SQL}")
def cleaned_after_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    config, early, late = _life(spark, sf_dir)
    for path in (early, late):
        life.add_data(spark, config, [path], judge=False)
    rows = quality.clean_rows(life.source_rows(spark, config), config.roles)
    day = E.parse_date("l_shipdate")
    return rows.agg(F.count("*").alias("n"), F.count_if(day >= F.lit(T.CUT).cast("date")).alias("late"))


@query(
    "meta_merge",
    f"WITH {T.DIRTY_SQL}, m AS ({T.META_SQL}) SELECT m.*, 'l_orderkey' AS id_column, {T.MONTHS_SQL}, true AS loaded FROM m",
)
def meta_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.dirty(spark, sf_dir)
    halves = [rows.where(f"l_shipdate < '{T.CUT}'"), rows.where(f"l_shipdate >= '{T.CUT}'")]
    state = stats.merge_meta(stats.meta_state(halves[0], T._TEXTS, F.col("l_shipdate")).unionByName(stats.meta_state(halves[1], T._TEXTS, F.col("l_shipdate"))))
    ids = stats.id_state(halves[0], "l_orderkey").unionByName(stats.id_state(halves[1], "l_orderkey"))
    out = stats.meta_report(state, ids, "l_orderkey")
    return out.withColumn("unique_months", F.array_join("unique_months", ",")).withColumn("loaded", F.col("loaded_at").isNotNull()).drop("loaded_at")


@query("unfinished_load", f"WITH {T.DIRTY_SQL}, {_EARLY} SELECT count(*) AS n, CAST(2 AS BIGINT) AS next_load, count(*) AS total_rows FROM early")
def unfinished_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a crashed load left in the store aren't read, and their number isn't used again."""
    config, early, late = _life(spark, sf_dir)
    life.add_data(spark, config, [early], judge=False)
    left = csv.scan(spark, late, csv.header_of(spark, late))
    store.append(store.to_events(left, config.roles.datetime, config.roles.datetime_format, left.columns, 1), config.store)
    after = store.open_store(spark, config.store).agg((F.max("load_seq") + 1).alias("next_load"))
    meta = stats.merge_meta(life._state(spark, config, "meta_state")).first()["total_rows"]
    return life.source_rows(spark, config).agg(F.count("*").alias("n")).withColumn("next_load", F.lit(after.first()[0])).withColumn("total_rows", F.lit(meta))


@query(
    "policy_summary",
    f"{T.POLICY_CTE} SELECT string_agg(\"column\", ',' ORDER BY \"column\") FILTER (reason = '') AS kept, string_agg(\"column\" || ':' || reason, ',' ORDER BY \"column\") FILTER (reason <> '') AS dropped FROM r",
)
def policy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.dirty(spark, sf_dir)
    numeric, levels = stats.numeric_report(stats.numeric_state(rows, T.NUMERIC)), stats.categorical_report(stats.level_counts(rows, T.CATEGORICAL))
    policy = quality.column_policy(numeric, levels, T.ROLES, T.LIMITS)
    out = quality.cleaning_summary(C.Config(T.ROLES), policy)
    return spark.createDataFrame([(",".join(sorted(out["kept"])) or None, ",".join(f"{k}:{v}" for k, v in sorted(out["dropped"].items())) or None)], "kept string, dropped string")


@query("feature_contract", _values("part, columns", ("numeric", "a,b,rule_0,log1p_a,ratio,gap"), ("categorical", "c"), ("features", "a,b,c"), ("all", "a,b,c,y,i,d,x")))
def feature_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = C.Roles("y", "d", id="i", numeric=("a", "b"), categorical=("c",), drop=("x",))
    made = quality.feature_contract(roles, ["rule_0"], C.Engineered(("a",), (("ratio", "a", "b"),), (("gap", "a", "b"),)))
    found = {**made, "features": roles.features, "all": roles.all}
    return spark.createDataFrame([(k, ",".join(v)) for k, v in found.items()], "part string, columns string")


@query("eda_projection", f"WITH {T.DIRTY_SQL} SELECT TRY_CAST(l_quantity AS DOUBLE) AS l_quantity, l_returnflag, TRY_CAST(l_extendedprice AS DOUBLE) AS l_extendedprice, l_shipdate FROM dirty ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice NULLS FIRST, l_quantity NULLS FIRST LIMIT 500")
def eda_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = C.Roles("l_extendedprice", "l_shipdate", numeric=("l_quantity",), categorical=("l_returnflag",))
    return eda.projection(T.dirty(spark, sf_dir), roles, 500, ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"])


@query(
    "ordered_scan",
    "SELECT event_id, CAST(ts AS DATE) AS event_date, row_number() OVER (ORDER BY CAST(ts AS DATE), event_id) - 1 AS place FROM events",
)
def ordered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table in date order: a global sort; each row's place comes from its partition's."""
    events = T.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("date").alias("event_date"))
    ordered = store.checkpointed(store.ordered(events, "event_id").withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    counts = {r["_p"]: r["n"] for r in ordered.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # a row a partition
    starts, at = [], 0
    for p in sorted(counts):
        starts.append((p, at))
        at += counts[p]
    table = spark.createDataFrame(starts, "_p int, _start long")
    within = F.col("_i") - F.shiftleft(F.col("_p").cast("long"), 33)
    return ordered.join(F.broadcast(table), "_p").select("event_id", "event_date", (F.col("_start") + within).alias("place"))


# ---- rules and bins


@query("transaction_sample", "SELECT least(count(*), 5000) AS n, true AS repeats FROM lineitem")
def transaction_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "lineitem").select(F.xxhash64("*").alias("key"))
    settings = C.RuleSettings(max_transactions=10)  # under the least allowed, 5000
    a, b = (rules.sample(rows, settings, "key") for _ in range(2))
    n = a.count()
    return spark.createDataFrame([(n, a.exceptAll(b).isEmpty())], "n long, repeats boolean")


@query("capped_edges", "SELECT 7 AS n_edges, true AS ascending, true AS inside FROM (SELECT 1)")
def capped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = T.table(spark, sf_dir, "lineitem")
    edges = bins.fit_edges(li, ["l_extendedprice"], 6, cap=2000)["l_extendedprice"]
    low, high = li.agg(F.min("l_extendedprice"), F.max("l_extendedprice")).first()
    return spark.createDataFrame([(len(edges), edges == sorted(set(edges)), low <= edges[0] + 0.001 and edges[-1] <= high + 0.001)], "n_edges int, ascending boolean, inside boolean")


@query(
    "rule_report",
    f"{T.RULES_SQL} SELECT CAST(row_number() OVER (ORDER BY lift DESC, confidence DESC, antecedent, consequent) - 1 AS BIGINT) AS place, antecedent || ' -> ' || consequent AS rule, round(support, 3) AS support, "
    "round(confidence, 3) AS confidence, round(lift, 3) AS lift, CASE WHEN confidence > 0.8 THEN 'strong' WHEN lift > 1.2 THEN 'interesting' END AS insight "
    "FROM (SELECT * FROM r WHERE lift >= 1.05 ORDER BY lift DESC, confidence DESC, antecedent, consequent LIMIT 5)",
)
def rule_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets, n = T._sets(spark, sf_dir)
    report = rules.rule_report(rules.top_rules(rules.all_rules(sets, n, T.SETTINGS.min_confidence), T.SETTINGS), T.SETTINGS)
    rows = [(i, r["rule"], r["support"], r["confidence"], r["lift"], r["insight"]) for i, r in enumerate(report)]
    return spark.createDataFrame(rows, "place long, rule string, support double, confidence double, lift double, insight string")


@query("rule_specs_cut", _values("name, antecedent", ("rule_0", "a + b"), ("rule_1", "a")))
def rule_specs_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spark.createDataFrame([(["a", "b"], ["c"], 3.0), (["a"], ["c"], 2.0), (["b"], ["c"], 1.5)], "antecedent array<string>, consequent array<string>, lift double")
    found = found.withColumns({"count": F.lit(5), "support": F.lit(0.5), "confidence": F.lit(0.9)})
    settings = C.RuleSettings(max_features=2)
    specs = rules.feature_specs(rules.rule_report(rules.top_rules(found, settings), settings), settings)
    return spark.createDataFrame([(s["name"], " + ".join(s["antecedent"])) for s in specs], "name string, antecedent string")


@query("mining_guard", _values("refused, levels, max_transactions", (True, 2, 5000)))
def mining_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = C.RuleSettings(levels=1, max_items=3, min_support=0.0001, max_transactions=1)
    rows = T.table(spark, sf_dir, "part").select(F.array("p_brand").alias("items"))
    try:
        rules.compressed(rows, settings)
        refused = False
    except ValueError:
        refused = True
    return spark.createDataFrame([(refused, settings.levels, settings.max_transactions)], "refused boolean, levels long, max_transactions long")


_LEVEL_ITEMS = " UNION ALL ".join(f"SELECT '{c} = ' || trim({c}) AS item FROM early WHERE coalesce({c}, '') <> '' AND trim({c}) <> ''" for c in T.CATEGORICAL)


@query("saved_rules_reread", f"WITH {T.DIRTY_SQL}, {_EARLY} SELECT item, count(*) AS count FROM ({_LEVEL_ITEMS}) GROUP BY item")
def saved_rules_reread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges and levels as the lifecycle wrote them, applied to the rows again; its numbers' bins are seen to by ``transactions``."""
    config, early, _ = _life(spark, sf_dir)
    life.add_data(spark, config, [early])
    saved = life._read_json(spark, f"{config.reports}/rules")
    items = bins.with_items(life.source_rows(spark, config), saved["edges"], saved["categories"])
    each = items.select(F.explode("items").alias("item")).where(F.col("item").contains(" = ") & ~F.col("item").endswith("= ") & ~F.col("item").endswith("__OTHER__"))
    return each.groupBy("item").agg(F.count("*").alias("count"))


@query("csv_flags", f"WITH {T.DIRTY_SQL}, {_EARLY} SELECT count(*) AS n, count(*) FILTER (trim(l_returnflag) = 'R') AS flagged FROM early WHERE " + " AND ".join(f"coalesce({c}, '') <> ''" for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_returnflag", "l_linestatus")))
def csv_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    config, early, _ = _life(spark, sf_dir)
    mined = {"edges": {}, "categories": {"l_returnflag": ["R", "N", "A"]}, "specs": [{"name": "rule_0", "antecedent": ["l_returnflag = R"]}], "rules": []}
    life._write_json(spark, mined, f"{config.reports}/rules")
    rows, numeric, _ = life.training_rows(spark, config, early, None)
    return rows.agg(F.count("*").alias("n"), F.sum("rule_0").alias("flagged"))


@query("dataset_builder", f"WITH {T.DIRTY_SQL}, {_EARLY} SELECT count(*) AS n, 'l_quantity,l_discount,l_tax,log1p_l_quantity' AS numeric, 'l_returnflag,l_linestatus' AS categorical, round(sum(ln(1 + TRY_CAST(l_quantity AS DOUBLE))), 2) AS log1p_sum FROM early WHERE {_CLEAN_SQL}")
def dataset_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    config, early, _ = _life(spark, sf_dir, engineered=C.Engineered(log1p=("l_quantity",)))
    life.add_data(spark, config, [early], judge=False)
    rows, numeric, categorical = life.training_rows(spark, config, None, "1998-12-31")
    return rows.agg(F.count("*").alias("n"), F.lit(",".join(numeric)).alias("numeric"), F.lit(",".join(categorical)).alias("categorical"), F.round(F.sum("log1p_l_quantity"), 2).alias("log1p_sum"))


@query("engineered_matrix", f"WITH {T.DIRTY_SQL} SELECT count(*) AS n, 'l_orderkey,twice' AS columns, round(sum(CAST(l_orderkey AS DOUBLE) - CAST(l_linenumber AS DOUBLE)), 0) AS total FROM dirty")
def engineered_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived features, then the columns whose every cell is a number."""
    rows = T.dirty(spark, sf_dir).select("l_orderkey", "l_quantity", "l_returnflag", *E.engineered(C.Engineered(differences=(("twice", "l_orderkey", "l_linenumber"),))))
    kept = prep.numeric_only(rows, rows.columns)
    return rows.agg(F.count("*").alias("n"), F.lit(",".join(kept)).alias("columns"), F.round(F.sum("twice"), 0).alias("total"))


# ---- reports and drift


@query(
    "default_limits",
    _values("name, value", ("missing", 0.3), ("nonvalid", 0.2), ("zero_warn", 0.95), ("cv_warn", 80.0), ("dominance_warn", 0.995), ("min_support", 0.14), ("min_confidence", 0.5), ("min_lift", 1.05), ("top_k", 5.0), ("bins", 6.0), ("max_items", 2500.0)),
)
def default_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, r = C.QualityLimits(), C.RuleSettings()
    found = {k: getattr(q, k) for k in ("missing", "nonvalid", "zero_warn", "cv_warn", "dominance_warn")} | {k: getattr(r, k) for k in ("min_support", "min_confidence", "min_lift", "top_k", "bins", "max_items")}
    return spark.createDataFrame([(k, float(v)) for k, v in found.items()], "name string, value double")


@query("lifecycle_report", f"WITH {T.DIRTY_SQL} SELECT count(*) AS total_rows, 'l_discount,l_linestatus,l_quantity,l_returnflag' AS kept, true AS findings, true AS rules FROM dirty")
def lifecycle_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    config, early, late = _life(spark, sf_dir)
    config = C.Config(**(vars(config) | {"quality": C.QualityLimits()}))
    for path in (early, late):
        life.add_data(spark, config, [path])
    contract = life._read_json(spark, f"{config.reports}/contract")
    meta = store.read_report(spark, f"{config.reports}/meta", "total_rows long")
    findings = store.read_report(spark, f"{config.reports}/findings", "check string")
    return meta.select("total_rows", F.lit(",".join(sorted(contract["kept"]))).alias("kept"), F.lit(not findings.isEmpty()).alias("findings"), F.lit(store.exists(spark, f"{config.reports}/rules")).alias("rules"))


_MONITOR_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(abs(mb - ma) / greatest(sa, 1e-9), 6) AS mean_shift_sigmas FROM (SELECT round(avg(TRY_CAST({c} AS DOUBLE)), 3) AS ma, round(stddev_samp(TRY_CAST({c} AS DOUBLE)), 3) AS sa FROM early), "
    f"(SELECT round(avg(TRY_CAST({c} AS DOUBLE)), 3) AS mb FROM dirty)"
    for c in ("l_quantity", "l_discount", "l_tax")
)


@query("drift_against_reference", f"WITH {T.DIRTY_SQL}, {_EARLY} {_MONITOR_SQL}")
def drift_against_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference frozen from the first file, then both files loaded; the target isn't judged."""
    config, early, late = _life(spark, sf_dir)
    life.build_reference(spark, config)
    for path in (early, late):
        life.add_data(spark, config, [path], judge=False)
    report = life.check_drift(spark, config)
    return spark.createDataFrame([(r["column"], float(r["mean_shift_sigmas"])) for r in report["numeric"]], "column string, mean_shift_sigmas double")


@query(
    "drift_actions",
    _values(
        "status, place, action", ("critical", 0, "retrain or recalibrate: the distribution shifted strongly"), ("critical", 1, "refresh statistics and rules"), ("critical", 2, "retrain without or repair n"),
        ("no_current", 0, "load data: there are no current statistics"), ("no_reference", 0, "freeze a reference from trusted data"), ("ok", 0, "none: within tolerance"),
        ("warn", 0, "review features and segments: the distribution shifted"), ("warn", 1, "review the encoding of levels"), ("warn", 2, "watch c"),
    ),
)
def drift_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = {"no_reference": ([], []), "no_current": ([], []), "ok": ([], []), "critical": ([{"column": "n", "severity": "critical"}], []), "warn": ([], [{"column": "c", "severity": "warn"}])}
    return spark.createDataFrame([(s, i, a) for s, parts in cases.items() for i, a in enumerate(drift.actions(s, *parts))], "status string, place long, action string")


@query("drift_policy", _values("fail_on, status, raised", ("critical", "critical", True), ("critical", "warn", False), ("off", "critical", False), ("warn", "no_reference", True), ("warn", "warn", True)))
def drift_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    def raised(fail_on: str, status: str) -> bool:
        try:
            drift.enforce({"status": status}, C.DriftLimits(fail_on=fail_on, fail_on_incomplete=True))
        except drift.DataDriftPolicyError:
            return True
        return False

    cases = [("off", "critical"), ("warn", "warn"), ("critical", "warn"), ("critical", "critical"), ("warn", "no_reference")]
    return spark.createDataFrame([(f, s, raised(f, s)) for f, s in cases], "fail_on string, status string, raised boolean")


@query("stream_after_hook", "SELECT count(*) AS n, true AS called_after_each_batch FROM events")
def stream_after_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy that runs after each load sees that load's state."""
    folder, seen = T.scratch(spark, "stream"), []
    stream = spark.readStream.schema(T.table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    ingest.ingest(stream, folder, ["value"], ["event_type"], after=lambda s, f: seen.append(ingest.numeric_state(s, f).first()["count"])).awaitTermination()
    return spark.read.parquet(f"{folder}/rows").agg(F.count("*").alias("n")).withColumn("called_after_each_batch", F.lit(len(seen) >= 1 and seen[-1] > 0))


# ---- preparation and models


@query("variant_names", _values("asked, family, variant", (None, "mlp", "mlp_ohe"), (None, "tree", "tree"), ("mean", "tree", "tree_mean"), ("mlp_ohe", "tree", "tree"), ("nothing", "tree", "refused"), ("ordinal", "mlp", "mlp_ordinal")))
def variant_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    def resolved(name, family):
        try:
            return prep.resolve_variant(name, family)
        except ValueError:
            return "refused"

    cases = [(None, "tree"), (None, "mlp"), ("mean", "tree"), ("ordinal", "mlp"), ("mlp_ohe", "tree"), ("nothing", "tree")]
    return spark.createDataFrame([(n, f, resolved(n, f)) for n, f in cases], "asked string, family string, variant string")


@query("preprocessor_saved", f"SELECT {T._KEY_SQL}, round((l_quantity - m) / s, 6) AS l_quantity, CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS BIGINT) AS l_returnflag FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem)")
def preprocessor_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("long"))
    again = prep.Preprocessor(**prep.fit(rows, ["l_quantity"], ["l_returnflag"], "mlp_ordinal").to_dict())
    return again.transform(rows, T.KEY).withColumn("l_quantity", F.round("l_quantity", 6))


_BRANDS = "(SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS r FROM part GROUP BY p_brand)"


@query("onehot_rare_levels", f"SELECT p_partkey, CAST(sum(CASE WHEN r <= 9 THEN 1 ELSE 0 END) AS DOUBLE) AS own, CAST(sum(CASE WHEN r > 9 THEN 1 ELSE 0 END) AS DOUBLE) AS tail FROM part JOIN {_BRANDS} USING (p_brand) GROUP BY p_partkey")
def onehot_rare_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 levels in ten indicators: nine levels of their own, one for the others together."""
    rows = T.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    p = prep.fit(rows, [], ["p_brand"], "mlp_ohe", max_levels=10)
    out = p.transform(rows, ["p_partkey"])
    own = [c for c in out.columns if c.startswith("p_brand=")]
    return out.select("p_partkey", sum((F.col(f"`{c}`") for c in own), F.lit(0.0)).alias("own"), F.col(f"`p_brand:{prep.OTHER}`").alias("tail"))


@query("ordinal_many_levels", "SELECT c_custkey, row_number() OVER (ORDER BY c_name) - 1 AS code FROM customer")
def ordinal_many_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return prep.fit(rows, [], ["c_name"]).transform(rows, ["c_custkey"]).withColumnRenamed("c_name", "code")


@query("holdout_split", "SELECT count(*) AS n, true AS disjoint, true AS near_share, true AS repeats FROM lineitem")
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, _ = T._model_rows(spark, sf_dir)
    twice = rows.select(models.holdout("_key", 0.2).alias("a"), models.holdout("_key", 0.2).alias("b"), models.holdout("_key", 0.2, 7).alias("other"))
    share = F.avg(F.col("a").cast("double"))
    return twice.agg(F.count("*").alias("n"), (F.count_if(F.col("a")) + F.count_if(~F.col("a")) == F.count("*")).alias("disjoint"), (F.abs(share - 0.2) < 0.02).alias("near_share"), F.every(F.col("a") == F.col("b")).alias("repeats"))


@query("residual_variance", "SELECT count(*) AS n, true AS as_measured, true AS mean_restored FROM lineitem")
def residual_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted model's residual variance in log space is that of its own residuals, and moves predictions by half of it."""
    rows, numeric, categorical = T._model_rows(spark, sf_dir)
    data, names = models.matrix(rows, prep.fit(rows, numeric, categorical, "tree"), F.expr(T._TARGET_SQL), "_key")
    data = store.checkpointed(data)
    model = models.TreeModel(iterations=3, depth=3).fit(data, names)
    both = model.predict(model.predict_log(data).withColumnRenamed("_log", "log"))
    gap = F.log1p("y") - F.col("log")
    moved = F.max(F.abs(F.col("p") - F.expm1(F.col("log") + F.lit(model.residual_variance / 2))))
    return both.agg(F.count("*").alias("n"), (F.abs(F.var_pop(gap) - F.lit(model.residual_variance)) < 1e-6).alias("as_measured"), (moved < 1e-6).alias("mean_restored"))


def _fit_for(spark: SparkSession, sf_dir: str, kind: str, **options):
    """(model, metrics, data, what the best constant on the log scale gives): the error that a fit has to beat."""
    rows, numeric, categorical = T._model_rows(spark, sf_dir)
    data, names = models.matrix(rows, prep.fit(rows, numeric, categorical, prep.FAMILY_DEFAULT[kind]), F.expr(T._TARGET_SQL), "_key")
    data = store.checkpointed(data)
    model, metrics = models.train(kind, data, names, C.Validation(), "_key", **options)
    test = models.holdout("_key", 0.2, 42)
    flat = data.where(test).agg(F.stddev_pop(F.log1p("y"))).first()[0]
    return model, metrics, data, flat


_FIT_SQL = "SELECT '{m}' AS model, count(*) AS n, true AS every_row_once, true AS beats_constant FROM lineitem"


def _fit_frame(spark: SparkSession, name: str, metrics: dict, data: DataFrame, flat: float) -> DataFrame:
    n = data.count()
    train = data.where(~models.holdout("_key", 0.2, 42)).count()
    return spark.createDataFrame([(name, n, train + metrics["n"] == n, metrics["rmsle"] < flat)], "model string, n long, every_row_once boolean, beats_constant boolean")


@query("train_gbt", _FIT_SQL.format(m="tree"))
def train_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, metrics, data, flat = _fit_for(spark, sf_dir, "tree")
    return _fit_frame(spark, "tree", metrics, data, flat)


@query("train_mlp", _FIT_SQL.format(m="mlp"))
def train_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, metrics, data, flat = _fit_for(spark, sf_dir, "mlp")
    return _fit_frame(spark, "mlp", metrics, data, flat)


@query("update_gbt", "SELECT count(*) AS n, CAST(2 AS BIGINT) AS n_stages, true AS no_worse FROM lineitem")
def update_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _, data, _ = _fit_for(spark, sf_dir, "tree", iterations=5)
    before = model.residual_variance
    after = models.evaluate(model.update(data), data)
    return spark.createDataFrame([(after["n"], len(model.stages), model.residual_variance <= before * 1.001)], "n long, n_stages long, no_worse boolean")


@query("variant_sweep", _values("model, chosen_is_best", ("tree", True), ("tree_mean", True)))
def variant_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, numeric, categorical = T._model_rows(spark, sf_dir)
    best, tried = models.sweep(rows, numeric, categorical, ["tree", "tree_mean"], "tree", F.expr(T._TARGET_SQL), "_key", C.Validation(), iterations=5)
    return spark.createDataFrame([(n, tried[best]["rmse"] <= m["rmse"]) for n, m in tried.items()], "model string, chosen_is_best boolean")


@query("bundle_reread", "SELECT count(*) AS n, true AS same_predictions, 'tree' AS kind FROM lineitem")
def bundle_reread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, numeric, categorical = T._model_rows(spark, sf_dir)
    p = prep.fit(rows, numeric, categorical, "tree")
    data, names = models.matrix(rows, p, F.expr(T._TARGET_SQL), "_key")
    data = store.checkpointed(data)
    model = models.TreeModel(iterations=3, depth=3).fit(data, names)
    path = T.scratch(spark, "bundle")
    models.save_bundle(spark, path, model, p, {"rmse": 1.0})
    again, _, bundle = models.load_bundle(spark, path)
    both = again.predict(model.predict(data).withColumnRenamed("p", "before"))
    return both.agg(F.count("*").alias("n"), (F.max(F.abs(F.col("p") - F.col("before"))) < 1e-9).alias("same_predictions"), F.lit(bundle["model"]["kind"]).alias("kind"))


@query("train_and_validate", f"WITH {T.DIRTY_SQL}, {_EARLY} SELECT 'tree' AS kind, count(*) AS n, 'RMSE' AS metric, true AS recorded FROM early WHERE {_CLEAN_SQL}")
def train_and_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    config, early, _ = _life(spark, sf_dir)
    life.add_data(spark, config, [early], judge=False)
    path = f"{config.store}-model"
    made = life.train(spark, config, "tree", path, date_until="1998-12-31", iterations=3, depth=3)
    out = life.validate(spark, config, path, date_until="1998-12-31")
    history = store.read_report(spark, f"{config.reports}/model_history", monitor.HISTORY)
    return spark.createDataFrame([(made["kind"], out["metrics"]["n"], out["drift"]["metric"], history is not None and history.count() == 1)], "kind string, n long, metric string, recorded boolean")


@query("command_line", _values("options, taken", ("--clear", True), ("--clear --mode train", False), ("--mode add_data", False), ("--mode train --new tree --date-until 2016-12-31", True), ("--mode train --new tree", False), ("--mode val --old m --path-csv x", True), ("--mode update --path-csv x", False)))
def command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    def taken(options: str) -> bool:
        try:
            cli.checked(cli.parser().parse_args(options.split()))
        except SystemExit:
            return False
        return True

    cases = ["--clear", "--clear --mode train", "--mode add_data", "--mode train --new tree --date-until 2016-12-31", "--mode train --new tree", "--mode val --old m --path-csv x", "--mode update --path-csv x"]
    return spark.createDataFrame([(o, taken(o)) for o in cases], "options string, taken boolean")


@query("profiled_run", "SELECT count(*) AS result, true AS pages, CAST(2 AS BIGINT) AS runs FROM nation")
def profiled_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pathlib import Path

    folder = Path(tempfile.mkdtemp(prefix="tallymill-"))  # the driver's own pages
    for _ in range(2):
        result, report = monitor.profiled(lambda: T.table(spark, sf_dir, "nation").count(), str(folder), "count", spark)
    pages = len(list(folder.glob("*/time.html"))) == len(list(folder.glob("*/memory.html"))) == 2 and report["python_peak_mb"] > 0 and report["jvm_used_mb"] > 0
    return spark.createDataFrame([(result, pages, len((folder / "manifest.jsonl").read_text().splitlines()))], "result long, pages boolean, runs long")


@query("profile_frames", "SELECT 'profile' AS name, CAST(4 AS BIGINT) AS sections")
def profile_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "lineitem").select(*T.NUMERIC, *T.CATEGORICAL)
    html = eda.profile(rows, C.Roles("l_extendedprice", numeric=("l_quantity", "l_discount", "l_tax"), categorical=tuple(T.CATEGORICAL)))
    return spark.createDataFrame([("profile", html.count("<h2>"))], "name string, sections long")


# ---- text labs


@query("pca_components", "SELECT count(*) AS n, CAST(3 AS BIGINT) AS k, true AS uncorrelated, true AS descending FROM embeddings")
def pca_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    made = text.principal_components(T._vectors(spark, sf_dir), 3).select(vector_to_array("components").alias("c"))
    c = made.select(F.size("c").cast("long").alias("k"), *(F.get("c", F.lit(i)).alias(f"c{i}") for i in range(3)))
    apart = [F.abs(F.corr(f"c{i}", f"c{j}")) < 1e-6 for i in range(3) for j in range(i)]
    falls = (F.var_pop("c0") >= F.var_pop("c1")) & (F.var_pop("c1") >= F.var_pop("c2"))
    return c.agg(F.count("*").alias("n"), F.max("k").alias("k"), (apart[0] & apart[1] & apart[2]).alias("uncorrelated"), falls.alias("descending"))


@query("svd_values", "SELECT round(sum(x * x), 1) AS squares, max(n) AS dimensions FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS x, len(embedding) AS n FROM embeddings)")
def svd_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All singular values: their squares add up to those of the cells."""
    rows = T._vectors(spark, sf_dir)
    size = T.table(spark, sf_dir, "embeddings").select(F.size("embedding")).first()[0]
    values, _ = text.truncated_svd(rows, size)
    return spark.createDataFrame([(float((values**2).sum()), len(values))], "squares double, dimensions long").withColumn("squares", F.round("squares", 1))


@query("nmf_topics", "SELECT count(*) AS n_docs, CAST(50 AS BIGINT) AS n_topics, true AS non_negative, true AS error_never_grows FROM documents")
def nmf_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.table(spark, sf_dir, "documents")
    weights = text.tfidf(docs, max_features=8000, min_df=2, max_df=0.95)
    topics, made = text.factorised(weights, docs.select("doc_id"), 50, rounds=6)
    falls = all(b <= a * (1 + 1e-6) for a, b in zip(made.errors, made.errors[1:]))
    least = F.min(F.array_min("topics"))
    return topics.agg(F.count("*").alias("n_docs"), F.max(F.size("topics")).cast("long").alias("n_topics"), (least >= 0).alias("non_negative"), F.lit(falls).alias("error_never_grows"))


@query("stratified_folds", "SELECT quality AS label, count(*) AS n, CAST(5 AS BIGINT) AS n_folds, true AS even FROM labels GROUP BY quality")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = text.stratified(T.table(spark, sf_dir, "labels"), "quality", "doc_id", 5, rows=50)
    sizes = folds.groupBy("quality", "fold").agg(F.count("*").alias("n"))
    return sizes.groupBy(F.col("quality").alias("label")).agg(F.sum("n").alias("n"), F.count("*").alias("n_folds"), (F.max("n") - F.min("n") <= 1).alias("even"))


@query("classifier_cv", "SELECT m AS model, (SELECT count(*) FROM embeddings) AS n, CAST(5 AS BIGINT) AS n_folds, true AS in_range FROM (VALUES ('lr'), ('rf')) t(m)")
def classifier_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, out = T._vectors(spark, sf_dir), None
    for name in ("lr", "rf"):
        scores = text.cross_validated(rows, name, 5, key="vec_id").withColumn("model", F.lit(name))
        out = scores if out is None else out.unionByName(scores)
    inside = F.every(F.col("accuracy").between(0, 1) & F.col("weighted_f1").between(0, 1))
    return out.groupBy("model").agg(F.sum("n").alias("n"), F.count_distinct("fold").alias("n_folds"), inside.alias("in_range"))


@query("text_timing", "SELECT s AS step, (SELECT count(*) FROM labels) AS rows, true AS measured FROM (VALUES ('vectorizer fit'), ('vectorizer transform'), ('classifier fit'), ('classifier predict')) t(s)")
def text_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "documents").join(T.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    return text.measured(rows).select("step", "rows", ((F.col("seconds") > 0) & (F.col("driver_peak_mb") > 0)).alias("measured"))


@query("frequent_sets_of_four", "SELECT 'a + b + c + d' AS itemset, CAST(4 AS BIGINT) AS size, count(*) FILTER (n_nationkey % 2 = 0) AS count FROM nation")
def frequent_sets_of_four(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set of four items, which the lineitem view has none of at its support."""
    rows = T.table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, F.array(*map(F.lit, "abcd"))).otherwise(F.array(F.lit("a"), F.lit("e"))).alias("items"))
    slim, n = rules.compressed(rows, C.RuleSettings())
    sets = rules.frequent_sets(slim, n, 0.3).where("size = 4")
    return sets.select(F.array_join("items", " + ").alias("itemset"), "size", "count")


_FOUR = "(SELECT count(*) FILTER (n_nationkey % 2 = 0) / count(*) AS s FROM nation)"


@query("rules_of_four", f"SELECT CAST(50 AS BIGINT) AS n_rules, CAST(14 AS BIGINT) AS from_four, round(s, 6) AS least_confidence FROM {_FOUR}")
def rules_of_four(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every split of every set: 14 of the one of four, 24 of the four of three, 12 of the six of two."""
    rows = T.table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, F.array(*map(F.lit, "abcd"))).otherwise(F.array(F.lit("a"), F.lit("e"))).alias("items"))
    slim, n = rules.compressed(rows, C.RuleSettings())
    made = rules.all_rules(rules.frequent_sets(slim, n, 0.5), n, 0.5)
    four = F.count_if(F.size("antecedent") + F.size("consequent") == 4)
    return made.agg(F.count("*").alias("n_rules"), four.alias("from_four"), F.round(F.min("confidence"), 6).alias("least_confidence"))
