"""The tabular engine's queries on the driver's tables, each beside its SQL.

``dirty`` is lineitem as text with cells spoilt by rule (missing, not a number,
blank), the same in both engines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymill.config import AutoSettings, DriftLimits, ModelDriftLimits, QualityLimits, Roles, RuleSettings, Validation
from tallymill.functions import expr as E
from tallymill.operators import bins, drift, eda, models, monitor, prep, quality, rules, stats, text
from tallymill.sources import csv, store
from tallymill.streaming import ingest

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CATEGORICAL = ["l_returnflag", "l_linestatus"]
ROLES = Roles("l_extendedprice", "l_shipdate", "%Y-%m-%d", "l_orderkey", ("l_quantity", "l_discount", "l_tax"), ("l_returnflag", "l_linestatus"))
LIMITS = QualityLimits(nonvalid=0.05, dominance_warn=0.45, cv_warn=0.5, row_missing=0.1, id_uniqueness=0.9, zero_warn=0.04)
CUT = "1998-06-01"
KEY = ["l_orderkey", "l_linenumber"]


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A folder for what a query writes: the cluster's shared one, a temporary one in tests."""
    return f"{store.shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _spoilt(c: str, more: str = "") -> str:
    h = "(l_orderkey * 7 + l_linenumber)"
    return (
        f"CASE {more.format(h=h)} WHEN {h} % 17 = 0 THEN '' WHEN {h} % 19 = 0 THEN NULL WHEN {h} % 23 = 0 THEN 'n/a' "
        f"WHEN {h} % 29 = 0 THEN '  ' WHEN {h} % 31 = 0 THEN '1d' ELSE CAST({c} AS STRING) END AS {c}"
    )


_DIRTY_COLUMNS = [
    "l_orderkey", "l_linenumber", "CAST(l_shipdate AS DATE) AS l_shipdate", _spoilt("l_quantity"), _spoilt("l_extendedprice"), _spoilt("l_discount"),
    _spoilt("l_tax", "WHEN {h} % 5 < 2 THEN ''"), _spoilt("l_returnflag"), _spoilt("l_linestatus"),
]
DIRTY_SQL = f"dirty AS (SELECT {', '.join(_DIRTY_COLUMNS)} FROM lineitem)"


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*_DIRTY_COLUMNS)


# ---- sources


@query(
    "csv_scan_roundtrip",
    "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_quantity AS STRING) AS l_quantity, l_returnflag, "
    "l_returnflag || ',\"' || l_linestatus || '\"' AS quoted FROM lineitem",
)
def csv_scan_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "csv")
    li = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "CAST(l_quantity AS STRING) AS l_quantity", "l_returnflag", "concat(l_returnflag, ',\"', l_linestatus, '\"') AS quoted"
    )
    li.write.option("header", True).option("escape", '"').csv(path)
    back = csv.scan(spark, path, li.columns)
    return back.select(F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("long"), "l_quantity", "l_returnflag", "quoted")


@query(
    "csv_row_numbers",
    "SELECT CAST(1 AS BIGINT) AS first_row, count(*) AS last_row, count(*) AS n_rows, count(*) AS n_distinct FROM nation",
)
def csv_row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "csv")
    table(spark, sf_dir, "nation").coalesce(1).write.option("header", True).csv(path)
    rows = csv.scan(spark, path)
    return rows.agg(F.min("row_number").alias("first_row"), F.max("row_number").alias("last_row"), F.count("*").alias("n_rows"), F.count_distinct("row_number").alias("n_distinct"))


@query(
    "csv_training_rows",
    f"WITH {DIRTY_SQL} SELECT l_quantity, l_returnflag, CAST(l_orderkey AS FLOAT) AS y FROM dirty WHERE coalesce(l_quantity, '') <> '' AND coalesce(l_returnflag, '') <> ''",
)
def csv_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "csv")
    rows = dirty(spark, sf_dir).select("l_quantity", "l_returnflag", F.col("l_orderkey").cast("string").alias("y"))
    rows.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return csv.load_training(spark, path, Roles("y", numeric=("l_quantity",), categorical=("l_returnflag",)))


@query(
    "event_store_json",
    "SELECT event_id, CAST(ts AS DATE) AS event_date, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
)
def event_store_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", "props")
    rows = events.withColumn("source_path", F.lit("events")).withColumn("row_number", F.col("event_id"))
    path = scratch(spark, "store")
    store.init(spark, path)
    store.append(store.to_events(rows, "day", "%Y-%m-%d", ["event_id", "event_type", "props"]), path)
    back = store.decoded(store.open_store(spark, path), ["event_id", "event_type", "props"])
    return back.select(F.col("event_id").cast("long"), "event_date", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(
    "parse_event_date",
    "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN (l_orderkey + l_linenumber) % 5 < 4 THEN CAST(l_shipdate AS DATE) END AS event_date FROM lineitem",
)
def parse_event_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = (F.col("l_orderkey") + F.col("l_linenumber")) % 5
    ship = F.col("l_shipdate")
    written = (
        F.when(h == 0, F.date_format(ship, "yyyy-MM-dd")).when(h == 1, F.date_format(ship, "dd-MMM-yy")).when(h == 2, F.upper(F.date_format(ship, "d-MMM-yy")))
        .when(h == 3, F.concat(F.lit(" \t"), F.date_format(ship, "dd-MMM-yy"), F.lit(" "))).otherwise("31-FEB-11")
    )
    li = table(spark, sf_dir, "lineitem").withColumn("_d", written)
    return li.select("l_orderkey", F.col("l_linenumber").cast("long"), E.parse_date("_d").alias("event_date"))


@query(
    "range_scan_shifted",
    "SELECT event_id, CAST(ts AS DATE) AS event_date, event_type FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-07' AND DATE '2024-01-20'",
)
def range_scan_shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("date").alias("event_date"), "event_type")
    return store.in_range(events, "2024-01-10", "2024-01-20", -3)


@query(
    "multi_source_union",
    "SELECT source, count(*) AS n FROM (SELECT 'a' AS source FROM nation UNION ALL SELECT 'b' FROM region) GROUP BY source",
)
def multi_source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = scratch(spark, "csv-a"), scratch(spark, "csv-b")
    table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).write.option("header", True).csv(a)
    table(spark, sf_dir, "region").select(F.col("r_name").alias("name")).write.option("header", True).csv(b)
    rows = csv.scan(spark, [a, b], ["name"])
    return rows.groupBy(F.when(F.contains("source_path", F.lit("csv-a")), "a").otherwise("b").alias("source")).agg(F.count("*").alias("n"))


# ---- statistics

_CELL = "TRY_CAST(trim({c}, ' ') AS DOUBLE)"


def _numeric_sql(c: str, source: str = "dirty") -> str:
    v = f"TRY_CAST({c} AS DOUBLE)"
    return (
        f"SELECT '{c}' AS \"column\", count({v}) AS count, count(*) FILTER (coalesce({c}, '') = '') AS missing, "
        f"count(*) FILTER (coalesce({c}, '') <> '' AND {v} IS NULL) AS nonvalid, count(*) FILTER ({v} = 0) AS zero_count, "
        f"round(coalesce(sum({v}), 0), 3) AS sum, round(min({v}), 3) AS min, round(max({v}), 3) AS max, round(avg({v}), 3) AS mean, round(coalesce(stddev_samp({v}), 0), 3) AS std, "
        f"round(count(*) FILTER ({v} = 0) / count({v}), 3) AS zero_frequency, round(count(*) FILTER (coalesce({c}, '') = '') / count(*), 3) AS missing_frequency, "
        f"round(count(*) FILTER (coalesce({c}, '') <> '' AND {v} IS NULL) / count(*), 3) AS nonvalid_frequency FROM {source}"
    )


NUMERIC_SQL = " UNION ALL ".join(_numeric_sql(c) for c in NUMERIC)


@query("numeric_stats", f"WITH {DIRTY_SQL} {NUMERIC_SQL}")
def numeric_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.numeric_report(stats.numeric_state(dirty(spark, sf_dir), NUMERIC))


@query("stats_merge", f"WITH {DIRTY_SQL} {NUMERIC_SQL}")
def stats_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dirty(spark, sf_dir)
    first, second = (stats.numeric_state(rows.where(w), NUMERIC) for w in (f"l_shipdate < '{CUT}'", f"l_shipdate >= '{CUT}'"))
    return stats.numeric_report(stats.merge_numeric(first.unionByName(second)))


def _levels_sql(c: str) -> str:
    m = f"coalesce(trim({c}), '') = ''"
    return (
        f"SELECT '{c}' AS \"column\", trim({c}) AS level, count(*) AS count, round(count(*) / (SELECT count(*) FROM dirty WHERE NOT ({m})), 3) AS share, "
        f"(SELECT count(*) FROM dirty WHERE {m}) AS missing, round((SELECT count(*) FROM dirty WHERE {m}) / (SELECT count(*) FROM dirty), 3) AS missing_frequency "
        f"FROM dirty WHERE NOT ({m}) GROUP BY trim({c})"
    )


LEVELS_SQL = " UNION ALL ".join(_levels_sql(c) for c in CATEGORICAL)


@query("categorical_stats", f"WITH {DIRTY_SQL} {LEVELS_SQL}")
def categorical_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.categorical_report(stats.level_counts(dirty(spark, sf_dir), CATEGORICAL))


_TEXTS = [*NUMERIC, *CATEGORICAL]
_GAP = " + ".join(f"CAST(coalesce({c}, '') = '' AS BIGINT)" for c in _TEXTS)
META_SQL = (
    f"SELECT count(*) AS total_rows, CAST(sum({_GAP}) AS BIGINT) AS total_missing, count(*) FILTER ({_GAP} > 0) AS rows_with_any_missing, "
    f"round(count(*) FILTER ({_GAP} > 0) / count(*), 3) AS row_any_missing_frequency, count(DISTINCT l_orderkey) AS n_unique_ids, "
    "count(DISTINCT strftime(l_shipdate, '%Y-%m')) AS n_unique_months, min(l_shipdate) AS min_date, max(l_shipdate) AS max_date FROM dirty"
)


def _meta(rows: DataFrame) -> DataFrame:
    return stats.dataset_meta(rows, _TEXTS, "l_orderkey", F.col("l_shipdate"))


MONTHS_SQL = "(SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS k FROM dirty)) AS unique_months"


@query("dataset_meta", f"WITH {DIRTY_SQL}, m AS ({META_SQL}) SELECT m.*, 'l_orderkey' AS id_column, {MONTHS_SQL}, true AS loaded FROM m")
def dataset_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _meta(dirty(spark, sf_dir))
    return out.withColumn("unique_months", F.array_join("unique_months", ",")).withColumn("loaded", F.col("loaded_at").isNotNull()).drop("loaded_at")


# ---- quality

_F = "SELECT '{b}' AS bucket, {col} AS \"column\", '{k}' AS \"check\", CAST({v} AS DOUBLE) AS value, CAST({t} AS DOUBLE) AS threshold FROM {src} WHERE {w}"
FINDINGS_SQL = f"WITH {DIRTY_SQL}, num AS ({NUMERIC_SQL}), cat AS ({LEVELS_SQL}), meta AS ({META_SQL}) " + " UNION ALL ".join(
    [
        _F.format(b="numeric", col='"column"', k="missing_frequency", v="missing_frequency", t=0.3, src="num", w="\"column\" <> 'l_extendedprice' AND missing_frequency > 0.3"),
        _F.format(b="numeric", col='"column"', k="nonvalid_frequency", v="nonvalid_frequency", t=0.05, src="num", w="\"column\" <> 'l_extendedprice' AND nonvalid_frequency > 0.05"),
        _F.format(b="categorical", col='"column"', k="missing_frequency", v="missing_frequency", t=0.3, src='(SELECT DISTINCT "column", missing_frequency FROM cat)', w="missing_frequency > 0.3"),
        _F.format(b="numeric", col='"column"', k="zero_frequency", v="zero_frequency", t=0.04, src="num", w="\"column\" <> 'l_extendedprice' AND zero_frequency > 0.04"),
        _F.format(b="numeric", col='"column"', k="coefficient_of_variation", v="round(std / abs(sum / count), 3)", t=0.5, src="num", w="\"column\" <> 'l_extendedprice' AND abs(sum / count) >= 0.001 AND round(std / abs(sum / count), 3) > 0.5"),
        _F.format(b="categorical", col='"column"', k="dominance", v="top", t=0.45, src='(SELECT "column", round(max(count) / sum(count), 3) AS top FROM cat GROUP BY "column")', w="top > 0.45"),
        _F.format(b="meta", col="'*'", k="row_any_missing_frequency", v="row_any_missing_frequency", t=0.1, src="meta", w="row_any_missing_frequency > 0.1"),
        _F.format(b="meta", col="'l_orderkey'", k="id_uniqueness", v="round(n_unique_ids / total_rows, 3)", t=0.9, src="meta", w="round(n_unique_ids / total_rows, 3) < 0.9"),
    ]
)


@query("quality_findings", FINDINGS_SQL)
def quality_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dirty(spark, sf_dir)
    numeric, levels = stats.numeric_report(stats.numeric_state(rows, NUMERIC)), stats.categorical_report(stats.level_counts(rows, CATEGORICAL))
    return quality.findings(numeric, levels, _meta(rows), ROLES, LIMITS)


_REASON = "CASE WHEN missing_frequency > 0.3 THEN 'missing_frequency' {n} ELSE '' END"
POLICY_CTE = (
    f"WITH {DIRTY_SQL}, num AS ({NUMERIC_SQL}), cat AS ({LEVELS_SQL}), r AS ("
    f"SELECT \"column\", {_REASON.format(n=chr(32) + 'WHEN nonvalid_frequency > 0.05 THEN ' + chr(39) + 'nonvalid_frequency' + chr(39))} AS reason FROM num WHERE \"column\" IN ('l_quantity', 'l_discount', 'l_tax') "
    f"UNION ALL SELECT DISTINCT \"column\", {_REASON.format(n='')} FROM cat)"
)
POLICY_SQL = f"{POLICY_CTE} SELECT \"column\", reason = '' AS kept, reason FROM r"


@query("column_policy", POLICY_SQL)
def column_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dirty(spark, sf_dir)
    numeric, levels = stats.numeric_report(stats.numeric_state(rows, NUMERIC)), stats.categorical_report(stats.level_counts(rows, CATEGORICAL))
    return quality.column_policy(numeric, levels, ROLES, LIMITS)


@query(
    "clean_rows",
    f"WITH {DIRTY_SQL} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_discount, l_returnflag, l_linestatus, l_extendedprice, l_shipdate FROM dirty WHERE "
    + " AND ".join(f"TRY_CAST({c} AS DOUBLE) IS NOT NULL" for c in ("l_quantity", "l_discount", "l_extendedprice"))
    + " AND " + " AND ".join(f"coalesce(trim({c}), '') <> ''" for c in CATEGORICAL),
)
def clean_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dirty(spark, sf_dir).withColumn("l_linenumber", F.col("l_linenumber").cast("long"))
    return quality.clean_rows(rows, Roles(ROLES.target, ROLES.datetime, id=ROLES.id, numeric=("l_quantity", "l_discount"), categorical=ROLES.categorical), keep=["l_linenumber"])


# ---- bins and rules


@query(
    "bins_equal_width",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(i AS BIGINT) AS edge_index, round(lo + (hi - lo) * i / 6, 3) AS edge FROM (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem), range(0, 7) t(i)"
        for c in ("l_quantity", "l_extendedprice")
    ),
)
def bins_equal_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, bins.fit_edges(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], 6, "equal_width"))


@query(
    "bins_quantile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(i AS BIGINT) AS edge_index, round(e[i + 1], 3) AS edge FROM (SELECT quantile_cont({c}, [0, 1/6, 2/6, 3/6, 4/6, 5/6, 1]) AS e FROM lineitem), range(0, 7) t(i)"
        for c in ("l_quantity", "l_extendedprice")
    ),
)
def bins_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, bins.fit_edges(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], 6))


def _edges(spark: SparkSession, edges: dict[str, list[float]]) -> DataFrame:
    return spark.createDataFrame([(c, i, e) for c, own in edges.items() for i, e in enumerate(own)], "column string, edge_index long, edge double")


@query(
    "bin_labels",
    f"""WITH {DIRTY_SQL}, v AS (SELECT TRY_CAST(l_quantity AS DOUBLE) AS v FROM dirty)
    SELECT CASE WHEN v < 5 THEN '(l_quantity < 5.0)' WHEN v < 20 THEN '(5.0 <= l_quantity < 20.0)' WHEN v <= 40 THEN '(20.0 <= l_quantity <= 40.0)'
    WHEN v > 40 THEN '(l_quantity > 40.0)' END AS label, count(*) AS count FROM v GROUP BY 1""",
)
def bin_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirty(spark, sf_dir).groupBy(bins.label("l_quantity", [5.0, 20.0, 20.0, 40.0]).alias("label")).agg(F.count("*").alias("count"))


T_NUM, T_CAT = ["l_quantity", "o_totalprice"], ["l_returnflag", "l_linestatus", "o_orderstatus", "o_orderpriority", "CLAIM"]
SETTINGS = RuleSettings()


def transactions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    wide = li.join(o, li["l_orderkey"] == o["o_orderkey"]).withColumn("CLAIM", F.when(F.col("l_returnflag") == "R", "yes").otherwise("no"))
    edges = bins.fit_edges(wide, T_NUM, SETTINGS.bins)
    return bins.with_items(wide, edges, {c: None for c in T_CAT}).select("l_orderkey", "l_linenumber", "items")


def _label_sql(c: str, e: str) -> str:
    out = "CASE "
    for i in range(1, 6):
        out += f"WHEN {c} < {e}[{i + 1}] THEN '(' || {e}[{i}] || ' <= {c} < ' || {e}[{i + 1}] || ')' "
    return out + f"ELSE '(' || {e}[6] || ' <= {c} <= ' || {e}[7] || ')' END"


TRANSACTIONS_SQL = (
    "wide AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 'yes' ELSE 'no' END AS CLAIM FROM lineitem JOIN orders ON l_orderkey = o_orderkey), "
    "e AS (SELECT list_transform(quantile_cont(l_quantity, [0, 1/6, 2/6, 3/6, 4/6, 5/6, 1]), lambda x: round(x, 3)) AS eq, "
    "list_transform(quantile_cont(o_totalprice, [0, 1/6, 2/6, 3/6, 4/6, 5/6, 1]), lambda x: round(x, 3)) AS et FROM wide), "
    f"t AS (SELECT row_number() OVER () AS id, l_orderkey, l_linenumber, [{_label_sql('l_quantity', 'eq')}, {_label_sql('o_totalprice', 'et')}, "
    + ", ".join(f"'{c} = ' || {c}" for c in T_CAT)
    + "] AS items FROM wide, e), x AS (SELECT id, unnest(items) AS item FROM t), n AS (SELECT count(*) AS n FROM t), "
    "one AS (SELECT item, count(*) AS c FROM x GROUP BY item HAVING count(*) >= 0.14 * (SELECT n FROM n)), "
    "f AS (SELECT id, x.item FROM x JOIN one USING (item)), "
    "two AS (SELECT a.item AS i1, b.item AS i2, count(*) AS c FROM f a JOIN f b ON a.id = b.id AND a.item < b.item GROUP BY 1, 2 HAVING count(*) >= 0.14 * (SELECT n FROM n)), "
    "three AS (SELECT a.item AS i1, b.item AS i2, d.item AS i3, count(*) AS c FROM f a JOIN f b ON a.id = b.id AND a.item < b.item JOIN f d ON d.id = b.id AND b.item < d.item "
    "GROUP BY 1, 2, 3 HAVING count(*) >= 0.14 * (SELECT n FROM n))"
)


@query("transactions", f"WITH {TRANSACTIONS_SQL} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, array_to_string(list_sort(items), ' + ') AS items FROM t")
def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions_of(spark, sf_dir).select("l_orderkey", F.col("l_linenumber").cast("long"), F.array_join(F.sort_array("items"), " + ").alias("items"))


@query("item_support", f"WITH {TRANSACTIONS_SQL} SELECT item, c AS count, round(c / n, 6) AS support FROM one, n")
def item_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim, n = rules.compressed(transactions_of(spark, sf_dir).select("items"), SETTINGS)
    return rules.item_support(slim, n=n).withColumn("support", F.round("support", 6))


def _sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    slim, n = rules.compressed(transactions_of(spark, sf_dir).select("items"), SETTINGS)
    return rules.frequent_sets(slim, n, SETTINGS.min_support), n


@query(
    "frequent_itemsets",
    f"WITH {TRANSACTIONS_SQL} SELECT s AS itemset, CAST(k AS BIGINT) AS size, c AS count, round(c / n, 6) AS support FROM (SELECT item AS s, 1 AS k, c FROM one "
    "UNION ALL SELECT i1 || ' + ' || i2, 2, c FROM two UNION ALL SELECT i1 || ' + ' || i2 || ' + ' || i3, 3, c FROM three), n",
)
def frequent_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets, _ = _sets(spark, sf_dir)
    return sets.select(F.array_join("items", " + ").alias("itemset"), "size", "count", F.round("support", 6).alias("support"))


RULES_SQL = (
    f"WITH {TRANSACTIONS_SQL}, s AS (SELECT item AS k, c FROM one UNION ALL SELECT i1 || ' + ' || i2, c FROM two), sp AS ("
    "SELECT i1 AS a, i2 AS b, c FROM two UNION ALL SELECT i2, i1, c FROM two "
    "UNION ALL SELECT i1, i2 || ' + ' || i3, c FROM three UNION ALL SELECT i2, i1 || ' + ' || i3, c FROM three UNION ALL SELECT i3, i1 || ' + ' || i2, c FROM three "
    "UNION ALL SELECT i2 || ' + ' || i3, i1, c FROM three UNION ALL SELECT i1 || ' + ' || i3, i2, c FROM three UNION ALL SELECT i1 || ' + ' || i2, i3, c FROM three), "
    "r AS (SELECT a AS antecedent, b AS consequent, sp.c / n AS support, sp.c / sa.c AS confidence, (sp.c / sa.c) / (sb.c / n) AS lift "
    "FROM sp JOIN s sa ON sa.k = a JOIN s sb ON sb.k = b, n WHERE sp.c / sa.c >= 0.5)"
)
_RULE_COLUMNS = "antecedent, consequent, round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift"


def _shown(df: DataFrame) -> DataFrame:
    return df.select(*(F.array_join(c, " + ").alias(c) for c in ("antecedent", "consequent")), *(F.round(c, 6).alias(c) for c in ("support", "confidence", "lift")))


@query("association_rules", f"{RULES_SQL} SELECT {_RULE_COLUMNS} FROM r")
def association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets, n = _sets(spark, sf_dir)
    return _shown(rules.all_rules(sets, n, SETTINGS.min_confidence))


@query("top_k_rules", f"{RULES_SQL} SELECT {_RULE_COLUMNS} FROM (SELECT * FROM r WHERE lift >= 1.05 ORDER BY lift DESC, confidence DESC, antecedent, consequent LIMIT 5)")
def top_k_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets, n = _sets(spark, sf_dir)
    return _shown(rules.top_rules(rules.all_rules(sets, n, SETTINGS.min_confidence), SETTINGS))


@query(
    "rule_flags",
    f"WITH {DIRTY_SQL} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(coalesce(l_returnflag = 'R', false) AS INTEGER) AS rule_0, "
    "CAST(coalesce(l_returnflag = 'N' AND l_linestatus = 'O' AND TRY_CAST(l_quantity AS DOUBLE) >= 25 AND TRY_CAST(l_quantity AS DOUBLE) <= 50, false) AS INTEGER) AS rule_1 FROM dirty",
)
def rule_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = [{"name": "rule_0", "antecedent": ["l_returnflag = R"]}, {"name": "rule_1", "antecedent": ["l_returnflag = N", "l_linestatus = O", "(25.0 <= l_quantity <= 50.0)"]}]
    rows = bins.with_items(dirty(spark, sf_dir), {"l_quantity": [1.0, 25.0, 50.0]}, {"l_returnflag": None, "l_linestatus": None}, "_i")
    return rows.select("l_orderkey", F.col("l_linenumber").cast("long"), *rules.flags(F.col("_i"), specs))


@query(
    "rare_levels",
    "SELECT item, count(*) AS count FROM (SELECT CASE WHEN o_orderpriority IN (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2) "
    "THEN 'o_orderpriority = ' || o_orderpriority ELSE 'o_orderpriority = __OTHER__' END AS item FROM orders) GROUP BY item",
)
def rare_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    top = bins.top_levels(stats.level_counts(o, ["o_orderpriority"]), 2)
    return o.select(F.explode(bins.items({}, top)).alias("item")).groupBy("item").agg(F.count("*").alias("count"))


# ---- drift


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li = table(spark, sf_dir, "lineitem").withColumn("_late", F.col("l_shipdate") >= F.lit(CUT).cast("timestamp_ntz"))
    late = li.where("_late").withColumn("l_quantity", F.col("l_quantity") * 3 + 40).withColumn("l_extendedprice", F.col("l_extendedprice") + 70000)
    return li.where("not _late"), late.withColumn("l_returnflag", F.when(F.col("l_returnflag") == "N", "R").otherwise(F.col("l_returnflag")))


_LATE = (
    f"a AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '{CUT}'), b AS (SELECT * REPLACE (l_quantity * 3 + 40 AS l_quantity, l_extendedprice + 70000 AS l_extendedprice, "
    f"CASE WHEN l_returnflag = 'N' THEN 'R' ELSE l_returnflag END AS l_returnflag) FROM lineitem WHERE l_shipdate >= TIMESTAMP '{CUT}')"
)
_D_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
NUMERIC_DRIFT_SQL = " UNION ALL ".join(
    f"SELECT \"column\", round(shift, 6) AS mean_shift_sigmas, round(ratio, 6) AS std_ratio, CAST(0 AS DOUBLE) AS missing_frequency_delta, "
    f"CASE WHEN shift >= 4 OR ratio >= 4 OR ratio <= 0.25 THEN 'critical' WHEN shift >= 2 OR ratio >= 2 OR ratio <= 0.5 THEN 'warn' ELSE 'ok' END AS severity FROM ("
    f"SELECT '{c}' AS \"column\", abs(mb - ma) / greatest(sa, 1e-9) AS shift, sb / sa AS ratio FROM "
    f"(SELECT round(avg({c}), 3) AS ma, round(stddev_samp({c}), 3) AS sa FROM a), (SELECT round(avg({c}), 3) AS mb, round(stddev_samp({c}), 3) AS sb FROM b))"
    for c in _D_NUM
)
CATEGORICAL_DRIFT_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(greatest(sum(0.5 * p * ln((p + 1e-9) / ((p + q) / 2 + 1e-9)) + 0.5 * q * ln((q + 1e-9) / ((p + q) / 2 + 1e-9))), 0), 6) AS js_divergence, "
    f"CAST(0 AS DOUBLE) AS missing_frequency_delta FROM (SELECT coalesce(x.n, 0) / (SELECT count(*) FROM a) AS p, coalesce(y.n, 0) / (SELECT count(*) FROM b) AS q FROM "
    f"(SELECT {c} AS k, count(*) AS n FROM a GROUP BY 1) x FULL JOIN (SELECT {c} AS k, count(*) AS n FROM b GROUP BY 1) y USING (k))"
    for c in CATEGORICAL
)
_C_DRIFT = f"SELECT *, CASE WHEN js_divergence >= 0.22 THEN 'critical' WHEN js_divergence >= 0.12 THEN 'warn' ELSE 'ok' END AS severity FROM ({CATEGORICAL_DRIFT_SQL})"


@query("drift_numeric", f"WITH {_LATE} {NUMERIC_DRIFT_SQL}")
def drift_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (stats.numeric_report(stats.numeric_state(x, _D_NUM)) for x in _halves(spark, sf_dir))
    return drift.numeric_drift(a, b, DriftLimits())


@query("drift_categorical", f"WITH {_LATE} {_C_DRIFT}")
def drift_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (stats.level_counts(x, CATEGORICAL) for x in _halves(spark, sf_dir))
    return drift.categorical_drift(a, b, DriftLimits())


@query(
    "drift_status",
    f"WITH {_LATE}, s AS (SELECT severity FROM ({NUMERIC_DRIFT_SQL}) UNION ALL SELECT severity FROM ({_C_DRIFT})) SELECT CASE WHEN count(*) FILTER (severity = 'critical') > 0 THEN 'critical' "
    "WHEN count(*) FILTER (severity = 'warn') > 0 THEN 'warn' ELSE 'ok' END AS status, count(*) FILTER (severity = 'ok') AS n_ok, count(*) FILTER (severity = 'warn') AS n_warn, "
    "count(*) FILTER (severity = 'critical') AS n_critical FROM s",
)
def drift_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.status(drift_numeric(spark, sf_dir), drift_categorical(spark, sf_dir))


# ---- features and preprocessing


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirty(spark, sf_dir).withColumn("l_linenumber", F.col("l_linenumber").cast("long"))


_KEY_SQL = "l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber"


@query("fe_log1p", f"WITH {DIRTY_SQL} SELECT {_KEY_SQL}, round(ln(1 + greatest(TRY_CAST(l_quantity AS DOUBLE), 0)), 6) AS log1p_l_quantity FROM dirty WHERE TRY_CAST(l_quantity AS DOUBLE) IS NOT NULL "
       f"UNION ALL SELECT {_KEY_SQL}, NULL FROM dirty WHERE TRY_CAST(l_quantity AS DOUBLE) IS NULL")  # fmt: skip
def fe_log1p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select(*KEY, F.round(E.log1p_of("l_quantity"), 6).alias("log1p_l_quantity"))


@query("fe_ratio", f"WITH {DIRTY_SQL} SELECT {_KEY_SQL}, round(TRY_CAST(l_quantity AS DOUBLE) / (TRY_CAST(l_discount AS DOUBLE) + 1e-6), 4) AS ratio FROM dirty")
def fe_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select(*KEY, F.round(E.ratio("l_quantity", "l_discount"), 4).alias("ratio"))


@query("fe_difference", f"WITH {DIRTY_SQL} SELECT {_KEY_SQL}, round(TRY_CAST(l_quantity AS DOUBLE) - TRY_CAST(l_tax AS DOUBLE), 6) AS difference FROM dirty")
def fe_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select(*KEY, F.round(E.difference("l_quantity", "l_tax"), 6).alias("difference"))


@query("impute_median", f"WITH {DIRTY_SQL} SELECT {_KEY_SQL}, coalesce(TRY_CAST(l_quantity AS DOUBLE), (SELECT median(TRY_CAST(l_quantity AS DOUBLE)) FROM dirty)) AS l_quantity FROM dirty")
def impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return prep.fit(rows, ["l_quantity"], []).transform(rows, KEY)


@query(
    "impute_mode",
    f"WITH {DIRTY_SQL}, m AS (SELECT trim(l_returnflag) AS k FROM dirty WHERE coalesce(trim(l_returnflag), '') <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) "
    f"SELECT {_KEY_SQL}, CASE WHEN coalesce(trim(l_returnflag), '') <> '' THEN trim(l_returnflag) ELSE (SELECT k FROM m) END AS l_returnflag FROM dirty",
)
def impute_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    p = prep.fit(rows, [], ["l_returnflag"])
    return rows.select(*KEY, p.level("l_returnflag").alias("l_returnflag"))


@query(
    "standardize",
    f"SELECT {_KEY_SQL}, round((l_quantity - mq) / sq, 6) AS l_quantity, round((l_tax - mt) / st, 6) AS l_tax FROM lineitem, "
    "(SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_tax) AS mt, stddev_pop(l_tax) AS st FROM lineitem)",
)
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("long"))
    p = prep.fit(rows, ["l_quantity", "l_tax"], [], "mlp_ohe")
    return rows.select(*KEY, *(F.round(p.number(c), 6).alias(c) for c in p.numeric))


def _fitted_without_r(spark: SparkSession, sf_dir: str, variant: str) -> tuple[DataFrame, prep.Preprocessor]:
    rows = table(spark, sf_dir, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("long"))
    return rows, prep.fit(rows.where("l_returnflag <> 'R'"), [], ["l_returnflag"], variant)


@query("ordinal_encode", f"SELECT {_KEY_SQL}, CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE -1 END AS BIGINT) AS l_returnflag FROM lineitem")
def ordinal_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, p = _fitted_without_r(spark, sf_dir, "tree")
    return p.transform(rows, KEY)


@query("onehot_encode", f"SELECT {_KEY_SQL}, CAST(l_returnflag = 'A' AS DOUBLE) AS flag_a, CAST(l_returnflag = 'N' AS DOUBLE) AS flag_n FROM lineitem")
def onehot_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, p = _fitted_without_r(spark, sf_dir, "mlp_ohe")
    return p.transform(rows, KEY).toDF(*KEY, "flag_a", "flag_n")


_TARGET_SQL = "CASE WHEN l_returnflag = 'R' THEN l_extendedprice * l_discount ELSE 0 END"


@query("target_transform", f"SELECT {_KEY_SQL}, round(y, 4) AS y, round(ln(1 + y), 6) AS y_log, round(exp(ln(1 + y) + 0.125) - 1, 4) AS y_back FROM (SELECT *, {_TARGET_SQL} AS y FROM lineitem)")
def target_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = E.scalar_target(F.expr(f"CAST({_TARGET_SQL} AS STRING)"))
    rows = table(spark, sf_dir, "lineitem").withColumn("y", y)
    return rows.select(
        "l_orderkey", F.col("l_linenumber").cast("long"), F.round("y", 4).alias("y"), F.round(prep.log_target("y"), 6).alias("y_log"), F.round(prep.from_log(prep.log_target("y"), 0.25), 4).alias("y_back")
    )


@query(
    "numeric_only_columns",
    f"WITH {DIRTY_SQL} SELECT 'clean' AS name, CAST(count(*) = count(TRY_CAST(CAST(l_orderkey AS STRING) AS DOUBLE)) AS BOOLEAN) AS numeric FROM dirty "
    "UNION ALL SELECT 'dirty', count(*) = count(TRY_CAST(l_quantity AS DOUBLE)) FROM dirty",
)
def numeric_only_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dirty(spark, sf_dir).select(F.col("l_orderkey").cast("string").alias("clean"), F.col("l_quantity").alias("dirty"))
    kept = prep.numeric_only(rows, ["clean", "dirty"])
    return spark.createDataFrame([(c, c in kept) for c in ("clean", "dirty")], "name string, numeric boolean")


# ---- families, metrics, folds

_Q = "TRY_CAST({c} AS DOUBLE)"
_FENCES = ", ".join(f"(SELECT quantile_cont({_Q.format(c=c)}, 0.25) AS lo_{c}, quantile_cont({_Q.format(c=c)}, 0.75) AS hi_{c} FROM dirty)" for c in ("l_quantity", "l_extendedprice"))
_OUT = " OR ".join(f"coalesce({_Q.format(c=c)} < lo_{c} - 0.25 * (hi_{c} - lo_{c}) OR {_Q.format(c=c)} > hi_{c} + 0.25 * (hi_{c} - lo_{c}), false)" for c in ("l_quantity", "l_extendedprice"))
_MISS = " OR ".join(f"coalesce(trim({c}), '') = ''" for c in ("l_quantity", "l_extendedprice", "l_returnflag"))
RATES_SQL = f"WITH {DIRTY_SQL}, r AS (SELECT count(*) AS rows, avg(CAST({_MISS} AS DOUBLE)) AS missing_row_share, avg(CAST({_OUT} AS DOUBLE)) AS outlier_row_share FROM dirty, {_FENCES})"


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.row_rates(dirty(spark, sf_dir), ["l_quantity", "l_extendedprice"], ["l_returnflag"], 0.25)


@query("iqr_row_rates", f"{RATES_SQL} SELECT rows, round(missing_row_share, 6) AS missing_row_share, round(outlier_row_share, 6) AS outlier_row_share FROM r")
def iqr_row_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rates(spark, sf_dir).select("rows", F.round("missing_row_share", 6).alias("missing_row_share"), F.round("outlier_row_share", 6).alias("outlier_row_share"))


@query("choose_family", f"{RATES_SQL} SELECT rows, CASE WHEN rows < 8000 OR missing_row_share > 0.4 OR outlier_row_share > 0.3 THEN 'tree' ELSE 'mlp' END AS family FROM r")
def choose_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rates(spark, sf_dir).select("rows", models.family(AutoSettings()).alias("family"))


@query(
    "regression_metrics",
    f"SELECT round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(sqrt(avg(pow(ln(1 + greatest(p, 0)) - ln(1 + y), 2))), 6) AS rmsle, "
    f"round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 6) AS r2, count(*) AS n FROM (SELECT y, y * 0.9 + l_quantity - 10 AS p FROM (SELECT *, {_TARGET_SQL} AS y FROM lineitem))",
)
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("y", F.expr(_TARGET_SQL)).withColumn("p", F.col("y") * 0.9 + F.col("l_quantity") - 10)
    return models.regression_metrics(rows).select(F.round("rmse", 4).alias("rmse"), F.round("rmsle", 6).alias("rmsle"), F.round("r2", 6).alias("r2"), "n")


_POS = "(SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position, count(*) OVER () AS n FROM orders)"
_KFOLD = "CASE WHEN position < (n % 7) * (n // 7 + 1) THEN position // (n // 7 + 1) ELSE n % 7 + (position - (n % 7) * (n // 7 + 1)) // (n // 7) END"


def _kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return models.positions(orders, ["o_orderdate", "o_orderkey"]).withColumn("fold", models.kfold(F.col("position"), orders.count(), 7))


@query("fold_kfold", f"SELECT o_orderkey, CAST({_KFOLD} AS BIGINT) AS fold FROM {_POS}")
def fold_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kfold(spark, sf_dir).select("o_orderkey", "fold")


@query(
    "fold_time_series",
    f"SELECT o_orderkey, CAST(fold AS BIGINT) AS fold, CASE WHEN position < n - (5 - fold) * (n // 6) THEN 'train' ELSE 'test' END AS role FROM {_POS}, range(0, 5) f(fold) "
    "WHERE position < n - (5 - fold) * (n // 6) + n // 6",
)
def fold_time_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    placed = models.positions(orders, ["o_orderdate", "o_orderkey"])
    return models.time_series(placed, orders.count(), 5).select("o_orderkey", "fold", "role")


@query(
    "fold_summary",
    f"WITH f AS (SELECT {_KFOLD} AS fold, avg(o_totalprice) AS average, max(o_totalprice) AS largest FROM {_POS} GROUP BY 1) "
    "SELECT 'average' AS metric, round(avg(average), 4) AS mean, round(stddev_pop(average), 4) AS std, count(*) AS n_folds FROM f "
    "UNION ALL SELECT 'largest', round(avg(largest), 4), round(stddev_pop(largest), 4), count(*) FROM f",
)
def fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _kfold(spark, sf_dir).groupBy("fold").agg(F.avg("o_totalprice").alias("average"), F.max("o_totalprice").alias("largest"))
    return models.fold_summary(each, ["average", "largest"]).select("metric", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "n_folds")


_CASES = [("RMSE", 10.0, 10.5), ("RMSE", 10.0, 11.5), ("RMSE", 10.0, 13.0), ("RMSE", 0.0, 1.0), ("R2", 0.5, 0.6), ("R2", 0.5, 0.45), ("R2", 0.5, 0.3), ("R2", -0.1, 0.2), ("RMSLE", 1.0, 1.1)]


@query(
    "model_drift_ratio",
    "SELECT *, CASE WHEN stress_ratio IS NULL THEN 'unknown' WHEN stress_ratio >= 1.25 THEN 'critical' WHEN stress_ratio >= 1.1 THEN 'warn' ELSE 'ok' END AS status FROM ("
    "SELECT metric, baseline, current, CASE WHEN metric = 'R2' THEN CASE WHEN baseline <= 0 THEN NULL WHEN current >= baseline THEN 1 ELSE baseline / current END "
    "WHEN baseline > 0 THEN current / baseline END AS stress_ratio FROM (VALUES "
    + ", ".join(f"('{m}', CAST({b} AS DOUBLE), CAST({c} AS DOUBLE))" for m, b, c in _CASES)
    + ") t(metric, baseline, current))",
)
def model_drift_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.judged(spark.createDataFrame(_CASES, "metric string, baseline double, current double"), ModelDriftLimits())


# ---- exploration


@query(
    "eda_describe",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, "
        f"round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75, round(max({c}), 4) AS max FROM lineitem"
        for c in NUMERIC
    ),
)
def eda_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.describe(table(spark, sf_dir, "lineitem"), NUMERIC)


@query("eda_corr", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS corr FROM lineitem" for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1 :]))
def eda_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.correlations(table(spark, sf_dir, "lineitem"), NUMERIC)


@query(
    "eda_histogram",
    "SELECT 'l_quantity' AS \"column\", bin, round(1 + bin * CAST(4.9 AS DOUBLE), 4) AS lo, round(1 + (bin + 1) * CAST(4.9 AS DOUBLE), 4) AS hi, count(*) AS count FROM "
    "(SELECT CAST(least(floor((l_quantity - 1.0) * 10 / 49.0), 9) AS BIGINT) AS bin FROM lineitem) GROUP BY bin",
)
def eda_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.histogram(table(spark, sf_dir, "lineitem"), {"l_quantity": (1.0, 50.0)})


# ---- models


def _model_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str], list[str]]:
    rows = table(spark, sf_dir, "lineitem").withColumn("_key", F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    return rows, ["l_quantity", "l_extendedprice", "l_discount"], ["l_returnflag", "l_linestatus"]


# ---- streaming


@query(
    "stream_ingest_stats",
    "SELECT 'value' AS \"column\", count(value) AS count, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS nonvalid, count(*) FILTER (value = 0) AS zero_count, round(sum(value), 3) AS sum, "
    "round(min(value), 3) AS min, round(max(value), 3) AS max, round(avg(value), 3) AS mean, round(stddev_samp(value), 3) AS std, round(count(*) FILTER (value = 0) / count(*), 3) AS zero_frequency, "
    "CAST(0 AS DOUBLE) AS missing_frequency, CAST(0 AS DOUBLE) AS nonvalid_frequency FROM events",
)
def stream_ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    folder = scratch(spark, "stream")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    ingest.ingest(stream, folder, ["value"], ["event_type"]).awaitTermination()
    return stats.numeric_report(ingest.numeric_state(spark, folder))


# ---- text labs


@query("text_lower", "SELECT doc_id, lower(text) AS text FROM documents")
def text_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.lowered().alias("text"))


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_SPLIT = "regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s]', '', 'g'), '\\s+')"


@query("text_clean", f"SELECT doc_id, array_to_string(list_filter({_SPLIT}, lambda w: length(w) >= 3 AND w NOT IN ({_STOP})), ' ') AS cleaned FROM documents")
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.cleaned().alias("cleaned"))


@query(
    "tfidf_weights",
    f"WITH t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_SPLIT}) AS term FROM documents) WHERE length(term) >= 2 GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents), "
    "d AS (SELECT term, count(*) AS df, sum(tf) AS s FROM t GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= 0.95 * (SELECT n FROM n) ORDER BY s DESC, term LIMIT 500), "
    "w AS (SELECT doc_id, term, tf, df, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM t JOIN d USING (term), n) "
    "SELECT doc_id, term, tf, df, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w",
)
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = text.tfidf(table(spark, sf_dir, "documents"), max_features=500, min_df=2, max_df=0.95)
    return out.withColumn("weight", F.round("weight", 6))


@query(
    "classification_metrics",
    "WITH p AS (SELECT quality AS l, CAST(doc_id % 7 <> 0 AS INTEGER) AS p FROM labels), k AS (SELECT k, count(*) FILTER (l = k AND p = k) AS tp, count(*) FILTER (l = k) AS n_of, "
    "count(*) FILTER (p = k) AS said FROM p, (VALUES (0), (1)) c(k) GROUP BY k), m AS (SELECT *, tp / said AS pr, tp / n_of AS re FROM k) "
    "SELECT round(sum(tp) / sum(n_of), 6) AS accuracy, round(sum(pr * n_of) / sum(n_of), 6) AS weighted_precision, round(sum(re * n_of) / sum(n_of), 6) AS weighted_recall, "
    "round(sum(2 * pr * re / (pr + re) * n_of) / sum(n_of), 6) AS weighted_f1, round(avg(re), 6) AS balanced_accuracy, CAST(sum(n_of) AS BIGINT) AS n FROM m",
)
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").withColumn("p", (F.col("doc_id") % 7 != 0).cast("int"))
    out = text.classification_metrics(rows, "quality", "p")
    return out.select(*(F.round(c, 6).alias(c) for c in ("accuracy", "weighted_precision", "weighted_recall", "weighted_f1", "balanced_accuracy")), "n")


@query(
    "top_levels_per_column",
    "SELECT \"column\", level, count FROM (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY count DESC, level) AS r FROM ("
    "SELECT 'p_brand' AS \"column\", p_brand AS level, count(*) AS count FROM part GROUP BY p_brand UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY p_type)) WHERE r <= 3",
)
def top_levels_per_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stats.level_counts(table(spark, sf_dir, "part"), ["p_brand", "p_type"])
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), "level")))
    return ranked.where("r <= 3").select("column", "level", "count")


# ---- more of the inventory


@query(
    "eda_levels",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(sum(n) AS BIGINT) AS count, count(*) AS \"unique\", min(k) FILTER (n = m) AS top, max(n) AS freq FROM "
        f"(SELECT {c} AS k, count(*) AS n, max(count(*)) OVER () AS m FROM lineitem GROUP BY {c})"
        for c in CATEGORICAL
    ),
)
def eda_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.describe_levels(table(spark, sf_dir, "lineitem"), CATEGORICAL)


@query("stream_window_counts", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS count FROM events GROUP BY 1, 2")
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    folder, name = scratch(spark, "windows"), f"windows_{uuid.uuid4().hex}"
    counts = ingest.windowed_counts(stream, "ts", "event_type")
    counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "count")


@query("stream_level_counts", "SELECT 'event_type' AS \"column\", event_type AS level, count(*) AS count FROM events GROUP BY event_type")
def stream_level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    folder = scratch(spark, "stream")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    ingest.ingest(stream, folder, ["value"], ["event_type"]).awaitTermination()
    return ingest.level_state(spark, folder)


@query("ordered_first_rows", "SELECT event_id, CAST(ts AS DATE) AS event_date FROM events ORDER BY CAST(ts AS DATE), event_id LIMIT 100")
def ordered_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("date").alias("event_date"))
    return store.ordered(events, "event_id").limit(100)


@query(
    "first_batches_per_file",
    "SELECT count(*) AS n, CAST(20 AS BIGINT) AS last_row FROM (SELECT n_nationkey FROM nation LIMIT 20)",
)
def first_batches_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "csv")
    table(spark, sf_dir, "nation").coalesce(1).write.option("header", True).csv(path)
    return csv.first_batches(csv.scan(spark, path), 10, 2).agg(F.count("*").alias("n"), F.max("row_number").alias("last_row"))


@query("missing_kinds", f"WITH {DIRTY_SQL} SELECT count(*) FILTER (coalesce(l_returnflag, '') = '') AS exact, count(*) FILTER (coalesce(trim(l_returnflag), '') = '') AS trimmed, count(*) AS n FROM dirty")
def missing_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dirty(spark, sf_dir)
    return rows.agg(F.count_if(E.missing_exact("l_returnflag")).alias("exact"), F.count_if(E.missing_trimmed("l_returnflag")).alias("trimmed"), F.count("*").alias("n"))


@query("level_union_and_difference", "SELECT l_returnflag AS level, 'common' AS side FROM (SELECT l_returnflag FROM lineitem WHERE l_linestatus = 'O' INTERSECT SELECT l_returnflag FROM lineitem WHERE l_linestatus = 'F') "
       "UNION ALL SELECT l_returnflag, 'first only' FROM (SELECT l_returnflag FROM lineitem WHERE l_linestatus = 'O' EXCEPT SELECT l_returnflag FROM lineitem WHERE l_linestatus = 'F')")  # fmt: skip
def level_union_and_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    a, b = (li.where(F.col("l_linestatus") == s).select(F.col("l_returnflag").alias("level")) for s in ("O", "F"))
    return a.intersect(b).withColumn("side", F.lit("common")).unionByName(a.subtract(b).withColumn("side", F.lit("first only")))


@query(
    "best_model",
    "SELECT arg_max(model, s) AS model, max(s) AS score FROM (SELECT model, avg(weighted_f1) AS s FROM (VALUES ('lr', CAST(0.5 AS DOUBLE)), ('lr', 0.75), ('rf', 0.75), ('rf', 0.625)) t(model, weighted_f1) GROUP BY model)",
)
def best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.best_model(spark.createDataFrame([("lr", 0.5), ("lr", 0.75), ("rf", 0.75), ("rf", 0.625)], "model string, weighted_f1 double"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"), F.col("label").cast("double").alias("label"))
