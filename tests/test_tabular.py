import math
from itertools import combinations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallymill.config import AutoSettings, DriftLimits, ModelDriftLimits, Roles, RuleSettings, Validation, from_dict
from tallymill.operators import bins, drift, eda, models, monitor, prep, quality, rules, stats, text
from tallymill.sources import csv, store

slow = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@slow
@given(st.lists(st.one_of(st.floats(-1e6, 1e6).map(str), st.sampled_from(["", "x", "1d", "  "])), min_size=2, max_size=30), st.integers(0, 30))
def test_merge_is_whole(spark, cells, cut):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, a string")
    whole = stats.numeric_report(stats.numeric_state(df, ["a"]), 2).first()
    parts = stats.numeric_state(df.where(F.col("i") < cut), ["a"]).unionByName(stats.numeric_state(df.where(F.col("i") >= cut), ["a"]))
    merged = stats.numeric_report(stats.merge_numeric(parts), 2).first()
    for key in whole.asDict():
        a, b = whole[key], merged[key]
        assert a == b or b == pytest.approx(a, abs=0.02, rel=1e-9), key


def test_numeric_report_of_nothing(spark):
    row = stats.numeric_report(stats.numeric_state(spark.createDataFrame([], "a string"), ["a"])).first()
    assert row["count"] == 0 and row["missing_frequency"] == 1.0 and row["std"] == 0.0 and row["min"] is None


def test_blank_cells_differ_by_kind(spark):
    df = spark.createDataFrame([("  ",), ("1",), (None,)], "a string")
    n = stats.numeric_state(df, ["a"]).first()
    assert (n["count"], n["missing"], n["nonvalid"]) == (1, 1, 1)
    levels = {r["level"]: r["count"] for r in stats.level_counts(df, ["a"]).collect()}
    assert levels == {None: 2, "1": 1}


def test_id_sketches_merge(spark):
    a, b = (stats.id_sketch(spark.range(lo, lo + 1000).selectExpr("cast(id as string) id"), "id") for lo in (0, 500))
    assert stats.merge_ids(a.union(b)).first()[0] == pytest.approx(1500, rel=0.05)


def test_bin_labels(spark):
    edges = [0.0, 1.0, 1.0, 2.0]
    df = spark.createDataFrame([(x,) for x in ("-1", "0", "1", "2", "3", "nan", "x", None)], "c string")
    assert [r[0] for r in df.select(bins.label("c", edges)).collect()] == ["(c < 0.0)", "(0.0 <= c < 1.0)", "(1.0 <= c <= 2.0)", "(1.0 <= c <= 2.0)", "(c > 2.0)", "(c > 2.0)", None, None]


def test_edges_of_odd_columns(spark):
    df = spark.createDataFrame([("5", None), ("5", None)], "a string, b string")
    assert bins.fit_edges(df, ["a", "b"]) == {"a": [5.0, 5.0 + 1e-9], "b": [0.0, 1.0]}
    assert bins.fit_edges(df, ["b"], method="equal_width") == {"b": [0.0, 1.0]}


def test_blank_category_is_an_item(spark):
    df = spark.createDataFrame([("  ",), ("",), (" x",)], "c string")
    assert [r[0] for r in df.select(bins.items({}, {"c": None})).collect()] == [["c = "], [], ["c = x"]]


def brute_rules(sets, least, confidence):
    n = len(sets)
    universe = sorted(set().union(*sets))
    count = lambda s: sum(set(s) <= t for t in sets)
    out = {}
    for k in range(2, len(universe) + 1):
        for s in combinations(universe, k):
            if (c := count(s)) >= least * n:
                for j in range(1, k):
                    for a in combinations(s, j):
                        b = tuple(x for x in s if x not in a)
                        if c / count(a) >= confidence:
                            out[a, b] = (c / n, c / count(a), c / count(a) / (count(b) / n))
    return out


def test_rules_have_consequents_of_any_size(spark):
    sets = [set("abc"), set("ab"), set("ac"), set("abc")]
    df = spark.createDataFrame([(sorted(s),) for s in sets], "items array<string>")
    s = RuleSettings(min_support=0.5, min_confidence=0.5)
    slim, n = rules.compressed(df, s)
    got = {(tuple(r["antecedent"]), tuple(r["consequent"])): (r["support"], r["confidence"], r["lift"]) for r in rules.all_rules(rules.frequent_sets(slim, n, 0.5), n, 0.5).collect()}
    want = brute_rules(sets, 0.5, 0.5)
    assert got.keys() == want.keys() and (("a",), ("b", "c")) in got
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_rare_items_and_empty_transactions_go(spark):
    df = spark.createDataFrame([(["a"],)] * 9 + [(["z"],), ([],)], "items array<string>")
    slim, n = rules.compressed(df, RuleSettings(min_support=0.2))
    assert n == 9 and slim.count() == 9
    with pytest.raises(ValueError):
        rules.compressed(df, RuleSettings(min_support=0.01, max_items=1))


def counts(spark, **levels):
    return spark.createDataFrame([("c", k, v) for k, v in levels.items()], "column string, level string, count long")


def test_divergence(spark):
    js = lambda a, b: drift.divergence(a, b).first()["js_divergence"]
    a, b = counts(spark, x=5, y=5), counts(spark, z=4)
    assert js(a, a) == pytest.approx(0, abs=1e-9)
    assert js(a, b) == pytest.approx(math.log(2), rel=1e-6) and js(b, a) == pytest.approx(js(a, b))
    assert 0 < js(a, counts(spark, x=5, y=5, w=1)) < math.log(2)


def test_drift_monitor_and_policy(spark):
    df = spark.createDataFrame([(str(i), "a") for i in range(20)], "n string, c string")
    late = spark.createDataFrame([(str(i + 500), "b") for i in range(20)], "n string, c string")
    state = lambda d: (stats.numeric_state(d, ["n"]), stats.level_counts(d, ["c"]))
    report = drift.monitor(state(df), state(late), DriftLimits())
    assert report["status"] == "critical" and len(report["actions"]) == 5
    assert report["actions"][0].startswith("retrain or recalibrate") and report["actions"][3:] == ["retrain without or repair n", "retrain without or repair c"]
    assert drift.actions("ok") == ["none: within tolerance"] and len(drift.actions("no_reference")) == len(drift.actions("no_current")) == 1
    with pytest.raises(drift.DataDriftPolicyError):
        drift.enforce(report, DriftLimits(fail_on="critical"))
    drift.enforce(report, DriftLimits(fail_on="nonsense"))
    assert drift.monitor(None, state(df), DriftLimits())["status"] == "no_reference"
    with pytest.raises(drift.DataDriftPolicyError):
        drift.enforce({"status": "no_current"}, DriftLimits(fail_on_incomplete=True))


def test_prep_parameters(spark):
    df = spark.createDataFrame([("1", "b"), ("2", "a"), ("3", "a"), ("4", None), (None, "a")], "n string, c string")
    p = prep.fit(df, ["n"], ["c"], "tree")
    assert p.fill["n"] == 2.5 and p.levels["c"] == ["a", "b"] and p.level_fill["c"] == "a"
    new = spark.createDataFrame([(None, "zz")], "n string, c string")
    assert tuple(p.transform(new).first()) == (2.5, -1)
    onehot = prep.fit(spark.createDataFrame([("1", "a"), ("3", "b")], "n string, c string"), ["n"], ["c"], "mlp_ohe")
    assert [tuple(r) for r in onehot.transform(spark.createDataFrame([("1", "a"), ("3", "zz")], "n string, c string")).collect()] == [(-1, 1, 0), (1, 0, 0)]
    assert prep.fit(spark.createDataFrame([(None,)], "n string"), ["n"], []).constant_filled == ["n"]
    assert p.transform(spark.createDataFrame([("a",)], "c string")).columns == ["n", "c"]
    assert prep.resolve_variant("tree", "mlp") == "mlp_ohe" and prep.resolve_variant("ordinal", "mlp") == "mlp_ordinal"


def test_folds(spark):
    df = models.positions(spark.range(11).withColumnRenamed("id", "k"), ["k"])
    assert [r["position"] for r in df.orderBy("k").collect()] == list(range(11))
    sizes = {r["f"]: r["count"] for r in df.groupBy(models.kfold(F.col("position"), 11, 3).alias("f")).count().collect()}
    assert sizes == {0: 4, 1: 4, 2: 3}
    series = models.time_series(df, 11, 3).groupBy("fold", "role").agg(F.min("position"), F.max("position")).collect()
    assert {(r[0], r[1]): (r[2], r[3]) for r in series} == {(0, "train"): (0, 4), (0, "test"): (5, 6), (1, "train"): (0, 6), (1, "test"): (7, 8), (2, "train"): (0, 8), (2, "test"): (9, 10)}


def test_family_choice(spark):
    df = spark.createDataFrame([(r, 0.0, 0.0) for r in (10, 9000)] + [(9000, 0.5, 0.0), (9000, 0.0, 0.4)], "rows long, missing_row_share double, outlier_row_share double")
    assert [r[0] for r in df.select(models.family(AutoSettings())).collect()] == ["tree", "mlp", "tree", "tree"]


def test_outliers_and_gaps(spark):
    df = spark.createDataFrame([(str(i),) for i in range(20)] + [("1000",), ("inf",), (None,)], "n string")
    row = models.row_rates(df, ["n"], [], 4.0).first()
    assert row["rows"] == 23 and row["missing_row_share"] == pytest.approx(1 / 23) and row["outlier_row_share"] == pytest.approx(2 / 23)


def test_models_and_bundles(spark, tmp_path):
    df = spark.range(400).selectExpr("id as k", "cast(id % 20 as string) n", "cast(id % 3 as string) c", "cast(id % 20 * 3 as double) t")
    p = prep.fit(df, ["n"], ["c"], "tree")
    data, names = models.matrix(df, p, F.col("t"), "k")
    model, metrics = models.train("tree", data, names, Validation(), "k", iterations=4, depth=3)
    assert metrics["r2"] > 0.5
    models.save_bundle(spark, f"file://{tmp_path}/b", model, p, metrics)
    again, q, bundle = models.load_bundle(spark, f"file://{tmp_path}/b")
    assert models.evaluate(again, data) == pytest.approx(models.evaluate(model, data)) and q == p
    before = models.evaluate(model, data)["rmse"]
    assert models.evaluate(model.update(data), data)["rmse"] <= before
    mlp = models.MlpModel(epochs=30, rate=1e-2).fit(*models.matrix(df, prep.fit(df, ["n"], ["c"], "mlp_ohe"), F.col("t"), "k"))
    scaled, _ = models.matrix(df, prep.fit(df, ["n"], ["c"], "mlp_ohe"), F.col("t"), "k")
    assert models.evaluate(mlp, scaled)["rmse"] < 20
    _, cv = models.train("tree", data, names, Validation(mode="time_series", splits=2), "k", iterations=2, depth=2)
    assert cv["n_folds"] == 2


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_network_learns_from_small_partitions(spark, parts):
    df = spark.range(0, 400, 1, parts).selectExpr("id as k", "cast(id % 20 as string) n", "cast(id % 3 as string) c", "cast(id % 20 * 3 as double) t")
    data, names = models.matrix(df, prep.fit(df, ["n"], ["c"], "mlp_ohe"), F.col("t"), "k")
    assert models.evaluate(models.MlpModel(epochs=30, rate=1e-2).fit(data, names), data)["rmse"] < 8


def test_model_drift(spark, tmp_path):
    limits = ModelDriftLimits(enabled=True, fail_on="critical")
    report = monitor.assess(spark, {"rmse": 13.0}, {"rmse": 10.0}, limits)
    assert report["status"] == "critical" and report["stress_ratio"] == pytest.approx(1.3)
    monitor.record(spark, report, f"file://{tmp_path}/h")
    monitor.record(spark, report, f"file://{tmp_path}/h")
    assert spark.read.json(f"file://{tmp_path}/h").count() == 2
    with pytest.raises(monitor.ModelDriftPolicyError):
        monitor.enforce(report, limits)


def test_store_and_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('d,x,y\n08-AUG-11,"say ""hi""\nthere",1\n\nbad,,2\n09-AUG-11,z\n')
    rows = csv.scan(spark, f"file://{tmp_path}/a.csv")
    got = [(r["row_number"], r["d"], r["x"], r["y"]) for r in rows.orderBy("row_number").collect()]
    assert got == [(1, "08-AUG-11", 'say "hi"\nthere', "1"), (2, "bad", None, "2"), (3, "09-AUG-11", "z", None)]
    path = f"file://{tmp_path}/store"
    store.init(spark, path)
    for _ in range(2):
        store.append(store.to_events(rows, "d", "%d-%b-%y", ["d", "x", "y"]), path)
    events = store.open_store(spark, path)
    assert events.count() == 6 and store.in_range(events, "2011-08-09").count() == 2 and store.in_range(events, "2011-08-09", shift_days=-1).count() == 4
    assert store.ordered(events).first()["event_date"] is None
    assert store.reset(spark, path, f"file://{tmp_path}/none") == [path] and not store.exists(spark, path)


def test_yaml_report(spark, tmp_path):
    import yaml

    store.write_yaml(spark, {"status": "ok", "n": [1, 2]}, f"file://{tmp_path}/r.yaml")
    assert yaml.safe_load((tmp_path / "r.yaml").read_text()) == {"status": "ok", "n": [1, 2]}


def test_capped_edges_repeat(spark):
    df = spark.range(1000).selectExpr("cast(id as string) a")
    assert bins.fit_edges(df, ["a"], cap=100) == bins.fit_edges(df.repartition(7), ["a"], cap=100)


def test_training_loader(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,y\n1,2\n,3\n4,x\n")
    roles = Roles("y", numeric=("a",))
    assert csv.load_training(spark, f"file://{tmp_path}/t.csv", roles, strict=False).count() == 1
    with pytest.raises(Exception, match="no number"):
        csv.load(spark, f"file://{tmp_path}/t.csv", roles).collect()
    with pytest.raises(ValueError):
        csv.load(spark, None, roles)


def test_clean_rows_and_contract(spark):
    df = spark.createDataFrame([("1", "2", "a"), ("x", "2", "a"), ("1", "", "a"), ("1", "2", "  ")], "y string, n string, c string")
    roles = Roles("y", numeric=("n",), categorical=("c",))
    assert quality.clean_rows(df, roles).count() == 1
    assert quality.feature_contract(roles, ["rule_0"]) == {"numeric": ["n", "rule_0"], "categorical": ["c"]}


def test_text(spark):
    df = spark.createDataFrame([("The CAT, sat on it!! 42x",), ("",)], "text string")
    assert [r[0] for r in df.select(text.cleaned()).collect()] == ["cat sat 42x", ""]
    pred = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "l int, p int")
    row = text.classification_metrics(pred, "l", "p").first()
    assert row["accuracy"] == 0.75 and row["balanced_accuracy"] == 0.75 and row["weighted_precision"] == pytest.approx(5 / 6)


def test_profile_page(spark, tmp_path):
    df = spark.createDataFrame([("1", "2", "a"), ("3", "4", "b")], "y string, n string, c string")
    html = eda.profile(df, Roles("y", numeric=("n",), categorical=("c",)), str(tmp_path / "p.html"))
    assert "correlations" in html and (tmp_path / "p.html").exists()


def test_config():
    c = from_dict({"roles": {"target": "y", "numeric": ["a"]}, "rules": {"levels": 1}, "sources": ["x.csv"]})
    assert c.rules.levels == 2 and c.roles.features == ("a",)
    with pytest.raises(ValueError):
        from_dict({"roles": {"target": "y", "wrong": 1}})


@pytest.mark.parametrize("most", [200_000, 40])
def test_exact_quantiles(spark, monkeypatch, most):
    """Against numpy: ties, few values, one value, none, infinities; also with brackets that have to be narrowed."""
    import numpy as np

    from tallymill.operators import quantiles

    monkeypatch.setattr(quantiles, "MOST", most)
    rng = np.random.default_rng(4)
    n = 30_000
    data = [rng.normal(0, 1, n), rng.integers(0, 7, n).astype(float), np.round(rng.exponential(3, n), 1), np.full(n, 2.5), rng.choice([-np.inf, 0.0, 1.0, np.inf], n)]
    rows = [(*(float(c[i]) for c in data), float(i) if i < 9 else None, None) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(7))).repartition(5)
    shares = [0.0, 0.1, 1 / 3, 0.5, 0.77, 1.0]
    got = quantiles.exact(df, [F.col(f"c{i}") for i in range(7)], shares)
    for own, c in zip(got, data[:4]):
        assert own == pytest.approx(np.quantile(c, shares).tolist(), abs=1e-12)
    assert got[4][0] == -np.inf and got[4][-1] == np.inf and got[4][3] in (0.0, 0.5, 1.0)
    assert got[5] == pytest.approx(np.quantile(np.arange(9.0), shares).tolist()) and got[6] is None
    assert quantiles.exact(df.limit(0), [F.col("c0")], [0.5]) == [None] and quantiles.exact(df, [], [0.5]) == []
