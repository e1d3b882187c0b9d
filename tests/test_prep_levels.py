from pyspark.sql import functions as F

from tallymill.operators import models, prep


def test_rare_levels_share_an_indicator(spark):
    """60 levels, the first ten more frequent: 49 have their own indicator, 11 share one."""
    rows = [(f"v{i:02d}",) for i in range(60)] + [(f"v{i:02d}",) for i in range(10)]
    p = prep.fit(spark.createDataFrame(rows, "c string"), [], ["c"], "mlp_ohe")
    assert len(p.output) == 50 and p.levels["c"] == [f"v{i:02d}" for i in range(49)]
    out = p.transform(spark.createDataFrame([("v00",), ("v48",), ("v49",), ("v59",), ("zz",), (None,)], "c string"))
    assert out.columns == p.output
    got = [tuple(r) for r in out.collect()]
    place = [r.index(1.0) if sum(r) else None for r in got]
    assert place == [0, 48, 49, 49, None, 0] and all(sum(r) in (0, 1) for r in got)
    fifty = prep.fit(spark.createDataFrame(rows[:50], "c string"), [], ["c"], "mlp_ohe")
    assert len(fifty.levels["c"]) == 50 and not fifty.tail["c"]


def test_ordinals_past_the_array(spark):
    """More levels than a literal array, and than the former limit of 100,000."""
    n = 100_005
    df = spark.range(n).selectExpr("lpad(id, 6, '0') AS c")
    p = prep.fit(df, [], ["c"], "tree")
    new = spark.createDataFrame([("000000",), ("100004",), ("zz",)], "c string")
    assert sorted(r["c"] for r in p.transform(new).collect()) == [-1, 0, n - 1]
    q = prep.fit(df, [], ["c"], "mlp_ohe")
    assert sorted(r[-1] for r in q.transform(new).collect()) == [0, 0, 1] and q.output[-1] == "c:__OTHER__"


def test_matrix_of_many_levels(spark):
    df = spark.range(1500).selectExpr("id AS k", "lpad(id, 4, '0') AS c")
    for variant, width in (("tree", 1), ("mlp_ohe", 50)):
        data, names = models.matrix(df, prep.fit(df, [], ["c"], variant), F.lit(1.0), "k")
        rows = {r["k"]: [r[n] for n in names] for r in data.collect()}
        assert len(rows) == 1500 and len(names) == width
        assert rows[1499] == ([1499.0] if variant == "tree" else [0.0] * 49 + [1.0])
