import random

import pytest

from tallymill import __main__ as cli
from tallymill.config import from_dict
from tallymill.plans import lifecycle


@pytest.fixture()
def config(tmp_path):
    rng = random.Random(3)
    for name, shift in (("a", 0), ("b", 100)):
        lines = ["ID,DAY,N,M,C,Y"]
        for i in range(300):
            n = rng.randrange(50)
            lines.append(f"{i},{1 + i % 28:02d}-{'JAN' if name == 'a' else 'FEB'}-11,{n + shift if i % 20 else ''},{rng.random():.3f},{'u' if n < 25 else 'v'},{n * 2 if n > 10 else 0}")
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
    return from_dict(
        {
            "roles": {"target": "Y", "datetime": "DAY", "id": "ID", "numeric": ["N", "M"], "categorical": ["C"]},
            "sources": [f"file://{tmp_path}/a.csv"], "store": f"file://{tmp_path}/store", "reports": f"file://{tmp_path}/reports",
            "engineered": {"log1p": ["N"], "ratios": [["NM", "N", "M"]], "differences": [["D", "N", "M"]]},
        }
    )


def test_whole_life(spark, config, tmp_path):
    lifecycle.build_reference(spark, config)
    lifecycle.ensure_data(spark, config)
    assert lifecycle.check_drift(spark, config)["status"] == "ok"
    lifecycle.add_data(spark, config, [f"file://{tmp_path}/b.csv"])
    report = lifecycle.check_drift(spark, config)
    assert report["status"] in ("warn", "critical") or any(r["mean_shift_sigmas"] > 1 for r in report["numeric"])
    out = lifecycle.train(spark, config, "auto", f"file://{tmp_path}/m", date_until="2011-01-31", iterations=3, depth=3)
    assert out["kind"] == "tree" and out["metrics"]["r2"] > 0.3
    val = lifecycle.validate(spark, config, f"file://{tmp_path}/m", date_until="2011-01-31")
    assert val["metrics"]["n"] > 200 and val["drift"]["metric"] == "RMSE"
    assert lifecycle.update(spark, config, f"file://{tmp_path}/m", f"file://{tmp_path}/m2", path_csv=f"file://{tmp_path}/b.csv")["n"] > 200
    assert lifecycle.clear(spark, config)


@pytest.mark.parametrize(
    "argv",
    [[], ["--clear", "--mode", "train"], ["--mode", "add_data"], ["--mode", "train", "--new", "tree"], ["--mode", "val", "--path-csv", "x"], ["--drift-ref", "--mode", "val"]],
)
def test_bad_options(argv):
    with pytest.raises(SystemExit):
        cli.checked(cli.parser().parse_args(argv))


def test_a_load_parses_its_files_once(spark, config, tmp_path, monkeypatch):
    from tallymill.sources import csv, store

    (tmp_path / "two").mkdir()
    for name, n in (("x", 700), ("y", 1500)):
        (tmp_path / "two" / f"{name}.csv").write_text("ID,DAY,N,M,C,Y\n" + "".join(f'{i},03-JAN-11,{i},1,"u\nv",2\n' for i in range(n)))
    path, parsed = f"file://{tmp_path}/two", []
    cells = csv._cells
    monkeypatch.setattr(csv, "_cells", lambda *a: parsed.append(a) or cells(*a))
    lifecycle.add_data(spark, config, [path], judge=False)
    assert len(parsed) == 1
    numbered = {(r["source_path"].rsplit("/", 1)[-1], r["row_number"], r["raw_json"]) for r in store.open_store(spark, config.store).collect()}
    scanned = csv.scan(spark, path)
    assert {(n, k) for n, k, _ in numbered} == {(r["source_path"].rsplit("/", 1)[-1], r["row_number"]) for r in scanned.collect()}
    assert all(f'"ID":"{k - 1}"' in doc for _, k, doc in numbered) and len(numbered) == 2200
    assert not list((tmp_path).glob("**/landed-*"))


def test_life_writes_its_files_in_parallel(spark, tmp_path):
    """Each load is a folder of files, so no single task writes or reads all rows."""
    from tallymill.plans import inventory

    spark.range(8000).selectExpr("id as l_orderkey", "cast(1 as int) l_linenumber", "cast(if(id % 2 = 0, '1996-01-01', '1998-07-01') as timestamp) l_shipdate", *(f"1.0D as {c}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")), "'A' l_returnflag", "'O' l_linestatus").repartition(4).write.parquet(f"file://{tmp_path}/lineitem.parquet")
    _, early, late = inventory._life(spark, f"file://{tmp_path}")
    for path in (early, late):
        assert spark.read.csv(path).inputFiles().__len__() > 1
