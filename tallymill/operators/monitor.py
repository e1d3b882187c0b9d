"""Model drift: metrics against the baseline's, history, policy."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.config import ModelDriftLimits
from tallymill.operators.drift import RANKS, normal_fail_on
from tallymill.sources import store

HISTORY = "at double, label string, metric string, value double, status string"


class ModelDriftPolicyError(RuntimeError):
    """The model is at least as much worse as the policy allows."""


def stress(metric: Column, current: Column, baseline: Column) -> Column:
    """How much worse the current value is: 1 is no worse, infinite past repair, NULL unknown.

    Errors grow, R2 shrinks.
    """
    inf = F.lit(float("inf"))
    r2 = F.when(baseline <= 0, F.lit(None).cast("double")).when(current >= baseline, F.lit(1.0)).when(current <= 0, inf).otherwise(baseline / current)
    error = F.when(baseline > 0, current / baseline)
    return F.when(F.upper(metric) == "R2", r2).otherwise(error)


def judged(df: DataFrame, limits: ModelDriftLimits) -> DataFrame:
    """(metric, baseline, current, stress_ratio, status) of rows (metric, baseline, current)."""
    ratio = stress(F.col("metric"), F.col("current"), F.col("baseline"))
    state = F.when(ratio.isNull(), "unknown").when(ratio >= limits.critical_ratio, "critical").when(ratio >= limits.warn_ratio, "warn").otherwise("ok")
    return df.select("metric", "baseline", "current", ratio.alias("stress_ratio"), state.alias("status"))


def assess(spark: SparkSession, current: dict, baseline: dict, limits: ModelDriftLimits) -> dict:
    key = limits.metric.lower()
    rows = spark.createDataFrame([(limits.metric, float(baseline[key]), float(current[key]))], "metric string, baseline double, current double")
    return judged(rows, limits).first().asDict() | {"warn_ratio": limits.warn_ratio, "critical_ratio": limits.critical_ratio}


def record(spark: SparkSession, report: dict, path: str, label: str = "val") -> None:
    row = (time.time(), label, report["metric"], float(report["current"]), report["status"])
    store.write_report(spark.createDataFrame([row], HISTORY), path, append_rows=True)


def enforce(report: dict, limits: ModelDriftLimits) -> None:
    level = normal_fail_on(limits.fail_on)
    if limits.enabled and level != "off" and RANKS.get(report["status"], 0) >= RANKS[level]:
        raise ModelDriftPolicyError(f"{report['metric']} is {report['status']}: {report['current']:.6g} against {report['baseline']:.6g}")


def profiled(fn, folder: str | None = None, mode: str = "run", spark: SparkSession | None = None):
    """(result, report): wall time, the driver's hottest functions, its Python peak and the JVM's used memory.

    With a ``folder`` of the driver's, a run gets a folder below it with a page for time
    and one for memory, and a line in the manifest.
    """
    import cProfile
    import io
    import pstats
    import tracemalloc

    profile, began = cProfile.Profile(), time.time()
    tracemalloc.start()
    try:
        result = profile.runcall(fn)
        seconds = time.time() - began
        peak, lines = tracemalloc.get_traced_memory()[1], tracemalloc.take_snapshot().statistics("lineno")[:25]
    finally:
        tracemalloc.stop()
    out = io.StringIO()
    pstats.Stats(profile, stream=out).sort_stats("cumulative").print_stats(25)
    jvm = spark.sparkContext._jvm.java.lang.Runtime.getRuntime() if spark is not None else None
    report = {"mode": mode, "seconds": seconds, "functions": out.getvalue(), "python_peak_mb": peak / 1e6, "jvm_used_mb": (jvm.totalMemory() - jvm.freeMemory()) / 1e6 if jvm else None}
    if folder:
        import json
        from datetime import datetime
        from html import escape
        from pathlib import Path

        stamp = datetime.now().strftime("%Y%m%d-%H%M%S-%f")
        run = Path(folder) / f"{mode}-{stamp}"
        run.mkdir(parents=True)
        (run / "time.html").write_text(f"<html><body><h1>{seconds:.2f} s</h1><pre>{escape(report['functions'])}</pre></body></html>")
        (run / "memory.html").write_text(f"<html><body><h1>{report['python_peak_mb']:.1f} MB</h1><pre>{escape(chr(10).join(map(str, lines)))}</pre></body></html>")
        with (Path(folder) / "manifest.jsonl").open("a") as f:
            f.write(json.dumps({"at": stamp, "mode": mode, "run": run.name, "seconds": seconds, "python_peak_mb": report["python_peak_mb"], "time": "time.html", "memory": "memory.html"}) + "\n")
    return result, report
