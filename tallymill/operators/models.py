"""Splits, metrics, regressors on a log target, family choice, variant sweep."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.config import AutoSettings, Validation
from tallymill.functions import expr as E
from tallymill.operators import prep, quantiles
from tallymill.sources.store import checkpointed


# ---- splits


def holdout(key: str | Column, share: float, seed: int = 42) -> Column:
    """Whether a row is in the test part; the same row always falls on the same side."""
    k = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.xxhash64(k, F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)


def positions(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Rows numbered from 0 in order, by range partitions and their counts.

    Ranges come from a sample that two jobs could draw differently, so the
    partitions are checkpointed before they are counted.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    parts = checkpointed(parts)
    counts = {r["_p"]: r["n"] for r in parts.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # a row a partition
    starts, at = {}, 0
    for p in sorted(counts):
        starts[p] = at
        at += counts[p]
    if not starts:
        return df.withColumn(name, F.lit(0).cast("long"))
    table = df.sparkSession.createDataFrame(list(starts.items()), "_p int, _start long")  # a row a partition
    within = F.col("_i") - F.shiftleft(F.col("_p").cast("long"), 33)
    return parts.join(F.broadcast(table), "_p").withColumn(name, F.col("_start") + within).drop("_p", "_i", "_start")


def kfold(position: Column, n: int, k: int) -> Column:
    """Contiguous folds; the first n mod k hold one row more."""
    size, more = divmod(n, k)
    edge = more * (size + 1)
    big = F.floor(position / F.lit(size + 1))
    small = F.lit(more) + F.floor((position - edge) / F.lit(max(size, 1)))
    return F.when(position < edge, big).otherwise(small).cast("long")


def shuffled_fold(key: Column, k: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(k)).cast("long")


def time_series(df: DataFrame, n: int, k: int, position: str = "position") -> DataFrame:
    """Each row once a fold: ``train`` before the fold's block, ``test`` within it."""
    block = n // (k + 1)
    folds = F.array(*(F.struct(F.lit(i).cast("long").alias("fold"), F.lit(n - (k - i) * block).cast("long").alias("_start")) for i in range(k)))
    out = df.select("*", F.explode(folds).alias("_f")).select("*", "_f.fold", F.col("_f._start").alias("_start")).drop("_f")
    role = F.when(F.col(position) < F.col("_start"), "train").when(F.col(position) < F.col("_start") + block, "test")
    return out.withColumn("role", role).where(F.col("role").isNotNull()).drop("_start")


# ---- metrics


def regression_metrics(df: DataFrame, target: str = "y", prediction: str = "p") -> DataFrame:
    """(rmse, rmsle, r2, n); predictions are clipped at 0 for rmsle."""
    y, p = F.col(target), F.col(prediction)
    gap = F.log1p(F.greatest(p, F.lit(0.0))) - F.log1p(y)
    sse = F.sum((y - p) * (y - p))
    return df.agg(
        F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"), F.sqrt(F.avg(gap * gap)).alias("rmsle"),
        (1 - sse / (F.var_pop(y) * F.count(y))).alias("r2"), F.count(y).alias("n"),
    )


def fold_summary(folds: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, mean, std, n_folds) of a row a fold; the deviation is the population's."""
    cells = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics))
    return folds.select(F.explode(cells).alias("c")).groupBy("c.metric").agg(F.avg("c.v").alias("mean"), F.stddev_pop("c.v").alias("std"), F.count("*").alias("n_folds"))


# ---- choice of the family


def fences(df: DataFrame, columns: list[str], factor: float = 4.0) -> dict[str, tuple[float, float]]:
    """Quartile fences of finite cells; columns with under 4 of them or no spread have none."""
    parsed = [E.number(df, c) for c in columns]
    df = df.select(*(F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v).alias(f"_v{i}") for i, v in enumerate(parsed)))
    values = [F.col(f"_v{i}") for i in range(len(columns))]
    row = df.agg(*(F.count(v).alias(f"n{i}") for i, v in enumerate(values))).first()
    out = {}
    for i, (c, own) in enumerate(zip(columns, quantiles.exact(df, values, [0.25, 0.75]))):
        if row[f"n{i}"] >= 4 and own[1] > own[0]:
            low, high = own
            out[c] = (low - factor * (high - low), high + factor * (high - low))
    return out


def row_rates(df: DataFrame, numeric: list[str], categorical: list[str], factor: float = 4.0) -> DataFrame:
    """(rows, missing_row_share, outlier_row_share)."""
    edges = fences(df, numeric, factor) if numeric else {}
    missing, outlier = F.lit(False), F.lit(False)
    for c in (*numeric, *categorical):
        missing = missing | E.missing_trimmed(c)
    df = df.select("*", *(E.number(df, c).alias(f"_o{i}") for i, c in enumerate(numeric)))
    for i, c in enumerate(numeric):
        v = F.col(f"_o{i}")
        odd = F.isnan(v) | (F.abs(v) == float("inf"))
        if c in edges:
            odd = odd | (v < edges[c][0]) | (v > edges[c][1])
        outlier = outlier | F.coalesce(odd, F.lit(False))
    share = lambda x: F.coalesce(F.avg(x.cast("double")), F.lit(0.0))
    return df.agg(F.count("*").alias("rows"), share(missing).alias("missing_row_share"), share(outlier).alias("outlier_row_share"))


def family(s: AutoSettings) -> Column:
    """tree for few rows, many gaps or many outliers; else the default."""
    few = F.col("rows") < s.min_rows
    return F.when(few | (F.col("missing_row_share") > s.missing_share) | (F.col("outlier_row_share") > s.outlier_share), "tree").otherwise(s.default)


# ---- regressors


@dataclass
class TreeModel:
    """Gradient-boosted trees on the log target; updates add boosters on what is left over."""

    stages: list = field(default_factory=list)
    iterations: int = 20
    depth: int = 4
    seed: int = 42
    residual_variance: float = 0.0
    features: list[str] = field(default_factory=list)

    def _vectors(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        return VectorAssembler(inputCols=self.features, outputCol="_x", handleInvalid="keep").transform(df)

    def predict_log(self, df: DataFrame) -> DataFrame:
        out, total = self._vectors(df), F.lit(0.0)
        for i, stage in enumerate(self.stages):
            out = stage.setPredictionCol(f"_p{i}").transform(out)
            total = total + F.col(f"_p{i}")
        return out.withColumn("_log", total).drop("_x", *(f"_p{i}" for i in range(len(self.stages))))

    def _boost(self, df: DataFrame, label: Column) -> None:
        from pyspark.ml.regression import GBTRegressor

        data = self._vectors(df.withColumn("_label", label))
        self.stages.append(GBTRegressor(featuresCol="_x", labelCol="_label", maxIter=self.iterations, maxDepth=self.depth, seed=self.seed).fit(data))
        left = self.predict_log(df.withColumn("_y", F.log1p("y"))).agg(F.var_pop(F.col("_y") - F.col("_log"))).first()[0]
        self.residual_variance = float(left or 0.0)

    def fit(self, df: DataFrame, features: list[str]) -> TreeModel:
        self.features, self.stages = list(features), []
        self._boost(df, F.log1p("y"))
        return self

    def update(self, df: DataFrame) -> TreeModel:
        left = self.predict_log(df).withColumn("_left", F.log1p("y") - F.col("_log")).drop("_log")
        self._boost(left, F.col("_left"))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return self.predict_log(df).withColumn("p", prep.from_log("_log", self.residual_variance)).drop("_log")

    def save(self, path: str) -> None:
        for i, stage in enumerate(self.stages):
            stage.write().overwrite().save(f"{path}/stage-{i}")

    def meta(self) -> dict:
        return {"kind": "tree", "stages": len(self.stages), "iterations": self.iterations, "depth": self.depth, "seed": self.seed, "residual_variance": self.residual_variance, "features": self.features}


@dataclass
class MlpModel:
    """A small ReLU network on the log target, fitted on all rows where they are.

    Spark has no network regressor. In each epoch every partition goes on from the same
    weights through its own rows in small batches (Adam), and the new weights are averaged
    by rows; a tenth of the rows, by hash, is kept aside for early stopping. The driver
    holds the weights alone. Prediction is an Arrow UDF.
    """

    hidden: tuple[int, ...] = (32, 16)
    epochs: int = 60
    patience: int = 5
    rate: float = 1e-3
    seed: int = 42
    weights: list = field(default_factory=list)
    residual_variance: float = 0.0
    features: list[str] = field(default_factory=list)

    def _taken(self, df: DataFrame) -> DataFrame:
        cols = [E.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(self.features)]
        rows = df.select(F.log1p("y").alias("_y"), *cols)
        aside = F.pmod(F.xxhash64("_y", *(f"_{i}" for i in range(len(cols))), F.lit(self.seed)), F.lit(10)) == 0
        return checkpointed(rows.withColumn("_aside", aside))

    @staticmethod
    def forward(weights: list, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for i, (w, b) in enumerate(weights):
            z = out[-1] @ w + b
            out.append(np.maximum(z, 0) if i < len(weights) - 1 else z)
        return out

    @staticmethod
    def stepped(weights: list, x: np.ndarray, y: np.ndarray, rate: float, rng, batch: int = 256) -> list:
        """The weights after one pass through the rows in small batches: of few rows smaller ones, so that it has steps enough."""
        batch = min(batch, max(8, len(y) // 8))
        moments = [[[np.zeros_like(p) for p in layer] for layer in weights] for _ in range(2)]
        order, t = rng.permutation(len(y)), 0
        for a in range(0, len(order), batch):
            own = order[a : a + batch]
            acts = MlpModel.forward(weights, x[own])
            grad = 2 * (acts[-1] - y[own, None]) / len(own)
            t += 1
            new = [None] * len(weights)
            for i in range(len(weights) - 1, -1, -1):
                w, b = weights[i]
                parts = acts[i].T @ grad, grad.sum(axis=0)
                grad = grad @ w.T * (acts[i] > 0)
                step = []
                for j, (p, g) in enumerate(zip((w, b), parts)):
                    m, v = moments[0][i][j], moments[1][i][j]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    step.append(p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8))
                new[i] = tuple(step)
            weights = new
        return weights

    def _train(self, rows: DataFrame) -> None:
        rng, inputs = np.random.default_rng(self.seed), len(self.features)
        if not self.weights:
            sizes = [inputs, *self.hidden, 1]
            self.weights = [(rng.normal(0, math.sqrt(2 / a), (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:])]
        shapes = [p.shape for layer in self.weights for p in layer]
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        names = [f"_{i}" for i in range(inputs)]

        def flat(weights: list) -> np.ndarray:
            return np.concatenate([p.ravel() for layer in weights for p in layer])

        def shaped(values: np.ndarray) -> list:
            parts = [v.reshape(s) for v, s in zip(np.split(values, ends[:-1]), shapes)]
            return list(zip(parts[::2], parts[1::2]))

        def epoch(weights: np.ndarray, number: int, rate: float, seed: int):
            def run(batches):
                own, seen = shaped(weights), 0
                start, squares = own, np.zeros(2)  # of the rows aside: their number and squared error
                rng = np.random.default_rng([seed, number])
                for batch in batches:
                    x = np.stack([batch.column(n).to_numpy() for n in names], axis=1) if names else np.zeros((batch.num_rows, 0))
                    y, aside = batch.column("_y").to_numpy(), batch.column("_aside").to_numpy(zero_copy_only=False)
                    gap = MlpModel.forward(start, x[aside])[-1][:, 0] - y[aside]
                    squares += [len(gap), float((gap**2).sum())]
                    if (~aside).any():
                        own, seen = MlpModel.stepped(own, x[~aside], y[~aside], rate, rng), seen + int((~aside).sum())
                values = np.append(flat(own) * seen, [seen, *squares])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["id", "value"])

            return run

        now, best, wait = flat(self.weights), (math.inf, flat(self.weights)), 0
        for number in range(self.epochs + 1):
            sums = rows.mapInArrow(epoch(now, number, self.rate, self.seed), "id long, value double").groupBy("id").agg(F.sum("value")).collect()  # a row a weight
            total = np.zeros(len(now) + 3)
            for i, value in sums:
                total[i] = value
            seen, aside, error = total[-3:]
            if not seen:
                break
            loss = error / aside if aside else -number
            if loss < best[0] * (1 - 1e-4) or best[0] == math.inf:
                best, wait = (loss, now), 0
            else:
                wait += 1
                if wait >= self.patience:
                    break
            now = total[:-3] / seen
        self.weights = shaped(best[1])
        log = self._log()
        self.residual_variance = float(rows.select((F.col("_y") - log(names)).alias("_left")).agg(F.var_pop("_left")).first()[0] or 0.0)

    def _log(self):
        weights = self.weights

        def log_of(columns: pd.DataFrame) -> pd.Series:
            return pd.Series(MlpModel.forward(weights, columns.to_numpy(dtype=np.float64))[-1][:, 0])

        udf = F.pandas_udf(log_of, "double")
        return lambda names: udf(F.struct(*names))

    def fit(self, df: DataFrame, features: list[str]) -> MlpModel:
        self.features, self.weights = list(features), []
        self._train(self._taken(df))
        return self

    def update(self, df: DataFrame) -> MlpModel:
        self._train(self._taken(df))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        log = self._log()([E.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(self.features)])
        return df.withColumn("p", prep.from_log(log, self.residual_variance))

    def save(self, path: str) -> None:
        return None

    def meta(self) -> dict:
        return {
            "kind": "mlp", "hidden": list(self.hidden), "seed": self.seed, "residual_variance": self.residual_variance, "features": self.features,
            "weights": [[w.tolist(), b.tolist()] for w, b in self.weights],
        }


REGISTRY = {"tree": TreeModel, "mlp": MlpModel}


def evaluate(model, df: DataFrame) -> dict[str, float]:
    return regression_metrics(model.predict(df)).first().asDict()


def train(kind: str, df: DataFrame, features: list[str], validation: Validation, key: str, **options) -> tuple[object, dict]:
    """(model, metrics). Holdout keeps the model of the train part; cross validation refits on all.

    ``df`` has the features, ``y`` and ``key``. Too few rows for the folds fall back to holdout.
    """
    make = REGISTRY[kind]
    n = df.count()
    if validation.mode == "holdout" or n < 2 * validation.splits:
        test = holdout(key, validation.test_share, validation.seed)
        model = make(**options).fit(df.where(~test), features)
        return model, evaluate(model, df.where(test))
    if validation.mode == "kfold" and validation.shuffle:
        folds = df.withColumn("fold", shuffled_fold(F.col(key), validation.splits, validation.seed))
        pairs = [(folds.where(F.col("fold") != i), folds.where(F.col("fold") == i)) for i in range(validation.splits)]
    elif validation.mode == "kfold":
        folds = positions(df, [key]).withColumn("fold", kfold(F.col("position"), n, validation.splits))
        pairs = [(folds.where(F.col("fold") != i), folds.where(F.col("fold") == i)) for i in range(validation.splits)]
    else:
        folds = time_series(positions(df, [key]), n, validation.splits)
        pairs = [(folds.where((F.col("fold") == i) & (F.col("role") == "train")), folds.where((F.col("fold") == i) & (F.col("role") == "test"))) for i in range(validation.splits)]
    each = [evaluate(make(**options).fit(a, features), b) for a, b in pairs]
    metrics = {m: float(np.mean([e[m] for e in each])) for m in ("rmse", "rmsle", "r2")}
    metrics |= {f"{m}_std": float(np.std([e[m] for e in each])) for m in ("rmse", "rmsle", "r2")} | {"n_folds": len(each)}
    return make(**options).fit(df, features), metrics


def matrix(df: DataFrame, p: prep.Preprocessor, target: Column, key: str) -> tuple[DataFrame, list[str]]:
    """(features under plain names, ``y``, key), feature names."""
    names = [f"f{i}" for i in range(len(p.output))]
    cols = [c.cast("double").alias(n) for c, n in zip(p.columns(set(df.columns)), names)]
    return p.placed(df).select(key, target.alias("y"), *cols), names


def sweep(df: DataFrame, numeric: list[str], categorical: list[str], variants: list[str], kind: str, target: Column, key: str, validation: Validation, **options) -> tuple[str, dict[str, dict]]:
    """(variant of the lowest validation RMSE, metrics by variant)."""
    found = {}
    for v in variants:
        data, names = matrix(df, prep.fit(df, numeric, categorical, v), target, key)
        found[v] = train(kind, data, names, validation, key, **options)[1]
    return min(found, key=lambda v: found[v]["rmse"]), found


def save_bundle(spark: SparkSession, path: str, model, preprocessor: prep.Preprocessor, metrics: dict, parent: str | None = None) -> None:
    """A folder: the model's stages, and one JSON row with all else."""
    model.save(f"{path}/model")
    bundle = {"model": model.meta(), "preprocessor": preprocessor.to_dict(), "metrics": metrics, "parent_model": parent}
    spark.createDataFrame([(json.dumps(bundle),)], "bundle string").coalesce(1).write.mode("overwrite").text(f"{path}/bundle")


def load_bundle(spark: SparkSession, path: str) -> tuple[object, prep.Preprocessor, dict]:
    from pyspark.ml.regression import GBTRegressionModel

    bundle = json.loads(spark.read.text(f"{path}/bundle").first()[0])
    m = bundle["model"]
    if m["kind"] == "tree":
        stages = [GBTRegressionModel.load(f"{path}/model/stage-{i}") for i in range(m["stages"])]
        model = TreeModel(stages, m["iterations"], m["depth"], m["seed"], m["residual_variance"], m["features"])
    else:
        model = MlpModel(hidden=tuple(m["hidden"]), seed=m["seed"], residual_variance=m["residual_variance"], features=m["features"])
        model.weights = [(np.array(w), np.array(b)) for w, b in m["weights"]]
    return model, prep.Preprocessor(**bundle["preprocessor"]), bundle

