"""Text cleaning, term weights, decompositions and classification metrics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.sources.store import checkpointed

#: A short list of English function words.
STOP_WORDS = (
    "a", "about", "after", "all", "an", "and", "are", "as", "at", "be", "been", "but", "by", "for", "from", "had", "has", "have", "he", "her", "his", "if",
    "in", "into", "is", "it", "its", "not", "of", "on", "or", "she", "so", "that", "the", "their", "them", "they", "this", "to", "was", "we", "were",
    "which", "who", "will", "with", "would", "you", "your",
)


def lowered(c: str | Column = "text") -> Column:
    return F.lower(F.col(c) if isinstance(c, str) else c)


def cleaned(c: str | Column = "text", stop: tuple[str, ...] = STOP_WORDS, least: int = 3) -> Column:
    """Lower case, only a-z, 0-9 and white space, no stop words, no short words."""
    return F.array_join(words(c, stop, least), " ")


def words(c: str | Column = "text", stop: tuple[str, ...] = STOP_WORDS, least: int = 3) -> Column:
    plain = F.regexp_replace(lowered(c), r"[^a-z0-9\s]", "")
    split = F.filter(F.split(plain, r"\s+"), lambda w: F.length(w) >= least)
    return F.filter(split, lambda w: ~w.isin(list(stop)))


def tfidf(df: DataFrame, key: str = "doc_id", text: str = "text", max_features: int | None = None, min_df: int = 1, max_df: float = 1.0) -> DataFrame:
    """(key, term, tf, df, weight): smoothed idf, rows of unit length.

    Terms outside the document-frequency limits or beyond the ``max_features`` most
    frequent ones are left out.
    """
    n = df.count()
    terms = df.select(key, F.explode(words(text, stop=("",), least=2)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    terms = checkpointed(terms)
    seen = terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("_all")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    if max_features is not None:
        seen = seen.orderBy(F.desc("_all"), "term").limit(max_features)
        seen = F.broadcast(seen) if max_features <= 100_000 else seen  # as many rows at most
    weighted = terms.join(seen.drop("_all"), "term").withColumn("_w", F.col("tf") * (F.ln((1 + F.lit(n)) / (1 + F.col("df"))) + 1))
    norm = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_n"))
    return weighted.join(norm, key).select(key, "term", "tf", "df", (F.col("_w") / F.col("_n")).alias("weight"))


def hashed_vectors(df: DataFrame, text: str = "text", features: int = 1024) -> DataFrame:
    from pyspark.ml.feature import IDF, HashingTF

    tf = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=features).transform(df.withColumn("_w", words(text)))
    return IDF(inputCol="_tf", outputCol="features").fit(tf).transform(tf).drop("_w", "_tf")


def principal_components(df: DataFrame, k: int, column: str = "features") -> DataFrame:
    from pyspark.ml.feature import PCA

    return PCA(k=k, inputCol=column, outputCol="components").fit(df).transform(df)


def truncated_svd(df: DataFrame, k: int, column: str = "features"):
    """(singular values, right vectors) of the rows as one distributed matrix."""
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    svd = RowMatrix(MLUtils.convertVectorColumnsFromML(df.select(column), column)).computeSVD(k)
    return svd.s.toArray(), svd.V.toArray()


class Factors:
    """A non-negative factorisation: ``topics`` x ``terms``, and the squared error of each round."""

    def __init__(self, terms: list[str], topics: np.ndarray):
        self.terms, self.topics, self.errors = terms, topics, []


def factorised(weights: DataFrame, keys: DataFrame, k: int, key: str = "doc_id", rounds: int = 15, inner: int = 30, seed: int = 42, most_terms: int = 100_000) -> tuple[DataFrame, Factors]:
    """((key, topics) of every row of ``keys``, the factors) of the matrix of (key, term, weight).

    Absent terms count as zeros. Each round solves all rows for the topics by multiplicative
    updates, whose only sums over rows are (rows x topics)' (rows x terms) and a k x k Gram
    matrix; the topics follow from them. The driver holds k rows of all terms, of which
    there may be ``most_terms``; a row without terms has zero topics.
    """
    terms = [r["term"] for r in weights.select("term").distinct().orderBy("term").limit(most_terms + 1).collect()]
    if len(terms) > most_terms:
        raise ValueError(f"over {most_terms} terms; limit them in tfidf")
    table = weights.sparkSession.createDataFrame(list(zip(terms, range(len(terms)))), "term string, _at int")
    cells = weights.join(F.broadcast(table), "term").groupBy(key).agg(F.collect_list(F.struct("_at", "weight")).alias("_cells"))
    rows = checkpointed(keys.select(key).join(cells, key, "left").select(key, F.col("_cells._at").alias("at"), F.col("_cells.weight").alias("w")))
    rng, spark = np.random.default_rng(seed), weights.sparkSession
    out = Factors(terms, rng.random((k, len(terms))) + 1e-3)

    def solved(batch: pa.RecordBatch, topics: np.ndarray, gram: np.ndarray):
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            dense = np.zeros((part.num_rows, topics.shape[1]))
            for i, (at, w) in enumerate(zip(part.column("at").to_pylist(), part.column("w").to_pylist())):
                dense[i, at or []] = w or []
            wanted = dense @ topics.T
            own = np.where(wanted > 0, 1.0, 0.0)
            for _ in range(inner):
                own *= wanted / (own @ gram + 1e-12)
            yield part, dense, wanted, own

    def sums(held):
        def run(batches):
            topics = held.value
            gram, n = topics @ topics.T, topics.shape[1]
            products, square, error = np.zeros((n, k)), np.zeros((k, k)), 0.0
            for batch in batches:
                for _, dense, wanted, own in solved(batch, topics, gram):
                    products += dense.T @ own
                    square += own.T @ own
                    error += float((dense**2).sum() - 2 * (own * wanted).sum() + ((own @ gram) * own).sum())
            ids = np.concatenate([np.arange(n), -1 - np.arange(k), [-1 - k]])
            values = np.concatenate([products, square, np.r_[error, np.zeros(k - 1)][None]])
            some = values.any(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some], pa.int64()), *(pa.array(values[some, j]) for j in range(k))], names=["id", *(f"c{j}" for j in range(k))])

        return run

    schema = "id long, " + ", ".join(f"c{j} double" for j in range(k))
    for _ in range(rounds if terms else 0):
        held = spark.sparkContext.broadcast(out.topics)
        total = rows.mapInArrow(sums(held), schema).groupBy("id").agg(*(F.sum(f"c{j}").alias(f"c{j}") for j in range(k))).collect()  # a row a term and topic
        products, square, error = np.zeros((len(terms), k)), np.zeros((k, k)), 0.0
        for r in total:
            values = np.array(r[1:], dtype=np.float64)
            if r[0] >= 0:
                products[r[0]] = values
            elif r[0] >= -k:
                square[-1 - r[0]] = values
            else:
                error = values[0]
        out.errors.append(error)
        for _ in range(inner):
            out.topics = out.topics * products.T / (square @ out.topics + 1e-12)
        held.destroy()
    held = spark.sparkContext.broadcast(out.topics)

    def final(batches):
        topics = held.value
        gram = topics @ topics.T
        for batch in batches:
            for part, _, _, own in solved(batch, topics, gram):
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * k), pa.array(own.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(key), lists], names=[key, "topics"])

    kind = keys.schema[key].dataType.simpleString()
    return rows.mapInArrow(final, f"`{key}` {kind}, topics array<double>"), out


def stratified(df: DataFrame, label: str, key: str, k: int, rows: int = 1_000_000) -> DataFrame:
    """``df`` with a ``fold`` of nearly equal size within each label, by hash order.

    A label is numbered in slices of its hash range, of about ``rows`` rows each, and the
    slices' counts are added up, so that a label of half the table isn't one task.
    """
    from pyspark.sql import Window

    slices = 1 << (df.count() // rows).bit_length()
    bits = slices.bit_length() - 1
    order = F.shiftrightunsigned(F.xxhash64(key), 1)
    cut = df.withColumn("_order", order).withColumn("_slice", F.shiftright("_order", 63 - bits) if bits else F.lit(0).cast("long"))
    counts = cut.groupBy(F.col(label).alias("_l"), F.col("_slice").alias("_s")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_l").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a label and slice
    starts = counts.withColumn("_before", before).drop("_n")
    numbered = cut.withColumn("_r", F.row_number().over(Window.partitionBy(label, "_slice").orderBy("_order", key)) - 1)
    both = numbered.join(starts, numbered[label].eqNullSafe(starts["_l"]) & (numbered["_slice"] == starts["_s"]))
    return both.select(*(numbered[c] for c in df.columns), F.pmod(F.col("_before") + F.col("_r"), F.lit(k)).cast("long").alias("fold"))


def classifier(name: str, features: str = "features", label: str = "label", **options):
    """Logistic regression or a random forest of 100 trees."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier

    if name == "rf":
        return RandomForestClassifier(featuresCol=features, labelCol=label, seed=42, **({"numTrees": 100} | options))
    return {"lr": LogisticRegression}[name](featuresCol=features, labelCol=label, **options)


def measured(df: DataFrame, label: str = "label", text: str = "text") -> DataFrame:
    """(step, rows, seconds, driver_peak_mb) of the vectoriser and of a classifier on its vectors, each run to its end."""
    from pyspark.ml.feature import IDF, HashingTF

    from tallymill.operators.monitor import profiled

    spark, rows = df.sparkSession, []
    tf = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=1024).transform(df.withColumn("_w", words(text)))
    idf = IDF(inputCol="_tf", outputCol="features")
    n = df.count()

    def step(name: str, fn):
        out, report = profiled(fn)
        rows.append((name, n, report["seconds"], report["python_peak_mb"]))
        return out

    model = step("vectorizer fit", lambda: idf.fit(tf))
    vectors = step("vectorizer transform", lambda: checkpointed(model.transform(tf).select(F.col(label).cast("double").alias("label"), "features")))
    fitted = step("classifier fit", lambda: classifier("lr").fit(vectors))
    step("classifier predict", lambda: fitted.transform(vectors).agg(F.sum("prediction")).first())
    return spark.createDataFrame(rows, "step string, rows long, seconds double, driver_peak_mb double")


def cross_validated(df: DataFrame, name: str, k: int = 5, label: str = "label", key: str = "doc_id") -> DataFrame:
    """(fold, accuracy, weighted_f1, ...) of each stratified fold."""
    folds = checkpointed(stratified(df, label, key, k).withColumn(label, F.col(label).cast("double")))
    out = None
    for i in range(k):
        model = classifier(name, label=label).fit(folds.where(F.col("fold") != i))
        scored = classification_metrics(model.transform(folds.where(F.col("fold") == i)), label, "prediction").withColumn("fold", F.lit(i))
        out = scored if out is None else out.unionByName(scored)
    return out


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(accuracy, weighted_precision, weighted_recall, weighted_f1, balanced_accuracy, n) from the confusion table."""
    pairs = df.groupBy(F.col(label).alias("l"), F.col(prediction).alias("p")).agg(F.count("*").alias("c"))
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("l").alias("k"), F.when(F.col("l") == F.col("p"), F.col("c")).otherwise(zero).alias("tp"), F.col("c").alias("of"), zero.alias("said")),
        F.struct(F.col("p").cast(pairs.schema["l"].dataType).alias("k"), zero.alias("tp"), zero.alias("of"), F.col("c").alias("said")),
    )
    per = pairs.select(F.explode(sides).alias("s")).groupBy("s.k").agg(*(F.sum(f"s.{x}").alias(x) for x in ("tp", "of", "said")))
    precision = F.when(F.col("said") > 0, F.col("tp") / F.col("said")).otherwise(0.0)
    recall = F.when(F.col("of") > 0, F.col("tp") / F.col("of")).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    all_ = F.sum("of")
    return per.agg(
        (F.sum("tp") / all_).alias("accuracy"), (F.sum(precision * F.col("of")) / all_).alias("weighted_precision"), (F.sum(recall * F.col("of")) / all_).alias("weighted_recall"),
        (F.sum(f1 * F.col("of")) / all_).alias("weighted_f1"), F.avg(F.when(F.col("of") > 0, recall)).alias("balanced_accuracy"), all_.alias("n"),
    )


def best_model(scores: DataFrame, by: str = "weighted_f1") -> DataFrame:
    return scores.groupBy("model").agg(F.avg(by).alias("score")).agg(F.max_by("model", "score").alias("model"), F.max("score").alias("score"))
