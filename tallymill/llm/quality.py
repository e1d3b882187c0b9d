"""Quality classifier: a sparse rule ensemble over text statistics.

Statistics of each whole text (shares of byte classes, word and line counts,
repetition, entropy) feed small boosted trees; every path from a root becomes a
conjunctive rule; a lasso logistic regression keeps few rules with weights; and the
kept rules are compiled into one Spark column expression that scores all rows.

Training reads at most ``bound`` labelled rows (20,000 by default: those with the
lowest hash of doc_id), a documented bound; scoring covers every row. Labels and
statistics of a repeated doc_id are averaged. Without labels of both classes the score is the
smoothed label share.

A null or empty text has zero statistics and a score like any other. Ties and
repeated rows score alike; an empty table gives an empty result; other columns are
kept by ``score_rows`` and never looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tallymill.llm.common import pieces, spare, texts_of

STATS = (
    "log_bytes", "log_words", "word_bytes", "long_words", "unique_words", "top_word", "pair_repeats", "lines", "line_bytes", "repeated_lines", "upper",
    "digit", "space", "period", "comma", "exclaim", "bar", "marks", "quote", "high", "entropy", "top_byte", "letters", "vowels",
)
_CLASSES = {
    "upper": range(65, 91), "digit": range(48, 58), "space": [9, 10, 11, 12, 13, 32], "period": [46], "comma": [44], "exclaim": [33, 63], "bar": [124],
    "marks": [35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 92, 94, 95, 123, 125, 126], "quote": [34, 39, 40, 41, 45, 58, 59, 91, 93, 96], "high": range(128, 256),
    "letters": [*range(65, 91), *range(97, 123)], "vowels": [b for v in b"aeiou" for b in (v, v - 32)],
}
_SHARES = np.zeros((256, len(_CLASSES)))
for _i, _bytes in enumerate(_CLASSES.values()):
    _SHARES[list(_bytes), _i] = 1


def statistics(texts: list[bytes]) -> np.ndarray:
    """(texts x STATS)."""
    n = len(texts)
    counts = np.zeros((n, 256))
    own = np.zeros((n, len(STATS)))
    for i, text in enumerate(texts):
        if not text:
            continue
        counts[i] = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
        words = text.lower().split()
        lines = text.split(b"\n")
        k = len(words)
        seen: dict[bytes, int] = {}
        for w in words:
            seen[w] = seen.get(w, 0) + 1
        row = own[i]
        row[0], row[1] = math.log1p(len(text)), math.log1p(k)
        if k:
            row[2] = sum(map(len, words)) / k
            row[3] = sum(v for w, v in seen.items() if len(w) > 12) / k
            row[4], row[5] = len(seen) / k, max(seen.values()) / k
            row[6] = 1 - len(set(zip(words, words[1:]))) / (k - 1) if k > 1 else 0.0
        full = [x for x in lines if x]
        row[7], row[8] = math.log1p(len(full)), len(text) / (len(full) or 1)
        row[9] = 1 - len(set(full)) / len(full) if full else 0.0
    total = counts.sum(axis=1)
    safe = np.maximum(total, 1)[:, None]
    shares = counts @ _SHARES / safe
    for j, name in enumerate(_CLASSES):
        own[:, STATS.index(name)] = shares[:, j]
    p = counts / safe
    with np.errstate(divide="ignore", invalid="ignore"):
        own[:, STATS.index("entropy")] = -np.nansum(np.where(p > 0, p * np.log2(p), 0.0), axis=1)
    own[:, STATS.index("top_byte")] = p.max(axis=1) if n else 0
    return np.round(own, 9) + 0.0


def with_statistics(docs: DataFrame, name: str = "__stats") -> DataFrame:
    """All columns of ``docs`` and the statistics as one array column."""
    names = docs.columns
    given = docs.schema

    def run(batches):
        for batch in pieces(batches):
            values = statistics(texts_of(batch.column("text")))
            stats = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * len(STATS), pa.int32()), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, stats], names=[*names, name])

    return docs.mapInArrow(run, StructType([*given.fields, StructField(name, ArrayType(DoubleType()))]))


@dataclass(frozen=True)
class Rule:
    """All conditions hold: statistic ``i`` is at most (``True``) or over (``False``) the cut."""

    conditions: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for i, under, cut in self.conditions:
            out &= (x[:, i] <= cut) if under else (x[:, i] > cut)
        return out

    def column(self, stats: Column) -> Column:
        parts = [(F.get(stats, F.lit(i)) <= F.lit(cut)) if under else (F.get(stats, F.lit(i)) > F.lit(cut)) for i, under, cut in self.conditions]
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out

    def __str__(self) -> str:
        return " and ".join(f"{STATS[i]} {'<=' if under else '>'} {cut:g}" for i, under, cut in self.conditions)


@dataclass
class RuleModel:
    bias: float
    rules: list[tuple[Rule, float]]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, weight in self.rules:
            z += weight * rule.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self, stats: Column) -> Column:
        """The score as a Spark expression; terms are added pairwise to keep the tree flat."""
        terms = [F.lit(self.bias), *(F.when(r.column(stats), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.rules)]
        while len(terms) > 1:
            terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-terms[0]))


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 48) -> list[Rule]:
    """Paths of gradient-boosted trees on binned statistics, each node below a root a rule."""
    cuts = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for i in range(x.shape[1])]
    coded = np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)], axis=1)
    z = np.full(len(y), math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    found: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        nodes = [(np.arange(len(y)), ())]
        for _ in range(depth):
            below = []
            for rows, path in nodes:
                best = (1e-3, None)
                total_g, total_h = g[rows].sum(), h[rows].sum()
                for i, c in enumerate(cuts):
                    if len(c) < 1:
                        continue
                    left_g = np.cumsum(np.bincount(coded[rows, i], g[rows], len(c) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(coded[rows, i], h[rows], len(c) + 1))[:-1]
                    gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], (i, k))
                if best[1] is None:
                    z[rows] += rate * total_g / (total_h + 1)
                    continue
                i, k = best[1]
                low = coded[rows, i] <= k
                for mask, under in ((low, True), (~low, False)):
                    rule = (*path, (i, under, float(cuts[i][k])))
                    found[Rule(rule)] = None
                    below.append((rows[mask], rule))
            nodes = below
        for rows, _ in nodes:
            z[rows] += rate * g[rows].sum() / (h[rows].sum() + 1)
    return list(found)


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 200) -> tuple[float, np.ndarray]:
    """(bias, weights) by accelerated proximal gradient; the bias isn't penalised."""
    n = len(y)
    bias = math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    w = np.zeros(a.shape[1], dtype=a.dtype)
    v = np.ones(a.shape[1], dtype=a.dtype)
    for _ in range(20):  # the largest singular value, for the step
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 4 / ((np.linalg.norm(a @ v) ** 2) / n + 1)
    wy, by, t = w, bias, 1.0
    for _ in range(steps):
        r = (1 / (1 + np.exp(-(a @ wy + by))) - y).astype(a.dtype)
        new = wy - step * (a.T @ r) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_bias = by - step * float(r.mean())
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        wy, by = new + (t - 1) / nt * (new - w), new_bias + (t - 1) / nt * (new_bias - bias)
        w, bias, t = new, new_bias, nt
    return bias, w


def fit_statistics(x: np.ndarray, y: np.ndarray, penalties=(1e-2, 3e-3, 1e-3)) -> RuleModel:
    """The sparsest of the penalties whose deviance on a fifth kept aside is within 2 % of the best."""
    share = (y.sum() + 1) / (len(y) + 2)
    if len(y) < 20 or y.min() == y.max():
        return RuleModel(float(math.log(share / (1 - share))), [])
    rules = tree_rules(x, y)
    a = np.stack([r.holds(x) for r in rules], axis=1).astype(np.float32)
    aside = np.arange(len(y)) % 5 == 4
    loss = []
    for penalty in penalties:
        b, w = lasso_logistic(a[~aside], y[~aside], penalty)
        z = a[aside] @ w + b
        loss.append(float(np.logaddexp(0, np.where(y[aside] > 0.5, -z, z)).mean()))
    chosen = next(p for p, x_ in zip(penalties, loss) if x_ <= 1.02 * min(loss) + 1e-4)
    bias, w = lasso_logistic(a, y, chosen)
    return RuleModel(float(bias), [(r, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-6])


def training_part(labels: DataFrame, mod: int = 5) -> DataFrame:
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % mod != 0)


def fit(docs: DataFrame, labels: DataFrame, bound: int = 20_000, target: str = "quality") -> RuleModel:
    """Learn from at most ``bound`` labelled documents outside the held-out part."""
    known = training_part(labels).where(F.col(target).isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg((F.avg(target) >= 0.5).cast("int").alias("__label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # ``bound`` rows at most
    means = [F.round(F.avg(F.get("__stats", F.lit(i))), 9).alias(f"s{i}") for i in range(len(STATS))]
    each = with_statistics(texts).groupBy("doc_id").agg(F.first("__label").alias("label"), *means)  # a row a label, however often its doc_id occurs
    rows = each.orderBy("doc_id").collect() if bound else []
    x = np.array([[r[f"s{i}"] for i in range(len(STATS))] for r in rows]).reshape(-1, len(STATS))
    return fit_statistics(x, np.array([r["label"] for r in rows], dtype=np.float64))


def score_rows(docs: DataFrame, model: RuleModel, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score; a column that is named like it already is replaced."""
    stats = spare(docs.columns, "__stats")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != name.lower()]
    return with_statistics(docs, stats).select(*kept, model.column(F.col(stats)).alias(name))
