"""Frequent item sets and association rules with consequents of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.config import RuleSettings
from tallymill.sources.store import checkpointed


def item_support(transactions: DataFrame, items: str = "items", n: int | None = None) -> DataFrame:
    """(item, count, support) over all transactions, ``n`` of them if known."""
    n = transactions.count() if n is None else n
    each = transactions.select(F.explode(F.array_distinct(items)).alias("item")).groupBy("item").agg(F.count("*").alias("count"))
    return each.select("item", "count", (F.col("count") / F.lit(n)).alias("support"))


def compressed(transactions: DataFrame, settings: RuleSettings, items: str = "items") -> tuple[DataFrame, int]:
    """(transactions of frequent items only, how many remain).

    The floor counts all transactions; emptied ones then leave, so supports are
    shares of what remains. Transactions are computed once and kept in the shared folder.
    """
    transactions = checkpointed(transactions)
    whole, none = "\0all", "\0none"
    marks = F.array_append(F.when(F.size(items) == 0, F.array(F.lit(none))).otherwise(F.array_distinct(items)), F.lit(whole))
    each = transactions.select(F.explode(marks).alias("item")).groupBy("item").agg(F.count("*").alias("count"))
    rows = each.orderBy(F.desc("count"), "item").limit(settings.max_items + 3).collect()
    total = {r["item"]: r["count"] for r in rows}
    n, empty = total.pop(whole, 0), total.pop(none, 0)
    floor = max(1, int(settings.min_support * n))
    kept = [item for item, count in total.items() if count >= floor]
    if len(kept) > settings.max_items:
        raise ValueError(f"over {settings.max_items} distinct items")
    if len(kept) == len(total) <= settings.max_items:  # nothing to drop
        return transactions.withColumn(items, F.array_distinct(items)).where(F.size(items) > 0), n - empty
    allowed = F.array(*map(F.lit, kept)) if kept else F.array().cast("array<string>")
    slim = transactions.withColumn(items, F.array_intersect(F.array_distinct(items), allowed)).where(F.size(items) > 0)
    return slim, slim.count()


def sample(transactions: DataFrame, settings: RuleSettings, key: str, seed: int = 0) -> DataFrame:
    """A repeatable subsample by hash; everything where no cap is set."""
    if settings.max_transactions is None:
        return transactions
    return transactions.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(settings.max_transactions)


def frequent_sets(transactions: DataFrame, n: int, min_support: float, items: str = "items") -> DataFrame:
    """(items sorted, size, count, support)."""
    from pyspark.ml.fpm import FPGrowth

    model = FPGrowth(itemsCol=items, minSupport=min_support, minConfidence=1.0).fit(transactions)
    found = model.freqItemsets
    return found.select(F.sort_array("items").alias("items"), F.size("items").cast("long").alias("size"), F.col("freq").cast("long").alias("count"), (F.col("freq") / F.lit(n)).alias("support"))


def all_rules(sets: DataFrame, n: int, min_confidence: float) -> DataFrame:
    """(antecedent, consequent, count, support, confidence, lift): every split of every set.

    FPGrowth's own rules have single consequents; here each set is cut by all bit
    masks and met with the counts of both parts.
    """
    masks = F.sequence(F.lit(1), (F.shiftleft(F.lit(1), 30) / F.pow(F.lit(2), 30 - F.col("size"))).cast("int") - 2)
    split = sets.where(F.col("size") > 1).select("items", "count", F.explode(masks).alias("mask"))
    bit = lambda wanted: F.expr(f"filter(items, (x, i) -> (shiftright(mask, i) & 1) = {wanted})")
    split = split.select(bit(1).alias("antecedent"), bit(0).alias("consequent"), "count")
    a = sets.select(F.col("items").alias("antecedent"), F.col("count").alias("n_a"))
    b = sets.select(F.col("items").alias("consequent"), F.col("count").alias("n_b"))
    out = split.join(a, "antecedent").join(b, "consequent")
    confidence = F.col("count") / F.col("n_a")
    out = out.withColumn("support", F.col("count") / F.lit(n)).withColumn("confidence", confidence).withColumn("lift", confidence / (F.col("n_b") / F.lit(n)))
    return out.where(F.col("confidence") >= min_confidence).select("antecedent", "consequent", "count", "support", "confidence", "lift")


def top_rules(rules: DataFrame, settings: RuleSettings) -> DataFrame:
    text = [F.array_join("antecedent", " + "), F.array_join("consequent", " + ")]
    return rules.where(F.col("lift") >= settings.min_lift).orderBy(F.desc("lift"), F.desc("confidence"), *text).limit(settings.top_k)


def rule_report(rules: DataFrame, settings: RuleSettings, precision: int = 3) -> list[dict]:
    """Texts, rounded measures and insights of the top rules (top_k rows at most)."""
    out = []
    for i, r in enumerate(rules.collect()):
        kind = "strong" if r["confidence"] > settings.strong_confidence else "interesting" if r["lift"] > settings.interesting_lift else None
        out.append(
            {
                "rule": f"{' + '.join(r['antecedent'])} -> {' + '.join(r['consequent'])}",
                "support": round(r["support"], precision), "confidence": round(r["confidence"], precision), "lift": round(r["lift"], precision),
                "insight": kind, "feature": {"name": f"rule_{i}", "antecedent": list(r["antecedent"])},
            }
        )
    return out


def feature_specs(report: list[dict], settings: RuleSettings) -> list[dict]:
    return [r["feature"] for r in report][: settings.max_features]


def flag(items: Column, antecedent: list[str]) -> Column:
    """1 where the row holds all items of the antecedent."""
    return (F.size(F.array_except(F.array(*map(F.lit, antecedent)), items)) == 0).cast("int")


def flags(items: Column, specs: list[dict]) -> list[Column]:
    return [flag(items, s["antecedent"]).alias(s["name"]) for s in specs]
