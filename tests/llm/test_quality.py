import math
import zlib

import numpy as np
import pytest

from tallymill.llm import quality


def test_compiled_score_is_the_models(spark, docs):
    rng = np.random.default_rng(0)
    x = rng.random((400, len(quality.STATS)))
    y = ((x[:, 3] > 0.5) & (x[:, 7] < 0.6)).astype(float)
    model = quality.fit_statistics(x, y)
    assert 0 < len(model.rules) < 300 and ((model.score(x) >= 0.5) == (y > 0.5)).mean() > 0.95
    scored = quality.score_rows(docs, model)
    stats = quality.statistics([(r["text"] or "").encode() for r in docs.collect()])
    assert [r["score"] for r in scored.collect()] == pytest.approx(model.score(stats).tolist())
    assert scored.columns == [*(c for c in docs.columns if c != "score"), "score"]  # the old one is replaced
    odd = docs.withColumn("__stats", quality.F.lit(1)).withColumn("__score", quality.F.lit("mine"))
    kept = quality.score_rows(odd, model, "other")
    assert kept.columns == [*odd.columns, "other"] and {r["__score"] for r in kept.collect()} == {"mine"}


def test_rules_are_tree_paths():
    x = np.zeros((200, len(quality.STATS)))
    x[:, 2] = np.arange(200)
    y = (x[:, 2] > 99).astype(float)
    rules = quality.tree_rules(x, y, trees=1, depth=1)
    assert len(rules) == 2 and {c[0][1] for c in (r.conditions for r in rules)} == {True, False}
    assert (rules[0].holds(x) ^ rules[1].holds(x)).all()


def test_lasso_is_sparse():
    rng = np.random.default_rng(1)
    a = (rng.random((500, 40)) > 0.5).astype(np.float32)
    y = a[:, 0].astype(float)
    _, w = quality.lasso_logistic(a, y, 0.02)
    assert abs(w[0]) > 0.5 and (np.abs(w[1:]) < 0.05).all()


def test_held_out_accuracy(spark):
    from tallymill.llm import queries

    rows = queries.op10_rule_quality(spark, "/root/testdata/sf0.01").collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(rows) == 1000 and np.mean([p == q for p, q in held]) > 0.93
    assert all(p == 1 for p, q in held if q == 1)


def test_odd_tables(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    scores = [r["score"] for r in quality.score_rows(docs, model).collect()]
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
    assert quality.score_rows(none, quality.fit(none, labels.limit(0))).count() == 0


def brute_statistics(text):
    """The statistics of one text, one after another, from their names."""
    words, lines = text.lower().split(), [x for x in text.split(b"\n") if x]
    size, k = len(text), len(words)
    counts = [text.count(bytes([b])) for b in range(256)]
    share = lambda members: sum(counts[b] for b in members) / max(size, 1)
    p = [c / size for c in counts if c]
    letters = [b for b in range(256) if chr(b).isascii() and chr(b).isalpha()]
    out = {
        "log_bytes": math.log1p(size), "log_words": math.log1p(k), "word_bytes": sum(map(len, words)) / k if k else 0, "long_words": sum(len(w) > 12 for w in words) / k if k else 0,
        "unique_words": len(set(words)) / k if k else 0, "top_word": max(map(words.count, set(words))) / k if k else 0,
        "pair_repeats": 1 - len(set(zip(words, words[1:]))) / (k - 1) if k > 1 else 0, "lines": math.log1p(len(lines)), "line_bytes": size / (len(lines) or 1) if size else 0,
        "repeated_lines": 1 - len(set(lines)) / len(lines) if lines else 0, "upper": share(range(65, 91)), "digit": share(range(48, 58)), "space": share(b" \t\n\x0b\x0c\r"),
        "period": share(b"."), "comma": share(b","), "exclaim": share(b"!?"), "bar": share(b"|"), "marks": share(b"#$%&*+/<=>@\\^_{}~"), "quote": share(b"\"'()-:;[]`"),
        "high": share(range(128, 256)), "entropy": -sum(x * math.log2(x) for x in p), "top_byte": max(p, default=0), "letters": share(letters), "vowels": share(b"aeiouAEIOU"),
    }
    return [out[name] for name in quality.STATS]


def test_statistics_as_brute_force(docs, real):
    texts = [(r["text"] or "").encode() for r in [*docs.collect(), *real.limit(40).collect()]]
    texts = [t if len(t) < 60_000 else t[:5000] for t in texts]
    for own, t in zip(quality.statistics(texts), texts):
        assert own.tolist() == pytest.approx(brute_statistics(t), abs=2e-9), t[:50]


def test_first_split_is_the_best():
    """Against every cut of every statistic."""
    rng = np.random.default_rng(7)
    x = np.round(rng.random((300, len(quality.STATS))), 2)
    y = (x[:, 5] + 0.3 * rng.random(300) > 0.7).astype(float)
    rule = quality.tree_rules(x, y, trees=1, depth=1, bins=1000)[0]
    p = (y.mean() + 1e-3) / (1 + 2e-3)
    start = 1 / (1 + np.exp(-np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))))
    g, h = y - start, np.full(len(y), max(start * (1 - start), 1e-6))
    value = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    best = max(((value(x[:, i] <= c) + value(x[:, i] > c), i, c) for i in range(x.shape[1]) for c in np.unique(x[:, i])[:-1]), key=lambda t: t[0])
    i, _, cut = rule.conditions[0]
    assert value(x[:, i] <= cut) + value(x[:, i] > cut) == pytest.approx(best[0], rel=1e-9) and 0 < p < 1


def test_lasso_is_optimal():
    """The optimality conditions of the penalised problem."""
    rng = np.random.default_rng(3)
    a = (rng.random((400, 12)) > 0.5).astype(np.float64)
    y = (a[:, 0] + a[:, 3] + 0.5 * rng.random(400) > 1.2).astype(float)
    penalty = 0.02
    bias, w = quality.lasso_logistic(a, y, penalty, steps=4000)
    r = 1 / (1 + np.exp(-(a @ w + bias))) - y
    grad = a.T @ r / len(y)
    assert abs(r.mean()) < 1e-4 and (np.abs(grad) <= penalty + 1e-4).all()
    assert np.allclose(grad[w != 0], -penalty * np.sign(w[w != 0]), atol=1e-4)


def test_query_as_brute_force(spark):
    """held_out and predicted by their rules, the score by the rules over statistics made here."""
    from tallymill.llm import queries

    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    for r in queries.op10_rule_quality(spark, sf).collect():
        stats = np.round(brute_statistics(texts[r["doc_id"]]), 9)
        z = model.bias + sum(w for rule, w in model.rules if all(stats[i] <= c if under else stats[i] > c for i, under, c in rule.conditions))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3)


def test_repeated_ids_are_one_row(spark, monkeypatch):
    """A labelled doc_id on many rows brings one row to the driver."""
    seen = []
    monkeypatch.setattr(quality, "fit_statistics", lambda x, y: seen.append((len(x), len(y))))
    docs = spark.range(3000).select(quality.F.lit(7).cast("long").alias("doc_id"), quality.F.concat(quality.F.lit("text "), "id").alias("text"))
    quality.fit(docs, spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, quality int"), bound=10)
    assert seen == [(1, 1)]
