import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tallymill.llm import neardup


def brute_kept(rows, least=0.8):
    """doc_ids that stay among (doc_id, text) with exact shingle sets, all pairs compared."""
    rows = sorted(rows)
    words = [(t or "").encode().lower().split() for _, t in rows]
    sets = [{b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {rows[i][0] for i in range(len(rows)) if find(i) == i}


def test_stage_as_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute_kept([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = [r["doc_id"] for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()]
    assert len(got) == len(want) and set(got) == want


def test_many_near_copies(spark):
    """Copies at similarities on both sides of 0.8, most of them many bits apart."""
    rng = np.random.default_rng(5)
    rows = []
    for g in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        for edits in (0, 2, 4, 5, 6, 7, 9, 12):
            words = list(base)
            for at in rng.choice(200, edits, replace=False):
                words[at] = f"n{rng.integers(0, 10**9)}"
            rows.append((len(rows), " ".join(words)))
    want = brute_kept(rows)
    got = {r["doc_id"] for r in neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == want and 12 < len(want) < 96


def test_odd_rows(docs, none):
    kept = neardup.keep_one(docs)
    rows = kept.collect()
    ids = [r["doc_id"] for r in rows]
    assert kept.columns == docs.columns and ids.count(8) == 1 and 5 not in ids and 2 in ids and not {3, 4} & set(ids)
    assert neardup.keep_one(none).count() == 0


def test_pairs_of_a_bucket_never_become_rows(spark, monkeypatch):
    """Many texts about 0.7 alike: all pairs of a bucket are met in blocks, and none is given out for verification."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(240)]
    texts = []
    for k in range(90):
        words = list(base)
        for at in rng.choice(240, 8, replace=False):
            words[at] = f"x{k}y{at}"
        texts.append(" ".join(words))
    texts += [" ".join([*texts[7].split(" ")[:-1], "end"]), " ".join([*texts[8].split(" ")[:-2], "an", "end"])]
    monkeypatch.setattr(neardup, "EDGE", 16)
    calls, real = [], neardup.similar
    monkeypatch.setattr(neardup, "similar", lambda *a: calls.append(a) or real(*a))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in neardup.keep_one(docs).collect()}
    assert len(calls) == 2  # pairs of fingerprints and of buckets' ends
    sets = [neardup.shingle_set(t.encode()) for t in texts]
    up = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if neardup.jaccard(sets[a], sets[b]) >= 0.8 and up[a] != up[b]:
                low, high = sorted((up[a], up[b]))
                up = [low if u == high else u for u in up]
    assert kept == set(up) and 2 <= len(kept) < len(texts)


def test_blocks_of_a_bucket_miss_no_pair(spark, monkeypatch):
    """One bucket of 60 texts in blocks of about 7: the links join what brute force joins."""
    monkeypatch.setattr(neardup, "EDGE", 7)
    texts = [" ".join(f"g{k // 3}w{i}" for i in range(100)) + f" tail{k % 3}" for k in range(60)]
    nodes = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "node long, text string")
    rows = neardup.signatures(nodes).join(nodes, "node").withColumn("root", F.col("node")).withColumn("count", F.lit(97)).withColumn("n", F.lit(60))
    rows = rows.withColumn("bands", F.transform("bands", lambda _: F.lit(5).cast("long"))).withColumn("key", F.lit(5).cast("long"))
    for tasks in (0, 4):
        links = {(r["a"], r["b"]) for r in neardup.linked(rows, tasks=tasks).collect()}
        assert all(a // 3 == b // 3 for a, b in links) and {a // 3 for a, _ in links} == set(range(20))
        up = list(range(60))
        for a, b in links:
            up = [up[a] if u == up[b] else u for u in up]
        assert all(up[3 * g] == up[3 * g + 1] == up[3 * g + 2] for g in range(20))
