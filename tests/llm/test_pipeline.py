import math

import numpy as np

import corpus_pipeline
from tallymill.llm import decontaminate, quality

from .test_bpe import LIBRARY
from .test_decontaminate import brute
from .test_neardup import brute_kept
from .test_quality import brute_statistics


def test_as_brute_force(spark):
    """Each stage made again by other means: plain statistics, all pairs of texts, all windows, the tokenizer library."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))

    def good(text):
        stats = np.round(brute_statistics(text.encode()), 9)
        z = model.bias + sum(w for rule, w in model.rules if all(stats[i] <= c if under else stats[i] > c for i, under, c in rule.conditions))
        return 1 / (1 + math.exp(-z)) >= corpus_pipeline.LEAST_QUALITY

    rows = {k: t for k, t in rows.items() if good(t)}
    kept = brute_kept(list(rows.items()))
    rows = {k: t for k, t in rows.items() if k in kept}
    bench = [r["text"] or "" for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    cut = [(x, decontaminate.words_of(x)) for x in bench]

    def leaked(text):
        words = decontaminate.words_of(text)
        for item, own in cut:
            k = min(5, len(own))
            if own and {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} & {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} and brute(text, item) >= 0.8:
                return True
        return False

    rows = {k: t for k, t in rows.items() if not leaked(t)}
    want = {k: (LIBRARY.encode_ordinary(t), len(t.encode())) for k, t in rows.items()}
    got = {r["doc_id"]: (np.frombuffer(bytes(r["ids"]), "<u4").tolist(), r["n_bytes"]) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and 0 < len(got) < docs.count()


def test_stages_keep_columns(spark, docs):
    odd = docs.withColumns({c: quality.F.lit(c) for c in ("__own", "__row", "__score", "__stats", "__id_hash", "__text_hash", "__number", "__maybe")})
    for name, stage in corpus_pipeline.STAGES[1:3]:
        out = stage(spark, odd, "/root/testdata/sf0.001")
        assert out.columns == odd.columns and {r["__own"] for r in out.collect()} == {"__own"}, name
    model = quality.fit(odd, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert quality.score_rows(odd, model, "__score_").drop("__score_").columns == odd.columns
