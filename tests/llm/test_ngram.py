import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from xxhash import xxh64_intdigest

from tallymill.llm import eliasfano as ef
from tallymill.llm import ngram

END = b"\n"


@pytest.mark.parametrize("n,u", [(1, 1), (1, 10**9), (1000, 10**12), (5000, 6000), (3000, 5000 * 10**6), (10, 64), (200, 200)])
def test_elias_fano(n, u):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, u, n))
    seq = ef.EliasFano(**ef.build(v, u))
    assert (seq[np.arange(n)] == v).all()
    q = np.concatenate([rng.integers(0, u, 1000), v])
    at, found = seq.successor(q)
    assert (at == np.searchsorted(v, q)).all() and (found == np.isin(q, v)).all()


def test_elias_fano_with_a_dense_stretch():
    v = np.concatenate([np.arange(5000) * 10**7, 5 * 10**10 + np.arange(20000)])
    seq = ef.EliasFano(**ef.build(v, 10**11))
    at, found = seq.successor(v + 1)
    assert (at == np.searchsorted(v, v + 1)).all() and (found == np.isin(v + 1, v)).all()


def test_elias_fano_selects_over_long_runs():
    rng = np.random.default_rng(5)
    for v in (np.arange(40_000), np.concatenate([np.arange(30_000), 10**9 + np.arange(3)]), np.sort(rng.choice([7, 10**6, 10**6 + 1], 9_000)), np.zeros(700, int)):
        seq = ef.EliasFano(**ef.build(v, int(v[-1]) + 2))
        assert (seq[np.arange(len(v))] == v).all()
        q = np.unique(np.concatenate([v, v + 1, rng.integers(0, v[-1] + 1, 500)]))
        at, found = seq.successor(q)
        assert (at == np.searchsorted(v, q)).all() and (found == np.isin(q, v)).all()


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_tokens_are_those_of_bytes(kind):
    texts = ["", " ", None, "\t A\x0bb\x0cC\r\nÀ É ", "x\x1cy\x1dz\x85w\xa0v\u2028u\x00t", "a a  A b", "  ", "Z" * 40, "🙂 ſ K İ"]
    want = [[*(t or "").encode().lower().split(), END] for t in texts]
    for a, b in ((0, len(texts)), (2, 6), (0, 2), (1, 1), (6, 7)):
        hashes, codes, sizes = ngram.tokens_of(pa.array(texts, kind).slice(a, b - a))
        assert sizes.tolist() == [len(w) for w in want[a:b]] and len(set(hashes.tolist())) == len(hashes)
        assert hashes[codes].tolist() == [xxh64_intdigest(x) for w in want[a:b] for x in w]
        assert hashes[-1] == xxh64_intdigest(END) and len(hashes) == len({END}.union(*want[a:b]))


def test_small_batches_visit_a_segment_once(real, monkeypatch):
    """Look-ups are gathered over batches: their number doesn't follow the batches' number."""
    df = real.select("doc_id", "text", ngram.held_out().alias("held_out"))
    model = ngram.Model(ngram.train(df, 2_000))
    rows = pa.Table.from_batches(df.toArrow().to_batches())
    visits, look_up = [], ngram.Segment.look_up
    monkeypatch.setattr(ngram.Segment, "look_up", lambda self, *a: visits.append(id(self)) or look_up(self, *a))
    whole = pa.Table.from_batches(ngram.scored(model, iter(rows.to_batches())))
    once, visits[:] = len(visits), []
    small = pa.Table.from_batches(ngram.scored(model, iter(rows.to_batches(max_chunksize=3))))
    assert once > 5 and len(visits) == once == len(set(visits))
    monkeypatch.setattr(ngram, "BLOCK", 50_000)  # words are looked up by smaller blocks than pairs
    visits[:] = []
    parts = pa.Table.from_batches(ngram.scored(model, iter(rows.to_batches(max_chunksize=3))))
    assert len(visits) == once and small.equals(whole) and parts.equals(whole)


def test_a_text_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(ngram, "BLOCK", 64)
    monkeypatch.setattr(ngram, "PAIRS", 100)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a b " * 40, "", None, "b c", "c c c", "d " * 500, "a"] * 3)], "doc_id long, text string")
    model = ngram.Model(ngram.train(df, 20))
    rows = df.withColumn("held_out", ngram.held_out()).toArrow()
    got = pa.Table.from_batches(ngram.scored(model, iter(rows.to_batches(max_chunksize=2))))
    want = brute([(r["doc_id"], r["text"]) for r in df.collect()])
    assert got["doc_id"].to_pylist() == [w[0] for w in want] and got["n_tokens"].to_pylist() == [w[1] for w in want]
    assert got["base_score"].to_pylist() == pytest.approx([w[4] for w in want], abs=1e-6)
    assert got["score"].to_pylist() == pytest.approx([w[5] for w in want], abs=0.2)


def brute(rows):
    tokens = [(d, [*(t or "").encode().lower().split(), END]) for d, t in rows]
    training = [t for d, t in tokens if d is not None and zlib.crc32(str(d).encode()) % 10]
    c, pairs = Counter(), Counter()
    for t in training:
        c.update(t)
        pairs.update(zip([END, *t], t))
    total, size = sum(c.values()), len(c)
    less = ngram.discounts([sum(v == k for v in pairs.values()) for k in (1, 2, 3, 4)])
    kinds = defaultdict(lambda: [0, 0, 0])
    for (a, _), n in pairs.items():
        kinds[a][min(n, 3) - 1] += 1
    out = []
    for d, t in tokens:
        base = score = 0.0
        for a, b in zip([END, *t], t):
            under = (c[b] + 0.1) / (total + 0.1 * (size + 1))
            base += math.log10(under)
            p = under
            if c[a]:
                back = sum(x * y for x, y in zip(kinds[a], less)) / c[a]
                n = pairs[a, b]
                p = back * under + ((n - less[min(n, 3) - 1]) / c[a] if n else 0)
            score += math.log10(p)
        out.append((d, len(t), sum(c[w] > 0 for w in t), total, base, score))
    return out


def compare(df, tokens):
    got = sorted((tuple(r) for r in ngram.score(df, ngram.train(df.repartition(3), tokens)).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[6]))
    want = sorted(brute([(r["doc_id"], r["text"]) for r in df.collect()]), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[5]))
    for g, w in zip(got, want, strict=True):
        assert (g[0], g[2], g[3], g[4]) == w[:4]
        assert g[1] == (g[0] is None or zlib.crc32(str(g[0]).encode()) % 10 == 0)
        assert g[5] == pytest.approx(w[4], abs=1e-6) and g[6] == pytest.approx(w[5], abs=3e-4 * g[2])


def test_as_brute_force(real):
    compare(real.select("doc_id", "text"), 2_000_000)


def test_words_over_several_segments(real):
    compare(real.select("doc_id", "text").limit(60), 300)


def test_odd_rows(docs, none, spark):
    compare(docs, 50_000)
    assert ngram.score(none, ngram.train(none)).count() == 0
    held = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    row = ngram.score(held, ngram.train(held)).first()
    assert row["train_tokens"] == 0 and row["n_known"] == 0 and row["score"] == pytest.approx(row["base_score"])


def test_held_out_text_is_likelier_than_by_words_alone(spark):
    from tallymill.llm import queries

    rows = [r for r in queries.op1_ngram_score(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
