import random
from collections import Counter

import numpy as np
import pytest

from tallymill.llm import decontaminate as dc


def alike_of(a, b):
    both = sum(min(v, b[k]) for k, v in a.items() if k in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


def brute(text, item):
    words, own = dc.words_of(text), dc.words_of(item)
    k = min(5, len(own))
    if not own:
        return 0
    want = Counter(tuple(own[i : i + k]) for i in range(len(own) - k + 1))
    n, shingles = sum(want.values()), [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    return max((alike_of(Counter(shingles[a : a + n]), want) for a in range(len(shingles))), default=0)


def test_as_brute_force():
    rng = random.Random(7)
    items = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 5, 12, 40])))) for i in range(12)] + [(50, "x x x x x x x y"), (51, None), (52, "..")]
    index, hits = dc.Index(items), 0
    for _ in range(400):
        key, item = rng.choice(items[:13])
        words = item.split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "zz"
        cut = words[: max(1, int(len(words) * rng.choice([1, 1, 0.9, 0.7])))]
        text = " ".join([*(f"v{rng.randrange(50)}" for _ in range(rng.randrange(20))), *cut, *(f"v{rng.randrange(50)}" for _ in range(rng.randrange(20)))])
        got = {index.ids[h[0]]: h[1] for h in index.find([text])[0]}
        for k, item in items:
            alike = brute(text, item or "")
            hits += alike >= 0.8
            assert (k in got) == (alike >= 0.8), (text, item)
            if k in got:
                assert got[k] == pytest.approx(alike)
    assert hits > 50


def test_operators(spark, docs, none):
    bench = spark.createDataFrame([(1, "the cat sat on THE mat, and the dog ran off!", "e"), (2, None, "e"), (3, "", "e"), (4, "no such words are there at all", "e")], "item_id long, text string, doc_id string")
    got = sorted((r["doc_id"], r["item_id"]) for r in dc.hits(docs, bench).collect())
    assert got == [(1, 1), (5, 1)]
    assert dc.hits(docs, bench, block=1).count() == 2
    left = dc.clean(docs, bench)
    assert left.count() == docs.count() - 2 and left.columns == docs.columns
    assert dc.hits(none, bench).count() == 0 and dc.clean(none, bench).count() == 0
    assert dc.hits(docs, bench.limit(0)).count() == 0 and dc.clean(docs, bench.limit(0)).count() == docs.count()


def test_blocks_meet_everything_within_the_radius():
    rng = np.random.default_rng(0)
    for items in (3, 2 * len(dc.FLIPS)):  # without tables, and with
        prints = rng.integers(0, 256, (items, 32), dtype=np.uint8)
        group = dc.Group(list(range(items)), prints)
        assert (group.tables is None) == (items == 3)
        flips = rng.integers(0, 64, 300)
        own, windows = rng.integers(0, items, 300), []
        for i, n in zip(own, flips):
            bits = np.unpackbits(prints[i], bitorder="little")
            bits[rng.choice(256, n, replace=False)] ^= 1
            windows.append(np.packbits(bits, bitorder="little"))
        windows = np.stack(windows)
        window, item = group.candidates(windows)
        got = set(zip(window.tolist(), item.tolist()))
        assert got >= set(enumerate(own.tolist()))
        near = (np.bitwise_count(windows.view("<u2")[:, None, :] ^ prints.view("<u2")[None, :, :]) <= 3).any(axis=2)
        assert got == set(zip(*(x.tolist() for x in np.nonzero(near)))) and len(got) < 0.2 * near.size + 300


def test_query_as_brute_force(spark):
    """Every pair of a document and an item that share a shingle; without one the similarity is zero."""
    from tallymill.llm.queries import op9_decontaminate

    sf = "/root/testdata/sf0.001"
    docs, bench = ({r[0]: r[1] or "" for r in spark.read.parquet(f"{sf}/{t}.parquet").select(k, "text").collect()} for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    shingles = lambda words, k: {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}
    items = {k: dc.words_of(t) for k, t in bench.items()}
    want = {}
    for d, text in docs.items():
        words = dc.words_of(text)
        by_size = {k: shingles(words, k) for k in range(1, 6)}
        for i, own in items.items():
            k = min(5, len(own))
            if own and by_size[k] & shingles(own, k) and (alike := brute(text, bench[i])) >= 0.8:
                want[d, i] = round(alike, 6)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in op9_decontaminate(spark, sf).collect()}
    assert got == want and len(want) >= 3


def test_several_blocks_as_one(spark, real):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    one = sorted(map(tuple, dc.hits(real, bench).collect()))
    assert sorted(map(tuple, dc.hits(real, bench, block=60).collect())) == one
    assert sorted(r["doc_id"] for r in dc.clean(real, bench, block=60).collect()) == sorted(r["doc_id"] for r in dc.clean(real, bench).collect())


def test_long_text(spark):
    """Far over one batch, with an item at the very end."""
    item = " ".join(f"w{i}" for i in range(40))
    text = "lorem ipsum dolor " * 150_000 + item
    rows = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    got = dc.hits(rows, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["first_word"]) for r in got] == [(1, 7, 450_000)]
