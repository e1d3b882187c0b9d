import numpy as np
from pyspark.sql import functions as F

from tallymill.llm import simhash


def brute_print(text):
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    n = len(prints)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprints(real):
    texts = [(r["text"] or "").encode() for r in real.limit(60).collect()] + [b"", b" \t", b"a", b"A b", b"a b c", "É é".encode()]
    assert simhash.fingerprints_of(texts).tolist() == [brute_print(t) for t in texts]


def test_hash_is_sparks(spark):
    h = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0]
    assert brute_print(b"a b c") == h & (1 << 64) - 1


def test_links_are_all_pairs_within_three(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64) * np.uint64(2)
    prints = set(base.tolist())
    for b in base.tolist():
        for _ in range(25):
            x = b
            for bit in rng.integers(0, 64, rng.integers(1, 6)).tolist():
                x ^= 1 << bit
            prints.add(x)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    mask = (1 << 64) - 1
    want = {(a, b) for a in signed for b in signed if a < b and ((a & mask) ^ (b & mask)).bit_count() <= 3}
    assert got == want and len(want) > 100
    rows = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).count()
    assert rows == len(want)  # each pair once


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 205)]
    roots = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(roots[i] == 0 for i in range(1, 41)) and all(roots[100 + i] == 100 for i in range(1, 30)) and roots[205] == 0


def test_query_as_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    prints = [brute_print((r["text"] or "").encode()) for r in rows]
    want = [(r["doc_id"], f"{p:016x}", rows[c]["doc_id"]) for r, p, c in zip(rows, prints, brute_components(prints))]
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == want
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert kept == {w[2] for w in want} and simhash.keep_one(docs).columns == docs.columns


def test_odd_rows(docs, none):
    got = simhash.near_duplicates(docs).collect()
    by = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in got}
    assert len(got) == docs.count() and by[2, "0" * 16] == by[3, "0" * 16] == by[4, "0" * 16] == by[None, "0" * 16] == 2
    kept = simhash.keep_one(docs).collect()
    assert sum(r["doc_id"] == 8 for r in kept) == 1 and sum(r["doc_id"] == 5 for r in kept) == 0
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_any_column_name(docs):
    odd = docs.withColumns({c: F.lit(c) for c in ("__own", "__row", "__id_hash", "__number", "__text_hash")})
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and all(r["__own"] == "__own" and r["__row"] == "__row" for r in kept.collect())


def test_dense_clusters_write_few_links(spark):
    """61 fingerprints around one centre are 1,830 pairs; each node and round writes one."""
    shapes = [0, *(1 << i for i in range(60))]
    rows = spark.createDataFrame([(x,) for x in shapes], "fp long")
    assert simhash.links(rows).count() == 61 * 60 // 2
    assert simhash.nearest(rows.withColumn("root", F.col("fp"))).count() == 61
    found = {r["fp"]: r["root"] for r in simhash.clustered(rows).collect()}
    assert found == dict.fromkeys(shapes, 0)


def test_clusters_as_brute_force(spark, monkeypatch):
    """Chains that need several rounds, signs on both sides, and crowded cells dealt to several tasks."""
    rng = np.random.default_rng(9)
    prints = set()
    for _ in range(15):
        x = int(rng.integers(0, 1 << 63, dtype=np.uint64)) * 2 + 1
        for _ in range(20):
            for bit in rng.integers(0, 64, rng.integers(1, 5)).tolist():
                x ^= 1 << bit
            prints.add(x)
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    mask = (1 << 64) - 1
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if ((a & mask) ^ (b & mask)).bit_count() <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    rows = spark.createDataFrame([(p,) for p in prints], "fp long")
    alone = {p for p in prints if not any(p != q and ((p & mask) ^ (q & mask)).bit_count() <= 3 for q in prints)}
    want = {p: find(p) for p in prints if p not in alone}
    assert {r["fp"]: r["root"] for r in simhash.clustered(rows).collect()} == want and want
    nodes = rows.withColumn("root", F.col("fp"))
    whole = simhash.meeting(nodes, 3, F.col("p.a") < F.col("i.b")).select("a", "b")
    dealt = simhash.meeting(nodes, 3, F.col("p.a") < F.col("i.b"), crowd=1).select("a", "b")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, dealt.collect()))
