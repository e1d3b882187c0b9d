import zlib
from collections import Counter, defaultdict

import pytest

from tallymill.llm import hilbert


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(spark, dims, bits):
    from itertools import product

    from pyspark.sql import functions as F

    cells = list(product(range(1 << bits), repeat=dims))
    df = spark.createDataFrame(cells, ", ".join(f"x{i} int" for i in range(dims)))
    order = [tuple(r)[:-1] for r in df.withColumn("h", hilbert.curve_index([F.col(f"x{i}") for i in range(dims)], bits)).orderBy("h").collect()]
    assert len(set(order)) == len(cells)
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(order, order[1:]))


def check(rows, docs, shards):
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(i, [])) for i in range(shards)]
    assert max(counts) - min(counts) <= 1
    order = [r["curve"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)


def test_law(docs, real, none):
    dims = (("label", "hash"), ("doc_id", "linear"), ("size", "log"))
    check(hilbert.assign(docs, 5, dims).collect(), docs, 5)
    check(hilbert.assign(real).collect(), real, 40)
    check(hilbert.assign(real.withColumn("source", hilbert.F.lit("hot")), 7, slices=8).collect(), real, 7)
    assert hilbert.assign(none, 5, dims).count() == 0


def test_files_prune(spark, real, tmp_path):
    path, boxes = hilbert.write_shards(real, f"file://{tmp_path}/s", shards=8)
    back = spark.read.parquet(path)
    assert back.select("doc_id", "text").exceptAll(real.select("doc_id", "text")).isEmpty() and back.count() == real.count()
    boxes = boxes.collect()
    assert len(boxes) == 8 and sum(b["rows"] for b in boxes) == real.count()
    assert any(b["high_axis_0"] - b["low_axis_0"] < 15 for b in boxes)


def test_repeats_spread_over_slices(spark):
    """A row that is there 150,000 times, beside others in its cell."""
    from pyspark.sql import functions as F

    hot = spark.range(150_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.lit("s").alias("source"), F.lit("en").alias("lang"))
    rest = spark.range(1000).select("id", F.concat(F.lit("t"), "id"), F.lit("s"), F.lit("en"))
    rows = hilbert.assign(hot.union(rest), 7).collect()
    counts = Counter(r["shard"] for r in rows)
    assert len(rows) == 151_000 and max(counts.values()) - min(counts.values()) <= 1
    for shard in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(counts[shard]))
    assert sum(r["doc_id"] == 5 and r["text_crc32"] == zlib.crc32(b"same") for r in rows) == 150_000


def test_text_ids(spark, real):
    rows = hilbert.assign(real.withColumn("doc_id", hilbert.F.concat(hilbert.F.lit("d"), "doc_id")), 4).collect()
    counts = Counter(r["shard"] for r in rows)
    assert sum(counts.values()) == real.count() and max(counts.values()) - min(counts.values()) <= 1


def test_query_columns(spark):
    """The query's own columns: law, no grown shard, shards and slots, equal texts as they are."""
    from tallymill.llm.queries import op2_hilbert_shards

    sf = "/root/testdata/sf0.001"
    rows = op2_hilbert_shards(spark, sf).collect()
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None} and {r["shard"] for r in rows} == set(range(40))
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sorted((k, len(t) + 16, zlib.crc32(t)) for k, t in docs.items())
