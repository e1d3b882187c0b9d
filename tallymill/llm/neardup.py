"""SimHash near-duplicates by exact shingle similarity, for the corpus pipeline.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles
(lower-cased A-Z, words as in ``simhash``; fewer words: the whole sequence) is 0.8 or
more. Links are transitive; one row of each group stays. Equal sets are one node.

Candidates come in three steps, and every one is verified on the texts:

1. ``simhash``: nodes whose five-word fingerprints are equal or meet in the grid join.
2. Bits of a 64-bit fingerprint can't reach down to 0.8 (there they differ by 10 with a
   deviation of 3, and a grid for a radius that wide selects nothing), so the rest comes
   from BANDS x DEPTH minima of hashes: sets that share all DEPTH minima of a band are in
   a bucket. A pair at similarity s is passed over with probability (1 - s^DEPTH)^BANDS:
   5e-8 at 0.8. In buckets that still hold several groups, each node is compared with the
   bucket's smallest and largest group.
3. Only those pairs of a bucket are left whose groups still differ. Their nodes get LONG
   minima of four bits each and travel with their texts to their buckets' tasks (large buckets
   by two blocks of rows at a time), where pairs are compared and links found: no row a pair
   is made. A pair whose minima differ in more than MOST_APART of them is left out before any
   text is looked at. At 0.8 they differ in 96 on
   average with a deviation of 8.8: the limit is 5 deviations out, which a pair at exactly
   0.8 passes once in some 10^6. A pair is taken in the first bucket that it shares.
   Many texts that are near copies of one but less than 0.8 alike cost comparisons of
   bits, not of texts.

A set whose size is under 0.8 of another's can't be similar to it and isn't compared.
A large group of near copies so costs few pairs. A null text is empty; all empty texts
are one group. Null doc_ids take part. Other columns are kept, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.llm import simhash
from tallymill.llm.common import bitmap, pieces, saved, texts_of
from tallymill.llm.simhash import components, prints_of, shingle_hashes

SIZE = 5
LEAST = 0.8
BANDS, DEPTH = 32, 4
LONG, MOST_APART = 512, 140
EDGE = 512  # rows of a bucket's block: two blocks and their texts are held by a task
BLOCK = 512  # hashes at once, for bounded memory and the processor's cache
_RANDOM = np.random.default_rng(42)
FACTOR = _RANDOM.integers(0, 1 << 63, LONG, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFT = _RANDOM.integers(0, 1 << 63, LONG, dtype=np.uint64)


def shingle_set(text: bytes, size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    return np.unique(shingle_hashes(text, size))


def minima(own: np.ndarray, orders: int) -> np.ndarray:
    """The least values of a set under so many orders."""
    least = np.full(orders, np.iinfo(np.uint64).max, dtype=np.uint64)
    room = np.empty((orders, min(BLOCK, len(own))), dtype=np.uint64)
    for a in range(0, len(own), BLOCK):
        block = own[None, a : a + BLOCK]
        values = room[:, : block.shape[1]]
        # The shift spreads bits before the product, as the hash 0 of an empty text is a fixed point of it.
        np.bitwise_xor(block, SHIFT[:orders, None], out=values)
        np.multiply(values, FACTOR[:orders, None], out=values)
        np.minimum(least, values.min(axis=1), out=least)
    return least


def bands_of(own: np.ndarray) -> np.ndarray:
    """One key a band, from the minima of a set under BANDS * DEPTH orders."""
    return keys_of(minima(own, BANDS * DEPTH))


def keys_of(least: np.ndarray) -> np.ndarray:
    keys = np.arange(BANDS, dtype=np.uint64)
    for m in least.reshape(BANDS, DEPTH).T:
        keys = (keys ^ m) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys


def signature_of(least: np.ndarray) -> np.ndarray:
    """Four mixed bits of each of LONG minima, sixteen to a word."""
    least = (least ^ (least >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(60)
    return np.bitwise_or.reduce(least.reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=1)


def apart(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """In how many places a signature differs from each of the ``rows``."""
    v = x ^ rows
    v |= v >> np.uint64(1)
    v |= v >> np.uint64(2)
    return np.bitwise_count(v & np.uint64(0x1111111111111111)).sum(axis=1, dtype=np.int64)


def signatures(texts: DataFrame, size: int = SIZE) -> DataFrame:
    """(node, bands, s0, s1, ...) of (node, text)."""
    names = [f"s{i}" for i in range(LONG // 16)]

    def run(batches):
        for batch in pieces(batches):
            least = [minima(shingle_set(t, size), LONG) for t in texts_of(batch.column("text"))]
            rows = np.stack([signature_of(x) for x in least]).view(np.int64)
            bands = np.stack([keys_of(x[: BANDS * DEPTH]) for x in least]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(least) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists, *(pa.array(rows[:, i]) for i in range(len(names)))], names=["node", "bands", *names])

    return texts.select("node", "text").mapInArrow(run, "node long, bands array<long>, " + ", ".join(f"{n} long" for n in names))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def sketches(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, text_hash, node, fp, count, bands): equal shingle sets have one node."""

    def run(batches):
        from xxhash import xxh3_64_intdigest

        for batch in pieces(batches):
            nodes, bands = np.zeros(batch.num_rows, dtype=np.uint64), np.zeros((batch.num_rows, BANDS), dtype=np.uint64)
            counts, held, prints = np.zeros(batch.num_rows, dtype=np.int64), [], []
            for i, text in enumerate(texts_of(batch.column("text"))):
                held.append(shingle_hashes(text, size))
                own = np.unique(held[-1])
                nodes[i], bands[i], counts[i] = xxh3_64_intdigest(own.tobytes()), bands_of(own), len(own)
                if sum(map(len, held[-32:])) > 1 << 16 or len(held) == 32:
                    prints.append(prints_of(held))
                    held = []
            prints = np.concatenate([*prints, prints_of(held)])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel().view(np.int64)))
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(nodes.view(np.int64)), pa.array(prints.astype("<u8").view("<i8")), pa.array(counts), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "node", "fp", "count", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_hash long, node long, fp long, count long, bands array<long>"
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, schema)


def texts_at(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the ``wanted`` (node, key), where key is a hash of doc_id and of the text.

    A filter of bounded size keeps most other texts out of the shuffle. Copies have keys of their
    own, as their doc_ids differ, so a large group of them doesn't meet in one task.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(bitmap(wanted.select("key")))

    def run(batches):
        on = np.frombuffer(held.value, dtype=np.uint8)
        for batch in batches:
            at = batch.column("key").to_numpy() & np.int64(8 * len(on) - 1)
            yield batch.filter(pa.array((on[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))

    rows = docs.select(F.xxhash64("doc_id", F.xxhash64("text")).alias("key"), "text").mapInArrow(run, "key long, text string")
    return rows.join(wanted, "key").groupBy("key").agg(F.first("node").alias("node"), F.first("text").alias("text")).select("node", "text")


def similar(pairs: DataFrame, texts: DataFrame, size: int = SIZE, least: float = LEAST) -> DataFrame:
    """The ``pairs`` (a, b) of nodes whose texts are at least so similar."""

    def run(batches):
        for batch in pieces(batches, column="text_b"):
            keep, last, own = [], None, None
            for a, b in zip(texts_of(batch.column("text_a")), texts_of(batch.column("text_b"))):
                if a != last:  # the join on a comes last, so its pairs follow each other
                    last, own = a, shingle_set(a, size)
                keep.append(jaccard(own, shingle_set(b, size)) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = first.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def alike(x: str, y: str, least: float) -> Column:
    """Whether sets of so many shingles can be similar."""
    return F.least(x, y) >= F.greatest(x, y) * F.lit(least - 1e-9)


def linked(rows: DataFrame, size: int = SIZE, least: float = LEAST, tasks: int = 0) -> DataFrame:
    """(a, b): similar nodes of different roots that share a bucket, enough of them to join all that are linked.

    ``rows`` has key, n (rows of the key), node, root, count, text, bands and the signature. A bucket is
    dealt into blocks of about EDGE rows and every two blocks meet in a task of their own. There all pairs are compared
    by bits and what passes by texts, so that pairs never become rows: only links leave the task, and
    none whose ends are joined already by links of the same task.
    """
    names = [f"s{i}" for i in range(LONG // 16)]

    def run(table: pa.Table) -> pa.Table:
        key, found = table["key"][0].as_py(), []
        node, root, count, block = (table[c].to_numpy() for c in ("node", "root", "count", "block"))
        marks = np.stack([table[c].to_numpy() for c in names], axis=1).view(np.uint64)
        bands = np.array(table["bands"].combine_chunks().flatten()).reshape(-1, BANDS)
        texts, sets, up = texts_of(table["text"].combine_chunks()), {}, {}
        across = table["i"][0].as_py() != table["j"][0].as_py()

        def own(at: int) -> np.ndarray:
            if at not in sets:
                sets[at] = shingle_set(texts[at], size)
            return sets[at]

        def top(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        for x in range(len(node) - 1):
            near = (root[x + 1 :] != root[x]) & (np.minimum(count[x + 1 :], count[x]) >= np.maximum(count[x + 1 :], count[x]) * (least - 1e-9))
            if across:
                near &= block[x + 1 :] != block[x]
            ys = np.flatnonzero(near) + x + 1
            ys = ys[apart(marks[x], marks[ys]) <= MOST_APART]
            if len(ys):  # a pair is taken in the first bucket that it shares
                ys = ys[bands[x][(bands[ys] == bands[x]).argmax(axis=1)] == key]
            for y in ys.tolist():
                p, q = top(int(root[x])), top(int(root[y]))
                if p != q and jaccard(own(x), own(y)) >= least:
                    up[p] = q
                    found.append(sorted((int(node[x]), int(node[y]))))
            sets.pop(x, None)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    parts = F.ceil(F.col("n") / EDGE)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("node"), parts)).withColumn("__with", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    dealt = dealt.withColumn("i", F.least("block", "__with")).withColumn("j", F.greatest("block", "__with"))
    dealt = dealt.select("key", "i", "j", "block", "node", "root", "count", "text", "bands", *names)
    if tasks:  # few bytes, much work: a number of its own keeps small partitions from being put together
        dealt = dealt.repartition(tasks, "key", "i", "j")
    return dealt.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def by_prints(nodes: DataFrame, least: float) -> DataFrame:
    """(a, b): nodes of one fingerprint, and of the nearest other one within its radius."""
    prints = saved(nodes.groupBy("fp").agg(F.min(F.struct("node", "count")).alias("rep")), "prints", nodes.count())
    same = nodes.join(prints, "fp").where(F.col("node") != F.col("rep.node"))
    near = simhash.nearest(prints.select("fp", F.col("fp").alias("root"))).select("a", "b")
    ends = [prints.select(F.col("fp").alias(x), F.col("rep.node").alias(f"node_{x}"), F.col("rep.count").alias(f"count_{x}")) for x in ("a", "b")]
    near = near.join(ends[0], "a").join(ends[1], "b").where(alike("count_a", "count_b", least))
    same = same.where(alike("count", "rep.count", least)).select(*ordered("node", "rep.node"))
    return near.select(*ordered("node_a", "node_b")).union(same).distinct()


def roots(nodes: DataFrame, docs: DataFrame, size: int = SIZE, least: float = LEAST) -> DataFrame:
    """(node, root) of the nodes that have a similar one; ``nodes`` has node, key, fp, count and bands."""
    first = saved(by_prints(nodes.select("node", "fp", "count"), least), "print-pairs", 2 * nodes.count())
    rows = nodes.select("node", "count", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
    members = saved(rows.join(shared, "key"), "buckets")
    wanted = members.select("node").union(first.select("a")).union(first.select("b")).distinct()
    texts = saved(texts_at(docs, nodes.select("node", "key").join(wanted, "node", "left_semi")), "texts")
    links = saved(similar(first, texts, size, least), "print-links", first.count(), 50)  # few pairs a task: it reads their texts
    found = components(links)

    placed = members.join(found, "node", "left").select("key", "node", "count", F.coalesce("root", "node").alias("root"))
    ends = placed.groupBy("key").agg(*(f(F.struct("root", "node", "count")).alias(n) for f, n in ((F.min, "lo"), (F.max, "hi")))).where("lo.root < hi.root")
    open_ = placed.join(ends, "key")
    stars = None
    for end in ("lo", "hi"):
        part = open_.where((F.col("root") != F.col(f"{end}.root")) & alike("count", f"{end}.count", least)).select(*ordered("node", f"{end}.node"))
        stars = part if stars is None else stars.union(part)
    stars = saved(stars.distinct().join(first, ["a", "b"], "left_anti"), "stars", 2 * members.count())
    more = saved(similar(stars, texts, size, least), "star-links", stars.count(), 50)
    if not more.isEmpty():
        links = links.union(more)
        found = components(links)

    placed = members.join(found, "node", "left").select("key", "node", "count", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n")
    mixed = saved(mixed, "mixed")
    rest = placed.join(mixed, "key")
    open_texts = texts.join(rest.select("node").distinct(), "node", "left_semi")
    marks = saved(signatures(open_texts, size).join(texts, "node"), "signatures")
    met = mixed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-met // 1_000))
    more = saved(linked(rest.join(marks, "node"), size, least, tasks), "cross-links")
    return found if more.isEmpty() else components(links.union(more))


def keep_one(docs: DataFrame, size: int = SIZE, least: float = LEAST) -> DataFrame:
    """The rows of ``docs``, one of each group of near duplicates: the one with the smallest doc_id."""
    prints = saved(sketches(docs, size), "sketches")
    known = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash")))
    same = [F.first(c).alias(c) for c in ("fp", "count", "bands")]  # copies of a node may differ in fp alone: repeats count there
    nodes = prints.groupBy("node").agg(known.alias("__first"), F.min(F.struct("doc_id", "text_hash")).alias("__any"), *same)
    nodes = saved(nodes.select("node", F.coalesce("__first", "__any").alias("first"), "fp", "count", "bands"), "nodes")
    key = F.xxhash64("first.doc_id", "first.text_hash").alias("key")
    found = roots(nodes.select("node", key, "fp", "count", "bands"), docs, size, least)
    placed = nodes.select("node", "first").join(found, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    least_of = placed.groupBy("root").agg(F.min(F.when(F.col("first.doc_id").isNotNull(), F.col("first"))).alias("__first"), F.min("first").alias("__any"))
    return simhash.rows_of(docs, least_of.select(F.coalesce("__first", "__any").alias("keeper")).select("keeper.*"))
