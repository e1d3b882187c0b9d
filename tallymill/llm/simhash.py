"""SimHash near-duplicates with a segment-popcount embedding.

Fingerprint: lower-cased A-Z, words ``[^\\x20\\x09-\\x0D]+``, three-word shingles
with repeats (fewer words: the whole sequence; none: fingerprint zero), XXH64 with
seed 42; a bit is set if over half of the hashes have it.

Search: each fingerprint is cut into 32 segments of two bits; the counts of set bits
are coordinates whose Manhattan distance never exceeds the Hamming distance. Two
fingerprints within 3 agree to within 1 in one half of the coordinates, so a range
join on the grid of each half (own cell and the cells one step away, against own
cells) meets every pair; the Manhattan bound over all coordinates filters, and the
exact Hamming distance decides, both inside the join.

Equal fingerprints are one node before the search, so copies cost nothing there.
The join keeps one neighbour a node, outside its own component, and is repeated over
the linked nodes until there is none left, so a dense cluster never writes its pairs.
Components come from alternating large and small stars, each round checkpointed.

A null text is empty: fingerprint zero, one group with all other empty texts.
Null doc_ids take part; a component's id is its smallest non-null doc_id. Repeated
rows share a component. An empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.llm.common import gathered, pieces, saved, shared_dir, spare, texts_of

RADIUS = 3
BLOCK = 1 << 16
LOW = 0x5555555555555555


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """Hashes of a text's shingles of ``size`` words, in order and with repeats."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(1, dtype=np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxh64_intdigest(line, 42)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - size + 1
    return np.fromiter((xxh64_intdigest(line[a:b], 42) for a, b in zip(begins[:n].tolist(), ends[size - 1 :].tolist())), dtype=np.uint64, count=n)


def prints_of(hashes: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each array of shingle hashes; bits of BLOCK hashes are held at once."""
    sizes = np.array([len(x) for x in hashes], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    counts = np.zeros((len(hashes), 64), dtype=np.int64)
    every = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
    for at in range(0, len(every), BLOCK):
        bits = np.unpackbits(every[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first, last = int(np.searchsorted(starts, at, side="right")) - 1, int(np.searchsorted(starts, at + len(bits)))
        counts[first:last] += np.add.reduceat(bits, np.maximum(starts[first:last] - at, 0), axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints_of(texts: list[bytes], size: int = 3) -> np.ndarray:
    """64-bit fingerprints of lower-cased texts (as unsigned integers)."""
    return prints_of([shingle_hashes(text, size) for text in texts])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp): fp as a signed long."""

    def run(batches):
        for batch in pieces(batches):
            found = fingerprints_of(texts_of(batch.column("text")), size)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(found.astype("<u8").view("<i8"))], names=["doc_id", "text_hash", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {kind}, text_hash long, fp long")


def embedded(fp: Column) -> Column:
    """Counts of the 32 two-bit segments in unary: 0 is 00, 1 is 01, 2 is 11.

    The Manhattan distance of two embeddings is the number of bits that differ.
    """
    low, high = fp.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _near(cell: Column) -> Column:
    """A half's own cell and those one step away: the low bit of a segment may change where
    its high bit is 0, the high bit where its low bit is 1."""
    flips = F.array(*(F.lit(1 << j).cast("long") for j in range(32)))
    lows = F.shiftright(cell, 1).bitwiseAND(F.lit(LOW & 0xFFFFFFFF))
    free = F.lit(LOW & 0xFFFFFFFF).bitwiseAND(F.bitwise_not(lows)).bitwiseOR(F.shiftleft(cell.bitwiseAND(F.lit(LOW & 0xFFFFFFFF)), 1))
    moved = F.transform(F.filter(flips, lambda m: m.bitwiseAND(free) != 0), lambda m: cell.bitwiseXOR(m))
    return F.concat(F.array(cell), moved)


def meeting(nodes: DataFrame, radius: int, which: Column, crowd: int = 20_000) -> DataFrame:
    """The range join on the grid: (a, root_a, b, root_b) of the ``nodes`` (fp, root) within ``radius``
    (3 at most) for which ``which`` holds, a condition on ``p`` (a, root_a) and ``i`` (b, root_b).

    A cell of more than ``crowd`` fingerprints is dealt to several tasks.
    """
    if radius > 3:
        raise ValueError("the two halves guarantee a radius of 3")
    u = embedded(F.col("fp"))
    half = F.array(u.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(u, 32).bitwiseOR(F.lit(1 << 32)))
    cells = nodes.select("fp", "root", F.explode(half).alias("own"))
    index = cells.select(F.col("own").alias("cell"), F.col("fp").alias("b"), F.col("root").alias("root_b"))
    probe = cells.select(F.col("fp").alias("a"), F.col("root").alias("root_a"), F.explode(_near(F.col("own"))).alias("cell"))
    differ = embedded(F.col("p.a")).bitwiseXOR(embedded(F.col("i.b")))
    exact = (
        which
        & (F.bit_count(differ) <= radius)
        & (F.bit_count(F.col("p.a").bitwiseXOR(F.col("i.b"))) <= radius)
        & ((F.col("p.cell") < F.lit(1 << 32)) | (F.bit_count(differ.bitwiseAND(F.lit(0xFFFFFFFF))) > 1))
    )
    crowded = index.groupBy("cell").count().where(F.col("count") > crowd).select("cell", F.ceil(F.col("count") / crowd).cast("int").alias("parts"))
    if crowded.isEmpty():
        both = probe.alias("p").join(index.alias("i"), (F.col("p.cell") == F.col("i.cell")) & exact)
        return both.select("a", "root_a", "b", "root_b")
    crowded = saved(crowded, "crowded")
    plain = probe.join(crowded, "cell", "left_anti").alias("p").join(index.join(crowded, "cell", "left_anti").alias("i"), (F.col("p.cell") == F.col("i.cell")) & exact)
    dealt = probe.join(crowded, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    held = index.join(crowded, "cell").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    hot = dealt.alias("p").join(held.alias("i"), (F.col("p.cell") == F.col("i.cell")) & (F.col("p.part") == F.col("i.part")) & exact)
    return plain.select("a", "root_a", "b", "root_b").union(hot.select("a", "root_a", "b", "root_b"))


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) with a < b: all pairs of different fingerprints ``fp`` within ``radius`` (3 at most)."""
    return meeting(nodes.select("fp", F.col("fp").alias("root")), radius, F.col("p.a") < F.col("i.b")).select("a", "b")


def nearest(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, root_a, b, root_b): for each of the ``nodes`` (fp, root) the smallest fingerprint within
    ``radius`` that has another root. The minimum is taken where pairs meet, so a dense cluster
    writes one row a node and task, not its pairs."""
    pairs = meeting(nodes, radius, F.col("p.root_a") != F.col("i.root_b"))
    least = pairs.groupBy("a", "root_a").agg(F.min(F.struct("b", "root_b")).alias("n"))
    return least.select("a", "root_a", "n.b", "n.root_b")


def clustered(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root) of the fingerprints that have another one within ``radius``; linked ones share a root.

    Each round links every node to its smallest neighbour outside its own component; a component
    with such a neighbour at least doubles, so rounds grow with the logarithm of its size. After
    the first round only nodes with a neighbour are searched.
    """
    now = nodes.select("fp", F.col("fp").alias("root"))
    first, most = True, nodes.count()
    while True:
        found = saved(nearest(now, radius), "links", most)
        if found.isEmpty():
            return now.where(F.lit(not first))
        roots = components(found.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
        if first:
            now = roots.select(F.col("node").alias("fp"), "root")
        else:
            now = now.join(roots, now["root"] == roots["node"], "left").select("fp", F.coalesce(roots["root"], now["root"]).alias("root"))
        now, first = saved(now, "clustered", most), False
        most = now.count()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the smallest node.

    Alternating stars: each round joins on single nodes with pre-aggregated minima,
    so neighbours of a hub are never collected together. Rounds go on until nothing
    changes; their number grows with the logarithm of the longest path.
    """
    shared_dir(edges.sparkSession)
    now = edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v").distinct()
    now = now.checkpoint()
    seen, most = None, now.count()
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("__m")).select("u", F.least("u", "__m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        # large: v hangs on m < v. Small star: per v, all its parents hang on the smallest one.
        parents = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(parents, "v").select(F.col("m").alias("u"), F.col("u").alias("v")).where("u <> v")
        now = gathered(small.union(parents.select(F.col("m").alias("u"), "v")).distinct(), 2 * most).checkpoint()
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            members = now.select(F.col("v").alias("node"), F.col("u").alias("root"))
            return members.union(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
        seen, most = state, state[0]


def grouped(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root, component): each distinct fingerprint, its component's smallest
    fingerprint, and the smallest (doc_id, text_hash) of the component."""
    nodes = prints.groupBy("fp").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))).alias("__first"), F.min(F.struct("doc_id", "text_hash")).alias("__any"))
    nodes = saved(nodes.select("fp", F.coalesce("__first", "__any").alias("first")), "nodes")
    roots = clustered(nodes.select("fp"), radius)
    placed = nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    least = placed.groupBy("root").agg(F.min(F.when(F.col("first.doc_id").isNotNull(), F.col("first"))).alias("__first"), F.min("first").alias("__any"))
    return placed.join(least.select("root", F.coalesce("__first", "__any").alias("component")), "root").select("fp", "root", "component")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row."""
    prints = saved(fingerprints(docs), "fingerprints")
    groups = grouped(prints, radius)
    return prints.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component.doc_id").alias("component_id"))


def rows_of(docs: DataFrame, keepers: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are one of the ``keepers`` (doc_id, text_hash), once each.

    Both sides meet by two hashes, which the choice of one among equal rows reuses: one
    shuffle of the rows. Any column name may occur in ``docs``.
    """
    one, two = spare(docs.columns, "__id_hash"), spare(docs.columns, "__text_hash")
    keys = keepers.select(F.xxhash64("doc_id").alias(one), F.col("text_hash").alias(two))
    rows = docs.withColumns({one: F.xxhash64("doc_id"), two: F.xxhash64("text")})
    number = spare([*rows.columns], "__number")
    first = Window.partitionBy(one, two).orderBy(F.lit(0))
    kept = rows.join(keys, [one, two], "left_semi").withColumn(number, F.row_number().over(first)).where(F.col(number) == 1)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, one of each component: the one with the smallest doc_id."""
    prints = saved(fingerprints(docs), "fingerprints")
    return rows_of(docs, grouped(prints, radius).select("component").distinct().select("component.*"))
