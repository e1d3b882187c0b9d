"""Benchmark decontamination by SimHash of item-sized windows.

Texts are lower-cased, ASCII marks become spaces, words are cut at white space, and
five-word shingles (fewer words: the whole sequence) carry their count as weight.
A window as long as an item is compared with it in three steps:

1. SimHash: the window's 256-bit fingerprint, from sliding sums of its shingles' bits.
2. Multi-index blocks: the items of that window length have their fingerprints cut into
   16 blocks of 16 bits. Within ``radius`` 63 of an item, one block at least differs in
   at most 63 // 16 = 3 bits, so the item is met in that block's table.
3. Exact: the weighted Jaccard similarity of the shingles, 0.8 or more.

At similarity 0.8 a bit differs with probability 0.15, so 39 of 256 bits differ on
average with a deviation of 5.7, and the radius is over four deviations out: a window
at exactly 0.8 is passed over once in 10^5, a closer one less often. A block of an
unrelated item is within 3 bits with probability 0.011, all sixteen with 0.16. Only
windows that hold a shingle of some item of their length are looked up: any other one
has similarity zero.

The benchmark is broadcast in blocks of at most ``block`` items and ``MOST_BYTES`` of
text. With several blocks, texts without any shingle of the benchmark are told apart
first by a bitmap of bounded size; only the others are read once a block, each pass a
job of its own, so that an executor holds one block at a time.

Null texts are empty and match nothing; items without words match nothing. Items of
equal text each match. Repeated rows give repeated hits. Empty tables give no hits;
other columns are kept by ``clean`` and ignored by ``hits``.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm.common import bitmap, only, pieces, saved, spare

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 63
BITS, BLOCKS = 256, 16
MOST_BYTES = 32_000_000
_MARKS = bytes(32 if b < 128 and not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122) else b for b in range(256))
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
_SPREAD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], dtype=np.uint64)
_BITS = 20


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_MARKS).split()


class Words(dict):
    """Word -> 64-bit hash, forgotten when there are too many."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= self.most:
            self.clear()
        out = xxh64_intdigest(word, 7)
        if len(word) <= 40:
            self[word] = out
        return out


def mixed(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = words[:n] * _ODD[0]
    for j in range(1, size):
        out = (out ^ (out >> np.uint64(29))) + words[j : j + n] * _ODD[j]
    out ^= out >> np.uint64(32)
    out *= _ODD[4]
    return out ^ (out >> np.uint64(29))


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """(n x BITS): as many words of bits a hash as make up BITS."""
    wide = hashes[:, None] ^ (hashes[:, None] >> np.uint64(31))
    wide = wide * _SPREAD[None, :]
    wide ^= wide >> np.uint64(32)
    wide *= _ODD[4]
    wide ^= wide >> np.uint64(29)
    return np.unpackbits(wide.astype("<u8").view(np.uint8).reshape(len(hashes), -1), axis=1, bitorder="little")


def simhash(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint of a few shingles, as bytes."""
    return np.packbits(bits_of(hashes).sum(axis=0, dtype=np.int64) * 2 > len(hashes), bitorder="little")


def weighted_jaccard(a: np.ndarray, a_counts: np.ndarray, b: np.ndarray, b_counts: np.ndarray) -> float:
    """Of two multisets, each as sorted values and counts."""
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    same = b[at] == a
    both = int(np.minimum(a_counts[same], b_counts[at[same]]).sum())
    return both / (int(a_counts.sum()) + int(b_counts.sum()) - both)


def _flips() -> np.ndarray:
    """All 16-bit values with at most RADIUS // BLOCKS bits set."""
    every = np.arange(1 << (BITS // BLOCKS), dtype=np.uint16)
    return every[np.bitwise_count(every) <= RADIUS // BLOCKS]


FLIPS = _flips()


class Group:
    """Items of one shingle size and window length: fingerprints and a table a block."""

    def __init__(self, items: list[int], prints: np.ndarray):
        self.items = np.array(items, dtype=np.int64)
        self.words = prints.view("<u8").reshape(len(items), -1)
        self.blocks = prints.view("<u2").reshape(len(items), -1)
        self.tables: list[tuple[np.ndarray, np.ndarray]] | None = None
        if len(items) > len(FLIPS):
            order = np.argsort(self.blocks, axis=0, kind="stable")
            values = np.arange((1 << (BITS // BLOCKS)) + 1)
            self.tables = [(np.searchsorted(self.blocks[order[:, j], j], values), order[:, j]) for j in range(BLOCKS)]

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place of the item) of all pairs with a block within RADIUS // BLOCKS bits.

        A table is asked for all near values, or all its entries are compared, whichever are fewer.
        """
        blocks, n = prints.view("<u2").reshape(len(prints), -1), len(self.items)
        found = []
        step = max(1, (1 << 21) // (min(n, len(FLIPS)) * BLOCKS))
        for a in range(0, len(blocks), step):
            own = blocks[a : a + step]
            if self.tables is None:
                near = (np.bitwise_count(own[:, None, :] ^ self.blocks[None, :, :]) <= RADIUS // BLOCKS).any(axis=2)
                window, item = np.nonzero(near)
                found.append((window + a) * n + item)
                continue
            keys = []
            for j, (starts, order) in enumerate(self.tables):
                values = (own[:, j, None] ^ FLIPS[None, :]).astype(np.int64)
                counts = starts[values + 1] - starts[values]
                window, flip = np.nonzero(counts)
                some = counts[window, flip]
                at = np.repeat(starts[values[window, flip]] - np.cumsum(some) + some, some) + np.arange(some.sum())
                keys.append(np.repeat(window + a, some) * n + order[at])
            found.append(np.unique(np.concatenate(keys)))
        pairs = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
        return pairs // n, pairs % n


class Index:
    """One block of items: shingles with the window lengths they stand for, and a group a length."""

    def __init__(self, items: list[tuple[object, str]], radius: int = RADIUS, similarity: float = SIMILARITY, shingle: int = SHINGLE):
        if radius // BLOCKS > RADIUS // BLOCKS:
            raise ValueError(f"the blocks guarantee a radius of {RADIUS}")
        self.radius, self.similarity, self.shingle = radius, similarity, shingle
        self.cache = Words()
        self.ids, self.weights, prints = [], [], []
        of: dict[tuple[int, int], list[int]] = {}
        pairs: dict[int, list[tuple[np.ndarray, int]]] = {}
        for key, text in items:
            words = words_of(text)
            if not words:
                continue
            size = min(shingle, len(words))
            hashes = mixed(self._words(words), size)
            of.setdefault((size, len(hashes)), []).append(len(self.ids))
            self.ids.append(key)
            self.weights.append(np.unique(hashes, return_counts=True))
            prints.append(simhash(hashes))
            pairs.setdefault(size, []).append((self.weights[-1][0], len(hashes)))
        self.groups = {k: Group(own, np.stack([prints[i] for i in own])) for k, own in of.items()}
        self.known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # size -> (shingles, starts, window lengths)
        self.filters: dict[int, np.ndarray] = {}
        for size, own in pairs.items():
            table = np.unique(np.stack([np.concatenate([h for h, _ in own]), np.concatenate([np.full(len(h), c, dtype=np.uint64) for h, c in own])], axis=1), axis=0)
            first = np.flatnonzero(np.concatenate([[True], table[1:, 0] != table[:-1, 0]]))
            self.known[size] = (table[first, 0], np.append(first, len(table)), table[:, 1].astype(np.int64))
            self.filters[size] = np.zeros(1 << _BITS, dtype=bool)
            self.filters[size][(table[first, 0] >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.looked_up = self.met = 0  # windows, candidates

    def _words(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.cache.__getitem__, words), dtype=np.uint64, count=len(words))

    def flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(word hashes of all texts, where each text begins and the last one ends)."""
        words = [words_of(t) for t in texts]
        ends = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])
        return self._words([w for own in words for w in own]), ends

    def find(self, texts: list[str | None]) -> list[list[tuple[int, float, int, int, int]]]:
        """For each text: (item, similarity, first word, word after the last, distance), the best window of each item."""
        words, ends = self.flat(texts)
        out: list[list[tuple[int, float, int, int, int]]] = [[] for _ in texts]
        for size, (known, starts, lengths) in self.known.items():
            hashes = mixed(words, size)
            at = np.flatnonzero(self.filters[size][(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
            place = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
            row = np.searchsorted(ends, at, side="right") - 1
            held = (known[place] == hashes[at]) & (at + size <= ends[row + 1])
            at, place, row = at[held], place[held], row[held]
            many = starts[place + 1] - starts[place]
            count = lengths[np.repeat(starts[place] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            at, row = np.repeat(at, many), np.repeat(row, many)
            order = np.lexsort((at, count, row))
            at, row, count = at[order], row[order], count[order]
            cuts = np.flatnonzero((np.diff(row) != 0) | (np.diff(count) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
                if b > a:
                    r, c = int(row[a]), int(count[a])
                    out[r] += self._windows(hashes, int(ends[r]), int(ends[r + 1]) - size + 1, size, c, at[a:b].tolist())
        return [self._best(x) for x in out]

    def _windows(self, hashes: np.ndarray, low: int, high: int, size: int, count: int, anchors: list[int]) -> list[tuple[int, float, int, int, int]]:
        """Hits among the windows of ``count`` shingles that hold an anchor, within [low, high).

        A text shorter than the item, or a window cut by the text's end, is compared as it is.
        """
        found, at, group = [], 0, self.groups[size, count]
        while at < len(anchors):  # runs of anchors whose windows overlap
            to = at
            while to + 1 < len(anchors) and anchors[to + 1] - anchors[to] < count:
                to += 1
            first, last = max(low, anchors[at] - count + 1), min(anchors[to], high - 1)
            for block in range(first, last + 1, 1024):
                starts = np.arange(block, min(block + 1024, last + 1))
                stops = np.minimum(starts + count, high)
                prints = self._prints(hashes, starts, stops)
                window, place = group.candidates(prints)
                self.looked_up += len(starts)
                self.met += len(window)
                apart = np.bitwise_count(prints.view("<u8").reshape(len(prints), -1)[window] ^ group.words[place]).sum(axis=1)
                for w, p, d in zip(window[apart <= self.radius].tolist(), place[apart <= self.radius].tolist(), apart[apart <= self.radius].tolist()):
                    i, start, stop = int(group.items[p]), int(starts[w]), int(stops[w])
                    alike = weighted_jaccard(*np.unique(hashes[start:stop], return_counts=True), *self.weights[i])
                    if alike >= self.similarity:
                        found.append((i, alike, start - low, stop - low + size - 1, d))
            at = to + 1
        return found

    @staticmethod
    def _prints(hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Fingerprints of windows (starts and stops ascending), as rows of bytes."""
        begin, end = int(starts[0]), int(stops[-1])
        sums = np.zeros((end - begin + 1, BITS), dtype=np.int32)
        for a in range(begin, end, 4096):
            own = sums[a - begin + 1 : min(a + 4096, end) - begin + 1]
            np.cumsum(bits_of(hashes[a : min(a + 4096, end)]), axis=0, dtype=np.int32, out=own)
            own += sums[a - begin]
        on = (sums[stops - begin] - sums[starts - begin]) * 2 > (stops - starts)[:, None]
        return np.packbits(on, axis=1, bitorder="little")

    @staticmethod
    def _best(hits: list[tuple[int, float, int, int, int]]) -> list[tuple[int, float, int, int, int]]:
        best: dict[int, tuple[int, float, int, int, int]] = {}
        for hit in hits:
            if hit[0] not in best or (-hit[1], hit[2]) < (-best[hit[0]][1], best[hit[0]][2]):
                best[hit[0]] = hit
        return [best[i] for i in sorted(best)]


def item_blocks(benchmark: DataFrame, block: int = 20_000, most_bytes: int = MOST_BYTES):
    """The benchmark's items in blocks of bounded count and size, in order of the item."""
    held, size = [], 0
    for row in benchmark.select("item_id", "text").where(F.col("text").isNotNull()).orderBy("item_id", "text").toLocalIterator():
        length = len(row["text"].encode())
        if held and (len(held) >= block or size + length > most_bytes):
            yield tuple(held)
            held, size = [], 0
        held.append((row["item_id"], row["text"]))
        size += length
    if held:
        yield tuple(held)


class Sent:
    """A block of items on its way to the executors, by broadcast; built into an index once a worker."""

    def __init__(self, docs: DataFrame, items: tuple, *settings):
        self.held, self.settings, self.name = docs.sparkSession.sparkContext.broadcast(items), settings, uuid.uuid4().hex

    def index(self) -> Index:
        return only(("decontaminate", self.name), lambda: Index(list(self.held.value), *self.settings))


def suspects(docs: DataFrame, benchmark: DataFrame, shingle: int, name: str) -> DataFrame:
    """``docs`` with a flag: whether a text may hold a shingle of the benchmark (never a false no)."""

    def keys(texts: list[str | None], cache: Words):
        for text in texts:
            words = np.fromiter(map(cache.__getitem__, words_of(text)), dtype=np.uint64)
            yield [mixed(words, size) for size in range(1, shingle + 1)]

    def of_items(batches):
        cache = Words()
        for batch in pieces(batches):
            for by_size in keys(batch.column("text").to_pylist(), cache):
                n = next((s for s in range(shingle, 0, -1) if len(by_size[s - 1])), 0)
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(by_size[n - 1].view(np.int64) ^ n)], names=["key"])

    held = docs.sparkSession.sparkContext.broadcast(bitmap(benchmark.select("text").mapInArrow(of_items, "key long")))
    names, given = docs.columns, docs.schema

    def flagged(batches):
        on, cache = np.frombuffer(held.value, dtype=np.uint8), Words()
        for batch in pieces(batches):
            flags = []
            for by_size in keys(batch.column("text").to_pylist(), cache):
                at = np.concatenate([h.view(np.int64) ^ n for n, h in enumerate(by_size, 1)]) & np.int64(8 * len(on) - 1)
                flags.append(bool((on[at >> 3] >> (at & 7).astype(np.uint8) & 1).any()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flags, pa.bool_())], names=[*names, name])

    from pyspark.sql.types import BooleanType, StructField, StructType

    return docs.mapInArrow(flagged, StructType([*given.fields, StructField(name, BooleanType())]))


def hits(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY, shingle: int = SHINGLE, block: int = 20_000) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, last_word, distance): the best window of each pair."""
    key, item = docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    schema = f"doc_id {key.simpleString()}, item_id {item.simpleString()}, similarity double, first_word long, last_word long, distance int"

    def searching(sent: Sent):
        def run(batches):
            index = sent.index()
            for batch in pieces(batches):
                found = index.find(batch.column("text").to_pylist())
                rows = [(k, index.ids[i], round(a, 6), b, c - 1, d) for k, own in zip(batch.column("doc_id").to_pylist(), found) for i, a, b, c, d in own]
                if rows:
                    kinds = (batch.schema.field("doc_id").type, None, pa.float64(), pa.int64(), pa.int64(), pa.int32())
                    names = ["doc_id", "item_id", "similarity", "first_word", "last_word", "distance"]
                    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=names)

        return run

    rows, parts = docs.select("doc_id", "text"), []
    for items, more in _with_more(item_blocks(benchmark, block)):
        if more and not parts:
            rows = saved(suspects(rows, benchmark, shingle, "__maybe").where("__maybe").drop("__maybe"), "suspects")
        found = rows.mapInArrow(searching(Sent(docs, items, radius, similarity, shingle)), schema)
        parts.append(saved(found, "hits") if more or parts else found)
    out = parts[0] if parts else docs.sparkSession.createDataFrame([], schema)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _with_more(blocks):
    """Each block, and whether another one follows."""
    last = next(blocks, None)
    while last is not None:
        following = next(blocks, None)
        yield last, following is not None
        last = following


def clean(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY, shingle: int = SHINGLE, block: int = 20_000) -> DataFrame:
    """The rows of ``docs`` whose text holds no window like an item; no shuffle, no join."""

    def keeping(sent: Sent):
        def run(batches):
            index = sent.index()
            for batch in pieces(batches):
                found = index.find(batch.column("text").to_pylist())
                yield batch.filter(pa.array([not x for x in found], pa.bool_()))

        return run

    rows, apart = docs, None
    for items, more in _with_more(item_blocks(benchmark, block)):
        if more and apart is None:
            flag = spare(docs.columns, "__maybe")
            marked = saved(suspects(docs, benchmark, shingle, flag), "suspects")
            rows, apart = marked.where(F.col(flag)).drop(flag), marked.where(~F.col(flag)).drop(flag)
        rows = rows.mapInArrow(keeping(Sent(docs, items, radius, similarity, shingle)), docs.schema)
        if apart is not None:
            rows = saved(rows, "kept")
    return rows if apart is None else rows.unionByName(apart)
