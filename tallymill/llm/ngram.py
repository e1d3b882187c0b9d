"""Language-model scoring by an Elias-Fano n-gram trie.

Level one has all training words, level two the successors of each word. The trie
is cut into segments of bounded training tokens along (word, successor); a word with
more successors than a segment holds spans several. A segment file keeps

* pointers: where each word's successors begin, an Elias-Fano sequence;
* successors: ids relative to their context (word index * vocabulary + id), another
  one, queried by successor search within the context's range;
* quantised log10 probabilities of both levels, 16 bits each.

Probabilities are smoothed by interpolated absolute discounting with three discounts
estimated from the counts of counts; the lower order is the add-0.1 unigram. A text
is scored with an end token before it (context only) and after it.

Words are 64-bit hashes (XXH64) of ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z;
ids are ranks of hashes. Counting is distributed: tasks pre-aggregate words and pairs,
exchange compressed blocks by segment, and every segment is merged and encoded by
one task. Workers map the files from the shared folder. Nothing is pruned or capped.

Training rows are those whose crc32(doc_id as text) mod 10 isn't 0. A null ``doc_id``
is held out. Null texts are empty: one end token. Repeated rows count and score each
time. Without training rows N and V are 0 and every token is unknown. Extra columns
are ignored.
"""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm import eliasfano as ef
from tallymill.llm.common import blocks, fresh_dir, only, open_fs, saved

PARTS = 16  # of the vocabulary, by the top four bits of the hash
END = b"\n"  # no word holds it
ADD = 0.1
STEP = 4096.0  # quantisation: log10 probabilities in steps of 1/4096
FLOOR = 65535
BLOCK = 8 << 20  # bytes of text whose words are made distinct before they are looked up
PAIRS = 3_000_000  # pairs that are made distinct before they are looked up: every time visits all segments


def hashes_of(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def bytes_of(words: pa.Array) -> list[bytes]:
    """The words, none of which is null."""
    if not len(words):
        return []
    edges = np.frombuffer(words.buffers()[1], dtype=np.int64 if pa.types.is_large_string(words.type) else np.int32)
    edges = edges[words.offset : words.offset + len(words) + 1].tolist()
    data = words.buffers()[2].slice(0, edges[-1]).to_pybytes() if edges[-1] else b""
    return list(map(data.__getitem__, map(slice, edges, edges[1:])))


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each distinct token, each token's place among them, tokens of each text).

    An end follows every text's words; it is the last of the distinct tokens.
    """
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    coded = words.flatten().dictionary_encode()
    codes, edges = coded.indices.to_numpy(), words.offsets.to_numpy()
    distinct = bytes_of(coded.dictionary)
    if (empty := coded.dictionary.index("").as_py()) >= 0:  # beside leading and trailing blanks
        kept = codes != empty
        codes, edges = codes[kept] - (codes[kept] > empty), np.concatenate([[0], np.cumsum(kept)])[edges]
        del distinct[empty]
    sizes = np.diff(edges).astype(np.int64) + 1
    ends = np.cumsum(sizes) - 1
    out = np.empty(int(sizes.sum()), dtype=np.int32)
    inner = np.ones(len(out), dtype=bool)
    inner[ends] = False
    out[ends], out[inner] = len(distinct), codes
    return hashes_of([*distinct, END]), out, sizes


def held_out(key: str = "doc_id", mod: int = 10):
    return F.coalesce(F.crc32(F.col(key).cast("string")), F.lit(0)) % mod == 0


def quantised(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.clip(np.rint(-np.log10(p) * STEP), 0, FLOOR).astype(np.uint16)


def packed(values: np.ndarray, kind: str) -> bytes:
    """An integer array by byte planes, compressed."""
    import zstandard

    raw = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(len(values), -1)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes())


def unpacked(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def write_arrays(folder: str, name: str, arrays: dict[str, np.ndarray]) -> str:
    """One file: a JSON header with each array's place, then the arrays, 64-byte aligned."""
    table, at = {}, 0
    for key, a in arrays.items():
        table[key] = (at, str(a.dtype), len(a))
        at += -(-a.nbytes // 64) * 64
    head = json.dumps(table).encode()
    head += b" " * (-(len(head) + 8) % 64)
    fs, path = open_fs(folder)
    with fs.open_output_stream(f"{path}/{name}") as f:
        f.write(len(head).to_bytes(8, "little") + head)
        for a in arrays.values():
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 64))
    return name


def map_arrays(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays, mapped. From a store that can't be mapped the file is fetched once."""
    fs, path = open_fs(folder)
    local = f"{path}/{name}"
    if fs.type_name != "local":
        fd, local = tempfile.mkstemp()
        with os.fdopen(fd, "wb") as out, fs.open_input_stream(f"{path}/{name}") as f:
            while part := f.read(1 << 24):
                out.write(part)
    data = np.asarray(np.memmap(local, dtype=np.uint8, mode="r"))  # slices of a plain array are cheaper
    if fs.type_name != "local":
        os.unlink(local)  # the mapping keeps it
    size = int.from_bytes(data[:8].tobytes(), "little")
    table = json.loads(data[8 : 8 + size].tobytes())
    base = 8 + size
    return {k: data[base + at : base + at + n * np.dtype(kind).itemsize].view(kind) for k, (at, kind, n) in table.items()}


class Vocabulary:
    """Hash -> id and count, from the mapped parts."""

    def __init__(self, folder: str, names: list[str], sizes: list[int]):
        self.parts = [map_arrays(folder, n) if n else None for n in names]
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.size = int(self.base[-1])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id (-1 where it is unknown) and count of each hash."""
        ids, counts = np.full(len(hashes), -1, dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        order = np.argsort(hashes)  # searches in ascending order stay in the cache
        hashes = hashes[order]
        edges = np.append(np.searchsorted(hashes, np.arange(PARTS, dtype=np.uint64) << np.uint64(60)), len(hashes)).tolist()
        for p, (a, b) in enumerate(zip(edges, edges[1:])):
            if b > a and self.parts[p] is not None:
                known = self.parts[p]["hash"]
                at = np.searchsorted(known, hashes[a:b])
                hit = known[np.minimum(at, len(known) - 1)] == hashes[a:b]
                ids[order[a:b][hit]] = self.base[p] + at[hit]
                counts[order[a:b][hit]] = self.parts[p]["count"][at[hit]]
        return ids, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), dtype=np.int64)
        part = np.searchsorted(self.base, ids, side="right") - 1
        for p in np.unique(part[ids >= 0]):
            own = np.flatnonzero((part == p) & (ids >= 0))
            out[own] = self.parts[p]["count"][ids[own] - self.base[p]]
        return out


def _vocabulary(folder: str, names: tuple, sizes: tuple) -> Vocabulary:
    return only(("words", folder), lambda: Vocabulary(folder, list(names), list(sizes)))


def count_words(docs: DataFrame) -> DataFrame:
    """(hash, n) of training words, summed in tasks first."""

    def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        hashes, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(hashes)
        hashes, n = hashes[order], n[order]
        starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        return hashes[starts], np.add.reduceat(n, starts)

    def rows(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        hashes, n = summed(held)
        for at in range(0, len(n), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000].view(np.int64)) for x in (hashes, n)], names=["hash", "n"])

    def run(batches):
        held, size = [], 0
        for batch in blocks(batches, BLOCK):
            hashes, codes, _ = tokens_of(batch.column("text"))
            held.append((hashes, np.bincount(codes, minlength=len(hashes))))
            size += len(hashes)
            if size > 1_000_000:
                held = [summed(held)]
                size = len(held[0][0])
                if size > 500_000:
                    yield from rows(held)
                    held, size = [], 0
        if held:
            yield from rows(held)

    return docs.select("text").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def write_vocabulary(words: DataFrame, folder: str, tokens: int) -> DataFrame:
    """One row a part: its file, words, tokens, and where segments begin within it.

    A cut is (word within the part, share of the vocabulary of successors).
    """

    def run(group: pa.Table) -> pa.Table:
        from pyspark import TaskContext

        hashes = group["hash"].to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        hashes, n = hashes[order], group["n"].to_numpy()[order]
        part = group["part"][0].as_py()
        name = write_arrays(folder, f"words-{part:02d}-{TaskContext.get().taskAttemptId()}", {"hash": hashes, "count": n.astype(np.int64)})
        cuts, held = [(0, 0.0)], 0
        for at, c in enumerate(n.tolist()):
            if held and held + c > tokens:
                cuts.append((at, 0.0))
                held = 0
            extra = -(-c // tokens)
            cuts += [(at, j / extra) for j in range(1, extra)]
            held = held + c if extra == 1 else c // extra
        return pa.table({"part": pa.array([part], pa.int32()), "name": [name], "words": pa.array([len(n)], pa.int64()), "tokens": pa.array([int(n.sum())], pa.int64()), "cut_word": pa.array([[c[0] for c in cuts]], pa.list_(pa.int64())), "cut_share": pa.array([[c[1] for c in cuts]], pa.list_(pa.float64()))})

    parted = words.withColumn("part", F.shiftrightunsigned("hash", 60).cast("int"))
    return parted.groupBy("part").applyInArrow(run, "part int, name string, words long, tokens long, cut_word array<long>, cut_share array<double>")


def count_pairs(docs: DataFrame, folder: str, names: tuple, sizes: tuple, cuts: bytes) -> DataFrame:
    """(segment, keys, counts): blocks of sorted distinct pairs, pre-summed in tasks."""

    def run(batches):
        vocabulary = _vocabulary(folder, names, sizes)
        bounds = np.frombuffer(cuts, dtype=np.uint64)
        held, size = [], 0

        def counted():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            edges = np.append(np.searchsorted(keys, bounds), len(keys))
            rows = [(s, keys[a:b], n[a:b]) for s, (a, b) in enumerate(zip(edges.tolist(), edges[1:].tolist())) if b > a]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([packed(np.diff(r[1], prepend=np.uint64(0)), "<u8") for r in rows], pa.binary()), pa.array([packed(r[2], "<u4") for r in rows], pa.binary())],
                names=["segment", "keys", "counts"],
            )

        for batch in blocks(batches, BLOCK):
            hashes, codes, _ = tokens_of(batch.column("text"))
            ids = vocabulary.find(hashes)[0].astype(np.uint64)
            held.append(np.append(ids[-1], ids[codes[:-1]]) << np.uint64(32) | ids[codes])  # an end before the first text
            size += len(codes)
            if size > 1_500_000:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    return docs.select("text").mapInArrow(run, "segment int, keys binary, counts binary")


def merge_pairs(blocks: DataFrame, folder: str) -> DataFrame:
    """Each segment's pairs in one file; counts of counts, and those of its first and last word."""

    def run(group: pa.Table) -> pa.Table:
        from pyspark import TaskContext

        segment = group["segment"][0].as_py()
        keys = np.concatenate([np.cumsum(unpacked(x.as_py(), "<u8")) for x in group["keys"]])
        n = np.concatenate([unpacked(x.as_py(), "<u4") for x in group["counts"]]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, n = keys[starts], np.add.reduceat(n, starts)
        name = f"pairs-{segment:06d}-{TaskContext.get().taskAttemptId()}"
        delta, count = packed(np.diff(keys, prepend=np.uint64(0)), "<u8"), packed(n, "<i8")
        write_arrays(folder, name, {"keys": np.frombuffer(delta, np.uint8), "counts": np.frombuffer(count, np.uint8)})
        first, last = keys >> np.uint64(32) == keys[0] >> np.uint64(32), keys >> np.uint64(32) == keys[-1] >> np.uint64(32)
        edge = [[int(((n == k) & m).sum()) for k in (1, 2)] + [int(((n > 2) & m).sum())] for m in (first, last)]
        return pa.table({"segment": pa.array([segment], pa.int32()), "name": [name], "kinds": pa.array([[int((n == k).sum()) for k in (1, 2, 3, 4)]], pa.list_(pa.int64())), "first": pa.array([int(keys[0] >> np.uint64(32))], pa.int64()), "last": pa.array([int(keys[-1] >> np.uint64(32))], pa.int64()), "first_kinds": pa.array([edge[0]], pa.list_(pa.int64())), "last_kinds": pa.array([edge[1]], pa.list_(pa.int64()))})

    return blocks.groupBy("segment").applyInArrow(
        run, "segment int, name string, kinds array<long>, first long, last long, first_kinds array<long>, last_kinds array<long>"
    )


def discounts(kinds: list[int]) -> list[float]:
    """Discounts of counts 1, 2 and 3 or more, from the counts of counts."""
    n1, n2, n3, n4 = kinds
    if not (n1 and n2 and n3):
        return [0.5, 0.75, 1.0]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05), k - 0.01) for k, d in enumerate(raw, 1)]


def encode_segment(folder: str, source: str, name: str, vocabulary: Vocabulary, total: int, less: list[float], edges: dict[int, list[int]]) -> str:
    """Turn a segment's counts into its trie file. ``edges``: counts of counts of words that span segments."""
    data = map_arrays(folder, source)
    keys = np.cumsum(unpacked(data["keys"].tobytes(), "<u8"))
    n = unpacked(data["counts"].tobytes(), "<i8")
    word, successor = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    low, high = int(word[0]), int(word[-1]) + 1
    local, size = word - low, max(vocabulary.size, 1)
    pointers = np.searchsorted(local, np.arange(high - low + 1))
    kinds = np.stack([np.bincount(local, weights=m, minlength=high - low) for m in (n == 1, n == 2, n > 2)], axis=1)
    for w, k in edges.items():
        if low <= w < high:
            kinds[w - low] = k
    context = np.maximum(vocabulary.counts(np.arange(low, high)), 1)
    back = kinds @ np.array(less) / context
    under = (vocabulary.counts(successor) + ADD) / (total + ADD * (vocabulary.size + 1))
    p = (n - np.array(less)[np.minimum(n, 3) - 1]) / context[local] + back[local] * under
    arrays = {f"pointer_{k}": v for k, v in ef.build(pointers, len(keys) + 1).items()}
    arrays |= {f"next_{k}": v for k, v in ef.build(local * size + successor, (high - low) * size).items()}
    arrays |= {"range": np.array([low, high], np.int64), "back": quantised(np.maximum(back, 1e-15)), "prob": quantised(p)}
    return write_arrays(folder, name, arrays)


class Segment:
    def __init__(self, arrays: dict[str, np.ndarray], size: int):
        pick = lambda prefix: ef.EliasFano(*(arrays[f"{prefix}_{k}"] for k in ("head", "high", "zeros", "low", "zero_hints", "one_hints")))
        self.low, self.high = (int(x) for x in arrays["range"])
        self.pointer, self.next, self.size = pick("pointer"), pick("next"), size
        self.back, self.prob = arrays["back"], arrays["prob"]

    def look_up(self, word: np.ndarray, successor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether the pair is there, its code); words sorted."""
        there = np.zeros(len(word), dtype=bool)
        code = np.zeros(len(word), dtype=np.uint16)
        inside = np.flatnonzero((word >= self.low) & (word < self.high))
        if len(inside):
            local = word[inside] - self.low
            at, hit = self.next.successor(local * self.size + successor[inside])
            first = np.concatenate([[True], local[1:] != local[:-1]])
            own, back = local[first], np.cumsum(first) - 1
            begin, end = self.pointer[own], self.pointer[own + 1]
            hit &= (at >= begin[back]) & (at < end[back])
            there[inside] = hit
            code[inside[hit]] = self.prob[at[hit]]
        return there, code


class Model:
    """The trie as workers use it."""

    def __init__(self, folder: str):
        fs, path = open_fs(folder)
        with fs.open_input_stream(f"{path}/model.json") as f:
            self.meta = meta = json.loads(f.read())
        self.vocabulary = Vocabulary(folder, meta["words"], meta["sizes"])
        self.folder, self.total = folder, meta["tokens"]
        self.bounds = np.array(meta["cuts"], dtype=np.uint64)
        self.names = {int(k): v for k, v in meta["segments"].items()}
        self.open: dict[int, Segment] = {}
        self.scale = np.log10(self.total + ADD * (self.vocabulary.size + 1))

    def segment(self, s: int) -> Segment | None:
        if s not in self.open and s in self.names:
            self.open[s] = Segment(map_arrays(self.folder, self.names[s]), max(self.vocabulary.size, 1))
        return self.open.get(s)

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.log10(counts + ADD) - self.scale

    def backs(self, words: np.ndarray, segments: np.ndarray) -> np.ndarray:
        """log10 back-off weight of each word (0 where it has none); words sorted."""
        out = np.zeros(len(words))
        some, begin = np.unique(segments, return_index=True)
        for s, a, b in zip(some.tolist(), begin.tolist(), np.append(begin[1:], len(words)).tolist()):
            if (part := self.segment(s)) is not None:
                inside = a + np.flatnonzero((words[a:b] >= part.low) & (words[a:b] < part.high))
                out[inside] = part.back[words[inside] - part.low] / -STEP
        return out

    def coded(self, texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Figures of each text, where ``score`` lacks the pairs; the pairs with a known context; each pair's row."""
        hashes, codes, sizes = tokens_of(texts)
        id_of, count_of = self.vocabulary.find(hashes)
        ids = id_of[codes]
        context = np.append(id_of[-1], ids[:-1])  # the end before a text is its context
        base = self.unigram(count_of)[codes]
        known = context >= 0
        row = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        total = lambda x: np.bincount(row, weights=x, minlength=len(texts))
        out = {"n_tokens": sizes, "n_known": total(ids >= 0).astype(np.int64), "base_score": total(base), "score": total(np.where(known, 0.0, base))}
        # the low half of -1 stands for an unknown word, so that unknown successors back off too
        return out, context[known].astype(np.uint64) << np.uint64(32) | (ids[known] & 0xFFFFFFFF).astype(np.uint64), row[known]

    def logs(self, pairs: np.ndarray) -> np.ndarray:
        """log10 probability of each pair's second word after its first."""
        order = np.argsort(pairs)
        keys = pairs[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
        keys = keys[starts]
        halves = lambda x: ((x >> np.uint64(32)).astype(np.int64), (x & np.uint64(0xFFFFFFFF)).astype(np.int64))
        there, value = np.zeros(len(keys), dtype=bool), np.zeros(len(keys))
        edges = np.append(np.searchsorted(keys, self.bounds), len(keys)).tolist()
        for s, (a, b) in enumerate(zip(edges, edges[1:])):
            if b > a and (part := self.segment(s)) is not None:
                word, successor = halves(keys[a:b])
                own = np.flatnonzero(successor < self.vocabulary.size)
                hit, code = part.look_up(word[own], successor[own])
                there[own + a], value[own + a] = hit, code / -STEP
        # Back-off weights come from the segment where the word begins.
        missing = np.flatnonzero(~there)
        word, successor = halves(keys[missing])
        firsts = np.searchsorted(self.bounds, word.astype(np.uint64) << np.uint64(32), side="right") - 1
        under = self.unigram(self.vocabulary.counts(np.where(successor < self.vocabulary.size, successor, -1)))
        value[missing] = self.backs(word, firsts) + under
        out = np.empty(len(pairs))
        out[order] = np.repeat(value, np.diff(np.append(starts, len(pairs))))
        return out


def _model(folder: str) -> Model:
    return only(("model", folder), lambda: Model(folder))


def scored(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def finished() -> Iterator[pa.RecordBatch]:
        logs, at = model.logs(np.concatenate([pairs for _, _, pairs, _ in held])), 0
        for batch, out, pairs, row in held:
            score = out["score"] + np.bincount(row, weights=logs[at : at + len(pairs)], minlength=batch.num_rows)
            at += len(pairs)
            total = pa.array(np.full(batch.num_rows, model.total, dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(out["n_tokens"]), pa.array(out["n_known"]), total, pa.array(out["base_score"]), pa.array(score)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    for batch in blocks(batches, BLOCK):
        held.append((batch.select(["doc_id", "held_out"]), *model.coded(batch.column("text"))))
        size += len(held[-1][2])
        if size > PAIRS:
            yield from finished()
            held, size = [], 0
    if held:
        yield from finished()


def train(docs: DataFrame, tokens: int = 1_000_000, folder: str | None = None) -> str:
    """Count, smooth and encode; the model's folder. ``tokens`` bounds a segment."""
    spark = docs.sparkSession
    folder = folder or fresh_dir(spark, "ngram")
    fs, path = open_fs(folder)
    fs.create_dir(path, recursive=True)
    part = docs.where(~held_out()).select("text")
    parts = {r["part"]: r for r in saved(write_vocabulary(count_words(part), folder, tokens), "words").collect()}  # 16 rows
    names = tuple(parts[p]["name"] if p in parts else "" for p in range(PARTS))
    sizes = tuple(parts[p]["words"] if p in parts else 0 for p in range(PARTS))
    total, size = sum(r["tokens"] for r in parts.values()), sum(sizes)
    if size >= 1 << 31:
        raise ValueError("more words than a 32-bit id holds")
    cuts = []
    for p in sorted(parts):
        cuts += [(sum(sizes[:p]) + w << 32) + int(share * size) for w, share in zip(parts[p]["cut_word"], parts[p]["cut_share"])]
    bounds = np.array(cuts, dtype=np.uint64)
    segments = []
    if parts:
        merged = merge_pairs(count_pairs(part, folder, names, sizes, bounds.tobytes()), folder)
        segments = sorted(saved(merged, "pairs").collect(), key=lambda r: r["segment"])  # a row a segment
    kinds = [sum(r["kinds"][k] for r in segments) for k in range(4)]
    edges: dict[int, list[int]] = {}
    for r in segments:
        for word, own in {r["first"]: r["first_kinds"], r["last"]: r["last_kinds"]}.items():
            edges[word] = [a + b for a, b in zip(edges.get(word, [0, 0, 0]), own)]
    less = discounts(kinds)

    def run(batches):
        from pyspark import TaskContext

        vocabulary = _vocabulary(folder, names, sizes)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"trie-{row['segment']:06d}-{TaskContext.get().taskAttemptId()}"
                encode_segment(folder, row["name"], name, vocabulary, total, less, {w: edges[w] for w in (row["first"], row["last"])})
                yield pa.RecordBatch.from_pydict({"segment": pa.array([row["segment"]], pa.int32()), "name": [name]})

    written = []
    if segments:
        rows = spark.createDataFrame([(r["segment"], r["name"], r["first"], r["last"]) for r in segments], "segment int, name string, first long, last long")
        written = saved(rows.repartition(min(len(segments), 10_000)).mapInArrow(run, "segment int, name string"), "trie").collect()
        for r in segments:
            fs.delete_file(f"{path}/{r['name']}")
    meta = {"tokens": total, "words": names, "sizes": sizes, "cuts": cuts, "discounts": less, "segments": {r["segment"]: r["name"] for r in written}}
    with fs.open_output_stream(f"{path}/model.json") as f:
        f.write(json.dumps(meta).encode())
    return folder


def score(docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""

    def run(batches):
        yield from scored(_model(folder), batches)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
