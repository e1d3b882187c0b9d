"""Token-id files: one zstandard dictionary, each document compressed by itself.

The dictionary is trained on the serialised ids of a bounded sample of documents
(``sample`` of them, the ones with the lowest hash of their id; the first 32,768
characters of each, 64 KB of ids) and shared by all files. The sample decides how well
ids compress, nothing else: every text is encoded and stored whole. A file is::

    magic (8) | SHA-256 of the dictionary (32) | id width (8) | frames | index | trailer

where the index holds each frame's offset and id count, and the trailer the index's
place. One document is read by two small reads: its index entry and its frame.

Ids come from the tokenizers library. A text is cut before single spaces, where the
byte-level pattern always begins a new piece, and a piece of letters and a tail is
cut before the tail; each distinct piece is encoded by the library once while it
stays in a bounded cache; a piece of letters alone, which no pattern splits, by the
library's model directly. Texts with other white space around spaces, or with a
special token's string, go to the library whole.

Files follow ascending (doc_id, hash of the text, running number of the row as read): a
null ``doc_id`` comes first, and however many rows share a ``doc_id``, or are equal, the
range partitioning splits them. Their number follows the input's size. A ``doc_id`` has
to be an integer (ValueError else). A null text has only the end id. Extra columns are
ignored; an empty table gives no files.
Each attempt of a task writes under a name of its own and only files in the saved
manifest are read, so lost executors and repeated tasks do no harm.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tallymill.llm.common import fresh_dir, only, open_fs, pieces, saved, text_or_empty

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

MAGIC = b"TMIDS1\0\0"
END = 0
FILE_BYTES = 128 << 20  # of input a file
_ODD = re.compile(r"\s \s|\s \Z")
#: Letters that every Unicode version has as letters, then a mark or white space.
_TAIL = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~\n].*)", re.S)


_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")


def byte_letters() -> dict[int, int]:
    """How the byte-level vocabulary writes a byte: printable bytes as they are, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts as little-endian arrays, by the library and a cache of pieces."""

    def __init__(self, path: str, most: int = 700_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.width = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.cache: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.most = most

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.width).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, wanted: set[str]) -> list[str]:
        """Put the pieces (without the space before them) into the cache; those that were new."""
        cache, tails = self.cache, self.tails
        missing = [x for x in wanted if x not in cache]
        cut = {x: m.groups() for x in missing if (m := _TAIL.fullmatch(x))}
        heads = {x for x in missing if x not in cut} | {h for h, _ in cut.values() if h not in cache}
        plain = list(heads)
        rest = []
        tokenize, letters, width = self.library.model.tokenize, self.letters, self.width
        for x in plain:
            if _LETTERS.fullmatch(x):
                cache[x] = np.array([t.id for t in tokenize((" " + x).encode().decode("latin-1").translate(letters))], dtype=width).tobytes()
            else:
                rest.append(x)
        cache.update(zip(rest, self._ask([" " + x for x in rest])))
        ends = list({t for _, t in cut.values() if t not in tails})
        tails.update(zip(ends, self._ask(ends)))
        for x, (head, tail) in cut.items():
            cache[x] = cache[head] + tails[tail]
        for x in [x for x in ends if len(x) > 64]:
            del tails[x]
        return [*plain, *cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [t.split(" ") for t in texts]
        wanted: set[str] = set()
        for parts in cut:
            wanted.update(parts[1:])
        # Only a piece that is empty or begins with white space can follow other white space.
        odd = {x for x in wanted if not x or x[0].isspace()}
        whole = {i for i, t in enumerate(texts) if any(s in t for s in self.specials) or odd and not odd.isdisjoint(cut[i]) and _ODD.search(t)}
        if whole:
            wanted = {x for i, parts in enumerate(cut) if i not in whole for x in parts[1:]}
        if len(self.cache) + len(self.tails) + len(wanted) > self.most:
            self.cache.clear()
            self.tails.clear()
        new = self._learn(wanted)
        rest = [i for i in range(len(texts)) if i not in whole]
        out: list[bytes] = [b""] * len(texts)
        get = self.cache.__getitem__
        for i, head in zip(rest, self._ask([cut[i][0] for i in rest])):
            out[i] = head + b"".join(map(get, cut[i][1:]))
        for i, ids in zip(sorted(whole), self._ask([texts[i] for i in sorted(whole)])):
            out[i] = ids
        for x in [x for x in new if len(x) > 64]:
            del self.cache[x]
        return out


def _encoder(path: str) -> Encoder:
    return only(("idfiles", path), lambda: Encoder(path))


def train_dictionary(docs: DataFrame, path: str, sample: int, size: int) -> bytes:
    """A zstandard dictionary from ``sample`` documents' ids (64 KB of each at most)."""
    import zstandard

    chosen = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    ids = [r[0] for r in chosen if r[0] is not None]
    rows = docs.where(F.col("doc_id").isin(ids)).select("doc_id", F.substring(text_or_empty(), 1, 1 << 15).alias("text")).orderBy("doc_id", "text").limit(sample).collect() if ids else []
    arrays = [x[: 1 << 16] for x in _encoder(path).encode([r["text"] for r in rows]) if x]
    try:
        return zstandard.train_dictionary(size, arrays).as_bytes()
    except zstandard.ZstdError:  # too little to train on: the raw ids serve as a prefix
        return b"".join(arrays)[:size]


def size_of(df: DataFrame) -> int:
    """Bytes that the plan's statistics give the input; 0 where they know nothing."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else 0


def _dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw) if raw else None


def write_ids(docs: DataFrame, vocabulary: str | None = None, sample: int = 400, dict_size: int = 65_536, folder: str | None = None) -> DataFrame:
    """Write the files; the manifest (part, path, docs, ids), kept as Parquet."""
    spark = docs.sparkSession
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise ValueError("doc_id has to be an integer: files are in its order and frames hold it as 64 bits")
    vocabulary = vocabulary or default_vocabulary()
    folder = folder or fresh_dir(spark, "ids")
    raw = train_dictionary(docs, vocabulary, sample, dict_size)
    fs, at = open_fs(folder)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/dictionary") as f:
        f.write(raw)

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        encoder = _encoder(vocabulary)
        end = np.array([END], dtype=encoder.width).tobytes()
        wide = int(encoder.width[-1])
        here, path = open_fs(folder)
        with here.open_input_stream(f"{path}/dictionary") as f:
            given = f.read()
        squeeze = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(given))
        task = TaskContext.get()
        name = f"{path}/part-{task.partitionId():07d}-{task.taskAttemptId()}.ids"
        out, offsets, counts = None, [], []
        for batch in pieces(batches):
            if out is None:
                out = here.open_output_stream(name)
                out.write(MAGIC + hashlib.sha256(given).digest() + struct.pack("<Q", wide))
            keys = batch.column("doc_id").to_pylist()
            for key, ids in zip(keys, encoder.encode([x or "" for x in batch.column("text").to_pylist()])):
                ids += end
                frame = squeeze.compress(struct.pack("<?q", key is not None, key or 0) + ids)
                out.write(frame)
                offsets.append(len(frame))
                counts.append(len(ids) // wide)
        if out is None:
            return
        ends = np.cumsum([48, *offsets], dtype="<u8")
        out.write(ends.tobytes() + np.array(counts, dtype="<u4").tobytes() + struct.pack("<QQ", int(ends[-1]), len(counts)))
        out.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int64()), "path": [name], "docs": pa.array([len(counts)], pa.int64()), "ids": pa.array([sum(counts)], pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.monotonically_increasing_id().alias("__row"))
    order = ["doc_id", F.xxhash64("text"), "__row"]
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size_of(docs) // FILE_BYTES))
    manifest = rows.repartitionByRange(files, *order).sortWithinPartitions(*order).drop("__row").mapInArrow(run, "part long, path string, docs long, ids long")
    manifest = saved(manifest, "id-manifest")
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return manifest.withColumn("start", before).withColumn("folder", F.lit(folder))


class IdFile:
    """Reads one file; ``document`` fetches a single frame."""

    def __init__(self, fs, path: str, dictionary: bytes):
        import zstandard

        self.file = fs.open_input_file(path)
        self.size = self.file.size()
        head = self._at(0, 48)
        if head[:8] != MAGIC:
            raise ValueError(f"{path}: not a token-id file")
        if head[8:40] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path}: written with another dictionary")
        self.width = f"<u{struct.unpack('<Q', head[40:48])[0]}"
        self.index, self.count = struct.unpack("<QQ", self._at(self.size - 16, 16))
        self.expand = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def _at(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        return self.file.read(length)

    def _open(self, frame: bytes) -> tuple[int | None, np.ndarray]:
        body = self.expand.decompress(frame)
        there, key = struct.unpack_from("<?q", body)
        return (key if there else None), np.frombuffer(body, dtype=self.width, offset=9)

    def document(self, i: int) -> tuple[int | None, np.ndarray]:
        start, stop = struct.unpack("<QQ", self._at(self.index + 8 * i, 16))
        return self._open(self._at(start, stop - start))

    def __iter__(self):
        ends = np.frombuffer(self._at(self.index, 8 * (self.count + 1)), dtype="<u8").tolist()
        self.file.seek(ends[0] if ends else 48)
        for a, b in zip(ends, ends[1:]):
            yield self._open(self.file.read(b - a))


def read_ids(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files of the manifest.

    ``ids`` are little-endian unsigned 32-bit integers, end id included.
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, at = open_fs(row["folder"])
                with fs.open_input_stream(f"{at}/dictionary") as f:
                    dictionary = f.read()
                start, out, held = row["start"], [], 0
                for key, ids in IdFile(fs, row["path"], dictionary):
                    out.append((key, start, len(ids), ids.astype("<u4").tobytes()))
                    start += len(ids)
                    held += len(ids)
                    if held > 1 << 20:
                        yield _rows(out)
                        out, held = [], 0
                if out:
                    yield _rows(out)

    files = manifest.select("path", "folder", "start")
    spread = max(1, min(files.count(), 10_000))
    return files.repartition(spread).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds.values())], names=list(kinds))
