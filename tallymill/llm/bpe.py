"""Byte-level BPE with vectorised pre-tokenisation.

Boundaries come from class arrays, not from a regular expression: every code
point maps to a class, every class is a transition function of a small automaton,
and because composing functions is associative a blocked prefix scan yields the
automaton's state after every code point of many documents at once. A table over
(state before, state after) then says where tokens begin. The slices feed a cache
of merged pairs; each slice is merged once while it stays in the cache.

The automaton stands for ``public_tokenizers.PATTERN``: contractions, optional
single space before letters, numbers or other marks, and the two white-space rules.

Nulls in ``text`` encode as the empty text (no ids). Repeated rows give repeated
results, an empty table an empty one; other columns are left out unless ``keep``
names them.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallymill.llm.common import only, pieces

START, LETTER, NUMBER, MARK, SPACE, WHITE, QUOTE, R1, V1, L1, SHORT, LONG = range(12)
STATES = 12
#: Classes of code points.
C_LETTER, C_ONE, C_R, C_V, C_L, C_E, C_NUMBER, C_MARK, C_QUOTE, C_SPACE, C_WHITE, C_RESET = range(12)
BLOCK = 64


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of every code point, as the tiktoken library's own tables have it.

    The library is asked once per worker which code points its letter, number and
    white-space classes match, so both agree whatever Unicode version it carries.
    """
    import tiktoken

    points = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([i]): i for i in range(256)}

    def matched(pattern: str) -> np.ndarray:
        found = bytes(tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(points))
        return np.frombuffer(found.decode().encode("utf-32-le"), dtype=np.uint32)

    table = np.full(0x110000, C_MARK, dtype=np.uint8)
    table[matched(r"\p{L}+")] = C_LETTER
    table[matched(r"\p{N}+")] = C_NUMBER
    table[matched(r"\s+")] = C_WHITE
    for chars, kind in (("stmd", C_ONE), ("r", C_R), ("v", C_V), ("l", C_L), ("e", C_E), ("'", C_QUOTE), (" ", C_SPACE)):
        for c in chars:
            table[ord(c)] = kind
    return table


def _step(kind: int, state: int) -> int:
    if kind == C_RESET:
        return START
    if kind == C_QUOTE:
        return MARK if state in (MARK, SPACE, QUOTE) else QUOTE
    if kind in (C_NUMBER, C_MARK, C_SPACE, C_WHITE):
        return {C_NUMBER: NUMBER, C_MARK: MARK, C_SPACE: SPACE, C_WHITE: WHITE}[kind]
    if state == QUOTE:
        return {C_ONE: SHORT, C_R: R1, C_V: V1, C_L: L1}.get(kind, LETTER)
    if kind == C_E and state in (R1, V1) or kind == C_L and state == L1:
        return LONG
    return LETTER


@lru_cache(maxsize=1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element of each class, composition table, state reached by element and start)."""
    base = [tuple(_step(k, s) for s in range(STATES)) for k in range(12)]
    elements = list(dict.fromkeys(base))
    index = {f: i for i, f in enumerate(elements)}
    at = 0
    while at < len(elements):
        for g in base:
            new = tuple(g[s] for s in elements[at])
            if new not in index:
                index[new] = len(elements)
                elements.append(new)
        at += 1
    n = len(elements)
    assert n < 256
    compose = np.array([[index.get(tuple(g[s] for s in f), 0) for g in elements] for f in elements], dtype=np.uint8)
    return np.array([index[f] for f in base], dtype=np.uint8), compose, np.array(elements, dtype=np.uint8)


def _composed(own: np.ndarray) -> np.ndarray:
    """The composition of all functions up to each one: a blocked scan, and one of the blocks' totals."""
    _, compose, _ = _monoid()
    n, size, flat = len(own), len(compose), compose.ravel()
    rows = -(-n // BLOCK)
    grid = np.zeros(rows * BLOCK, dtype=np.uint8)
    grid[:n] = own
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    for j in range(1, BLOCK):
        grid[j] = flat[grid[j - 1].astype(np.uint16) * size + grid[j]]
    if rows > 1:
        before = _composed(grid[-1, :-1]).astype(np.uint16) * size
        grid[:, 1:] = flat[before[None, :] + grid[:, 1:]]
    return np.ascontiguousarray(grid.T).ravel()[:n]


def states_after(kinds: np.ndarray) -> np.ndarray:
    """State of the automaton after each class, from START."""
    first, _, reach = _monoid()
    if not len(kinds):
        return np.zeros(0, dtype=np.uint8)
    return reach[:, START][_composed(first[kinds])]


@lru_cache(maxsize=1)
def _begins() -> np.ndarray:
    """Whether a token begins between two states, but for the last character of white space."""
    out = np.zeros((STATES, STATES), dtype=bool)
    white, letters = (SPACE, WHITE), (LETTER, R1, V1, L1)
    for a in range(STATES):
        for b in range(STATES):
            if b in (SHORT, LONG):
                yes = False
            elif b in letters:
                yes = a not in (*letters, SPACE)
            elif b == NUMBER:
                yes = a not in (NUMBER, SPACE)
            elif b == MARK:
                yes = a not in (MARK, QUOTE, SPACE)
            elif b in white:
                yes = a not in white
            else:  # QUOTE or the reset between documents
                yes = True
            out[a, b] = yes
    return out.ravel()


def split_many(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Slices of all texts in order, and where each text's slices begin (one more at the end)."""
    joined = "\0".join([*texts, ""])
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    kinds = class_table()[codes]
    ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1) - 1
    kinds[ends] = C_RESET
    state = states_after(kinds)
    before = np.empty_like(state)
    before[:1] = START
    before[1:] = state[:-1]
    begin = _begins()[before.astype(np.uint16) * STATES + state]
    white = (state == SPACE) | (state == WHITE)
    solid = ~white & (kinds != C_RESET)
    begin[:-1] |= white[:-1] & solid[1:]
    longs = np.flatnonzero(state == LONG)
    begin[longs - 1] = False
    at = np.flatnonzero(begin)
    stop = np.empty_like(at)
    stop[:-1] = at[1:]
    stop[-1:] = len(codes)
    real = kinds[at] != C_RESET
    counts = np.concatenate([[0], np.cumsum(real)])
    bounds = counts[np.searchsorted(at, ends)]
    at, stop = at[real].tolist(), stop[real].tolist()
    return [joined[a:b] for a, b in zip(at, stop)], np.concatenate([[0], bounds])


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the pair of lowest rank merges first, leftmost among equals."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if len(parts) > 200:
        return _merge_long(parts, ranks)
    none = len(ranks) + 1
    pair = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pair:
        best = min(pair)
        if best == none:
            break
        i = pair.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i < len(pair):
            pair[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            pair[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes | None], ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap and a linked list, for slices of any length."""
    import heapq

    n = len(parts)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := ranks.get(a + b)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i] if parts[i] is not None else n
        if j >= n or parts[i] != a or parts[j] != b:
            continue
        parts[i], parts[j] = a + b, None
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
        for x, y in ((left[i], i), (i, right[i])):
            if x >= 0 and y < n and (r := ranks.get(parts[x] + parts[y])) is not None:
                heapq.heappush(heap, (r, x, parts[x], parts[y]))
    return [ranks[p] for p in parts if p is not None]


class Merged(dict):
    """Slice -> its ids as little-endian 32-bit integers; emptied when it holds ``most``."""

    def __init__(self, ranks: dict[bytes, int], most: int):
        super().__init__()
        self.ranks, self.most = ranks, most

    def __missing__(self, piece: str) -> bytes:
        out = np.array(merge(piece.encode(), self.ranks), dtype="<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = out
        return out


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Tokenizer:
    """What a worker holds: ranks, the bytes of every id, and slices that were merged before."""

    def __init__(self, path: str, most: int):
        self.ranks = load_ranks(path)
        self.vocabulary = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, i in self.ranks.items():
            self.vocabulary[i] = token
        self.lengths = np.array([len(x) for x in self.vocabulary], dtype=np.uint32)
        self.merged = Merged(self.ranks, most)


def tokenizer(path: str, most: int = 150_000) -> Tokenizer:
    return only(("bpe", path, most), lambda: Tokenizer(path, most))


def encode_texts(texts: list[str], path: str, most: int = 150_000) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers."""
    cache = tokenizer(path, most).merged
    found, bounds = split_many(texts)
    parts = list(map(cache.__getitem__, found))
    bounds = bounds.tolist()
    return [b"".join(parts[a:b]) for a, b in zip(bounds, bounds[1:])]


def decode_ids(ids: bytes, path: str) -> bytes:
    return b"".join(map(tokenizer(path).vocabulary.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def decode_span(ids: bytes, offsets: bytes, first: int, last: int, path: str) -> tuple[int, bytes]:
    """(byte offset in the text, bytes) of the tokens from ``first`` up to ``last``."""
    at = np.frombuffer(offsets, dtype="<u4")
    return int(at[first]) if first < len(at) else -1, decode_ids(ids[4 * first : 4 * last], path)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encode(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids, offsets): ids and each token's byte offset in the text.

    ``ids`` and ``offsets`` are little-endian unsigned 32-bit integers. Works
    within a scan: no shuffle; a task holds a few million characters at a time.
    """
    path = path or default_ranks()

    def run(batches):
        for batch in pieces(batches):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            ids = encode_texts(texts, path)
            at = []
            for x in ids:
                size = tokenizer(path).lengths[np.frombuffer(x, dtype="<u4")]
                at.append((np.cumsum(size, dtype=np.uint32) - size).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(at, pa.binary())],
                names=[key, "n_tokens", "ids", "offsets"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids binary, offsets binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The encoded rows with ``decoded`` (the text's bytes) in place of ``offsets``."""
    path = path or default_ranks()
    names = [c for c in encoded.columns if c != "offsets"]

    def run(batches):
        for batch in batches:
            out = [decode_ids(x or b"", path) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.binary())], names=[*names, "decoded"])

    kept = encoded.select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{schema}, decoded binary")


def round_trip(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids, decoded): ``decode`` of ``encode`` in one Python stage, so that a core has one worker."""
    path = path or default_ranks()

    def run(batches):
        for batch in pieces(batches):
            ids = encode_texts([x or "" for x in batch.column("text").to_pylist()], path)
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            decoded = pa.array([decode_ids(x, path) for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("key"), counts, pa.array(ids, pa.binary()), decoded], names=[key, "n_tokens", "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids binary, decoded binary")
