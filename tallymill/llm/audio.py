"""Media columns: audio features over losslessly stored samples.

``store`` writes each text's bytes, padded with spaces to whole blocks of 192, as
8-bit mono PCM in a WAV container. ``features`` reads the container back, brings
the samples to two thirds of their rate by a polyphase filter, takes overlapped
log-mel filterbanks, segments them by energy with hysteresis, and packs the frames
into tensors of one fixed shape, each with its time span, as an Arrow stream whose
tensor column has the fixed-shape-tensor type.

A null text is stored as the empty text, one block of spaces. Values depend on the
text alone, so equal texts have equal values. An empty table gives an empty one;
other columns are ignored. Frames are made in blocks, so memory follows the
longest text by a small factor.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallymill.llm.common import pieces, texts_of

BLOCK = 192
RATE, UP, DOWN = 24_000, 2, 3
WINDOW, HOP, BANDS = 256, 128, 16
SHAPE = (64, BANDS)
HEADER = 44


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """A WAV file of unsigned 8-bit mono samples (an even number, so no padding byte)."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", HEADER - 8 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload


def from_wav(media: bytes) -> bytes:
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def padded(text: bytes) -> bytes:
    return text + b" " * (-len(text) % BLOCK if text else BLOCK)


@lru_cache(maxsize=1)
def _filter(half: int = 8) -> np.ndarray:
    """(phase, tap): a windowed sinc at the lower of the two Nyquist rates, cut into phases."""
    length = 2 * half * DOWN + 1
    x = np.arange(length) - half * DOWN
    taps = np.sinc(x / DOWN) * np.hamming(length) / DOWN * UP
    taps = np.concatenate([taps, np.zeros(-length % UP)])
    return np.ascontiguousarray(taps.reshape(-1, UP).T[:, ::-1].astype(np.float32))


def resample(samples: np.ndarray) -> np.ndarray:
    """``samples`` at UP/DOWN of their rate: one strided FIR filter for each phase."""
    phases = _filter()
    taps = phases.shape[1]
    n = len(samples) * UP // DOWN
    centre = (phases.size - 1) // 2
    fill = np.concatenate([np.zeros(taps, np.float32), samples, np.zeros(taps + DOWN, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(fill, taps)
    out = np.empty(n, dtype=np.float32)
    for first in range(min(UP, n)):
        count = -(-(n - first) // UP)
        raised = first * DOWN + centre  # position of this output on the raised grid, at the last tap
        start = raised // UP + 1
        out[first::UP] = windows[start : start + (count - 1) * DOWN + 1 : DOWN] @ phases[raised % UP]
    return out


@lru_cache(maxsize=1)
def _mel() -> tuple[np.ndarray, np.ndarray]:
    rate = RATE * UP // DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(mel(60.0), mel(rate / 2), BANDS + 2) / 2595) - 1)
    freqs = np.fft.rfftfreq(WINDOW, 1 / rate)
    up = (freqs[:, None] - points[:-2]) / (points[1:-1] - points[:-2])
    down = (points[2:] - freqs[:, None]) / (points[2:] - points[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32), np.hanning(WINDOW + 1)[:-1].astype(np.float32)


def log_mel(samples: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(frames x BANDS log energies, each frame's energy in dB)."""
    bank, window = _mel()
    if len(samples) < WINDOW:
        samples = np.concatenate([samples, np.zeros(WINDOW - len(samples), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(samples, WINDOW)[::HOP]
    mels, energy = [], []
    for a in range(0, len(frames), block):
        part = frames[a : a + block] * window
        power = np.abs(np.fft.rfft(part, axis=1)) ** 2
        mels.append(np.log10(power.astype(np.float32) @ bank + 1e-6))
        energy.append(10 * np.log10((part * part).mean(axis=1) + 1e-9))
    return np.concatenate(mels), np.concatenate(energy)


def segments(energy: np.ndarray, rise: float = 1.0, fall: float = -1.0) -> list[tuple[int, int]]:
    """Runs of frames that open ``rise`` dB over the mean and close ``fall`` dB under it."""
    level = energy - energy.mean()
    event = np.where(level >= rise, 1, np.where(level <= fall, -1, 0))
    last = np.maximum.accumulate(np.where(event != 0, np.arange(len(event)), -1))
    on = np.where(last >= 0, event[last] > 0, False)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], on.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def seconds(frame: int) -> float:
    return frame * HOP * DOWN / (RATE * UP)


def pack(mels: np.ndarray) -> bytes:
    """An Arrow stream of (start_s, stop_s, frames, tensor) with tensors of SHAPE, the last one padded."""
    count, rows = -(-len(mels) // SHAPE[0]), len(mels)
    flat = np.zeros((count * SHAPE[0], BANDS), dtype=np.float32)
    flat[:rows] = mels
    kind = pa.fixed_shape_tensor(pa.float32(), SHAPE)
    tensors = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), SHAPE[0] * SHAPE[1]))
    starts = np.arange(count) * SHAPE[0]
    used = np.minimum(SHAPE[0], rows - starts)
    batch = pa.record_batch(
        [pa.array([seconds(int(x)) for x in starts]), pa.array([seconds(int(x)) for x in starts + used]), pa.array(used, pa.int32()), tensors],
        names=["start_s", "stop_s", "frames", "tensor"],
    )
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue()


def unpack(tensors: bytes) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """(frames x BANDS, time span of each tensor)."""
    table = pa.ipc.open_stream(tensors).read_all()
    parts = [b.column("tensor").to_numpy_ndarray() for b in table.to_batches()]
    used = table["frames"].to_numpy()
    return np.concatenate([x[:n] for x, n in zip(np.concatenate(parts), used)]), list(zip(table["start_s"].to_pylist(), table["stop_s"].to_pylist()))


def analyse(media: bytes) -> tuple[bytes, list[tuple[float, float]], str]:
    """(tensors, segments in seconds, summary read back from the tensors)."""
    samples = (np.frombuffer(from_wav(media), dtype=np.uint8).astype(np.float32) - 128) / 128
    mels, energy = log_mel(resample(samples))
    spans = [(seconds(a), seconds(b)) for a, b in segments(energy)]
    packed = pack(mels)
    back, times = unpack(packed)
    mean = back.mean(axis=0, dtype=np.float64)
    feature = f"frames={len(back)};tensors={len(times)};segments={len(spans)};active={sum(b - a for a, b in spans):.3f};mel=" + ",".join(f"{x:.2f}" for x in mean + 0.0)
    return packed, spans, feature


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the text as a WAV file."""

    def run(batches):
        for batch in pieces(batches):
            texts = texts_of(batch.column("text"))
            media = pa.array([to_wav(padded(x)) for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in texts], pa.int64()), media], names=["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


FEATURES = (
    "doc_id {key}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, segments array<struct<start: double, stop: double>>, tensors binary"
)


def features(stored: DataFrame) -> DataFrame:
    """What the stored files hold: digests, summary, segments and the tensors."""

    def run(batches):
        for batch in pieces(batches, column="media"):
            rows = []
            for media in batch.column("media").to_pylist():
                payload = from_wav(media)
                packed, spans, feature = analyse(media)
                rows.append(
                    (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature,
                     [{"start": a, "stop": b} for a, b in spans], packed)
                )
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.float64()), ("stop", pa.float64())])), pa.binary())
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "segments", "tensors"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], names=["doc_id", "n_bytes", *names])

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES.format(key=kind))
