import hashlib
import zlib

import numpy as np

from tallymill.llm import audio


def test_wav_is_lossless():
    import io
    import wave

    payload = audio.padded(bytes(range(256)))
    media = audio.to_wav(payload)
    assert audio.from_wav(media) == payload and len(payload) % 192 == 0
    with wave.open(io.BytesIO(media)) as f:
        assert (f.getnchannels(), f.getsampwidth(), f.readframes(f.getnframes())) == (1, 1, payload)
    assert audio.padded(b"") == b" " * 192 and audio.padded(b"x" * 192) == b"x" * 192


def test_resampling_as_direct_convolution():
    x = np.random.default_rng(0).random(999).astype(np.float32)
    half, down, up = 8, audio.DOWN, audio.UP
    n = 2 * half * down + 1
    taps = np.sinc((np.arange(n) - half * down) / down) * np.hamming(n) / down * up
    raised = np.zeros(len(x) * up)
    raised[::up] = x
    want = np.convolve(raised, taps)[half * down :][: len(raised) : down]
    got = audio.resample(x)
    assert np.abs(got - want[: len(got)]).max() < 1e-5


def test_hysteresis():
    e = np.array([0, 0, 5, 1, 0, -5, -5, 0, 0.5, 5, 0], dtype=float)
    on, state = [], False
    for level in e - e.mean():
        state = True if level >= 1 else False if level <= -1 else state
        on.append(state)
    spans = audio.segments(e)
    assert [any(a <= i < b for a, b in spans) for i in range(len(e))] == on


def test_tensors_round_trip():
    mels = np.random.default_rng(1).random((130, audio.BANDS)).astype(np.float32)
    back, times = audio.unpack(audio.pack(mels))
    assert (back == mels).all() and len(times) == 3 and times[0][0] == 0


def test_operator(docs, none):
    rows = audio.features(audio.store(docs)).collect()
    want = {(r["doc_id"], hashlib.sha256(audio.padded((r["text"] or "").encode())).hexdigest()) for r in docs.collect()}
    assert {(r["doc_id"], r["payload_sha256"]) for r in rows} == want and len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["feature"] == by[3]["feature"] and by[2]["n_bytes"] == 0 and by[2]["payload_bytes"] == 192
    assert by[2]["tail_crc32"] == zlib.crc32(b" " * 16) and by[2]["media_bytes"] == 192 + 44
    assert audio.features(audio.store(none)).count() == 0


def brute_feature(text):
    """Payload, media and summary from the definitions: whole convolutions, one frame at a time."""
    import io
    import wave

    payload = text + b" " * (-len(text) % 192 if text else 192)
    sink = io.BytesIO()
    with wave.open(sink, "wb") as f:
        f.setnchannels(1), f.setsampwidth(1), f.setframerate(24_000)
        f.writeframes(payload)
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    n = 2 * 8 * 3 + 1
    taps = np.sinc((np.arange(n) - 24) / 3) * np.hamming(n) / 3 * 2
    raised = np.zeros(len(x) * 2)
    raised[::2] = x
    y = np.convolve(raised, taps)[24:][: len(raised) : 3][: len(x) * 2 // 3]
    y = np.concatenate([y, np.zeros(max(0, 256 - len(y)))])
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(mel(60.0), mel(8000.0), 18) / 2595) - 1)
    freqs = np.arange(129) * 16_000 / 256
    bank = np.array([[max(0.0, min((f - points[b]) / (points[b + 1] - points[b]), (points[b + 2] - f) / (points[b + 2] - points[b + 1]))) for b in range(16)] for f in freqs])
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 256)
    mels, energy = [], []
    for a in range(0, len(y) - 255, 128):
        part = y[a : a + 256] * window
        mels.append(np.log10(np.abs(np.fft.rfft(part)) ** 2 @ bank + 1e-6))
        energy.append(10 * np.log10((part**2).mean() + 1e-9))
    return payload, sink.getvalue(), np.mean(mels, axis=0), len(mels), np.array(energy)


def test_query_as_brute_force(spark):
    from tallymill.llm.queries import op6_audio_features

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op6_audio_features(spark, sf).collect():
        payload, media, mean, frames, energy = brute_feature(texts[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(texts[r["doc_id"]]), len(payload), len(media))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["media_sha256"] == hashlib.sha256(media).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-16:])
        said = dict(x.split("=") for x in r["feature"].split(";"))
        assert int(said["frames"]) == frames and int(said["tensors"]) == -(-frames // 64) and int(said["segments"]) == r["n_segments"]
        assert np.abs(np.array([float(v) for v in said["mel"].split(",")]) - mean).max() < 0.02
        level, on, opened, near = energy - energy.mean(), False, 0, False
        for v in level:
            near |= min(abs(v - 1), abs(v + 1)) < 1e-3  # single precision may fall on the other side
            now = True if v >= 1 else False if v <= -1 else on
            opened += now and not on
            on = now
        assert near or opened == r["n_segments"]
