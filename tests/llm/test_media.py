"""Audio features against a plain implementation, stored bytes against the text; hard negatives by brute force."""

import hashlib
import math
import wave
import io
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from visiloom.llm import audio
from visiloom.llm.common import stored


def plain_log_mel(payload):
    """Zeros filled in, the whole filter run over all samples, a transform by its definition, triangles written out."""
    x = np.zeros(len(payload) * audio.UP)
    x[:: audio.UP] = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    taps = audio.TAPS * audio.UP
    t = np.arange(taps) - taps // 2
    h = np.sinc(t / max(audio.UP, audio.DOWN)) * np.hanning(taps + 2)[1:-1]
    for p in range(audio.UP):
        h[p :: audio.UP] /= h[p :: audio.UP].sum()
    full = np.convolve(x, h)
    y = np.append(full[taps // 2 :: audio.DOWN], np.zeros(audio.WINDOW))
    n = 1
    while (n - 1) * audio.HOP + audio.WINDOW < math.ceil(len(payload) * audio.UP / audio.DOWN):
        n += 1
    y = np.append(y, np.zeros(n * audio.HOP + audio.WINDOW))
    bins = np.arange(audio.FFT // 2 + 1)
    turn = np.exp(-2j * np.pi * np.outer(np.arange(audio.WINDOW), bins) / audio.FFT)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(audio.WINDOW) / audio.WINDOW)
    top = 2595 * math.log10(1 + audio.RATE / 2 / 700)
    edge = [700 * (10 ** (k * top / (audio.MELS + 1) / 2595) - 1) * audio.FFT / audio.RATE for k in range(audio.MELS + 2)]
    out, power = [], []
    for f in range(n):
        frame = y[f * audio.HOP : f * audio.HOP + audio.WINDOW]
        e = abs((frame * hann) @ turn) ** 2
        mel = [sum(e[b] * max(0, min((b - lo) / (mid - lo), (hi - b) / (hi - mid))) for b in bins) for lo, mid, hi in zip(edge, edge[1:], edge[2:])]
        out.append([math.log10(max(v, 1e-10)) for v in mel])
        power.append(np.mean((frame - frame.mean()) ** 2))
    return np.array(out), power


def plain_segments(power):
    level = [10 * math.log10(max(p, audio.SILENT)) for p in power]
    peak, on, out = max(level), False, []
    for i, (v, p) in enumerate(zip(level, power)):
        was = on
        if p <= audio.SILENT or v < peak + audio.END_DB:
            on = False
        elif v >= peak + audio.BEGIN_DB:
            on = True
        if on and not was:
            out.append([i, i])
        elif on:
            out[-1][1] = i
    return out


@pytest.fixture(scope="module")
def sounds():
    rng = np.random.RandomState(3)
    loud = (np.sin(np.arange(9000) / 5) * 100 + 128).astype(np.uint8)
    quiet = np.full(7000, 128, np.uint8)
    return [audio.filled(x) for x in (b"", b"a", bytes(64), bytes(rng.randint(0, 256, 3000, dtype=np.uint8)), np.concatenate([quiet, loud, quiet, loud, quiet]).tobytes(), b"text " * 500)]


def test_features_are_those_of_the_definition(sounds):
    mel, power, count = audio.log_mel(sounds)
    spoken, n = audio.segments(power, count)
    at = done = 0
    for s, c, k in zip(sounds, count, n):
        want, energy = plain_log_mel(s)
        assert want.shape == (c, audio.MELS)
        np.testing.assert_allclose(mel[at : at + c].astype(float), want, atol=0.02)
        np.testing.assert_allclose(power[at : at + c], energy, atol=1e-12)
        assert spoken[done : done + k].tolist() == plain_segments(power[at : at + c])
        at, done = at + c, done + k
    assert n[4] == 2  # two loud passages


def test_company_changes_nothing(sounds):
    mel, power, count = audio.log_mel(sounds)
    alone = [audio.log_mel([s]) for s in sounds]
    assert (np.concatenate([a[0] for a in alone]) == mel).all() and (np.concatenate([a[1] for a in alone]) == power).all()
    tensors, n = audio.tensors(mel, count)
    assert tensors.schema.field("log_mel").type.shape == [audio.FRAMES, audio.MELS]
    back = audio.from_stream(audio.to_stream(tensors))
    whole = np.concatenate([c.to_numpy_ndarray() for c in back["log_mel"].chunks])
    held = np.concatenate([w[:k] for w, k in zip(whole, back["frames"].to_pylist())])
    assert (held == mel).all() and back["end_ms"].to_pylist()[0] == 25


def test_stored_files_hold_the_texts(spark, odd_documents):
    files = audio.media(odd_documents, "size")  # the id of another name; ids that repeat or are null, columns with inner names
    rows = {r.size: r.text for r in odd_documents.select("size", "text").collect()}
    got = files.collect()
    assert len(got) == len(rows)
    for r in got:
        with wave.open(io.BytesIO(bytes(r.media))) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.getframerate()) == (1, 1, audio.RATE_IN)
            raw = (rows[r.doc_id] or "").encode()
            payload = w.readframes(w.getnframes())
            assert payload == raw + bytes(len(payload) - len(raw)) and len(payload) == max(64, -(-len(raw) // 64) * 64) and r.n_bytes == len(raw)
    found = audio.summarised(stored(audio.features(stored(files, "media")), "features")).collect()
    by_text = {}
    for r in found:
        raw = (rows[r.doc_id] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes == len(payload) + 44
        assert by_text.setdefault(payload, (r.feature, r.media_sha256)) == (r.feature, r.media_sha256)
    empty = odd_documents.where("false")
    assert audio.summarised(audio.features(audio.media(empty))).count() == 0
    with pytest.raises(ValueError, match="not a WAV"):
        audio.samples_of(b"RIFX" + bytes(40))
