"""Media columns: sound stored losslessly beside its documents, and features computed from the stored bytes.

A payload of bytes is stored as a WAV file of 8-bit mono samples at `RATE_IN`. Features are read from the stored file:
polyphase resampling by UP / DOWN (each phase of a windowed-sinc filter is applied to the samples that it needs, no zeros
are filled in), overlapping frames under a Hann window, log-mel energies, and segments by hysteresis: a segment begins
where the energy of a frame reaches `BEGIN_DB` of the file's loudest frame and lasts while it doesn't fall below `END_DB`.

Log-mel frames are stored as Arrow tensors of one shape, (FRAMES, MELS) of float16, each with its time span and how many
of its frames are sound (the rest are filled with the least energy): a binary column holds an Arrow stream for each
document, whose extension type says the shape, so readers get arrays without knowing anything else.

Rows: a null text counts as empty; payloads are filled with bytes 0 to a positive multiple of 64, so an empty text is 64 of
them. Sound of any length is resampled `BLOCK` frames at a time; rows that repeat are files of their own with equal bytes; null ids
stay; an empty table gives no rows. Only the id and the text are read, other columns may have any name. Whatever is equal
in text is equal in all features, whatever else is in a batch.
"""

from __future__ import annotations

import functools
import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, small_batches, stored

RATE_IN, UP, DOWN, TAPS = 24_000, 2, 3, 24
RATE = RATE_IN * UP // DOWN
WINDOW, HOP, FFT, MELS, FRAMES = 400, 192, 512, 40, 16
BLOCK, MULTIPLE, AT_ONCE = 256, 64, 2 << 20
BEGIN_DB, END_DB, SILENT = -6.0, -12.0, 1e-6
LEAST = -10.0  # log10 of the least energy
#: The layout of a WAV file's header: RIFF, size, WAVE, then format (PCM, 1 channel, rate, bytes a second, bytes a sample, bits) and data.
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def wav(payload: bytes) -> bytes:
    """8-bit mono samples as a file; the payload has an even length."""
    return HEADER.pack(b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE_IN, RATE_IN, 1, 8, b"data", len(payload)) + payload


def samples_of(media: bytes) -> bytes:
    """The samples of a file that wav() made; chunks other than format and data may stand between."""
    riff, _, kind = struct.unpack_from("<4sI4s", media)
    at, form = 12, None
    if (riff, kind) != (b"RIFF", b"WAVE"):
        raise ValueError("not a WAV file")
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            if form is None or (form[0], form[1], form[5]) != (1, 1, 8) or at + 8 + size > len(media):
                raise ValueError(f"not whole 8-bit mono samples: {form}")
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAV file without data")


def filled(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % MULTIPLE or (0 if raw else MULTIPLE))


@functools.cache
def phases() -> np.ndarray:
    """A row a phase: its taps, latest sample last."""
    n = np.arange(TAPS * UP) - TAPS * UP // 2
    cut = 1 / max(UP, DOWN)
    h = np.sinc(n * cut) * np.hanning(TAPS * UP + 2)[1:-1]
    rows = np.stack([h[p::UP][::-1] for p in range(UP)])
    return rows / rows.sum(axis=1, keepdims=True)  # a constant stays one in each phase


def resampled(samples: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Samples begin to end - 1 at the new rate, in -1 to 1; silence before and after the sound. Tap by tap, so that each sample's sum has one order wherever it stands."""
    centre = TAPS * UP // 2
    low, high = (begin * DOWN + centre) // UP - TAPS + 1, ((end - 1) * DOWN + centre) // UP + 1
    x = np.zeros(high - low)
    a, b = max(low, 0), max(min(high, len(samples)), max(low, 0))
    x[a - low : b - low] = samples[a:b]
    x[a - low : b - low] -= 128
    x /= 128
    every = [np.ascontiguousarray(x[i::DOWN]) for i in range(DOWN)]
    out = np.empty(end - begin)
    for n in range(begin, min(begin + UP, end)):
        at = n * DOWN + centre
        first, count = at // UP - TAPS + 1 - low, -(-(end - n) // UP)
        total, one = np.zeros(count), np.empty(count)
        for k, tap in enumerate(phases()[at % UP].tolist(), first):
            total += np.multiply(tap, every[k % DOWN][k // DOWN : k // DOWN + count], out=one)
        out[n - begin :: UP] = total
    return out


@functools.cache
def bank() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Triangles over the bins of the transform, evenly spaced in mel: the bin that each rising side begins at, and each bin's weights on the rising side it is on and on the falling side there."""
    mel = np.linspace(0, 2595 * np.log10(1 + RATE / 2 / 700), MELS + 2)
    edge = (700 * (10 ** (mel / 2595) - 1)) * FFT / RATE
    bins = np.arange(FFT // 2 + 1)
    begin = np.ceil(edge).astype(np.int64)
    side = np.clip(np.searchsorted(edge, bins, side="right") - 1, 0, MELS)
    up = (bins - edge[side]) / (edge[side + 1] - edge[side])
    return begin, up, 1 - up


def mel_energies(power: np.ndarray) -> np.ndarray:
    """Sums under each triangle, a row at a time in one order."""
    begin, up, down = bank()
    low, high = int(begin[0]), int(begin[-1])
    empty = begin[1:] == begin[:-1]  # sides without a bin
    at = np.minimum(begin[:-1], high - 1) - low
    rise, fall = (np.add.reduceat(power[:, low:high] * w[low:high], at, axis=1) for w in (up, down))
    rise[:, empty] = fall[:, empty] = 0
    return rise[:, :-1] + fall[:, 1:]


def frames_of(n: np.ndarray | int) -> np.ndarray | int:
    """Frames of n samples of a file: as many as it takes to cover them."""
    length = -(-n * UP // DOWN)
    return 1 + np.maximum(0, -(-(length - WINDOW) // HOP))


def log_mel(files: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-mel energies (frames x MELS) and the power around the mean of the frames of all files, end to end, and how many frames each file has.

    The files are laid out in one signal with silence between them, each where a sample of either rate begins, so each
    gets the very numbers that it would get alone."""
    gap = TAPS + WINDOW * DOWN // UP
    parts, begins, length = [], [], 0
    for f in files:
        parts += [np.frombuffer(f, np.uint8), np.full(gap + (-(len(f) + gap) % DOWN), 128, np.uint8)]
        begins.append(length)
        length += len(parts[-2]) + len(parts[-1])
    signal = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    count = frames_of(np.array([len(f) for f in files], dtype=np.int64))
    first = np.cumsum(count) - count
    at = np.repeat(np.array(begins, dtype=np.int64) * UP // DOWN - first * HOP, count) + np.arange(count.sum()) * HOP
    mel, power = np.empty((len(at), MELS), dtype=np.float16), np.empty(len(at))
    window = np.hanning(WINDOW + 1)[:-1]
    for a in range(0, len(at), BLOCK):
        some = at[a : a + BLOCK]
        x = resampled(signal, int(some[0]), int(some[-1]) + WINDOW)[(some - some[0])[:, None] + np.arange(WINDOW)]
        power[a : a + BLOCK] = x.var(axis=1)
        spectrum = np.fft.rfft(x * window, FFT)
        mel[a : a + BLOCK] = np.log10(np.maximum(mel_energies(spectrum.real**2 + spectrum.imag**2), 10.0**LEAST))
    return mel, power, count


def segments(power: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last frame (within its file) of each segment, and how many segments each file has; every file has a frame."""
    first = np.cumsum(count) - count
    level = 10 * np.log10(np.maximum(power, SILENT))
    peak, begin = np.repeat(np.maximum.reduceat(level, first), count), np.repeat(first, count)
    loud = (level >= peak + BEGIN_DB) & (power > SILENT)
    known = loud | (level < peak + END_DB) | (power <= SILENT)
    last = np.maximum.accumulate(np.where(known, np.arange(len(level)), -1))  # the last frame that is loud or quiet
    on = (last >= begin) & loud[last]
    before, after = np.append(False, on[:-1]), np.append(on[1:], False)
    before[first] = after[first + count - 1] = False
    a, b = np.flatnonzero(on & ~before), np.flatnonzero(on & ~after)
    return np.stack([a - begin[a], b - begin[a]], axis=1), np.diff(np.searchsorted(a, np.append(first, len(level))))


def milliseconds(frame: np.ndarray | int) -> np.ndarray | int:
    return frame * (HOP * 1000) // RATE


def tensors(mel: np.ndarray, count: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
    """log_mel (tensors of one shape), frames, start_ms and end_ms of the tensors of all files, and how many each file has."""
    n = -(-count // FRAMES)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    held = np.minimum(FRAMES, np.repeat(count, n) - place * FRAMES)
    whole = np.full((len(place) * FRAMES, MELS), LEAST, dtype=np.float16)
    whole[(np.arange(len(place))[:, None] * FRAMES + np.arange(FRAMES))[np.arange(FRAMES) < held[:, None]]] = mel
    kind = pa.fixed_shape_tensor(pa.float16(), (FRAMES, MELS), dim_names=("frame", "mel"))
    column = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(whole.ravel()), FRAMES * MELS))
    end = milliseconds(place * FRAMES + held - 1) + WINDOW * 1000 // RATE
    return pa.RecordBatch.from_arrays([column, pa.array(held.astype(np.int32)), pa.array(milliseconds(place * FRAMES)), pa.array(end)], names=["log_mel", "frames", "start_ms", "end_ms"]), n


def to_stream(batch: pa.RecordBatch) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue()


def from_stream(blob: bytes) -> pa.Table:
    """What a tensors column holds: log_mel as a tensor column (to_numpy_ndarray() of its chunks gives tensor x frame x mel), frames, start_ms, end_ms."""
    return pa.ipc.open_stream(blob).read_all()


def media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes of the text, media: its bytes as a file."""
    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1, AT_ONCE):
                raw = [(x or "").encode() for x in piece.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([wav(filled(x)) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tensors binary, segments array<struct<start_ms:bigint,end_ms:bigint>>"


def features(files: DataFrame) -> DataFrame:
    """doc_id and n_bytes with what is read and computed from the stored files: digests, tensors, and segments with their time spans."""
    small_batches(files.sparkSession)
    kind = files.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "tensors", "segments")
        for batch in batches:
            for piece in slices(batch, 2, AT_ONCE):
                held = [f.as_py() for f in piece.column(2)]
                payloads = [samples_of(f) for f in held]
                mel, power, count = log_mel(payloads)
                spoken, n_spoken = segments(power, count)
                made, n_made = tensors(mel, count)
                at = milliseconds(spoken)
                at = pa.StructArray.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1] + WINDOW * 1000 // RATE)], names=["start_ms", "end_ms"])
                found = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_spoken)).astype(np.int32)), at)
                streams = [to_stream(made.slice(a, n)) for a, n in zip((np.cumsum(n_made) - n_made).tolist(), n_made.tolist())]
                columns = ([len(p) for p in payloads], [hashlib.sha256(p).hexdigest() for p in payloads], [zlib.crc32(p[-MULTIPLE:]) for p in payloads], [len(f) for f in held], [hashlib.sha256(f).hexdigest() for f in held], streams)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *(pa.array(x, t) for x, t in zip(columns, kinds)), found], names=names)

    return files.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, {FEATURES}")


def summarised(found: DataFrame) -> DataFrame:
    """The digests with a short text of the stored features: tensors, frames, segments, milliseconds of sound in them, and a digest of all tensors and spans."""
    kind = found.schema["doc_id"].dataType.simpleString()
    plain = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for blob, spans in zip(batch.column("tensors"), batch.column("segments").to_pylist()):
                t = from_stream(blob.as_py())
                digest = hashlib.sha256()
                for chunk in t["log_mel"].chunks:
                    digest.update(np.ascontiguousarray(chunk.to_numpy_ndarray()).tobytes())
                for c in ("frames", "start_ms", "end_ms"):
                    digest.update(t[c].to_numpy().astype("<i8").tobytes())
                digest.update(repr([(s["start_ms"], s["end_ms"]) for s in spans]).encode())
                out.append(f"tensors={t.num_rows} frames={sum(t['frames'].to_pylist())} segments={len(spans)} ms={sum(s['end_ms'] - s['start_ms'] for s in spans)} sha256={digest.hexdigest()}")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in plain), pa.array(out, pa.string())], names=[*plain, "feature"])

    return found.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op11_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = stored(media(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media")
    return summarised(stored(features(files), "features"))
