"""Word spans, rolling hashes and packed integer arrays in numpy: whole batches of texts at once, no Python loop over words.

Hashes are 64-bit polynomial sums over random byte values, finished by a bit mixer; texts are cut into pieces of about
256 KB for them, so memory follows the number of words, not eight times the number of bytes.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

U = np.uint64
try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library keeps what it likes
    _trim = None
PIECE = 1 << 18
_rng = np.random.RandomState(20240229)
BYTE_VALUES = _rng.randint(0, 2**63, 256).astype(U) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
BASES = (U(0xD1342543DE82EF95), U(0xA0761D6478BD642F), U(0x8EBC6AF09C88C6E3))
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n, kept between calls."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        up = np.full(max(n, 4096), base, dtype=U)
        up[0] = 1
        down = np.full(len(up), U(pow(int(base), -1, 1 << 64)), dtype=U)
        down[0] = 1
        have = _powers[int(base)] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, end to end, and the n + 1 offsets; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if texts.offset or isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays([texts]) if isinstance(texts, pa.Array) else texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(buf: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of words, and the text that each is in. separator: for each byte, whether it is outside words."""
    if not len(buf):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    inside = ~separator[buf]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[:-1]
    before[cuts[cuts < len(buf)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = before
    after[-1] = False
    after[:-1] = inside[1:]
    cuts = offsets[1:]
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, *prefixes: int) -> np.ndarray | list[np.ndarray]:
    """A 64-bit hash of the bytes of each span; spans are in order and don't overlap. With prefixes (byte lengths), a list: of the spans, then of their first bytes, for each length; shorter spans then have the hash of the whole."""
    out = [np.empty(len(starts), dtype=U) for _ in range(1 + len(prefixes))]
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + PIECE, side="right")))
        sub = buf[base : ends[j - 1]]
        up, down = powers(BASE, len(sub) + 1)
        total = np.zeros(len(sub) + 1, dtype=U)
        np.cumsum(BYTE_VALUES[sub] * up[: len(sub)], out=total[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        for one, n in zip(out, (None, *prefixes)):
            t = e if n is None else np.minimum(e, s + n)
            one[i:j] = mix((total[t] - total[s]) * down[s] + (t - s).astype(U) * BASES[0])
        i = j
    return out if prefixes else out[0]


def run_hashes(h: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: int) -> np.ndarray:
    """A 64-bit hash of h[start : start + length] for each start; `which` chooses one of independent families."""
    base = BASES[which]
    up, down = powers(base, len(h) + 1)
    total = np.zeros(len(h) + 1, dtype=U)
    np.cumsum(mix(h + base) * up[: len(h)], out=total[1:])
    return mix((total[starts + lengths] - total[starts]) * down[starts] + lengths.astype(U) * BASE)


def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place that holds each distinct value, and the group of each place, numbered by the values' high bits.

    Sorts values with their places in the low bits, which is many times faster than sorting places by value; where the
    places displace bits that tell values apart, the few places concerned (or, if many, all) are sorted by value."""
    n = len(key)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    bits = max(1, (n - 1).bit_length())
    mask = U((1 << bits) - 1)
    small = int(key.max()) >> (64 - bits) == 0
    x = np.sort((key << U(bits) if small else key & ~mask) | np.arange(n, dtype=U))
    order = (x & mask).astype(np.int64)
    k = key[order]
    new = np.ones(n, dtype=bool)
    new[1:] = k[1:] != k[:-1]
    clash = np.flatnonzero(new[1:] & ((x[1:] ^ x[:-1]) <= mask)) if not small else ()
    if len(clash):
        if len(clash) > 1000:
            order = np.argsort(key, kind="stable")
        else:
            run = np.append(np.flatnonzero(np.append(True, (x[1:] ^ x[:-1]) > mask)), n)
            for i in np.unique(np.searchsorted(run, clash, side="right")).tolist():
                some = order[run[i - 1] : run[i]]
                order[run[i - 1] : run[i]] = some[np.argsort(key[some], kind="stable")]
        k = key[order]
        new[1:] = k[1:] != k[:-1]
    group = np.empty(n, dtype=np.int32)
    group[order] = np.cumsum(new, dtype=np.int32) - 1
    return order[new], group


_squeeze = zstandard.ZstdCompressor(level=1)
_expand = zstandard.ZstdDecompressor()


def pack(x: np.ndarray) -> bytes:
    """Integers of any width: smallest width, byte planes, zstandard."""
    x = np.ascontiguousarray(x)
    if x.dtype != U:
        x = x.astype(np.int64).view(U)
    top = int(x.max()) if len(x) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    x = x.astype(f"u{width}")
    planes = b"".join((x >> x.dtype.type(8 * i)).astype(np.uint8).tobytes() for i in range(width))
    return bytes([width]) + _squeeze.compress(planes)


def unpack(blob: bytes) -> np.ndarray:
    width = blob[0]
    raw = np.frombuffer(_expand.decompress(blob[1:]), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(f"u{width}").ravel().astype(U)


def pack_sorted(x: np.ndarray) -> bytes:
    d = x.copy()
    d[1:] -= x[:-1]
    return pack(d)


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=U)


def pack_floats(x: np.ndarray) -> tuple[bytes, bytes]:
    """Doubles with few distinct values: the values, and which one each is."""
    values, which = np.unique(x, return_inverse=True)
    return _squeeze.compress(values.astype("<f8").tobytes()), pack(which)


def unpack_floats(values: bytes, which: bytes) -> np.ndarray:
    return np.frombuffer(_expand.decompress(values), dtype="<f8")[unpack(which).astype(np.int64)]


def release() -> None:
    """Gives freed memory back to the system; worth a call after a large group, as workers live on."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)
