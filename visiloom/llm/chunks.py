"""Texts as chunks that any byte-level BPE of the usual pattern encodes on their own, cut and looked up in numpy.

A chunk is a run of bytes between two places where the pattern always starts a new piece, whatever is around: before the
last of the white-space characters in front of a word (before the word where that one isn't a plain space), before a run
of white space, and where letters, digits and marks meet, as far as ASCII and Latin-1 letters show it. An apostrophe or any
other character stays with its neighbours. `ChunkIds` keeps the ids of the chunks that it has met, by 64-bit hash, in flat
arrays of some 30 bytes a chunk; only new ones are given to an encoder.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .arrays import U, span_hashes

SPACE, LETTER, DIGIT, MARK, OTHER = range(5)
CLASS = np.full(256, OTHER, dtype=np.uint8)
CLASS[33:127] = MARK
CLASS[48:58] = DIGIT
CLASS[65:91] = CLASS[97:123] = LETTER
CLASS[39] = OTHER  # an apostrophe may begin a contraction
CLASS[[9, 10, 11, 12, 13, 32]] = SPACE


def _wide_spaces(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of white-space characters beyond ASCII: U+0085, 00A0, 1680, 2000 to 200A, 2028, 2029, 202F, 205F, 3000."""
    at = np.flatnonzero((buf == 0xC2) | ((buf >= 0xE1) & (buf <= 0xE3)))
    at = at[at + 1 < len(buf)]
    lead, one = buf[at], buf[at + 1]
    two = buf[np.minimum(at + 2, len(buf) - 1)]
    narrow = (lead == 0xC2) & ((one == 0x85) | (one == 0xA0))
    general = (lead == 0xE2) & (one == 0x80) & ((two <= 0x8A) | (two == 0xA8) | (two == 0xA9) | (two == 0xAF))
    wide = general | ((lead == 0xE1) & (one == 0x9A) & (two == 0x80)) | ((lead == 0xE2) & (one == 0x81) & (two == 0x9F)) | ((lead == 0xE3) & (one == 0x80) & (two == 0x80))
    some = narrow | wide
    return at[some], np.where(narrow[some], 2, 3)


def chunk_starts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks start in the UTF-8 bytes of texts laid end to end; each ends where the next one starts."""
    if not len(buf):
        return np.zeros(0, dtype=np.int64)
    kind = CLASS[buf]
    if (buf >= 0x80).any():
        latin = np.flatnonzero(buf == 0xC3)
        latin = latin[(buf[latin + 1] != 0x97) & (buf[latin + 1] != 0xB7)]
        kind[latin] = kind[latin + 1] = LETTER
        at, n = _wide_spaces(buf)
        for k in range(3):
            kind[at[n > k] + k] = SPACE
    start = np.zeros(len(buf), dtype=bool)
    first = offsets[:-1]
    start[first[first < len(buf)]] = True
    space = kind == SPACE
    before, here = kind[:-1], kind[1:]
    word = space[:-1] & ~space[1:] & ~start[1:]
    plain = buf[:-1] == 32
    meet = (before != here) & (before - np.uint8(1) < 3) & (here - np.uint8(1) < 3)
    start[1:] |= (space[1:] & ~space[:-1]) | (word & ~plain) | meet
    last = np.flatnonzero(word)
    for _ in range(2):
        last -= (buf[last] & 0xC0) == 0x80
    start[last] = True
    return np.flatnonzero(start)


def gathered(flat: np.ndarray, start: np.ndarray, length: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[start : start + length] of each place, end to end, and where each begins."""
    n = length[places]
    upto = np.zeros(len(places) + 1, dtype=np.int64)
    np.cumsum(n, out=upto[1:])
    at = np.repeat(start[places] - upto[:-1], n)
    at += np.arange(len(at))
    return flat[at], upto


class Numbers:
    """64-bit hashes to numbers in order of arrival: a table with open places, read and filled by whole arrays."""

    def __init__(self, bits: int = 15):
        self.bits, self.n = bits, 0
        self.keys, self.number = np.zeros(1 << bits, dtype=U), np.full(1 << bits, -1, dtype=np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash; -1 for unknown ones."""
        slot = (h >> U(64 - self.bits)).astype(np.int64)
        out = self.number[slot]
        rest = np.flatnonzero((out >= 0) & (self.keys[slot] != h))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
            out[rest] = self.number[slot[rest]]
            rest = rest[(out[rest] >= 0) & (self.keys[slot[rest]] != h[rest])]
        return out

    def add(self, h: np.ndarray) -> None:
        """Hashes that differ and are not in the table."""
        if 2 * (self.n + len(h)) > 1 << self.bits:
            full = self.number >= 0
            keys, numbers = np.append(self.keys[full], h), np.append(self.number[full], np.arange(self.n, self.n + len(h), dtype=np.int32))
            while 3 * len(keys) > 1 << self.bits:
                self.bits += 1
            self.keys, self.number = np.zeros(1 << self.bits, dtype=U), np.full(1 << self.bits, -1, dtype=np.int32)
        else:
            keys, numbers = h, np.arange(self.n, self.n + len(h), dtype=np.int32)
        self.n += len(h)
        slot = (keys >> U(64 - self.bits)).astype(np.int64)
        rest = np.arange(len(keys))
        while len(rest):
            free = rest[self.number[slot[rest]] < 0]
            self.number[slot[free]] = numbers[free]
            mine = free[self.number[slot[free]] == numbers[free]]  # of several that want a place one gets it
            self.keys[slot[mine]] = keys[mine]
            lost = self.number[slot[rest]] != numbers[rest]
            rest = rest[lost]
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)


class ChunkIds:
    """learn(new chunks) gives how many ids each has, and all of them; at most about `most` chunks are kept."""

    def __init__(self, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int):
        self.learn, self.most = learn, most
        self.forget()

    def forget(self) -> None:
        self.numbers, self.used = Numbers(), 0
        self.flat, self.start, self.length = np.zeros(1 << 16, dtype=np.uint32), np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int32)

    def _keep(self, lengths: np.ndarray, ids: np.ndarray) -> None:
        n = self.numbers.n
        while n + len(lengths) > len(self.start):
            self.start, self.length = np.append(self.start, np.zeros_like(self.start)), np.append(self.length, np.zeros_like(self.length))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.start[n : n + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.length[n : n + len(lengths)] = lengths
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def ids(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts laid end to end, and the n + 1 places where those of each begin."""
        starts = chunk_starts(buf, offsets)
        ends = np.append(starts[1:], len(buf))[: len(starts)]
        h = span_hashes(buf, starts, ends)
        if self.numbers.n > self.most:
            self.forget()
        found = self.numbers.find(h)
        unknown = np.flatnonzero(found < 0)
        if len(unknown):
            new, at = np.unique(h[unknown], return_index=True)
            at = unknown[at]
            raw = buf.tobytes()
            self._keep(*self.learn([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]))
            self.numbers.add(new)
            found[unknown] = self.numbers.find(h[unknown])
        ids, upto = gathered(self.flat, self.start, self.length, found)
        return ids, upto[np.searchsorted(starts, offsets)]
