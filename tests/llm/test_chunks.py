"""Chunks against the pattern over whole texts; the table of hashes against a dict."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex

from visiloom.llm.arrays import U, buffer_of, grouped
from visiloom.llm.chunks import Numbers, chunk_starts, gathered

ALPHABET = "aB3'.,- \n\t\x1c\x85\xa0\u1680\u2009\u2028\u202f\u205f\u3000\u2010éß×÷Ö́日$\x00"


def test_chunks_hold_whole_pieces():
    pattern, rng = regex.compile(public_tokenizers.PATTERN), random.Random(1)
    words = [*ALPHABET, " 's", "'re", "it's", "  "]
    for _ in range(8000):
        texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 4))]
        buf, offsets = buffer_of(pa.array(texts, pa.string()))
        cuts, raw = [*chunk_starts(buf, offsets).tolist(), len(buf)], buf.tobytes()
        got = [p for a, b in zip(cuts, cuts[1:]) for p in pattern.findall(raw[a:b].decode())]
        assert got == [p for t in texts for p in pattern.findall(t)], texts


def test_numbers_are_a_dict():
    rng, table, want = np.random.default_rng(2), Numbers(4), {}
    for k in range(120):
        h = np.unique(rng.integers(0, 2**63, rng.integers(1, 300)).astype(U) * U(2) >> U([0, 0, 40][k % 3]))  # crowded places too
        found = table.find(h)
        assert found.tolist() == [want.get(x, -1) for x in h.tolist()]
        new = h[found < 0]
        want.update({x: table.n + i for i, x in enumerate(new.tolist())})
        table.add(new)
        assert table.find(h).tolist() == [want[x] for x in h.tolist()]


def test_gathered():
    flat, at = gathered(np.arange(10), np.array([0, 3, 3]), np.array([2, 0, 4]), np.array([2, 1, 0, 0]))
    assert flat.tolist() == [3, 4, 5, 6, 0, 1, 0, 1] and at.tolist() == [0, 4, 4, 6, 8]


def test_grouped():
    rng = np.random.default_rng(3)
    for k in range(60):
        n = int(rng.integers(1, 3000))
        key = rng.integers(0, [5, 2**20, 2**63][k % 3], n).astype(U)
        if k % 3 == 2:  # values that differ in bits which places displace
            key[: n // 2] = key[0] + rng.integers(0, [3, 2000][k % 2], n // 2).astype(U)
        first, group = grouped(key)
        assert (key[first][group] == key).all() and len(np.unique(key)) == len(first)
