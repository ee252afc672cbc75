"""Collocations against counting by hand; suffix arrays against sorting; scores beyond 64 bits."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from visiloom.llm import collocations

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, most=5, least=100, top=2000):
    """rows: (lang, text)."""
    counts, out = {}, []
    for lang, text in rows:
        mine = counts.setdefault(lang if lang is not None else "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            mine.update(w[i : i + k] for k in range(1, most + 1) for i in range(len(w) - k + 1))
    for lang, c in counts.items():
        n = sum(v for g, v in c.items() if len(g) == 1)
        often = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        found = []
        for g, a in often.items():
            inside = any(len(h) > len(g) and b >= a and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h, b in often.items())
            if not inside:
                score, k = min((1000 * a * n // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        out += [(lang, r, p.decode(), -a, x, y, n, -s) for r, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def mined(docs, **kw):
    return sorted(tuple(r) for r in collocations.collocations(docs, **kw).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("shard,words", [(6 << 20, 2_000_000), (3000, 1500)])
def test_collocations(spark, odd_documents, monkeypatch, shard, words):
    monkeypatch.setattr(collocations, "SHARD_BYTES", shard)
    monkeypatch.setattr(collocations, "BUCKET_WORDS", words)
    monkeypatch.setattr(collocations, "MOST_BUCKET_WORDS", words)
    rows = [tuple(r) for r in odd_documents.select("lang", "text").collect()]
    want = brute(rows, least=4)
    assert len(want) > 50 and mined(odd_documents, least=4) == want
    assert mined(odd_documents, least=4, top=3) == brute(rows, least=4, top=3)


def test_overlaps_pieces_and_cases(spark):
    texts = ["a A a a a.a\ta  a", "x y z; x y z, X Y Z\nx y z" * 3, "p q r s t u " * 12, "", None, "é È é È é\x0bè é\x00é", " . ", "\x1c k \x85 k \x1c k"] * 2
    rows = [(["en", None, "und", ""][i % 4], t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, 1, "w") for r in rows], "lang string, text string, n int, word string")
    for least in (1, 2, 6):
        assert mined(df, least=least) == brute(rows, least=least)
    assert mined(df.where("false")) == [] and mined(df.where("text is null")) == [] and mined(df, least=10**6) == []


@pytest.mark.parametrize("k", [2, 3, 4, 5])
def test_intervals_count_all_grams(k):
    rng = random.Random(k)
    r = np.array([rng.choice([0, 1, 1, 2, 2, 3]) for _ in range(3000)] + [7] * 40 + [0], dtype=np.int32)
    order, common = collocations.suffix_array(r, k)
    assert sorted(order.tolist()) == list(range(len(r)))
    text = "".join(map(chr, r)).split("\0")
    end = {i: i + (r[i:] == 0).argmax() for i in range(len(r))}
    tops = [tuple(r[i : min(i + k, end[i])].tolist()) for i in order.tolist()]
    assert tops == sorted(tops)
    first, n = collocations.intervals(order, common, k)
    got = {tops[f]: c for f, c in zip(first.tolist(), n.tolist()) if len(tops[f]) == k}
    want = Counter(tuple(map(ord, t[i : i + k])) for t in text for i in range(len(t) - k + 1))
    assert got == want


def test_scores_are_exact_beyond_64_bits(spark):
    n, a, l, r = 9 * 10**15, 7 * 10**12 + 1, 8 * 10**13 + 3, 9 * 10**12 + 7
    totals = spark.createDataFrame([("en", n)], "lang string, n long")
    words = spark.createDataFrame([("en", "one", 1, l), ("en", "two", 2, r), ("en", "three", 3, r)], "lang string, word string, id long, a long")
    two = spark.createDataFrame([(1, 2, 1, a), (2, 3, 2, a - 1)], "p long, w long, id long, a long")
    three = spark.createDataFrame([(1, 3, 1, a - 2)], "p long, w long, id long, a long")
    got = {x.phrase: (x.a, x.l, x.r, x.score) for x in collocations.scored(collocations.described(totals, [words, two, three])).collect()}
    assert got["one two"] == (a, l, r, 1000 * a * n // (l * r)) and got["two three"] == (a - 1, r, r, 1000 * (a - 1) * n // (r * r))
    cuts = [(1000 * (a - 2) * n // (l * (a - 1)), 1, l, a - 1), (1000 * (a - 2) * n // (a * r), 2, a, r)]
    score, _, x, y = min(cuts)
    assert got["one two three"] == (a - 2, x, y, score)
