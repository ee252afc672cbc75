"""Katz scores against a plain implementation; every distribution sums to 1."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from visiloom.llm.common import held_out
from visiloom.llm.katz import CUTOFF, KatzScorer, Level

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Plain:
    def __init__(self, texts, order):
        self.order, self.n_texts = order, len(texts)
        self.counts = [Counter() for _ in range(order)]
        for t in texts:
            t = ["<s>"] * (order - 1) + t
            for i in range(order - 1, len(t)):
                for n in range(1, order + 1):
                    self.counts[n - 1][tuple(t[i - n + 1 : i + 1])] += 1
        self.tokens = sum(self.counts[0].values())
        self.d = [Level.fitted([sum(c == r for c in cs.values()) for r in range(1, CUTOFF + 2)]).d for cs in self.counts]
        self.after = [defaultdict(dict) for _ in range(order)]
        for n in range(1, order):
            for g, c in self.counts[n].items():
                self.after[n][g[:-1]][g[-1]] = c
        left = 1 - sum(self.disc(0, c) * c for c in self.counts[0].values()) / self.tokens if self.tokens else 1
        self.unknown = max(left, 1 / (self.tokens + 1))
        self.scale = (1 - self.unknown) / (1 - left) if left < 1 else 1

    def disc(self, n, c):
        return 1.0 if c > CUTOFF else self.d[n][c]

    def p(self, h, w):
        if not h:
            if not self.tokens:
                return 1.0
            c = self.counts[0][(w,)]
            return self.disc(0, c) * c / self.tokens * self.scale if c else self.unknown
        n, seen = len(h), self.after[len(h)].get(h)
        if not seen:
            return self.p(h[1:], w)
        total = sum(seen.values())
        freed = sum((1 - self.disc(n, c)) * c for c in seen.values())
        left, scale = (freed / total, 1.0) if freed > 1e-12 else (1 / (total + 1), total / (total + 1))
        if w in seen:
            return self.disc(n, seen[w]) * seen[w] / total * scale
        return left / (1 - sum(self.p(h[1:], x) for x in seen)) * self.p(h[1:], w)

    def score(self, t):
        t = ["<s>"] * (self.order - 1) + t
        return sum(math.log10(self.p(tuple(t[i - self.order + 1 : i]), t[i])) for i in range(self.order - 1, len(t)))


def tokens(text):
    return [w for w in WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))] + ["</s>"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["É", "a b"]
    out = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(62)], k=rng.randint(0, 60))), "x") for i in range(150)]
    return out + [(200, None, None), (201, "", "x"), (201, "The the THE\n\x0bthe " * 400, "x"), (202, "unseen words only", "x"), (None, "w1 w2", "x"), *out[:3]]


@pytest.mark.parametrize("order,bucket_tokens,block_bytes,hot_least", [(1, 500, 400, 1000), (2, 10**6, 1 << 20, 1000), (2, 700, 500, 5), (3, 600, 700, 5)])
def test_scores_equal_plain(spark, rows, order, bucket_tokens, block_bytes, hot_least):
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 10 == 0
    df = spark.createDataFrame(rows, "doc_id long, text string, held string").withColumn("n", F.lit(1)).withColumn("held_out", held_out("doc_id", 10))
    scorer = KatzScorer(df.repartition(3), order, bucket_tokens=bucket_tokens, block_bytes=block_bytes, hot_least=hot_least)
    got = scorer.scores().collect()
    model = Plain([tokens(t) for i, t, _ in rows if not held(i)], order)
    n, v = model.tokens, len(model.counts[0])
    want = sorted((str(i), held(i), len(t), sum((w,) in model.counts[0] for w in t), n, round(sum(math.log10((model.counts[0][(w,)] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6), round(model.score(t), 6)) for i, t in ((i, tokens(t)) for i, t, _ in rows))
    assert want == sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got)
    assert hot_least == 1000 or scorer.answers.upto(2).where("level = 2 and hot_h is not null").select("hot_h").distinct().count() > 3


def test_distributions_sum_to_one(rows):
    model = Plain([tokens(t) for _, t, _ in rows], 3)
    words = [g[0] for g in model.counts[0]] + ["never seen"]
    for h in [("w1",), ("<s>",), ("w1", "w2"), ("<s>", "w0"), ("the", "the"), ("nope", "w3")]:
        assert abs(sum(model.p(h, w) for w in words) - 1) < 1e-9, h


def test_empty_and_no_training(spark):
    schema = "doc_id long, text string, held_out boolean"
    assert KatzScorer(spark.createDataFrame([], schema)).scores().count() == 0
    one = KatzScorer(spark.createDataFrame([(1, "a b", True)], schema)).scores().first()
    assert (one.n_tokens, one.n_known, one.train_tokens, one.score, one.base_score) == (3, 0, 0, 0.0, 0.0)


def test_memory_of_a_bucket(spark):
    """A bucket is counted in ranges of histories: what a worker holds for each n-gram is less than the columns of one n-gram, widened."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from visiloom.llm import katz
    from visiloom.llm.arrays import pack, pack_floats, pack_sorted

    rng, rows, each = np.random.default_rng(1), [], 400_000
    for block in range(10):
        pairs = np.unique(rng.integers(1, 1 << 40, each).astype(np.uint64))
        words = np.arange(1, 5001, dtype=np.uint64)
        n = len(pairs)
        rows.append({"bucket": 0, "block": block, "h": pack_sorted(pairs), "runs": pack(np.ones(n, np.int64)), "hot": pack(np.zeros(n, np.int64)), "words": pack_sorted(words), "word": pack(rng.integers(0, 5000, n)), "lower": pack(np.ones(5000, np.int64)), "whole": pack(np.zeros(0, np.int64)), "n": pack(np.ones(n, np.int64))})
        rows[-1]["scales"], rows[-1]["scale"] = pack_floats(np.zeros(0))
    model = katz.Model(2, tokens=10 * each, texts=10, types=5000, levels=[katz.Level.fitted([0] * 6)])
    count, table, key = katz._count_grams(2, model), pa.Table.from_pylist(rows), (pa.scalar(0),)
    tracemalloc.start()
    out = count(key, table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(r["stats"][katz.CUTOFF + 2] for r in out.to_pylist() if r["stats"]) == sum(len(katz.unpack_sorted(r["h"])) for r in rows)
    assert peak < 60 * 10 * each, peak


@pytest.mark.parametrize("part_grams", [1, 50])
def test_parts_of_buckets_change_nothing(spark, part_grams):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(40)]
    df = spark.createDataFrame([(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(40)], k=rng.randint(0, 60))), i % 7 == 0) for i in range(60)], "doc_id long, text string, held_out boolean")
    of = lambda **more: sorted(tuple(r) for r in KatzScorer(df, 3, bucket_tokens=300, block_bytes=1500, hot_least=20, **more).scores().collect())
    assert of(part_grams=part_grams) == of()


@pytest.mark.parametrize("pairs", [True, False])
def test_grams_are_ordered_by_values(monkeypatch, pairs):
    """The n-grams of a large block are ordered by sorting values, not by sorting their places, which takes many times as long."""
    import numpy as np
    import pyarrow as pa

    from visiloom.llm import katz

    rng = np.random.RandomState(5)
    texts = [" ".join(map("w{}".format, rng.randint(0, 3000, n))) for n in (0, 1, 2, 150_000, 0, 3)]
    rows = pa.table([pa.array(range(6)), pa.array(texts), pa.array([False] * 5 + [True])], names=["id", "t", "h"])
    block = katz.Block(katz.tokenised(3, "id", "t", "h")(rows)[0])
    ids = rng.permutation(len(block.vocabulary)).astype(katz.U) + katz.U(1)
    block.ranked(ids)
    model = katz.Model(3, tokens=100_000, buckets=7, hot_least=10, pairs=pairs)
    history_counts = ids[block.which].astype(np.int64)
    sort, by_place = np.argsort, []
    monkeypatch.setattr(np, "argsort", lambda x, *a, **k: by_place.append(len(x)) or sort(x, *a, **k))
    two = katz.Grams(block, 2, ids, history_counts, model)
    three = katz.Grams(block, 3, ids, history_counts, model, two.group)
    assert not [n for n in by_place if n > 1000]
    for n, g in ((2, two), (3, three)):
        seen = {}
        for begin, size in zip(block.begin, block.n):
            tokens = [0] * (n - 1) + ids[block.which[begin : begin + size]].tolist()
            seen.update((begin + i, tuple(tokens[i : i + n])) for i in range(size))
        grams = [seen[t] for t in g.first.tolist()]
        assert len(set(grams)) == len(grams) and [grams[i] for i in g.inverse.tolist()] == [seen[t] for t in range(len(block.which))]
        assert g.w.tolist() == [x[-1] for x in grams]
        assert (np.diff(g.bucket) >= 0).all()
        for _, a, b in g.cuts():
            assert (g.h[a + 1 : b] >= g.h[a : b - 1]).all()
            same = g.h[a + 1 : b] == g.h[a : b - 1]
            assert (g.word_rank[a + 1 : b][same] > g.word_rank[a : b - 1][same]).all()
        kept = np.bincount(g.inverse[block.train], minlength=len(grams))
        assert (g.counts == kept).all()
