"""Hard negatives against brute force: odd rows, ties, hot clusters, scores beyond doubles."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from visiloom.llm import negatives

LEAST, MOST = -(1 << 63), (1 << 63) - 1


def brute(rows, k=5, anchors=lambda i: i % 100 == 0):
    """rows: (id, vector, label)."""
    fine = [(i, [min(max(math.floor(256 * float(x)), LEAST), MOST) for x in v], lab) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v, _ in fine), default=0)
    fine = [(i, v + [0] * (width - len(v)), lab) for i, v, lab in fine]
    out = []
    for a in sorted({i for i, _, _ in fine if anchors(i)}):
        _, (lab, mine) = a, min((lab, v) for i, v, lab in fine if i == a)
        scores = [(min(max(sum(x * y for x, y in zip(mine, v)), LEAST), MOST), i, la) for i, v, la in fine if i != a]
        good = sorted(((s, i) for s, i, la in scores if la == lab), key=lambda x: (-x[0], x[1]))[:k]
        for p, pid in good:
            bad = sorted(((s, i) for s, i, la in scores if la != lab and 80 * p <= 100 * s <= 100 * p), key=lambda x: (-x[0], x[1]))[:k]
            out += [(a, pid, r, i, p, s) for r, (s, i) in enumerate(bad, 1)]
    return sorted(out)


def mined(spark, rows, kind="float"):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], f"vec_id long, embedding array<{kind}>, label int, v int, cluster int")
    out = negatives.hard_negatives(negatives.labelled(df.repartition(3)), F.col("vec_id") % 100 == 0)
    return sorted(tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_hard_negatives(spark, monkeypatch):
    monkeypatch.setattr(negatives, "LIST", 16)
    monkeypatch.setattr(negatives, "ANCHORS", 2)
    monkeypatch.setattr(negatives, "CHUNK", 2)
    monkeypatch.setattr(negatives, "GROUP", 2)
    monkeypatch.setattr(negatives, "SEED", 8)
    rng = np.random.RandomState(7)
    centre = rng.randn(6, 8)
    rows = [(i, [float(np.float32(x)) for x in centre[0 if i % 3 == 0 else i % 6] + rng.randn(8) * 0.4], i % 4) for i in range(900)]
    rows += [(1000 + i, rows[100][1], i % 3) for i in range(80)]  # ties, in one cluster
    rows += [(2000, None, 1), (2001, [float("nan")] * 8, 1), (2002, [1.0, None], 1), (2003, rows[0][1], None), (None, rows[0][1], 1), (2100, [], 2), (2101, [0.5, 0.5], 2)]
    rows += [(200, rows[3][1], 3), rows[5], rows[5]]  # an anchor's id again, repeated rows
    assert mined(spark, rows) == brute(rows)


def test_scores_beyond_doubles(spark):
    rows = [(0, [1e8, -3.0, 2e9], 0), (1, [1e8, 5.0, 1.0], 0), (2, [1e8, 5.0, 2.0], 1), (3, [1e30, 0.0, 0.0], 1), (4, [-1e30, 0.0, 1.0], 0), (100, [0.0, 1.0, 0.0], 1), (101, [3.0, 0.9, 3.0], 0), (102, [1e8, 5.0, 2.5], 0), (103, [1.0, 0.0, 0.0], 0)]
    assert mined(spark, rows, "double") == brute(rows)


def test_few_rows(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 0)]) == [] and mined(spark, [(0, [1.0], 0)]) == []
    one = [(0, [], 0), (1, [], 0), (2, [], 1)]
    assert mined(spark, one) == brute(one) == [(0, 1, 1, 2, 0, 0)]


def test_walk_stops_where_bounds_fall_below_the_kth(spark):
    """Lists whose bounds can't reach the k-th best score, or that miss the window, are never scored."""
    c = np.array([[100.0, 0.0], [0.0, 100.0], [-100.0, 0.0]])
    pack = lambda m: negatives._stored(np.array(m))
    block = lambda k, rows, first: negatives.Members({"cluster": k, "radius": 2.0, "ids": np.arange(first, first + len(rows)).astype("<i8").tobytes(), "labels": np.zeros(len(rows), "<i8").tobytes(), "data": pack(rows)}, 2)
    lists = [block(0, [[100, 1], [99, 0]], 10), block(1, [[0, 99], [1, 100]], 20), block(2, [[-100, 1]], 30)]
    row = {"cluster": 0, "radius": 0.0, "ids": np.array([1], "<i8").tobytes(), "labels": np.array([0], "<i8").tobytes(), "data": pack([[50, 0]])}
    seen = []

    class Watched(negatives.Anchors):
        def score(self, some, m):
            seen.append(m.cluster)
            super().score(some, m)

    a = Watched(row, 2, 2, True)
    a.visit(lists, c)
    assert seen == [0] and a.found[0, 0][1].tolist() == [10, 11]
    seen.clear()
    b = Watched(row | {"windows": np.array([[[-200, 200]]], "<i8").tobytes(), "labels": np.array([1], "<i8").tobytes()}, 2, 2, False)
    b.visit(lists, c)
    assert seen == [1] and b.found[0, 0][1].tolist() == [21, 20]


def test_every_bucket_setting_gives_the_same(spark, monkeypatch):
    rng = np.random.RandomState(1)
    rows = [(i, [float(np.float32(x)) for x in rng.randn(5)], i % 2) for i in range(250)]
    want = brute(rows)
    for clusters in (1, 3):
        monkeypatch.setattr(negatives, "MOST_CLUSTERS", clusters)
        assert mined(spark, rows) == want
