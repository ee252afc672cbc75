"""Seeded draws against random.Random over the list of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from visiloom.operators.draws import Draws, numbered


def people(spark, n=700):
    rows = [(f"id{i * 7919 % n:05d}", "dcab"[i * 31 % 4] if i % 9 else "b", i % 6 + 1) for i in range(n)]
    return spark.createDataFrame(rows, "id string, domain string, documents int").repartition(5), sorted(rows)


def in_order(df, *columns, place="place"):
    rows = df.orderBy(place).select(place, *columns).collect()
    assert [r[0] for r in rows] == list(range(len(rows)))
    return [tuple(r[1:]) for r in rows]


def test_rows_are_numbered_in_order(spark):
    df, rows = people(spark)
    out = numbered(df, ["id"])
    assert [tuple(r)[:3] for r in out.orderBy("number").collect()] == rows
    assert [r.number for r in out.orderBy("number").select("number").collect()] == list(range(len(rows)))
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < len(rows)
    odd = spark.createDataFrame([(None, 1), ("b", 2), ("a", 3), ("a", 3), ("a", 4)], "k string, v int")
    assert [r.k for r in numbered(odd, ["k"]).orderBy("number").collect()] == [None, "a", "a", "a", "b"]
    assert numbered(odd.where("false"), ["k"]).count() == 0


@pytest.mark.parametrize("seed", [0, 7, 20260101])
def test_draws_are_those_of_the_generator(spark, seed):
    """The whole of a manifest's draws: a sample, a balanced choice, targets and the final order, from two generators."""
    df, rows = people(spark)
    ours, theirs = Draws(seed), random.Random(seed)
    sample = ours.sample(df, 60, ["id"])
    want = theirs.sample(rows, 60)
    assert in_order(sample, "id", "domain", "documents") == want
    balanced = ours.balanced(df, 43, ["id"])
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    chosen = []
    for i, d in enumerate(sorted(groups)):
        chosen += theirs.sample(groups[d], 43 // len(groups) + (i < 43 % len(groups)))
    theirs.shuffle(chosen)
    assert in_order(balanced, "id", "domain", "documents") == chosen
    other, target = Draws(seed + 1), random.Random(seed + 1)
    targets = other.choices(balanced, "documents")
    assert in_order(targets, "target") == [(target.randrange(r[2]),) for r in chosen]
    both = sample.select("place", "id").unionByName(targets.select((F.col("place") + 60).alias("place"), "id"))
    final = [r[0] for r in want + chosen]
    theirs.shuffle(final)
    assert in_order(ours.shuffled(both, name="manifest_index"), "id", place="manifest_index") == [(i,) for i in final]


def test_too_few_rows(spark):
    df, rows = people(spark, 20)
    with pytest.raises(ValueError):
        Draws(1).sample(df, 21, ["id"])
    with pytest.raises(ValueError, match="rows, "):
        Draws(1).balanced(df, 60, ["id"])
    assert Draws(1).sample(df, 0, ["id"]).count() == 0 and Draws(1).balanced(df.where("false"), 0, ["id"]).count() == 0
    assert in_order(Draws(3).sample(df, 20, ["id"]), "id") == [(r[0],) for r in random.Random(3).sample(rows, 20)]


def test_query_is_the_list_program(spark):
    from visiloom.plans import catalog

    sf = "/root/testdata/sf0.001"
    rows = sorted((r.c_custkey, r.c_mktsegment, r.c_nationkey % 6 + 1) for r in spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_mktsegment", "c_nationkey").collect())
    rng, target = random.Random(7), random.Random(8)
    one = [(i, d, None) for i, d, _ in rng.sample(rows, 100)]
    groups = {d: [r for r in rows if r[1] == d] for d in sorted({r[1] for r in rows})}
    two = []
    for i, group in enumerate(groups.values()):
        two += rng.sample(group, 53 // len(groups) + (i < 53 % len(groups)))
    rng.shuffle(two)
    both = one + [(i, d, target.randrange(n)) for i, d, n in two]
    rng.shuffle(both)
    got = catalog.QUERIES["manifest_draw"](spark, sf)
    assert in_order(got, "id", "domain", "target", place="manifest_index") == both
