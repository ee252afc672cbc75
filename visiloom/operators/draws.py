"""Seeded draws as a sequential generator makes them: samples, quotas, target choices and a final order, equal to those of
random.Random(seed) over the list of all rows in order.

A generator needs to know how many rows there are, not the rows. So rows are numbered in order by Spark (`numbered`: ranges
of the order, and running sums of the ranges' counts), the generator draws indices from the counts, and the rows with these
numbers are found by a join. Only what is drawn passes the driver, as indices: a sample's size is the caller's and known
beforehand (the driver needs some 100 bytes a drawn row), the table's isn't limited.

One `Draws` is one generator: each call goes on where the last one stopped, so calls must come in the order in which the
list-based program makes them.

Rows: the order columns decide; rows that tie in all of them go by a hash of all columns, so only equal rows can change
places. Nulls come first. A draw of more rows than there are is an error; an empty table allows only a draw of none.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored

AT, PART = "at_", "part_"
LOW = (1 << 33) - 1  # the part of a monotonically increasing id that counts within its partition


def numbered(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """df with the place of each row in the order, from 0. No task gets more than its range of the order; the counts of the ranges, one row each, are summed up on the driver."""
    keys = [*(F.col(c).asc_nulls_first() for c in order), F.xxhash64(*df.columns).asc()]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    dealt = stored(dealt.withColumn(PART, F.spark_partition_id()).withColumn(AT, F.monotonically_increasing_id().bitwiseAND(F.lit(LOW))), "numbered")
    counts = sorted((r[PART], r["n"]) for r in dealt.groupBy(PART).agg(F.count("*").alias("n")).collect())
    before, total = {}, 0
    for part, n in counts:
        before[part], total = total, total + n
    first = F.map_from_arrays(F.array(*map(F.lit, before)), F.array(*[F.lit(n).cast("long") for n in before.values()])) if before else F.lit(None).cast("map<int,bigint>")
    return dealt.withColumn(name, F.element_at(first, F.col(PART)) + F.col(AT)).drop(PART, AT)


class Draws:
    def __init__(self, seed: int):
        self.generator = random.Random(seed)

    def sample(self, df: DataFrame, n: int, order: list[str], place: str = "place") -> DataFrame:
        """n rows without replacement, with their place in the draw."""
        rows = numbered(df, order, "number_")
        return _picked(rows, self.generator.sample(range(rows.count()), n), place)

    def balanced(self, df: DataFrame, n: int, order: list[str], stratum: str = "domain", place: str = "place") -> DataFrame:
        """n rows, as many of each stratum as of the next; what doesn't divide goes to the first strata. Drawn stratum by stratum, then shuffled. The counts of the strata, one row each, pass the driver."""
        rows = numbered(df, [stratum, *order], "number_")
        strata = rows.groupBy(stratum).agg(F.min("number_").alias("first"), F.count("*").alias("n")).orderBy("first").collect()
        if not strata:
            if n:
                raise ValueError(f"no rows to draw {n} from")
            return _picked(rows, [], place)
        share, rest = divmod(n, len(strata))
        picked: list[int] = []
        for i, s in enumerate(strata):
            quota = share + (i < rest)
            if s["n"] < quota:
                raise ValueError(f"{stratum} {s[stratum]!r} has {s['n']} rows, {quota} are to be drawn")
            picked += [s["first"] + k for k in self.generator.sample(range(s["n"]), quota)]
        self.generator.shuffle(picked)
        return _picked(rows, picked, place)

    def choices(self, drawn: DataFrame, options: str, place: str = "place", name: str = "target") -> DataFrame:
        """drawn, numbered by place, with a number from 0 to options - 1 for each row, drawn in the order of the places."""
        counts = drawn.select(place, options).orderBy(place).collect()  # two numbers a drawn row
        return _joined(drawn, [(r[place], self.generator.randrange(r[options])) for r in counts], place, name)

    def shuffled(self, drawn: DataFrame, place: str = "place", name: str = "place") -> DataFrame:
        """drawn, numbered by place, in a new order."""
        order = list(range(drawn.count()))
        self.generator.shuffle(order)
        out = _joined(drawn, [(old, new) for new, old in enumerate(order)], place, "new_place_").drop(place)
        return out.withColumnRenamed("new_place_", name)


def _picked(rows: DataFrame, indices: list[int], place: str) -> DataFrame:
    return _joined(rows, [(k, i) for i, k in enumerate(indices)], "number_", place).drop("number_")


def _joined(rows: DataFrame, pairs: list[tuple[int, int]], key: str, name: str) -> DataFrame:
    found = rows.sparkSession.createDataFrame(pairs, f"{key} long, {name} long")
    return rows.withColumn(key, F.col(key).cast("long")).join(found, key)
