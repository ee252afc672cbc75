"""Selection, sharding and seeded sampling. Draws are by hash order, the same on any cluster; they aren't those of a sequential generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import shard_of
from .checks import required


def with_ids(df: DataFrame, ids: DataFrame, key: str = "sample_id", strict: bool = True) -> DataFrame:
    if strict:
        required(ids.join(df, key, "left_anti"), "unknown ids")
    return df.join(ids.select(key).distinct(), key, "left_semi")


def without_ids(df: DataFrame, ids: list[str], key: str = "sample_id") -> DataFrame:
    return df.where(~F.col(key).isin(*ids)) if ids else df


def in_given_order(df: DataFrame, ids: list[str], key: str = "sample_id") -> DataFrame:
    """The rows of these ids with their place in the list; the list has no id twice."""
    if len(set(ids)) != len(ids):
        raise ValueError("ids repeat")
    place = F.array_position(F.array(*[F.lit(i) for i in ids]), F.col(key))
    return df.withColumn("place", place).where("place > 0").orderBy("place")


def all_within(lengths: str, budget: int) -> Column:
    """Whether every value of a map is within the budget."""
    return F.forall(F.map_values(lengths), lambda v: v <= budget)


def draw_order(key: str | Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), (F.col(key) if isinstance(key, str) else key).cast("string")), 256)


def sample(df: DataFrame, n: int, seed: int, key: str = "sample_id") -> DataFrame:
    """n rows without replacement: those first in hash order (a top-n, not a full sort)."""
    return df.orderBy(draw_order(key, seed), key).limit(n)


def balanced(df: DataFrame, n: int, seed: int, stratum: str = "domain", key: str = "sample_id") -> DataFrame:
    """n rows, as many of each stratum as of the next; what doesn't divide goes to the first strata by name. A stratum with fewer rows than its share is an error for the caller to see: short says by how many."""
    strata = df.groupBy(stratum).agg(F.count("*").alias("available"))
    w = Window.orderBy(stratum)
    numbered = strata.select(stratum, "available", F.row_number().over(w).alias("i"), F.count("*").over(Window.partitionBy()).alias("k"))
    quota = numbered.select(F.col(stratum).alias("s_"), (F.floor(F.lit(n) / F.col("k")) + F.when(F.col("i") <= F.lit(n) % F.col("k"), 1).otherwise(0)).cast("int").alias("quota"))
    ranked = df.withColumn("draw", F.row_number().over(Window.partitionBy(stratum).orderBy(draw_order(key, seed), key))).where(F.col("draw") <= n)  # no quota is over n, so each task keeps n rows of a stratum at most
    return ranked.join(quota, F.col(stratum).eqNullSafe(F.col("s_"))).where("draw <= quota").drop("s_", "draw")


def random_index(key: str | Column, n: str | Column, seed: int) -> Column:
    """A number from 0 to n - 1 for each key."""
    count = F.col(n) if isinstance(n, str) else n
    return F.pmod(F.conv(F.substring(draw_order(key, seed), 1, 15), 16, 10).cast("long"), count.cast("long")).cast("int")


def shuffled(df: DataFrame, seed: int, key: str = "sample_id", name: str = "manifest_index") -> DataFrame:
    """A final order from 0, by hash: rows are numbered within 4,096 ranges of the hash, and ranges by running sums of their counts, so no task sorts all rows."""
    ordered = df.withColumn("o_", draw_order(key, seed)).withColumn("b_", F.substring("o_", 1, 3))
    counts = ordered.groupBy("b_").agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("b_", before.alias("before_"))
    place = F.row_number().over(Window.partitionBy("b_").orderBy("o_", key)) - 1
    return ordered.withColumn("place_", place).join(offsets, "b_").withColumn(name, (F.col("before_") + F.col("place_")).cast("int")).drop("o_", "b_", "before_", "place_")


def hash_shard(df: DataFrame, index: int, shards: int, limit: int | None = None, order: str | None = None) -> DataFrame:
    """Rows of one hash shard; with a limit, the first in the given order after sharding."""
    out = df.where(shard_of(shards) == index)
    return out if limit is None else out.orderBy(order).limit(limit)


def stride_shard(df: DataFrame, index: int, shards: int, place: str) -> DataFrame:
    return df.where(F.pmod(F.col(place), F.lit(shards)) == index)


def first_documents(rows: DataFrame, by: list[str], order: str, document: str, k: int = 10, query: str = "query", strict: bool = True) -> DataFrame:
    """The first k documents of each group in file order as an array; a group with two query texts is an error."""
    if strict:
        required(rows.groupBy(*by).agg(F.count_distinct(query).alias("n")).where("n > 1"), "query texts differ")
    w = Window.partitionBy(*by).orderBy(order)
    kept = rows.withColumn("i_", F.row_number().over(w)).where(F.col("i_") <= k)
    return kept.groupBy(*by).agg(F.min(query).alias(query), F.array_sort(F.collect_list(F.struct("i_", document))).alias("d")).select(*by, query, F.transform("d", lambda x: x[document]).alias("documents"))


def first_groups(rows: DataFrame, by: str, within: str, k: int) -> DataFrame:
    """Rows of the first k groups of each value of `within`."""
    return rows.withColumn("g_", F.dense_rank().over(Window.partitionBy(within).orderBy(by))).where(F.col("g_") <= k).drop("g_")


def disordered(rows: DataFrame, keys: list[str], place: str, range_rows: int = 65_536) -> DataFrame:
    """Rows whose key isn't above that of the row before, in file order; place is a number, and rows at one place go by key.

    Rows are compared within ranges of the place, of about range_rows where places are even, and the first of each range with the last of the range before, so no task sorts all rows."""
    p = F.col(place).cast("double")
    width = (F.max(p) - F.min(p)) * range_rows / F.greatest(F.count(p), F.lit(1))
    span = rows.agg(F.min(p).alias("low_"), F.greatest(width, F.lit(1e-9)).alias("width_"))
    dealt = rows.join(F.broadcast(span), F.lit(True)).withColumn("b_", F.coalesce(F.floor((p - F.col("low_")) / F.col("width_")), F.lit(-1))).withColumn("k_", F.struct(*keys)).drop("low_", "width_")
    ends = dealt.groupBy("b_").agg(F.max(F.struct(F.col(place).alias("place_"), "k_")).alias("end_"))
    ends = ends.select("b_", F.lag("end_.k_").over(Window.orderBy("b_")).alias("end_"))  # one row a range
    inner = dealt.withColumn("before_", F.lag("k_").over(Window.partitionBy("b_").orderBy(place, "k_")))
    return inner.join(ends, "b_").withColumn("before_", F.coalesce("before_", "end_")).where("before_ is not null and not (k_ > before_)").drop("b_", "k_", "before_", "end_")
