"""Set algebra and accounting of keys: integrity as data, and as an exception where `strict` asks for it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class IntegrityError(ValueError):
    pass


def required(df: DataFrame, check: str) -> None:
    """Raises if df, which holds defects, has a row; looks at one row only."""
    first = df.limit(1).collect()
    if first:
        raise IntegrityError(f"{check}: {first[0].asDict()}")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def duplicate_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """rows, distinct_keys, duplicate_rows."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("distinct_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def accounted(successes: DataFrame, errors: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with an outcome of either kind."""
    return successes.select(*keys).union(errors.select(*keys)).distinct()


def missing(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    return expected.select(*keys).distinct().join(observed.select(*keys), keys, "left_anti")


def overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def key_status(expected: DataFrame, successes: DataFrame, errors: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once with how it came out: one pass over the union of all three, aggregated by key."""
    tagged = union_all([d.select(*keys, *[F.lit(int(t == k)).alias(t) for t in ("e", "s", "f")]) for d, k in ((expected, "e"), (successes, "s"), (errors, "f"))])
    n = tagged.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("e", "s", "f")])
    status = F.when(F.col("e") == 0, "unexpected").when((F.col("s") > 0) & (F.col("f") > 0), "overlap").when(F.col("s") + F.col("f") > 1, "duplicate").when(F.col("s") > 0, "success").when(F.col("f") > 0, "error").otherwise("missing")
    return n.select(*keys, status.alias("status"))


def accounting(expected: DataFrame, successes: DataFrame, errors: DataFrame, keys: list[str]) -> DataFrame:
    """status, n."""
    return key_status(expected, successes, errors, keys).groupBy("status").agg(F.count("*").alias("n"))


def same_set(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """only_left, only_right, equal_sets."""
    tagged = a.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(b.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r")))
    per_key = tagged.groupBy(*keys).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    out = per_key.agg(F.count_if(F.col("r") == 0).alias("only_left"), F.count_if(F.col("l") == 0).alias("only_right"))
    return out.withColumn("equal_sets", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def histogram(df: DataFrame, column: str, *by: str) -> DataFrame:
    return df.groupBy(*by, column).agg(F.count("*").alias("n"))


def grid(spark: SparkSession, rows: DataFrame | None, **axes: tuple) -> DataFrame:
    """Every combination of the fixed axes, times the rows if there are any: explodes constants, no join."""
    out = rows if rows is not None else spark.range(1).select()
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def integrity(defects: dict[str, DataFrame]) -> DataFrame:
    """check, defect_count, passed for each named frame of defects."""
    return union_all([d.agg(F.count("*").alias("defect_count")).select(F.lit(name).alias("check"), "defect_count", (F.col("defect_count") == 0).alias("passed")) for name, d in defects.items()])


def all_passed(checks: DataFrame) -> DataFrame:
    return checks.agg(F.bool_and("passed").alias("integrity"))


def counters(flags: DataFrame, names: list[str], by: tuple[str, str] = ("model", "benchmark")) -> DataFrame:
    """Long-form counts of true flags over the four grouping sets (), (a), (b), (a, b); zero counts are left out."""
    a, b = by
    agg = flags.cube(a, b).agg(F.grouping_id().cast("int").alias("grouping"), *[F.count_if(F.col(n)).alias(n) for n in names])
    long = agg.select(a, b, "grouping", F.explode(F.array(*[F.struct(F.lit(n).alias("flag"), F.col(n).alias("n")) for n in names])).alias("x"))
    return long.select(a, b, "grouping", "x.flag", "x.n").where("n > 0")


def disagreements(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys of both sides with the columns that differ, null equal to null; keys of one side have `missing_left` or `missing_right`."""
    left = a.select(*keys, F.struct(*columns).alias("l"))
    right = b.select(*keys, F.struct(*columns).alias("r"))
    j = left.join(right, keys, "full")
    differ = F.array_compact(F.array(F.when(F.col("l").isNull(), "missing_left"), F.when(F.col("r").isNull(), "missing_right"), *[F.when(F.col("l").isNotNull() & F.col("r").isNotNull() & ~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), c) for c in columns]))
    return j.select(*keys, differ.alias("differ")).where(F.size("differ") > 0)


def first_examples(df: DataFrame, by: list[str], order: list[Column | str], k: int = 5) -> DataFrame:
    from pyspark.sql.window import Window

    return df.withColumn("example", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("example") <= k)


def preview(defects: DataFrame, keys: list[str], k: int = 100) -> DataFrame:
    return defects.orderBy(*keys).limit(k)


def progress(expected: DataFrame, successes: DataFrame, errors: DataFrame, keys: list[str]) -> DataFrame:
    """expected, completed, errors, remaining, percent (4 decimals)."""
    s = key_status(expected, successes, errors, keys).agg(
        F.count_if(F.col("status") != "unexpected").alias("expected"),
        F.count_if(F.col("status").isin("success", "duplicate", "overlap")).alias("completed"),
        F.count_if(F.col("status") == "error").alias("errors"),
    )
    done = F.col("completed") + F.col("errors")
    return s.select("*", (F.col("expected") - done).alias("remaining"), F.when(F.col("expected") > 0, F.round(100 * done / F.col("expected"), 4)).otherwise(0.0).alias("percent"))
