"""Restartable work: what is left to do, and an idempotent streaming form of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.checks import required
from ..sources.readers import exists


def remaining(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose key has no outcome yet."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def checked_log(successes: DataFrame, errors: DataFrame, work: DataFrame, keys: list[str]) -> None:
    """A log to resume from has each key once, as one outcome, and none that isn't work."""
    required(successes.groupBy(*keys).count().where("count > 1"), "keys twice in the log")
    required(successes.join(errors, keys, "left_semi"), "keys that succeeded and failed")
    required(successes.select(*keys).union(errors.select(*keys)).join(work, keys, "left_anti"), "keys that aren't work")


def run_remaining(work: DataFrame, path: str, schema: T.StructType, keys: list[str], step: Callable[[DataFrame], DataFrame]) -> int:
    """Runs `step` on what the log at `path` doesn't have and appends the outcome; gives how many rows there were."""
    spark: SparkSession = work.sparkSession
    done = spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)
    left = remaining(work, done, keys)
    before = done.count()
    step(left).write.mode("append").json(path)
    return spark.read.schema(schema).json(path).count() - before


def stream_once(source: DataFrame, path: str, checkpoint: str, keys: list[str], step: Callable[[DataFrame], DataFrame]):
    """A streaming query over new files: each key is worked on once, also when a batch is repeated after a failure."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        todo = df.dropDuplicates(keys)
        if exists(spark, path):
            todo = remaining(todo, spark.read.parquet(path), keys)
        step(todo).write.mode("append").parquet(path)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changed(new: DataFrame, old: DataFrame, keys: list[str], text: str) -> DataFrame:
    """key, state of a text since it was last seen: new, changed, same or gone, by content hash."""
    a = new.select(*keys, F.sha2(text, 256).alias("n_"))
    b = old.select(*keys, F.sha2(text, 256).alias("o_"))
    state = F.when(F.col("o_").isNull(), "new").when(F.col("n_").isNull(), "gone").when(F.col("n_") == F.col("o_"), "same").otherwise("changed")
    return a.join(b, keys, "full").select(*keys, state.alias("state"))
