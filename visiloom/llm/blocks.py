"""Documents as blocks of a few MB, one row each, stored once in a table bucketed by the task that wrote them.

Operators that ask other tasks about what is in a block (how often does this n-gram, this window occur?) send packed
questions by bucket and get packed answers by block. The block table is bucketed, so it never moves again: only questions
and answers are shuffled. A block keeps its number, whose high half is its task's, once it is written; retried tasks write
theirs anew as a whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import release
from .common import partitions, scratch, slices, small_batches

TARGET = 2 << 20
SCHEMA = "part int, block long, size long, tokens long, payload binary"


def packed(rows: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as w:
        w.write(rows)
    return sink.getvalue().to_pybytes()


def unpacked(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all().combine_chunks()


def bucketed(df: DataFrame, label: str, column: str, n: int, sorted_: bool = False, path: str | None = None) -> DataFrame:
    """Writes df as a table in the shared folder (or at a path), bucketed by the column, and reads it."""
    spark: SparkSession = df.sparkSession
    name = f"visiloom_{label}_{uuid.uuid4().hex[:12]}"
    writer = df.write.format("parquet").option("path", path or scratch(spark, label)).bucketBy(n, column)
    (writer.sortBy(column) if sorted_ else writer).saveAsTable(name)
    return spark.table(name)


def bucketed_at(spark: SparkSession, label: str, path: str, schema: str, column: str, n: int) -> DataFrame:
    """Reads what bucketed() has sorted and written there in an earlier session."""
    name = f"visiloom_{label}_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({column}) SORTED BY ({column}) INTO {n} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def part_of(block: str) -> Column:
    return F.shiftright(block, 32).cast("int")


class Answers:
    """Rows for blocks by level, in a table that is bucketed as the blocks are: each row is moved once, when it is written."""

    def __init__(self, blocks: DataFrame, label: str):
        self.spark, self.n = blocks.sparkSession, partitions(blocks.sparkSession)
        self.name, self.path = f"visiloom_{label}_{uuid.uuid4().hex[:12]}", scratch(self.spark, label)

    def add(self, rows: DataFrame) -> None:
        """rows have a level, and a block or, where that is null, a bucket."""
        part = F.coalesce(part_of("block"), F.pmod("bucket", F.lit(self.n)))
        moved = rows.withColumn("part", part).repartition(self.n, "part")
        moved.write.format("parquet").option("path", self.path).option("compression", "uncompressed").mode("append").partitionBy("level").bucketBy(self.n, "part").saveAsTable(self.name)

    def upto(self, level: int) -> DataFrame:
        return self.spark.table(self.name).where(F.col("level") <= level)


def as_is(rows: pa.Table) -> tuple[bytes, int]:
    return packed(rows), 0


def write_blocks(docs: DataFrame, text: str, target: int = TARGET, make: Callable[[pa.Table], tuple[bytes, int]] = as_is, first_part: int = 0, path: str | None = None) -> DataFrame:
    """part, block, size (rows), tokens and payload: what `make` gives for the block's rows, all their columns as they are. Parts, and so blocks, are numbered from first_part on, so that several tables can have numbers of their own."""
    small_batches(docs.sparkSession)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, n = (first_part + TaskContext.get().partitionId()) << 32, [], 0

        def row() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            payload, tokens = make(rows)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((number >> 32, pa.int32()), (number, pa.int64()), (rows.num_rows, pa.int64()), (tokens, pa.int64()), (payload, pa.binary()))], names=["part", "block", "size", "tokens", "payload"])

        for batch in batches:
            for piece in slices(batch, place, max(target // 8, 1)):
                held.append(piece)
                n += piece.column(place).nbytes
                if n >= target:
                    yield row()
                    number, held, n = number + 1, [], 0
        if held:
            yield row()

    return bucketed(docs.mapInArrow(run, SCHEMA), "blocks", "part", partitions(docs.sparkSession), path=path)


def answered(blocks: DataFrame, answers: DataFrame, run: Callable[[int, bytes, pa.Table], pa.Table], schema) -> DataFrame:
    """run(block, payload, answer rows) for every block, one after another; the answers have a column block, and those of a table that is bucketed like the blocks their part too, so that they don't move."""

    def both(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("block")
        number = np.asarray(right["block"])
        out = []
        for block, payload in zip(left["block"].to_pylist(), left["payload"]):
            a, b = np.searchsorted(number, [block, block + 1])
            out.append(run(block, payload.as_py(), right.slice(a, b - a)))
            release()
        return pa.concat_tables(out)

    asked = answers if "part" in answers.columns else answers.withColumn("part", part_of("block"))
    return blocks.select("part", "block", "payload").groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(both, schema)
