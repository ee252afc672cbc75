"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint's 64 bits are cut into two segments. Of two fingerprints that differ in at most two bits, one segment
differs in at most one: so either the high segments agree (key: the high segment), or they differ in one bit (key: the
high segment with that bit taken out, for each of its 32 bits), or the low segments agree (key: the low segment). That
makes 34 keys for each distinct fingerprint; equal keys give candidates, verified by counting bits.

Keys with more than `PAIRS` fingerprints don't make pairs. Their members get longer keys, with as many bits taken out as
may differ; all that share such a key are within two bits of each other, so one edge to the least of them loses no link.

Rows: null text counts as empty (fingerprint zero, linked like any other); rows that repeat a doc_id each get a row, with
the component of their own text; a null doc_id never is a component's id unless all its ids are null. An empty table gives
none. Only the id and the text are read. Joins are merged by hint, as in `graph`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clear_of, small_batches, stored
from .graph import components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SEED = 42
PAIRS = 64
AT_ONCE = 1 << 18


def fingerprint(text: str, width: int = 3) -> int:
    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - width + 1)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, AT_ONCE):
        some = words[at : at + AT_ONCE + width - 1]
        shingles = map(b" ".join, zip(*(some[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
        h = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8", count=min(n - at, AT_ONCE))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py() or "", width) for x in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, fp long")


def _variants(fps: DataFrame) -> DataFrame:
    """kind 0..31: high segment without that bit; 32: high segment; 33: low segment. key holds kind and what is left."""
    kinds = F.expr("""explode(transform(sequence(0, 33), k -> struct(k as kind, case
        when k < 32 then shiftleft(cast(k as long), 32) | (shiftrightunsigned(fp, 32) & ~shiftleft(1L, k))
        when k = 32 then shiftleft(32L, 32) | shiftrightunsigned(fp, 32)
        else shiftleft(33L, 32) | (fp & 4294967295L) end as key)))""")
    return fps.select("fp", kinds.alias("x")).select("fp", "x.kind", "x.key")


def edges(fps: DataFrame) -> DataFrame:
    """u, v over distinct fingerprints fp: at least a spanning set of all links of at most two bits, and only such links."""
    keyed = _variants(fps)
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(keyed.join(sizes.hint("merge"), "key"), "variants")
    few = (
        shared.where(f"n <= {PAIRS}").groupBy("key", "kind").agg(F.collect_list("fp").alias("l"))
        .select(F.expr("""explode(flatten(transform(l, a -> transform(filter(l, b -> a < b and bit_count(a ^ b) <= 2
            and (kind > 31 or (shiftrightunsigned(a ^ b, kind + 32) & 1) = 1)), b -> struct(a as v, b as u)))))""").alias("e"))
        .select("e.u", "e.v")
    )
    many = shared.where(f"n > {PAIRS}")
    # bits that may differ besides: one low bit for each missing high bit; two low bits where the high segment agrees; two high bits where the low one does
    masks = F.expr("""case
        when kind < 32 then transform(sequence(0, 31), j -> shiftleft(1L, j) | shiftleft(1L, kind + 32))
        when kind = 32 then flatten(transform(sequence(0, 30), i -> transform(sequence(i + 1, 31), j -> shiftleft(1L, i) | shiftleft(1L, j))))
        else flatten(transform(sequence(32, 62), i -> transform(sequence(i + 1, 63), j -> shiftleft(1L, i) | shiftleft(1L, j)))) end""")
    starred = many.select("fp", F.explode(masks).alias("mask")).select("fp", "mask", F.expr("fp & ~mask").alias("rest"))
    least = starred.groupBy("mask", "rest").agg(F.min("fp").alias("v"), F.max("fp").alias("most")).where("v < most").drop("most")
    stars = starred.join(least.hint("merge"), ["mask", "rest"]).where("fp <> v").select(F.col("fp").alias("u"), "v")
    return few.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id: the smallest doc_id that is reachable over links of at most two bits."""
    by_doc = stored(fingerprints(docs, doc_id, text, width), "fingerprints")
    by_fp = stored(by_doc.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(edges(by_fp.select("fp")))
    joined = by_fp.join(roots.select(F.col("node").alias("fp"), "root").hint("merge"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = joined.join(ids.hint("merge"), "root").select("fp", "component_id")
    return by_doc.join(of_fp.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """docs with one row of each group: that of the smallest doc_id, null ones last; the columns stay as they are."""
    fp, row = clear_of(docs.columns, "fp_"), clear_of(docs.columns, "row_")
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py() or "", width) for x in batch.column(place)), dtype=np.uint64, count=batch.num_rows)
            yield batch.append_column(fp, pa.array(fps.view(np.int64)))

    small_batches(docs.sparkSession)
    marked = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(fp, T.LongType())]))
    marked = stored(marked.withColumn(row, F.monotonically_increasing_id()), "fingerprints")
    slim = marked.select(F.col(doc_id).alias("i"), F.col(fp).alias("fp"), F.col(row).alias("r"))
    first = F.min(F.struct(F.col("i").isNull(), "i", "r")).alias("first")
    by_fp = stored(slim.groupBy("fp").agg(first), "distinct")
    roots = components(edges(by_fp.select("fp")))
    joined = by_fp.join(roots.select(F.col("node").alias("fp"), "root").hint("merge"), "fp", "left")
    kept = joined.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first")).select(F.col("first.r").alias(row))
    return marked.join(kept.hint("merge"), row, "left_semi").select(*docs.columns)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
