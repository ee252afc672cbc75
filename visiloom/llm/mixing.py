"""Mixing sources to target weights by entropy balancing.

Of all document rates that give each source its target number of words, the ones closest to 1 (least Kullback-Leibler
divergence, documents weighing alike) are exp(lambda_s * words / mean words of s), cut at the cap. The dual is convex and
separates by source; Newton's method with a bracket solves it for all sources at once, over a table of how many documents
each (source, words) has, so the corpus is read once. Sums are exact decimals: reruns agree whatever order tasks end in.

Rates become copies by carrying the rounding error, in words, from larger sizes to smaller within a source; the cells of a
source are its distinct sizes, at most as many as the longest document has words. Which documents of a cell get the
additional copy is decided by id hash, in `SUBS` sub-cells for each shuffle partition, so no cell is sorted in one task.

Joins of cells and sub-cells, which grow with the corpus, are merged by hint, as in `graph`.

Rows: null or empty texts have size 0, take nothing and get 0 words; null sources are one source, the last. Rows that
repeat are documents of their own; of those that share an id, a hash of their plain columns decides, so reruns agree. Texts
of any length are counted whole. Other columns pass through, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_PATTERN, clear_of, partitions, stored

CAP, SUBS, STEPS = 3, 4, 60
EXACT = "decimal(38,12)"


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sized: DataFrame, cap: int = CAP) -> DataFrame:
    """source, source_size, target. Sources by code point, null last, weigh 1, 2, 3, repeating; none gets over cap times its size, the excess going to the others by weight."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("w", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
    # filled like basins: in order of cap / weight, the first k are full; the level is what the rest share
    by = Window.orderBy(F.col("source_size") * cap / F.col("w"), F.col("source").asc_nulls_last())
    upto = by.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("full", F.coalesce(F.sum(F.col("source_size") * cap).over(upto), F.lit(0)).cast("double"))
    s = s.withColumn("left", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(upto), F.lit(0.0)))
    s = s.withColumn("level", (F.sum("source_size").over(whole) - F.col("full")) / F.col("left"))
    # the first basin that the level doesn't fill sets it for all
    s = s.withColumn("found", F.min(F.when(F.col("level") * F.col("w") <= F.col("source_size") * cap, F.struct(F.col("full"), F.col("level")))).over(whole))
    return s.select("source", "source_size", F.least(F.col("source_size") * F.lit(float(cap)), F.coalesce(F.col("found.level") * F.col("w"), F.col("source_size") * F.lit(float(cap)))).alias("target"))


def rates(cells: DataFrame, wanted: DataFrame, cap: int = CAP, tolerance: float = 1e-9) -> DataFrame:
    """source, size, m, rate: cells are source, size, m (documents of that size); wanted has source, source_size, target."""
    same = F.col("source").eqNullSafe(F.col("s"))
    means = cells.groupBy("source").agg(F.sum("m").alias("docs"))
    base = wanted.join(means.withColumnRenamed("source", "s"), same).drop("s")
    base = base.select("source", "target", (F.col("source_size") / F.col("docs")).alias("mean"), (F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)).alias("full"))
    state = stored(base.select("*", F.lit(0.0).alias("lam"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"), F.lit(False).alias("done")), "dual")
    keep = state.columns
    joined = cells.withColumnRenamed("source", "s")
    for _ in range(STEPS):
        r = F.least(F.exp(F.greatest(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0)), F.lit(-50.0))), F.lit(float(cap)))
        words = F.col("m") * F.col("size") * r
        slope = F.when(r < cap, words * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = joined.join(state, same).groupBy(*keep).agg(F.sum(words.cast(EXACT)).cast("double").alias("got"), F.sum(slope.cast(EXACT)).cast("double").alias("slope"))
        low = F.when(F.col("got") < F.col("target"), F.col("lam")).otherwise(F.col("low"))
        high = F.when(F.col("got") >= F.col("target"), F.col("lam")).otherwise(F.col("high"))
        step = F.col("lam") - (F.col("got") - F.col("target")) / F.greatest(F.col("slope"), F.lit(1e-300))
        # outside the bracket: its middle, or for an open side a doubling step
        open_ = F.when(F.col("lam") == 0, F.signum(F.col("target") - F.col("got"))).otherwise(F.col("lam") * 2)
        middle = F.when((low <= -1e6) | (high >= 1e6), open_).otherwise((low + high) / 2)
        step = F.when((step > low) & (step < high) & (F.abs(step - F.col("lam")) <= F.greatest(F.lit(1.0), F.abs("lam"))), step).otherwise(middle)
        done = F.abs(F.col("got") - F.col("target")) <= tolerance * F.greatest(F.col("target"), F.lit(1.0))
        new = sums.select("source", "target", "mean", "full", F.when(done | F.col("done"), F.col("lam")).otherwise(step).alias("lam"), low.alias("low"), high.alias("high"), (F.col("done") | done | F.col("full") | (high - low < 1e-13)).alias("done"))
        state = stored(new, "dual")
        if state.where(~F.col("done")).isEmpty():
            break
    else:
        raise RuntimeError(f"the dual did not settle in {STEPS} steps: {state.where(~F.col('done')).limit(20).collect()}")
    r = F.when(F.col("full"), F.lit(float(cap))).otherwise(F.least(F.exp(F.greatest(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0)), F.lit(-50.0))), F.lit(float(cap))))
    return joined.join(state, same).select("source", "size", "m", F.coalesce(r, F.lit(0.0)).alias("rate"))


def _rounded(cells: pd.DataFrame) -> pd.DataFrame:
    """Copies of each cell: from the largest size down, what rounding lost or gave too much is carried on."""
    cells = cells.sort_values("size", ascending=False)
    out, carry = [], 0.0
    for size, m, rate in zip(cells["size"], cells["m"], cells["rate"]):
        want = m * rate * size + carry
        low, high = m * max(int(rate) - 1, 0), m * min(int(rate) + 2, CAP)  # a copy beyond the rate's neighbours, to take up the carry
        k = min(max(round(want / size), low), high)
        carry = want - k * size
        out.append(k)
    return cells.assign(k=out)[["source", "size", "m", "k"]]


def with_copies(docs: DataFrame, size: str, copies: str, source: str = "source", doc_id: str = "doc_id", cap: int = CAP) -> DataFrame:
    """docs, which have their sizes in column `size`, and a struct `copies` of n, source_size and target. The rows themselves are dealt out once."""
    names = [clear_of(docs.columns, n) for n in ("key_", "sub_", "h_", "z_")]
    key, sub, h, z = names
    subs = SUBS * partitions(docs.sparkSession)
    keyed = docs.withColumns({key: F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null")), h: F.xxhash64(F.col(doc_id)), z: F.col(size).cast("long")})
    keyed = keyed.withColumn(sub, F.pmod(F.col(h), F.lit(subs)))
    slim = stored(keyed.groupBy(F.col(source).alias("source"), F.col(key).alias("key"), F.col(z).alias("size"), F.col(sub).alias("sub")).agg(F.count("*").alias("n")), "sizes")
    wanted = stored(targets(slim.select("source", (F.col("size") * F.col("n")).alias("size")), cap), "targets")
    cells = slim.groupBy("source", "key", "size").agg(F.sum("n").alias("m"))
    balanced = rates(cells.where("size > 0").select("source", "size", "m"), wanted, cap)
    kept = stored(balanced.groupBy("source").applyInPandas(_rounded, balanced.select("source", "size", "m", F.lit(0).cast("long").alias("k")).schema), "copies")
    kept = kept.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("key"), "size", "m", "k")
    # a cell's additional copies go to its sub-cells by their share, through running sums
    w = Window.partitionBy("key", "size").orderBy("sub").rowsBetween(Window.unboundedPreceding, 0)
    extra, upto = F.expr("k - m * (k div m)"), F.sum("n").over(w)
    parts = slim.join(kept.hint("merge"), ["key", "size"], "left").select("source", "key", "size", "sub", F.expr("k div m").alias("each"), (F.floor(extra * upto / F.col("m")) - F.floor(extra * (upto - F.col("n")) / F.col("m"))).alias("more"))
    parts = parts.join(wanted.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    parts = stored(parts.select(F.col("key").alias(key), F.col("sub").alias(sub), F.col("size").alias(z), F.struct("each", "more", "source_size", "target").alias(copies)), "subcells")
    plain = [c for c, t in docs.dtypes if not t.startswith(("map", "struct", "array", "variant"))]
    place = F.row_number().over(Window.partitionBy(key, z, sub).orderBy(h, doc_id, F.xxhash64(*plain)))
    n = F.coalesce(F.col(f"{copies}.each") + F.when(place <= F.col(f"{copies}.more"), 1).otherwise(0), F.lit(0)).cast("int")
    return keyed.join(parts.hint("merge"), [key, z, sub]).select(*docs.columns, F.struct(n.alias("n"), F.col(f"{copies}.source_size"), F.col(f"{copies}.target")).alias(copies))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", cap: int = CAP) -> DataFrame:
    """docs with each row as often as the mix takes it (rows that it leaves out are gone); the columns stay as they are."""
    size, copies = clear_of(docs.columns, "n_words_"), clear_of(docs.columns, "copies_")
    counted = with_copies(docs.withColumn(size, n_words(text)), size, copies, source, doc_id, cap)
    taken = counted.where(F.col(f"{copies}.n") > 0)
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(f"{copies}.n"))).alias(size)).select(*docs.columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = stored(docs.select("doc_id", "source", n_words("text").alias("size")), "sized")
    rows = with_copies(sized, "size", "mix")
    return rows.select("doc_id", "size", F.col("mix.source_size").cast("long").alias("source_size"), F.col("mix.target").alias("target"), (F.col("mix.n") * F.col("size")).cast("long").alias("taken"))
