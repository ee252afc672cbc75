"""Quality rules with adaptive thresholds, in DataFrame expressions only.

Each document's words, symbols, repeated lines and repeated three-word windows are counted. Thresholds aren't fixed: for
every (language, source), every language and the whole corpus, mergeable quantile sketches (Greenwald-Khanna summaries of
percentile_approx, partial sketches merged over partitions) give the quartiles of four ratios among documents that pass
the base rules; a ratio beyond its quartile by more than `WIDE` interquartile ranges rejects the document. Small groups
(under `FEW` documents) use the next wider one. The thresholds are joined back and filter the corpus.

Rows: a null text counts as empty (no words: base_failed). Null languages and sources are groups of their own. Rows that
repeat are judged each on its own. An empty table gives no rows. Columns that are kept may have any name that doesn't begin
with two underscores (nor one of the counts'). Texts are counted whole; windows that repeat are found by
sorting, so a long text takes n log n steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: ratio: least spread of its fence, and whether small values are bad too
RATIOS = {"symbol": (0.05, False), "dup_line": (0.1, False), "repeat": (0.1, False), "length": (0.5, True)}
WIDE, FEW, ACCURACY = 3.0, 30, 10000
SPACES = r"[\x20\x09-\x0D]+"
LOW = (1 << 24) - 1


def counted(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source"), text: str = "text") -> DataFrame:
    """The kept columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word) and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(*keep, t.alias("__t"))
    df = df.select(
        *keep, F.array_remove(F.split("__t", SPACES), "").alias("__w"), F.length(F.regexp_replace("__t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__l"),
    )
    df = df.select(
        *keep, "n_symbols", F.size("__w").cast("long").alias("n_words"), F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.size("__l").cast("long").alias("n_lines"), (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.expr("if(size(__w) < 3, array(), transform(sequence(0, size(__w) - 3), i -> xxhash64(get(__w, i), get(__w, i + 1), get(__w, i + 2))))").cast("array<bigint>").alias("__h"),
    )
    df = df.withColumn("__d", F.size(F.array_distinct("__h")))
    # high bits of the hash and the place in one long, sorted: equal windows become neighbours; if high bits clash, hash and place side by side
    df = df.withColumn("__p", F.expr(f"if(__d = size(__h), array(), transform(__h, h -> h & ~{LOW}L))").cast("array<bigint>"))
    df = df.withColumn("__fits", F.expr(f"size(__h) <= {LOW} and size(array_distinct(__p)) = __d"))
    df = df.withColumn("__s", F.expr("if(__fits, array_sort(transform(__p, (h, i) -> h | cast(i as bigint))), array())").cast("array<bigint>").alias("__s"))
    df = df.withColumn("__x", F.expr("if(size(__p) > 0 and not __fits, array_sort(transform(__h, (h, i) -> struct(h as h, i as i))), array())").cast("array<struct<h:bigint,i:int>>"))
    near = f"(get(__s, i - 1) & ~{LOW}L) <=> (x & ~{LOW}L) or (get(__s, i + 1) & ~{LOW}L) <=> (x & ~{LOW}L)"
    df = df.withColumn("__at", F.expr(f"""if(__fits, transform(filter(__s, (x, i) -> {near}), x -> cast(x & {LOW}L as int)),
        transform(filter(__x, (x, i) -> get(__x, i - 1).h <=> x.h or get(__x, i + 1).h <=> x.h), x -> x.i))""").cast("array<int>"))
    df = df.withColumn("__at", F.expr("sort_array(__at)"))
    df = df.withColumn("n_repeat_words", F.expr("aggregate(transform(__at, (x, i) -> if(i = 0, 3, least(3, x - get(__at, i - 1)))), 0L, (a, x) -> a + x)"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return df.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", failed.alias("base_failed"))


def ratios(counts: DataFrame) -> DataFrame:
    n = F.greatest("n_words", F.lit(1))
    return counts.withColumns({"__symbol": F.col("n_symbols") / n, "__dup_line": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), "__repeat": F.col("n_repeat_words") / n, "__length": F.col("word_chars") / n})


def thresholds(judged: DataFrame) -> DataFrame:
    """One row for each (lang, source), lang and the whole, by `level` 0, 1 and 3 (grouping_id), with the fences of each ratio."""
    q = {r: F.percentile_approx(f"__{r}", F.array(F.lit(0.25), F.lit(0.75)), F.lit(ACCURACY)).alias(r) for r in RATIOS}
    rows = judged.where(~F.col("base_failed")).rollup("lang", "source").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), *q.values())
    out = ["lang", "source", "level", "n"]
    for r, (least, both) in RATIOS.items():
        spread = F.greatest(F.col(r)[1] - F.col(r)[0], F.lit(least)) * WIDE
        out.append((F.col(r)[1] + spread).alias(f"{r}_most"))
        if both:
            out.append((F.col(r)[0] - spread).alias(f"{r}_least"))
    return rows.select(*out)


def kept_column() -> Column:
    ok = ~F.col("base_failed")
    for r, (_, both) in RATIOS.items():
        ok &= F.coalesce(F.col(f"__{r}") <= F.col(f"__{r}_most"), F.lit(True))
        if both:
            ok &= F.coalesce(F.col(f"__{r}") >= F.col(f"__{r}_least"), F.lit(True))
    return ok


def verdicts(counts: DataFrame) -> DataFrame:
    """counts with the column kept. Counts should be stored: they are read for the sketches and again for the join."""
    judged = ratios(counts)
    limits = stored(thresholds(judged), "thresholds")
    fences = [c for c in limits.columns if c not in ("lang", "source", "level", "n")]
    own = F.struct(*fences)
    one = limits.where("level = 0").select(F.col("lang").alias("__l"), F.col("source").alias("__s"), F.col("n").alias("__n"), own.alias("__own"))
    lang = limits.where("level = 1").select(F.col("lang").alias("__l"), F.col("n").alias("__m"), own.alias("__lang"))
    whole = limits.where("level = 3").select(own.alias("__all"))
    one = one.join(lang, one["__l"].eqNullSafe(lang["__l"]), "left").drop(lang["__l"])
    chosen = F.when(F.col("__n") >= FEW, F.col("__own")).when(F.col("__m") >= FEW, F.col("__lang"))
    by_group = one.select("__l", "__s", chosen.alias("__chosen"))
    joined = judged.join(by_group, judged["lang"].eqNullSafe(by_group["__l"]) & judged["source"].eqNullSafe(by_group["__s"]), "left").drop("__l", "__s")
    first = whole.collect()  # one row
    fallback = F.struct(*[F.lit(first[0]["__all"][c] if first else None).cast("double").alias(c) for c in fences])
    joined = joined.withColumn("__f", F.coalesce("__chosen", fallback)).select("*", *[F.col(f"__f.{c}").alias(f"__{c}") for c in fences])
    return joined.select(*counts.columns, kept_column().alias("kept"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stored(counted(spark.read.parquet(f"{sf_dir}/documents.parquet")), "counts")
    return verdicts(counts).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The sketches are exact on few rows (accuracy 10,000): the value of rank ceil(q n).
OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents
), p AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3
), k AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM p
), r AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM k WHERE c > 1) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM d LEFT JOIN r ON d.doc_id = r.doc_id
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols / greatest(n_words, 1) AS symbol, n_dup_lines / greatest(n_lines, 1) AS dup_line, n_repeat_words / greatest(n_words, 1) AS repeat, word_chars / greatest(n_words, 1) AS length FROM m
), x AS (
  SELECT lang, source, symbol, dup_line, repeat, length, 0 AS level FROM b WHERE NOT base_failed UNION ALL SELECT lang, NULL, symbol, dup_line, repeat, length, 1 FROM b WHERE NOT base_failed UNION ALL SELECT NULL, NULL, symbol, dup_line, repeat, length, 3 FROM b WHERE NOT base_failed
), q AS (
  SELECT level, lang, source, count(*) AS n, list_sort(list(symbol)) AS s, list_sort(list(dup_line)) AS u, list_sort(list(repeat)) AS e, list_sort(list(length)) AS g, CAST(ceil(0.25 * count(*)) AS INTEGER) AS lo, CAST(ceil(0.75 * count(*)) AS INTEGER) AS hi FROM x GROUP BY level, lang, source
), f AS (
  SELECT level, lang, source, n, s[hi] + 3 * greatest(s[hi] - s[lo], 0.05) AS fs, u[hi] + 3 * greatest(u[hi] - u[lo], 0.1) AS fu, e[hi] + 3 * greatest(e[hi] - e[lo], 0.1) AS fe, g[hi] + 3 * greatest(g[hi] - g[lo], 0.5) AS fg, g[lo] - 3 * greatest(g[hi] - g[lo], 0.5) AS fl FROM q
), j AS (
  SELECT b.*, CASE WHEN f0.n >= 30 THEN 0 WHEN f1.n >= 30 AND f0.n IS NOT NULL THEN 1 ELSE 3 END AS use, f0, f1, f3 FROM b
  LEFT JOIN f f0 ON f0.level = 0 AND f0.lang IS NOT DISTINCT FROM b.lang AND f0.source IS NOT DISTINCT FROM b.source LEFT JOIN f f1 ON f1.level = 1 AND f1.lang IS NOT DISTINCT FROM b.lang LEFT JOIN f f3 ON f3.level = 3
), v AS (
  SELECT *, CASE use WHEN 0 THEN f0 WHEN 1 THEN f1 ELSE f3 END AS z FROM j
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(symbol <= z.fs, true) AND coalesce(dup_line <= z.fu, true) AND coalesce(repeat <= z.fe, true) AND coalesce(length <= z.fg, true) AND coalesce(length >= z.fl, true) AS kept FROM v
"""
