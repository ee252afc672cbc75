"""Text audits: repeated units, identity patterns, capped outputs, failure kinds, and registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The identity patterns, in the common subset of regular expression dialects.
IDENTITY = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "code_host": r"(?:https?://)?(?:www\.)?(?:github|gitlab|bitbucket)\.(?:com|org)/[A-Za-z0-9_.-]+",
    "absolute_path": r"(?:/home/|/Users/|C:\\Users\\)[A-Za-z0-9_.-]*",
    "acknowledgement": r"(?i:acknowledg(?:e)?ments?)",
}


def repetition(df: DataFrame, key: str, text: str, least: int = 80) -> DataFrame:
    """Per text: paragraphs, additional occurrences of identical long paragraphs, the most occurrences of one long paragraph or line, and that unit (the largest text among ties)."""
    t = F.col(text)
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    paragraphs = F.filter(F.transform(F.split(t, r"\n\s*\n"), strip), lambda x: x != "")
    lines = F.transform(F.split(t, r"\r\n|[\n\r]"), strip)
    units = F.concat(F.transform(F.filter(paragraphs, lambda x: F.length(x) >= least), lambda x: F.struct(F.lit("p").alias("kind"), x.alias("unit"))), F.transform(F.filter(lines, lambda x: F.length(x) >= least), lambda x: F.struct(F.lit("l").alias("kind"), x.alias("unit"))))
    base = df.select(key, F.size(paragraphs).alias("paragraph_count"), units.alias("u"))
    counts = base.select(key, F.explode("u").alias("x")).groupBy(key, "x.kind", "x.unit").agg(F.count("*").alias("n"))
    per = counts.groupBy(key).agg(F.sum(F.when(F.col("kind") == "p", F.col("n") - 1).otherwise(0)).alias("more"), F.max(F.when(F.col("n") >= 2, F.struct("n", "unit"))).alias("top"))
    return base.drop("u").join(per, key, "left").select(key, "paragraph_count", F.coalesce("more", F.lit(0)).alias("duplicate_long_paragraphs"), F.coalesce("top.n", F.lit(0)).alias("max_identical_units"), F.substring(F.coalesce("top.unit", F.lit("")), 1, 600).alias("repeated_example"))


def identity_matches(df: DataFrame, key: str, text: str, patterns: dict[str, str] = IDENTITY) -> DataFrame:
    """key, kind, found, one row a match."""
    found = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)).alias("m")) for k, p in patterns.items()]))
    return df.select(key, found.alias("x")).select(key, "x.kind", F.explode("x.m").alias("found"))


def without_prefixes(df: DataFrame, path: str, prefixes: tuple[str, ...]) -> DataFrame:
    return df.where(~F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.col(path).startswith(p))) if prefixes else df


def failure_kind(error: str | Column) -> Column:
    e = F.lower(F.col(error) if isinstance(error, str) else error)
    return F.when(e.contains("json"), "invalid_json").when(e.contains("context") | e.contains("budget"), "context_budget").when(e.contains("empty") | e.contains("blank"), "empty_output").when(e.contains("schema") | e.contains("field"), "schema").otherwise("other")


def capped_profile(df: DataFrame, tokens: Column, cap: Column, text: Column) -> DataFrame:
    """Whether the output reached its cap, and whether it ends like a finished text."""
    ends = F.rtrim(text).rlike("[.!?。！？][\"'”’)]*$")
    return df.withColumns({"cap_hit": tokens >= cap, "native_stop": F.rtrim(text).endswith("<|user|>"), "sentence_final": ends})


def last_stage(stage_records: str) -> Column:
    return F.element_at(stage_records, -1)


def upserted(registry: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The registry with rows of `new` replaced, value by value where the new one has one, or added."""
    columns = [c for c in registry.columns if c != key]
    r, n = registry.select(key, F.struct(*columns).alias("old_")), new.select(key, F.struct(*[c for c in new.columns if c != key]).alias("new_"))
    have = set(new.columns)
    return r.join(n, key, "full").select(key, *[F.coalesce(*([F.col(f"new_.{c}")] if c in have else []), F.col(f"old_.{c}")).alias(c) for c in columns])


def missing_fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, missing: required fields that are null or blank."""
    absent = F.array_compact(F.array(*[F.when(F.col(f).isNull() | (F.trim(F.col(f).cast("string")) == ""), F.lit(f)) for f in fields]))
    return df.select(key, absent.alias("missing")).where(F.size("missing") > 0)


def last_rows(df: DataFrame, order: str, k: int = 3) -> DataFrame:
    return df.orderBy(F.desc(order)).limit(k)


def aliased(name: str | Column, aliases: dict[str, str]) -> Column:
    """The canonical name of an alias, by lower case without blanks around; unknown ones raise."""
    n = F.lower(F.trim(F.col(name) if isinstance(name, str) else name))
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    found = F.try_element_at(table, n)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unknown model "), F.coalesce(n, F.lit("null")))).cast("string"))


def ranked_top(df: DataFrame, by: list[str], order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where("rank = 1")
