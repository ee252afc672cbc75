"""Objective visibility scores: words, position and both, credited to cited sources.

Everything is local to an answer's row (higher-order functions over its sentences), so scoring is one scan without a
shuffle; the manifest, one row a sample, is joined to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.citations import SPLITTER, eligible_words, official_citations, sentences
from .improvement import paired_improvement

METRICS = ("word", "position", "overall")
POLICIES = ("official_uniform", "zero")


def units_of(found: str | Column) -> Column:
    """What scored() takes as units, from an array of sentences (Boundaries.sentences, for one)."""
    return F.transform(found, lambda s: F.struct(eligible_words(s).cast("double").alias("words"), official_citations(s).alias("citations")))


def _contributions(units: Column, source_count: Column) -> Column:
    """One struct(source, word, position, overall) for each citation occurrence in range. 0 credits the last source; all occurrences, in range or not, share a sentence's credit."""
    n = F.size(units)

    def of(u: Column, i: Column) -> Column:
        decay = F.when(n == 1, F.lit(1.0)).otherwise(F.exp(-i / (n - 1)))
        k = F.size(u["citations"])
        made = F.transform(u["citations"], lambda c: F.struct(
            F.when(c == 0, source_count).otherwise(c).alias("source"), (u["words"] / k).alias("word"), (decay / k).alias("position"), (u["words"] * decay / k).alias("overall")))
        return F.filter(made, lambda x: (x["source"] >= 1) & (x["source"] <= source_count))

    return F.flatten(F.transform(units, of))


def scored(answers: DataFrame, answer: str = "answer", source_count: str = "candidate_document_count", units: Column | None = None) -> DataFrame:
    """answers with `scores`: for each metric the raw vector over sources, and by policy the normalised one with its fallback flag.

    units: array of struct(words, citations); by default from this package's sentence splitter."""
    n = F.col(source_count)
    df = answers.withColumn("units_", units if units is not None else units_of(sentences(answer)))
    df = df.withColumn("parts_", _contributions(F.col("units_"), n))
    sources = F.sequence(F.lit(1), n)

    def raw(metric: str) -> Column:
        return F.transform(sources, lambda s: F.aggregate(F.filter("parts_", lambda p: p["source"] == s), F.lit(0.0), lambda a, p: a + p[metric]))

    df = df.withColumn("raw_", F.struct(*[raw(m).alias(m) for m in METRICS]))
    df = df.withColumn("sum_", F.struct(*[F.aggregate(F.col(f"raw_.{m}"), F.lit(0.0), lambda a, x: a + x).alias(m) for m in METRICS]))

    def normal(metric: str, policy: str) -> Column:
        total = F.col(f"sum_.{metric}")
        empty = 1.0 / n if policy == "official_uniform" else F.lit(0.0)
        return F.transform(F.col(f"raw_.{metric}"), lambda x: F.when(total == 0, empty).otherwise(x / total))

    by_policy = [F.struct(*[normal(m, p).alias(m) for m in METRICS]).alias(p) for p in POLICIES]
    fallback = F.struct(*[(F.col(f"sum_.{m}") == 0).alias(m) for m in METRICS])
    numbers = F.flatten(F.transform("units_", lambda u: u["citations"]))
    diagnostics = F.struct(
        F.size("units_").alias("sentence_count"), F.size(numbers).alias("citation_count"), F.size("parts_").alias("in_range_count"), (F.size(numbers) - F.size("parts_")).alias("out_of_range_count"),
        F.size(F.filter(numbers, lambda c: c == 0)).alias("zero_citation_count"), F.size(F.filter("units_", lambda u: F.size(u["citations"]) == 0)).alias("uncited_sentence_count"), F.lit(SPLITTER).alias("splitter"),
    )
    return df.withColumn("scores", F.struct(F.col("raw_").alias("raw"), F.col("sum_").alias("raw_sum"), *by_policy, fallback.alias("fallback"), diagnostics.alias("diagnostics"))).drop("units_", "parts_", "raw_", "sum_")


def source_rows(scored_: DataFrame, keys: list[str], policy: str = "zero") -> DataFrame:
    """keys, source_index (from 1), word, position, overall of every source."""
    at = [F.col(f"scores.{policy}.{m}") for m in METRICS]
    return scored_.select(*keys, F.posexplode(F.arrays_zip(*[c.alias(m) for c, m in zip(at, METRICS)])).alias("i", "x")).select(*keys, (F.col("i") + 1).alias("source_index"), *[F.col(f"x.{m}").alias(m) for m in METRICS])


def target_payload(policy: str, target: str | Column) -> Column:
    """struct over metrics of the target's normalised value, that times 100, its raw value, the raw sum and the fallback flag; target counts from 0."""
    t = F.col(target) if isinstance(target, str) else target
    at = t + 1
    ok = (t >= 0) & (t < F.size(F.col(f"scores.{policy}.word")))

    def one(m: str) -> Column:
        value = F.element_at(F.col(f"scores.{policy}.{m}"), at)
        return F.struct(value.alias("normalized"), (value * 100).alias("percent"), F.element_at(F.col(f"scores.raw.{m}"), at).alias("raw"), F.col(f"scores.raw_sum.{m}").alias("raw_sum"), F.col(f"scores.fallback.{m}").alias("fallback"))

    return F.when(ok, F.struct(*[one(m).alias(m) for m in METRICS])).otherwise(F.raise_error(F.lit("target index out of range")).cast("struct<" + ",".join(f"{m}:struct<normalized:double,percent:double,raw:double,raw_sum:double,fallback:boolean>" for m in METRICS) + ">"))


def evaluated(answers: DataFrame, manifest: DataFrame) -> DataFrame:
    """Answers joined to the manifest and scored, with the target's payload by policy. Answers whose sample is unknown are left out; see unmatched()."""
    m = manifest.select("sample_id", "candidate_document_count", "target_document_index")
    df = scored(answers.join(m, "sample_id"))
    return df.withColumns({p: target_payload(p, "target_document_index") for p in POLICIES}).withColumn("target_citation_index", F.col("target_document_index") + 1)


def unmatched(answers: DataFrame, manifest: DataFrame) -> DataFrame:
    return answers.join(manifest.select("sample_id"), "sample_id", "left_anti")


def with_baseline(scores: DataFrame, original: str, value: Column, method: str = "prompt_id") -> DataFrame:
    """paired: the improvement of `value` over the original's for the same model, sample and seed; rows without one have none and stay out."""
    keys = ["model", "sample_id", "answer_seed"]
    v = scores.withColumn("value_", value)
    # duplicates of an original are told by duplicates(); the least of them counts here
    base = v.where(F.col(method) == original).groupBy(*keys).agg(F.min("value_").alias("base_"))
    return v.join(base, keys).withColumn("paired", paired_improvement(F.col("base_"), F.col("value_"))).drop("value_", "base_")
