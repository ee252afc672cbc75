"""Roll-ups of citation diagnostics, their recomputation beside stored ones, and checked score maps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.citations import strict_diagnostics
from ..functions.contracts import optional_diagnostics
from .checks import required

VIEWS = ("basic", "v2", "v4", "v6")


def rollup(df: DataFrame, d: str = "d", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts over the four views in struct d; a view that is null counts nowhere."""
    c = lambda name: F.col(f"{d}.{name}")
    flags = {
        "numeric_citation": c("basic.has_numeric_citation"), "named_bracket": c("basic.has_named_bracket_citation"), "invalid_citation": F.size(c("basic.invalid_numeric_citations")) > 0, "format_scorable": c("basic.citation_format_scorable"),
        "citationless_sentence": c("basic.citationless_sentence_count") > 0, "named_source": F.size(c("v4.named_source_citations")) > 0, "combined_or_ranged": F.size(c("v4.combined_or_ranged_citations")) > 0, "citationless_answer": c("v4.citationless_answer"),
        "in_range_citation": c("v4.has_in_range_numeric_citation"), "reference_section": c("v6.separate_reference_section_detected"), "restated_mapping": c("v6.restated_source_mapping_detected"), "noncanonical": F.size(c("v6.noncanonical_numeric_citations")) > 0, "malformed_bracket": F.size(c("v6.malformed_bracket_groups")) > 0,
    }
    ok = [a for v in VIEWS[1:] for a in (F.count_if(c(f"{v}.contract_compliant")).alias(f"{v}_ok"), F.count_if(~c(f"{v}.contract_compliant")).alias(f"{v}_fail"))]
    return df.groupBy(*by).agg(F.count("*").alias("answers"), *[F.count_if(x).alias(n) for n, x in flags.items()], *ok)


def consistent_count(*counts: str | Column) -> Column:
    """The one value that all non-null counts have; none, or several, raise."""
    cs = [F.col(x) if isinstance(x, str) else x for x in counts]
    found = F.array_distinct(F.array_compact(F.array(*cs)))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("source counts differ: "), F.to_json(found))).cast("int"))


def recomputed(df: DataFrame, answer: str = "answer", count: str = "source_count", v2: str = "stored_v2", v4: str = "stored_v4") -> DataFrame:
    """df with v2 and v4 compliance anew, and whether each differs from the stored flag; a stored one may be null."""
    new = df.withColumn("v2", strict_diagnostics(answer, count)["contract_compliant"]).withColumn("v4", optional_diagnostics(answer, count)["contract_compliant"])
    return new.withColumn("v2_changed", ~F.col("v2").eqNullSafe(F.col(v2))).withColumn("v4_changed", ~F.col("v4").eqNullSafe(F.col(v4)))


def change_summary(df: DataFrame, v2: str = "stored_v2", v4: str = "stored_v4") -> DataFrame:
    """One row over recomputed(): rows, compliant before and after, and how many changed."""
    return df.agg(F.count("*").alias("n"), F.count_if(v2).alias("v2_before"), F.count_if("v2").alias("v2_after"), F.count_if("v2_changed").alias("v2_changed"), F.count_if(v4).alias("v4_before"), F.count_if("v4").alias("v4_after"), F.count_if("v4_changed").alias("v4_changed"))


def score_map(df: DataFrame, keys: list[str], value: Column, low: float = -math.inf, high: float = math.inf, usable: Column | None = None, strict: bool = True) -> DataFrame:
    """keys, benchmark, score of nested score rows; a key twice, a score that is null, not finite or out of range, or a row that isn't usable raises."""
    out = df.select(*keys, "benchmark", value.alias("score"), (F.lit(True) if usable is None else usable).alias("usable"))
    if strict:
        bad = F.col("score").isNull() | F.isnan("score") | ~F.col("score").between(low, high) | ~F.coalesce("usable", F.lit(False))
        required(out.where(bad), "scores that can't be used")
        required(out.groupBy(*keys).count().where("count > 1"), "score keys repeat")
    return out.drop("usable")


def token_sums(trials: DataFrame, by: str = "subjective_score_action") -> DataFrame:
    return trials.groupBy(by).agg(F.count("*").alias("n"), *[F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in ("input_tokens", "output_tokens")])
