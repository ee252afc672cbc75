"""Judge output to an integer score from 0 to 5, as one nested CASE of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The score patterns, in the order in which they apply.
EXACT = r"(?U)^\s*(?:\[([0-5])\]|([0-5]))\s*\z"
FINAL_LABELED = r"(?iuU)(?:final\s+(?:score|rating|answer)|最终(?:评分|得分|答案))\s*(?:is|为|[:=：])?\s*\[?\s*([0-5])\s*\]?"
LABELED = r"(?iuU)(?:final\s+)?(?:score|rating|answer|评分|得分)(?:\s*\(\s*0\s*[-–]\s*5\s*\))?\s*(?:is|为|[:=：])?\s*\[?\s*([0-5])\s*\]?"
RATIO = r"(?iuU)(?<!\d)([0-5])\s*(?:/|out\s+of)\s*5(?!\d)"
CONCLUDING = r"(?iuU)(?:therefore|thus|hence|so|最终|因此|故)\s*(?:(?:the\s+)?(?:score|rating|answer)\s*)?(?:is|为|[:=：])?\s*\[?\s*([0-5])\s*\]?"
LAST_LINE = r"(?U)(?:^|\n)\s*(?:\[([0-5])\]|([0-5]))\s*[.!。！]?\s*\z"
AMBIGUOUS = r"(?iuU)\b(?:or|either|could|maybe|between)\b|或|可能"
LEADING = r"(?U)^\s*(?:\[([0-5])\]|([0-5]))(?=\s|[.,;:!?)\-–—]|\z)"
ANY = r"(?U)(?<!\d)([0-5])(?!\d)"


def _all(raw: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(raw, F.lit(pattern), F.lit(1)))


def _either(raw: Column, pattern: str) -> Column:
    one, two = F.regexp_extract(raw, pattern, 1), F.regexp_extract(raw, pattern, 2)
    return F.when(one != "", one).otherwise(two)


def parsed_score(raw: str | Column) -> Column:
    """struct(score, method). The first rule that matches decides, even when its values differ and give no score."""
    r = F.col(raw) if isinstance(raw, str) else raw
    none = F.lit(None).cast("int")

    def result(score: Column, method: str | Column) -> Column:
        return F.struct(score.cast("int").alias("score"), (F.lit(method) if isinstance(method, str) else method).alias("method"))

    def unique(pattern: str, name: str) -> Column:
        found = _all(r, pattern)
        one = F.size(found) == 1
        return result(F.when(one, F.get(found, F.lit(0))), F.when(one, F.lit(name)).otherwise(F.lit(f"ambiguous_{name}")))

    cue = r.rlike(AMBIGUOUS)
    bracketed = F.regexp_extract(r, EXACT, 1) != ""
    rest = _all(r, ANY)
    return (
        F.when(r.rlike(EXACT), result(_either(r, EXACT), F.when(bracketed, F.lit("exact_bracketed")).otherwise(F.lit("exact_bare"))))
        .when(r.rlike(FINAL_LABELED), unique(FINAL_LABELED, "final_labeled"))
        .when(r.rlike(LABELED) & cue, result(none, "ambiguous_language"))
        .when(r.rlike(LABELED), unique(LABELED, "labeled"))
        .when(r.rlike(RATIO), unique(RATIO, "ratio"))
        .when(r.rlike(CONCLUDING), unique(CONCLUDING, "concluding"))
        .when(r.rlike(LAST_LINE), result(_either(r, LAST_LINE), "last_line"))
        .when(cue, result(none, "ambiguous_language"))
        .when(r.rlike(LEADING), result(_either(r, LEADING), "leading"))
        .when(F.size(rest) == 1, result(F.get(rest, F.lit(0)), "unique_numeric_candidate"))
        .otherwise(result(none, "ambiguous_or_missing"))
    )
