"""Citation expressions on answer text, all built-in SQL expressions.

Answers are split into paragraphs (a blank line), sentences and words by `regex_v1`; a sentence ends after . ! or ? and
white space. Its numbers are for that splitter; another one can give `sentences` arrays to the operators that take them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLITTER = "regex_v1"

# The patterns that define citation forms. (?U) makes digits and word characters Unicode.
OFFICIAL = r"(?U)\[[^\w\s]*\d+[^\w\s]*\]"
SEPARATE = r"(?U)\[(\d+)\]"
NUMERIC = r"(?U)\[(\d+(?:\s*[-,]\s*\d+)*)\]"
NAMED_BRACKET = r"(?U)\[([^\]\d][^\]]*)\]"
SENTENCE_END = r"(?U)(?<=[.!?])\s+(?=[A-Z0-9\"'])"
V2_SENTENCE_END = r"(?U)(?<=[.!?。！？])\s+(?=[A-Z0-9\"'“‘])"
V2_FINAL = r"(?U)(?:\[\d+\])+\s*[.!?。！？](?:[\"'”’)]*)$"
V2_COMBINED = r"(?U)\[\s*\d+(?:\s*[-,]\s*\d+)+\s*\]"
V2_NAMED = r"(?iU)(?:\[\s*Source\s+\d+\s*\]|\(\s*Source\s+\d+\s*\)|\bSource\s+\d+\b)"
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is made once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


# Decimal digits of other scripts that answers use, and what they stand for.
OTHER_DIGITS = "０１２３４５６７８９٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"


#: What numbers of more than 18 digits count as: beyond any source, like all numbers that long.
BEYOND = 10**18


def whole_number(digits: str) -> int:
    return int(digits) if len(digits) <= 18 or len(digits := digits.lstrip("0")) <= 18 else BEYOND


def _number(c: Column) -> Column:
    """Digits as a long; longer ones as BEYOND, none as null."""
    digits = F.translate(c, OTHER_DIGITS, "0123456789" * 3)
    return F.coalesce(F.least(digits.try_cast("long"), F.lit(BEYOND)), F.when(digits.rlike(r"^0*\d{19,}$"), F.lit(BEYOND)))


def _index(c: Column) -> Column:
    """A number as a source's; those that no source can have are null."""
    return _number(c).try_cast("int")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def official_citations(text: str | Column) -> Column:
    """The first integer of every bracket that has digits and otherwise only marks."""
    found = F.regexp_extract_all(_col(text), F.lit(OFFICIAL), F.lit(0))
    return F.transform(found, lambda m: _index(F.regexp_extract(m, r"(?U)\d+", 0)))


def separate_citations(text: str | Column) -> Column:
    return F.transform(F.regexp_extract_all(_col(text), F.lit(SEPARATE), F.lit(1)), _index)


def cites(text: str | Column, k: str | Column) -> Column:
    """Whether [k] stands by itself; [3,4] and [(3)] don't count."""
    return F.coalesce(F.array_contains(separate_citations(text), _col(k)), F.lit(False))


def expanded_numbers(text: str | Column) -> Column:
    """All numbers of [1], [1, 2] and [1-3] forms, as longs; a range gives its two ends."""
    bodies = F.regexp_extract_all(_col(text), F.lit(NUMERIC), F.lit(1))
    parts = F.flatten(F.transform(bodies, lambda b: F.split(b, r"(?U)\s*[,\-]\s*")))
    return F.transform(parts, _number)


def sentences(text: str | Column) -> Column:
    """Array of sentences over paragraphs split at exactly two newlines; empty ones are left out."""
    parts = F.flatten(F.transform(F.split(_col(text), "\n\n"), lambda p: F.split(p, r"(?U)(?<=[.!?])\s+")))
    return F.filter(F.transform(parts, _strip), lambda s: s != "")


def words(sentence: str | Column) -> Column:
    return F.regexp_extract_all(_col(sentence), F.lit(r"[A-Za-z0-9]+"), F.lit(0))


def eligible_words(sentence: str | Column) -> Column:
    """How many words have more than two characters."""
    return F.size(F.filter(words(sentence), lambda w: F.length(w) > 2))


def parsed(text: str | Column) -> Column:
    """Array of struct(text, tokens, citations), one for each sentence."""
    return F.transform(sentences(text), lambda s: F.struct(s.alias("text"), words(s).alias("tokens"), official_citations(s).alias("citations")))


def _distinct_out_of_range(numbers: Column, n: Column) -> Column:
    return F.sort_array(F.array_distinct(F.filter(numbers, lambda v: (v < 1) | (v > n))))


def basic_diagnostics(answer: str | Column, source_count: str | Column) -> Column:
    """The basic view of an answer's citations; the text is never edited."""
    a, n = _col(answer), _col(source_count)
    numbers = expanded_numbers(a)
    named = F.filter(F.transform(F.regexp_extract_all(a, F.lit(NAMED_BRACKET), F.lit(1)), _strip), lambda v: v != "")
    invalid = _distinct_out_of_range(numbers, n)
    parts = F.filter(F.transform(F.split(a, SENTENCE_END), _strip), lambda s: s != "")
    bare = F.size(F.filter(parts, lambda s: ~s.rlike(NUMERIC)))
    return F.struct(
        n.alias("source_count"), numbers.alias("numeric_citations"), named.alias("named_bracket_citations"), F.size(numbers).alias("numeric_citation_count"),
        (F.size(numbers) > 0).alias("has_numeric_citation"), (F.size(named) > 0).alias("has_named_bracket_citation"), invalid.alias("invalid_numeric_citations"),
        bare.alias("citationless_sentence_count"), ((F.size(numbers) > 0) & (F.size(invalid) == 0) & (F.size(named) == 0) & (bare == 0)).alias("citation_format_scorable"),
    )


def strict_units(answer: str | Column) -> Column:
    """Sentence units of the strict views: by line, after each CJK full stop, then at sentence ends."""
    lines = F.filter(F.transform(F.split(_col(answer), LINE_BREAKS), _strip), lambda x: x != "")
    parts = F.flatten(F.transform(lines, lambda x: F.split(x, r"(?<=[。！？])")))
    units = F.flatten(F.transform(parts, lambda x: F.split(_strip(x), V2_SENTENCE_END)))
    return F.filter(F.transform(units, _strip), lambda x: x != "")


def strict_diagnostics(answer: str | Column, source_count: str | Column) -> Column:
    """Version 2: every unit ends in separate in-range citations before its final mark; no combined or named forms."""
    a, n = _col(answer), _col(source_count)

    def of(x: Column) -> Column:
        good, bad = F.filter(x["units"], lambda u: u.rlike(V2_FINAL)), F.filter(x["units"], lambda u: ~u.rlike(V2_FINAL))
        return let(F.struct(F.size(x["units"]).alias("all"), F.size(good).alias("good"), bad.alias("bad")), lambda y: F.struct(
            n.alias("source_count"), y["all"].alias("sentence_count"), y["good"].alias("compliant_sentence_count"), F.size(y["bad"]).alias("noncompliant_sentence_count"),
            F.slice(y["bad"], 1, 5).alias("noncompliant_sentence_first_5"), x["invalid"].alias("invalid_numeric_citations"), x["named"].alias("named_source_citations"), x["combined"].alias("combined_or_ranged_citations"),
            ((y["all"] > 0) & (F.size(y["bad"]) == 0) & (F.size(x["invalid"]) == 0) & (F.size(x["named"]) == 0) & (F.size(x["combined"]) == 0)).alias("contract_compliant")))

    named, combined = F.regexp_extract_all(a, F.lit(V2_NAMED), F.lit(0)), F.regexp_extract_all(a, F.lit(V2_COMBINED), F.lit(0))
    return let(F.struct(strict_units(a).alias("units"), _distinct_out_of_range(expanded_numbers(a), n).alias("invalid"), named.alias("named"), combined.alias("combined")), of)
