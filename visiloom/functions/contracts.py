"""The optional (v4) and the strict (v6) citation contracts, as diagnostics of an answer that is never edited.

Both look at each sentence unit once (`Unit`) and then sum up. An Arrow-batched UDF, as positions within a unit matter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import small_batches
from . import units
from .citations import basic_diagnostics, strict_diagnostics, whole_number

# The patterns of the two contracts.
V2_END = re.compile(r"(?<=[.!?。！？])\s+(?=[A-Z0-9\"'“‘])")
NAMED = re.compile(r"(?:\[\s*Source\s+\d+\s*\]|\(\s*Source\s+\d+\s*\)|\bSource\s+\d+\b)", re.I)
COMBINED = re.compile(r"\[\s*\d+(?:\s*[-,]\s*\d+)+\s*\]")
TOKEN = re.compile(r"\[(\d+)\]")
LIKE = re.compile(r"(?:\[\s*(?:Source\s+)?\d[^\]\n]*\]|\(\s*Source\s+\d+\s*\)|\bSource\s+\d+\b)", re.I)
V4_FINAL = re.compile(r"((?:\[\d+\])+)\s*[.!?。！？](?:[\"'”’)]*)$")
V6_FINAL = re.compile(r"((?:\[\d+\][ \t]*)+)[.!?。！？](?:[\"'”’)]*)$")
HEADING = re.compile(r"(?im)^\s*(?:#{1,6}\s*)?(?:references|sources|bibliography|参考文献|资料来源|来源)\s*:?\s*$")
MAPPING = re.compile(r"(?im)^\s*(?:[-*+]\s*)?(?:Source|来源)\s+\d+\s*:\s*\S+")
GROUP = re.compile(r"\[[^\[\]\n]*\]")
MARKDOWN_HEADING = re.compile(r"^\s*#{1,6}\s+")
TABLE_ROW = re.compile(r"^\s*(?:[^|\n]*\|){2,}")
V6_HEADING = re.compile(r"(?im)^\s*(?:#{1,6}\s*)?(?:references|sources|bibliography|参考文献|资料来源|来源)(?:\s*(?:\[\d+\])+)?\s*[:：]?\s*[.!?。！？]?\s*$")
LEXICAL = re.compile(r"[A-Za-z0-9㐀-鿿]")
EMPHASIS = re.compile(r"(?<!\\)(\*{1,3}|_{1,3})")


@dataclass
class Unit:
    text: str
    n: int
    final: re.Pattern

    def __post_init__(self) -> None:
        self.tokens = list(TOKEN.finditer(self.text))
        self.numbers = [whole_number(t[1]) for t in self.tokens]
        block = self.final.search(self.text)
        # all tokens lie in the block before the final mark, and there are some, all in range
        self.at_end = bool(block and self.tokens) and all(block.start(1) <= t.start() and t.end() <= block.end(1) for t in self.tokens)
        self.in_range = bool(self.numbers) and all(1 <= k <= self.n for k in self.numbers)

    @property
    def like(self) -> int:
        return len(LIKE.findall(self.text))

    def optional_ok(self) -> bool:
        return self.at_end and self.in_range and self.like == len(self.tokens) and not NAMED.search(self.text) and not COMBINED.search(self.text)

    @property
    def noncanonical(self) -> list[str]:
        return [t[0] for t, k in zip(self.tokens, self.numbers) if t[0] != f"[{k}]"]

    @property
    def stray_groups(self) -> list[str]:
        spans = {t.span() for t in self.tokens}
        return [g[0] for g in GROUP.finditer(self.text) if g.span() not in spans]

    def strict_ok(self) -> bool:
        bare = GROUP.sub("", self.text)
        clean = not self.noncanonical and not self.stray_groups and not set("[]") & set(bare)
        return self.at_end and self.in_range and clean and bool(LEXICAL.search(bare)) and not MARKDOWN_HEADING.search(self.text) and not TABLE_ROW.search(self.text)


def lines(answer: str):
    for line in answer.splitlines():
        for part in re.split(r"(?<=[。！？])", line.strip()):
            if part.strip():
                yield part.strip()


def plain_units(answer: str) -> list[str]:
    return [u.strip() for part in lines(answer) for u in V2_END.split(part) if u.strip()]


def _open(text: str) -> list[str]:
    """Emphasis marks that are open at the end of the text, longest first."""
    runs = EMPHASIS.findall(text)
    return sorted((m for m in dict.fromkeys(runs) if runs.count(m) % 2), key=len, reverse=True)


def joined_units(answer: str, split=units.sentences) -> list[str]:
    """Sentences by line; one that closes an emphasis which the one before left open belongs to it."""
    out: list[str] = []
    for part in lines(answer):
        for s in filter(None, map(str.strip, split(part))):
            closing = next((m for m in _open(out[-1]) if m in EMPHASIS.findall(s)), None) if out else None
            if closing is None:
                out.append(s)
            else:
                out[-1] += s if s.startswith((closing, ":", ";", ",")) else " " + s
    return out


def _invalid(answer: str, n: int) -> tuple[list[int], list[int]]:
    numbers = [whole_number(k) for k in TOKEN.findall(answer)]
    return numbers, sorted({k for k in numbers if not 1 <= k <= n})


def optional_contract(answer: str, n: int) -> dict:
    found = [Unit(u, n, V4_FINAL) for u in plain_units(answer)]
    cited = [u for u in found if u.like]
    bad = [u.text for u in cited if not u.optional_ok()]
    numbers, invalid = _invalid(answer, n)
    named, combined = NAMED.findall(answer), COMBINED.findall(answer)
    heading, mapping = bool(HEADING.search(answer)), bool(MAPPING.search(answer))
    return {
        "source_count": n, "sentence_count": len(found), "citation_bearing_sentence_count": len(cited), "uncited_sentence_count": len(found) - len(cited), "compliant_citation_bearing_sentence_count": len(cited) - len(bad),
        "malformed_citation_sentence_count": len(bad), "malformed_citation_sentence_first_5": bad[:5], "numeric_citations": numbers, "invalid_numeric_citations": invalid, "named_source_citations": named, "combined_or_ranged_citations": combined,
        "separate_reference_section_detected": heading, "restated_source_mapping_detected": mapping, "citationless_answer": bool(found) and not cited, "has_in_range_numeric_citation": any(1 <= k <= n for k in numbers),
        "contract_compliant": bool(found) and not (bad or invalid or named or combined or heading or mapping),
    }


def strict_contract(answer: str, n: int) -> dict:
    found = [Unit(u, n, V6_FINAL) for u in joined_units(answer)]
    bad, uncited = [u.text for u in found if not u.strict_ok()], [u.text for u in found if not u.tokens]
    numbers, invalid = _invalid(answer, n)
    odd, groups = sorted({t for u in found for t in u.noncanonical}), sorted({g for u in found for g in u.stray_groups})
    heading, mapping = bool(HEADING.search(answer) or V6_HEADING.search(answer)), bool(MAPPING.search(answer))
    return {
        "source_count": n, "sentence_count": len(found), "compliant_sentence_count": len(found) - len(bad), "noncompliant_sentence_count": len(bad), "noncompliant_sentence_first_5": bad[:5], "uncited_sentence_count": len(uncited), "uncited_sentence_first_5": uncited[:5],
        "numeric_citations": numbers, "invalid_numeric_citations": invalid, "noncanonical_numeric_citations": odd, "malformed_bracket_groups": groups, "separate_reference_section_detected": heading, "restated_source_mapping_detected": mapping,
        "citationless_answer": bool(found) and not numbers, "contract_compliant": bool(found) and not (bad or invalid or odd or groups or heading or mapping),
    }



def _schema(sample: dict) -> str:
    def kind(name: str, v) -> str:
        return "boolean" if isinstance(v, bool) else "int" if isinstance(v, int) else "array<bigint>" if name in ("numeric_citations", "invalid_numeric_citations") else "array<string>"

    return "struct<" + ",".join(f"{k}:{kind(k, v)}" for k, v in sample.items()) + ">"


V4_SCHEMA, V6_SCHEMA = _schema(optional_contract("", 1)), _schema(strict_contract("", 1))


def _column(of, schema: str, answer: str | Column, source_count: str | Column) -> Column:
    names = [p.split(":")[0] for p in schema[7:-1].split(",")]

    @F.pandas_udf(schema)
    def run(texts: pd.Series, counts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([of(t, int(n)) if t is not None and n == n else dict.fromkeys(names) for t, n in zip(texts, counts)], columns=names, dtype=object)

    small_batches(SparkSession.active())
    return run(answer, source_count)


def optional_diagnostics(answer: str | Column, source_count: str | Column) -> Column:
    return _column(optional_contract, V4_SCHEMA, answer, source_count)


def exact_diagnostics(answer: str | Column, source_count: str | Column) -> Column:
    return _column(strict_contract, V6_SCHEMA, answer, source_count)


def diagnostics(answer: str | Column, source_count: str | Column) -> Column:
    """All four views."""
    return F.struct(basic_diagnostics(answer, source_count).alias("basic"), strict_diagnostics(answer, source_count).alias("v2"), optional_diagnostics(answer, source_count).alias("v4"), exact_diagnostics(answer, source_count).alias("v6"))
