"""Prompt rendering and text extraction in built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACEHOLDER = r"\{\{[A-Z][A-Z0-9_]*\}\}"
# The answer prompt protocols. Only the last has its text here; the others can be given as parameters.
PROTOCOLS = ("benchmark_official_v1", *(f"unified_answer_v{i}" for i in range(1, 10)))


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def source_blocks(documents: str | Column) -> Column:
    """Source 1:\\n<text>, and so on, with a blank line between."""
    return F.array_join(F.transform(_col(documents), lambda d, i: F.concat(F.lit("Source "), (i + 1).cast("string"), F.lit(":\n"), d)), "\n\n")


def source_labels(documents: str | Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), F.size(_col(documents))), lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("]"))), ", ")


def messages(user: Column, system: Column | None = None) -> Column:
    """Array of struct(role, content)."""
    turns = [("system", system)] if system is not None else []
    return F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in [*turns, ("user", user)]])


def answer_messages(query: str | Column, documents: str | Column, template: str, system: str | None = None) -> Column:
    """The template's {query}, {sources} and {labels} filled in; a query without text raises."""
    q = _col(query)
    checked = F.when(F.trim(q) != "", q).otherwise(F.raise_error(F.lit("the query is empty")).cast("string"))
    return messages(filled(template, query=checked, sources=source_blocks(documents), labels=source_labels(documents)), None if system is None else F.lit(system))


def filled(template: str, **values: Column) -> Column:
    """{name} parts of a template replaced at once: a value that has braces isn't filled in again."""
    parts = re.split(r"\{(" + "|".join(map(re.escape, values)) + r")\}", template)
    return F.concat(*[F.lit(p) if i % 2 == 0 else values[p] for i, p in enumerate(parts)])


def by_protocol(protocol: str | Column, templates: dict[str, Column]) -> Column:
    """The rendering of the row's protocol; a known one without a template, and an unknown one, raise."""
    p = _col(protocol)
    out = None
    for name, rendered in templates.items():
        out = F.when(p == name, rendered) if out is None else out.when(p == name, rendered)
    kind = F.when(p.isin(*PROTOCOLS), F.lit("no template for protocol ")).otherwise(F.lit("unknown protocol "))
    failed = F.raise_error(F.concat(kind, F.coalesce(p, F.lit("null"))))
    return failed.cast("string") if out is None else out.otherwise(failed.cast("string"))


def rendered(template: str, **values: str | Column) -> Column:
    """{{NAME}} parts, each exactly once, filled with text that isn't blank; anything else in double braces in the template is an error."""
    names = re.findall(r"\{\{([A-Z][A-Z0-9_]*)\}\}", template)
    if sorted(names) != sorted(values):
        raise ValueError(f"the template has {sorted(names)}, not {sorted(values)}")
    checked = {n: F.when(F.trim(_col(v)) != "", _col(v)).otherwise(F.raise_error(F.lit(f"{n} is blank")).cast("string")) for n, v in values.items()}
    parts = re.split(r"\{\{([A-Z][A-Z0-9_]*)\}\}", template)
    return F.concat(*[F.lit(p) if i % 2 == 0 else checked[p] for i, p in enumerate(parts)])


def retargeted(template: str, query: str | Column, answer: str | Column, target: str | Column) -> Column:
    """A judge prompt written for Source [1], for the target's citation index."""
    k = F.concat(F.lit("Source ["), _col(target).cast("string"), F.lit("]"))
    marked = template.replace("Source [1]", "{target_}")
    return filled(marked, target_=k, query=_col(query), answer=_col(answer))


def last_fenced_block(text: str | Column) -> Column:
    """The content of the last fenced block, else the whole text, without white space around."""
    t = _col(text)
    blocks = F.regexp_extract_all(t, F.lit(r"(?s)```[A-Za-z]*[ \t]*\n(.*?)\n?```"), F.lit(1))
    return F.regexp_replace(F.when(F.size(blocks) > 0, F.get(blocks, F.size(blocks) - 1)).otherwise(t), r"^\s+|\s+$", "")


def without_label(text: str | Column, labels: tuple[str, ...]) -> Column:
    return F.regexp_replace(_col(text), r"(?i)^\s*(?:" + "|".join(map(re.escape, labels)) + r")\s*:\s*", "")
