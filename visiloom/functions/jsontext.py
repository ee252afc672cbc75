"""JSON in model output: strict parsing, shape checks and format-only repair."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FENCE = r"(?s)^\s*```json\s*\n(.*?)\n```\s*$"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strict_json(text: str | Column) -> Column:
    """struct(payload, normalized): the text as JSON, or one json fence around it (normalized); payload is null for anything else."""
    t = _col(text)
    inner = F.regexp_extract(t, FENCE, 1)
    fenced = t.rlike(FENCE) & ~inner.contains("```")
    body = F.when(fenced, inner).otherwise(t)
    return F.struct(F.when(F.try_parse_json(body).isNotNull(), body).alias("payload"), fenced.alias("normalized"))


_QUERIES = "struct<queries:array<struct<query:string,probability:double>>>"
_SUGGESTIONS = "struct<suggestions:array<struct<excerpt:string,suggestion:string,necessity:double>>>"


def query_diagnosis(text: str | Column, expected: int) -> Column:
    """What is wrong with a list of queries: parses, is an object, how many, how many distinct, blank ones, probabilities outside 0 to 100, and the verdict."""
    s = strict_json(text)
    q = F.from_json(s["payload"], _QUERIES)["queries"]
    names = F.transform(q, lambda x: F.trim(x["query"]))
    n = F.coalesce(F.size(q), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    distinct = F.coalesce(F.size(F.array_distinct(F.array_compact(names))), F.lit(0))
    blank = F.coalesce(F.size(F.filter(names, lambda x: x.isNull() | (x == ""))), F.lit(0))
    off = F.coalesce(F.size(F.filter(q, lambda x: x["probability"].isNull() | ~x["probability"].between(0, 100))), F.lit(0))
    parses = s["payload"].isNotNull()
    is_object = F.coalesce(s["payload"].rlike(r"^\s*\{"), F.lit(False))
    ok = parses & is_object & (n == expected) & (distinct == n) & (blank == 0) & (off == 0)
    return F.struct(parses.alias("parses"), F.coalesce(s["normalized"], F.lit(False)).alias("normalized"), is_object.alias("is_object"), n.cast("int").alias("query_count"), F.greatest(distinct, F.lit(0)).alias("distinct_count"), F.greatest(blank, F.lit(0)).alias("blank_count"), F.greatest(off, F.lit(0)).alias("probability_out_of_range"), ok.alias("valid"))


def suggestions(text: str | Column, most: int) -> Column:
    """struct(items, valid): at most `most`, none with a blank part, necessity from 0 to 100."""
    s = strict_json(text)
    items = F.from_json(s["payload"], _SUGGESTIONS)["suggestions"]
    bad = F.exists(items, lambda x: x["excerpt"].isNull() | (F.trim(x["excerpt"]) == "") | x["suggestion"].isNull() | (F.trim(x["suggestion"]) == "") | x["necessity"].isNull() | ~x["necessity"].between(0, 100))
    return F.struct(items.alias("items"), F.coalesce((F.size(items) <= most) & ~bad, F.lit(False)).alias("valid"))


def necessary(items: Column, least: float = 60) -> Column:
    return F.filter(items, lambda x: x["necessity"] >= least)


class AmbiguousQuotes(ValueError):
    pass


_PROPERTY = re.compile(r'(\s*"[^"\\]+"\s*:\s*")(.*)("\s*,?\s*)')
_SYNTAX = re.compile(r'"\s*[,}:]')


def _escaped(line: str) -> tuple[str, int]:
    """A line that is one property with a string value, its inner quotes escaped."""
    m = _PROPERTY.fullmatch(line)
    if not m:
        return line, 0
    try:
        json.loads("{" + line.strip().removesuffix(",") + "}")
        return line, 0
    except json.JSONDecodeError:
        pass
    if _SYNTAX.search(m[2]):
        raise AmbiguousQuotes("a quote in the value looks like syntax")
    fixed, n = re.subn(r'((?:[^"\\]|\\.)*?)"', r'\1\\"', m[2])
    return m[1] + fixed + m[3], n


def repair_format(text: str) -> tuple[object, list[str]]:
    """The value and what was done to read it. Nothing is added but backslashes; what isn't JSON after that raises ValueError."""
    done, body = [], text.strip()
    if body.endswith("<|user|>"):
        body = body.removesuffix("<|user|>").rstrip()
        done.append("remove_terminal_user_token")
    fence = re.fullmatch(r"```json\s*\n(.*?)\n```", body, re.S)
    if fence:
        body = fence[1]
        done.append("remove_single_json_fence")
    try:
        return json.loads(body), done
    except json.JSONDecodeError:
        lines = [_escaped(x) for x in body.splitlines(keepends=True)]
        done += [f"escape_internal_double_quotes:{n}" for _, n in lines if n]
        return json.loads("".join(x for x, _ in lines)), done


@F.pandas_udf(T.StructType([T.StructField("payload", T.StringType()), T.StructField("actions", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())]))
def repaired_json(texts: pd.Series) -> pd.DataFrame:
    def one(t: str | None):
        if t is None:
            return None, None, None
        try:
            value, done = repair_format(t)
            return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")), done, None
        except ValueError as e:
            return None, None, type(e).__name__

    return pd.DataFrame([one(t) for t in texts], columns=["payload", "actions", "error"], dtype=object)


def input_hash(benchmark: str, domain: str, query: str, documents: str) -> Column:
    """SHA-256 of the condition as JSON with sorted keys and the default separators."""

    @F.pandas_udf("string")
    def run(b: pd.Series, d: pd.Series, q: pd.Series, docs: pd.Series) -> pd.Series:
        import hashlib

        return pd.Series([hashlib.sha256(json.dumps({"benchmark": x, "documents": list(w), "domain": y, "query": z}, ensure_ascii=False, sort_keys=True).encode()).hexdigest() for x, y, z, w in zip(b, d, q, docs)], dtype=object)

    return run(benchmark, domain, query, documents)
