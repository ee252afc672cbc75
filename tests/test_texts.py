"""Golden cases of citation parsing, canonical copies, contracts, repairs, score texts and JSON."""

import math
import random

import pytest
from pyspark.sql import functions as F

from visiloom.functions import citations
from visiloom.functions.canonical import attach_detached, canonical_column, tails_removed
from visiloom.functions.contracts import diagnostics, optional_contract, strict_contract
from visiloom.functions.jsontext import query_diagnosis, repair_format, repaired_json, strict_json, suggestions
from visiloom.functions.scores import parsed_score
from visiloom.operators import objective


def column(spark, values, of, schema="v string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, " + schema)
    return [r[0] for r in rows.orderBy("i").select(of("v")).collect()]


def test_official_citations(spark):
    got = column(spark, ["Separate [1][2], decorated [(3)], combined [4,5], named [ref].", "[é1] [１] [(3)]", "none"], citations.official_citations)
    assert got == [[1, 2, 3], [1, 3], []]


def test_separate_citations(spark):
    texts = ["Supported claim [3].", "[1][3].", "[1][2].", "[3,4]", "[(3)]", None]
    rows = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "i int, t string, k int")
    assert [r[0] for r in rows.orderBy("i").select(citations.cites("t", "k")).collect()] == [True, True, False, False, False, False]


def score(spark, text, n):
    df = objective.scored(spark.createDataFrame([(text, n)], "answer string, n int"), source_count="n")
    return df.first().scores


def test_objective_goldens(spark):
    s = score(spark, "Alpha evidence supports claim [1][2]. Beta evidence extends context [2].", 2)
    e = math.exp(-1)
    assert s.raw.word == [2.0, 6.0]
    assert s.official_uniform.word == [0.25, 0.75]
    assert s.zero.position == pytest.approx([0.5 / (1 + e), (0.5 + e) / (1 + e)], abs=1e-12)
    assert s.zero.overall == pytest.approx([2 / (4 + 4 * e), (2 + 4 * e) / (4 + 4 * e)], abs=1e-12)
    s = score(spark, "No citation appears.", 4)
    assert s.official_uniform.word == [0.25] * 4 and s.zero.word == [0.0] * 4 and s.fallback.word
    s = score(spark, "Alpha evidence supports claim [1][99].", 2)
    assert s.raw.word == [2.0, 0.0] and s.zero.word == [1.0, 0.0] and (s.diagnostics.citation_count, s.diagnostics.out_of_range_count) == (2, 1)
    s = score(spark, "Alpha evidence supports claim [0].", 3)
    assert s.raw.word == [0.0, 0.0, 4.0] and s.diagnostics.zero_citation_count == 1


def test_target_payload(spark):
    df = spark.createDataFrame([("Alpha evidence supports claim [3].", 3, 2)], "answer string, n int, t int")
    p = objective.scored(df, source_count="n").select(objective.target_payload("zero", "t").alias("p")).first().p
    assert (p.word.normalized, p.word.percent) == (1.0, 100.0)
    with pytest.raises(Exception, match="out of range"):
        objective.scored(df.withColumn("t", F.lit(3)), source_count="n").select(objective.target_payload("zero", "t").alias("p")).collect()


CANONICAL = [
    ("Claim [1, 2][2-4].", 5, "Claim [1][2][3][4]."),
    ("Claim [1] [1][2].", 5, "Claim [1][2]."),
    ("Claim [0][2][7].", 3, "Claim [2]."),
    ("Claim [19].", 3, "Claim."),
    ("First claim. [1] Second claim！ [2][3]", 5, "First claim [1]. Second claim [2][3]！"),
    ("Claim [1] [2] .", 5, "Claim [1][2]."),
    ("A [Source 1]. B (Source 2). C Source [3]. D Source 4.", 5, "A [1]. B [2]. C Source [3]. D Source [4]."),
    ("Claim. (Source 1, Source 4)", 5, "Claim [1][4]."),
    ("Supported claim [1].\n\nReferences:\n[1] Example title", 5, "Supported claim [1]."),
    ("Supported claim [1].\n\n[1] [2] [3].", 5, "Supported claim [1]."),
    ("Supported claim [1].\n\n[1] Source 1\n[2] Source 2", 5, "Supported claim [1]."),
    ("Supported claim [1].\n\n[Sources not used in the answer: 2, 3, 4]", 5, "Supported claim [1]."),
    ("Supported claim. [1]", 5, "Supported claim [1]."),
    ("Claim [1;2].", 5, "Claim [1;2]."),
    ("Body [1].\n\n[1] Dr. Biology. (2014). https://example.org/a\n[2] Author. Journal (2003).", 5, "Body [1]."),
    ("Body.\n\n[1] Explains the first point.\n[2] Explains another point.", 5, "Body.\n\n[1] Explains the first point.\n[2] Explains another point."),
    ("[1] Author (2020).\n[2] Author (2021).", 5, "[1] Author (2020).\n[2] Author (2021)."),
    ("Body text.\n\n(Source 1)\n\n(Source 7)", 7, "Body text."),
]


def canonical(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, n int")
    out = df.withColumn("c", canonical_column("t", "n"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    return [r.c and r.c.asDict(True) for r in out.orderBy("i").collect()]


def test_canonical(spark):
    got = canonical(spark, [(t, n) for t, n, _ in CANONICAL])
    for c, (text, _, want) in zip(got, CANONICAL):
        assert c["answer"] == want and c["changed"] == (text != want)
    assert [c["answer"] for c in canonical(spark, [(w, n) for _, n, w in CANONICAL])] == [w for *_, w in CANONICAL]


def test_canonical_log_and_column(spark):
    texts = [("Claim [0][2][7].", 3), ("Claim [1;2].", 5), ("Claim [1, 2].", 3), (None, 3), ("x", None), ("", 2), ("See [2-900000000000] and [0-1][99999999999999999999].", 4), ("Body.\n\n[2]\n\n[3]", 5)]
    got = canonical(spark, texts)
    assert got[0]["out_of_range"] == [{"first": 0, "last": 0}, {"first": 7, "last": 7}]
    assert got[1]["unresolved"] == [{"type": "malformed_numeric_bracket", "text": "[1;2]"}]
    assert [c and c["answer"] for c in got[2:6]] == ["Claim [1][2].", None, None, ""]
    far = got[6]  # ranges are told whole, however long
    assert far["answer"] == "See [2][3][4] and [1]." and far["out_of_range"] == [{"first": 5, "last": 900000000000}, {"first": 0, "last": 0}, {"first": 10**18, "last": 10**18}]
    assert far["action_counts"]["remove_invalid_or_out_of_range_label"] == 900000000000 - 4 + 2
    assert [t["type"] for t in got[7]["removed_tails"]] == ["standalone_citation_paragraph"] * 2
    df = spark.createDataFrame([("Supported body [1].\n\n[2]\n\n[3]",), (None,)], "t string")
    assert [r[0] for r in df.select(tails_removed("t")).collect()] == ["Supported body [1].", None]
    with pytest.raises(Exception, match="must be positive"):
        canonical(spark, [("x", 0)])


PIECES = ["Claim", "text é ", "[1]", "[2]", " [3]", "[1, 2]", "[2-4]", "[4-2]", "[9]", "[0-2]", "[3-9]", "[1-2-3]", " (Source 1, Source 4)", "(Source 2)", "[Source 3]", "Source 4", "Sources 7", ". ", ".", "! ", "。", "？", '"', "”", ")", " , ", ",", " ", "  ", "\n", "\n\n",
          "References:\n", "## Sources\n", "\n来源：", "---\n", "[1] Author (2020).", "[2] Title https://x.y", "[1] Source 1\n", "[Sources not used in the answer: 2, 3]", "[1;2]", "[01]", "Source [2]", "etc.", "\t", "[5] doi 3", "- [1] Book 1999.", "\r\n"]


def test_canonical_of_any_text(spark):
    """Texts put together from pieces, against the same rules in another engine."""
    duckdb = pytest.importorskip("duckdb")
    from visiloom.plans import adapters

    rng = random.Random(7)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    con = duckdb.connect()
    con.execute("CREATE TABLE f (doc_id BIGINT, answer VARCHAR)")
    con.executemany("INSERT INTO f VALUES (?, ?)", list(enumerate(texts)))
    sql = adapters.CANON.replace(adapters.PIECES, "answers AS (SELECT doc_id, 5 AS source_count, answer FROM f)")
    rows = con.execute(f"WITH RECURSIVE {sql} SELECT t, list_concat(k1, k2), {', '.join(adapters.CANON_ACTIONS)} FROM canon ORDER BY doc_id").fetchall()
    got = canonical(spark, [(t, 5) for t in texts])
    for text, g, (want, kinds, *counts) in zip(texts, got, rows):
        assert g["answer"] == want, text
        assert [t["type"] for t in g["removed_tails"]] == kinds
        assert {a: n for a, n in g["action_counts"].items() if a in adapters.CANON_ACTIONS} == {a: n for a, n in zip(adapters.CANON_ACTIONS, counts) if n}, text


def test_detached():
    assert attach_detached("Earlier sentence. Final factual sentence. ([1][2]).") == "Earlier sentence. Final factual sentence [1][2]."
    for same in ("Claim.\n\n[1]", "Claim.\n[1]", "Claim. A [1].", "[1] Dr. Biology.", "Claim [1]."):
        assert attach_detached(same) == same


def strict(spark, text, n):
    return column(spark, [text], lambda c: citations.strict_diagnostics(c, F.lit(n)))[0].contract_compliant


def test_contract_v2(spark):
    assert strict(spark, "First claim [1]. Second claim [2][3]!", 3)
    for bad, n in (("A claim. [1]", 3), ("Uncited claim. Supported claim [1].", 3), ("Claim [1,2].", 3), ("Claim [3].", 2)):
        assert not strict(spark, bad, n), bad


def test_contract_v4():
    d = optional_contract("No citation here. None there.", 3)
    assert d["contract_compliant"] and d["citationless_answer"]
    assert optional_contract("Uncited sentence. Supported claim [1].", 3)["contract_compliant"]
    for bad in ("A [1] supported claim.", "A claim [1] with more text [2].", "A supported claim. [1]", "", "Claim [4].", "Claim (Source 1).", "Claim [1].\n\nReferences\n"):
        assert not optional_contract(bad, 3)["contract_compliant"], bad


def test_contract_v6():
    for ok in ("Claim [1] .", "Claim [1][2]  !", "Claim [1]\t[2]\t?", "Dr. Smith reported the result [1].", "第一句话 [1]。第二句话 [2]！", "*Am I The Only Sane One Working Here?* is a title [1]."):
        assert strict_contract(ok, 3)["contract_compliant"], ok
    for bad in ("Claim [01].", "Claim [1], [2].", "Claim [note] [1].", "Claim [[1]].", "# Overview [1].", "| a | b [1].", "[1].", "Sources [1]", "Claim [1]. Uncited.", "Early [1] claim [2]."):
        assert not strict_contract(bad, 3)["contract_compliant"], bad


def test_rollup_and_views(spark):
    df = spark.createDataFrame([("Supported [1].", 2), ("Uncited. Claim [3].", 2), (None, 2)], "t string, n int")
    rows = [r.d for r in df.select(diagnostics("t", "n").alias("d")).collect()]
    assert [r.v2.contract_compliant for r in rows[:2]] == [True, False]
    assert [r.v4.contract_compliant for r in rows[:2]] == [True, False]
    assert rows[1].v4.invalid_numeric_citations == [3] and rows[0].v6.contract_compliant


SCORES = [
    ("[0]", 0, "exact_bracketed"), (" [5] ", 5, "exact_bracketed"), ("3", 3, "exact_bare"), (" 4 ", 4, "exact_bare"), ("score: [3]", 3, "labeled"), ("Final score is 3.", 3, "final_labeled"), ("评分：4", 4, "labeled"),
    ("3/5", 3, "ratio"), ("I would rate it a 2.", 2, "unique_numeric_candidate"), ("Source [1] is absent; score: 0.", 0, "labeled"), ("[6]", None, "ambiguous_or_missing"), ("The score could be 2 or 3.", None, "ambiguous_language"),
    ("score: 2 or 3", None, "ambiguous_language"), ("I considered 2 or 3. Final score: 3", 3, "final_labeled"), ("No numeric rating was given.", None, "ambiguous_or_missing"), ("Final score: 2. Final score: 3.", None, "ambiguous_final_labeled"),
    ("Because of all that\n4.", 4, "last_line"), ("4, as it is relevant to 3 points", 4, "leading"), ("最终评分：5", 5, "final_labeled"),
]


def test_score_texts(spark):
    got = column(spark, [s for s, *_ in SCORES], parsed_score)
    assert [(g.score, g.method) for g in got] == [(s, m) for _, s, m in SCORES]


def test_json(spark):
    assert repair_format('{"a": 1}') == ({"a": 1}, [])
    assert repair_format('{\n"a": "say "hi" now",\n"b": "x"\n}')[0] == {"a": 'say "hi" now', "b": "x"}
    assert repair_format('```json\n{"a": 1}\n```\n<|user|>') == ({"a": 1}, ["remove_terminal_user_token", "remove_single_json_fence"])
    for bad in ('{"a": 1', 'Here: {"a": 1}', '{"a": "x", "b" "y"}', '{\n"a": "x", "b": "y" z"\n}'):
        with pytest.raises(ValueError):
            repair_format(bad)
    got = column(spark, ['{"a": 1}', '```json\n{"a": 1}\n```', "not json", None], strict_json)
    assert [g.payload for g in got] == ['{"a": 1}', '{"a": 1}', None, None] and got[1].normalized
    assert [r.error for r in column(spark, ['{"a"', '{"a":1}'], repaired_json)] == ["JSONDecodeError", None]


def test_json_shapes(spark):
    good = '{"queries": [{"query": "a", "probability": 10}, {"query": "b", "probability": 90}]}'
    got = column(spark, [good, good.replace('"b"', '"a"'), good.replace("90", "190"), "[]", "x"], lambda c: query_diagnosis(c, 2))
    assert [g.valid for g in got] == [True, False, False, False, False] and got[1].distinct_count == 1
    s = '{"suggestions": [{"excerpt": "e", "suggestion": "s", "necessity": 60}]}'
    assert [g.valid for g in column(spark, [s, s.replace('"e"', '" "')], lambda c: suggestions(c, 3))] == [True, False]


def test_numbers_of_any_length(spark):
    """Numbers beyond 32 bits are out of range, not unknown; long ranges and thousands of digits cost nothing and don't fail."""
    rows = [(1, "Text one [3000000000]."), (2, "Text [1][2]."), (3, "Text [00000000000000000000001]."), (4, f"Text [{'9' * 5000}]."), (5, "Text [1-3000000].")]
    df = spark.createDataFrame(rows, "id int, answer string")
    got = {r.id: r for r in df.select("id", citations.basic_diagnostics("answer", F.lit(5)).alias("b"), citations.strict_diagnostics("answer", F.lit(5)).alias("s")).collect()}
    assert got[1].b.numeric_citations == [3000000000] == got[1].b.invalid_numeric_citations == got[1].s.invalid_numeric_citations
    assert not got[1].b.citation_format_scorable and not got[1].s.contract_compliant and got[2].s.contract_compliant
    assert got[3].b.numeric_citations == [1] and got[3].b.citation_format_scorable
    assert got[4].b.invalid_numeric_citations == [citations.BEYOND] and not got[4].s.contract_compliant
    assert got[5].b.numeric_citations == [1, 3000000]
    cases = [("x [1-3000000].", "x [1][2][3][4][5].", 2999995), ("x [1-1000000000].", "x [1][2][3][4][5].", 999999995), ("x [0-2].", "x [1][2].", 1), (f"x [{'7' * 5000}][2].", "x [2].", 1), (f"x [{'7' * 5000}, 3].", "x [3].", 1)]
    for c, (text, want, beyond) in zip(canonical(spark, [(t, 5) for t, *_ in cases]), cases):
        assert c["answer"] == want and c["action_counts"]["remove_invalid_or_out_of_range_label"] == beyond, (text[:20], c["answer"][:40])
        assert sum(s["last"] - s["first"] + 1 for s in c["out_of_range"]) == beyond and len(c["out_of_range"]) == 1


def test_headings_and_tokens_are_looked_for_where_they_can_begin(spark):
    """Patterns for whole answers decide at most places by one character; what they find stays the same."""
    from visiloom.functions import canonical as c

    assert "(?=" in c.TOKENS and "(?=" in c.CHAIN and "(?=" in c.LEFT_LABEL and c.HEADING_ANYWHERE.startswith(r"(?iU)(?:\A|")
    breaks = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x85", " ", " "]
    heads = ["References", "## ſOURCES:", " \t ### Bibliography", "来源："]
    texts = [f"One [1].{b}{h}{b}[1] A thing" for b in breaks for h in heads] + [f"One of the {h} here [1]." for h in heads]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select("i", c.tails_removed("x").alias("t")).collect()
    got = {r.i: r.t for r in rows}
    assert [got[i] for i in range(len(texts))] == ["One [1]."] * (len(breaks) * len(heads)) + texts[-len(heads) :]
