"""All queries of the library's own operators, with the SQL that gives the same rows. Doubles are rounded to 6 places on both sides."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import citations, keys
from ..functions.canonical import canonical_column, detached_repaired
from ..functions.contracts import diagnostics as all_views
from ..functions.contracts import exact_diagnostics, optional_diagnostics
from ..functions.templates import source_blocks, source_labels
from ..operators import boundaries, checks, conditions, diagnostics, generation, judge, lengths, objective, sampling, texts
from ..operators import improvement as imp
from ..operators.bootstrap import intervals
from ..operators.draws import Draws
from ..sources.readers import read_lines
from ..sources.scratch import shared_folder, stored
from ..sources.sinks import heat_table, write_jsonl
from ..streaming.resume import changed, remaining
from . import adapters as a

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(c, 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n.split('.')[-1]}" for n in names)


KEYS = ["model", "sample_id", "method", "answer_seed"]

# --- relational core -------------------------------------------------------------------------------------------------


@query("improvement_summary", f"WITH {a.SUMMARY} SELECT model, benchmark, method, n, {r('objective', 'subjective')} FROM summary")
def improvement_summary(spark, d):
    return rounded(imp.sample_means(imp.units(a.scores(spark, d), original=a.ORIGINAL)))


@query("paired_scores", f"WITH {a.PAIRED} SELECT model, sample_id, benchmark, method, answer_seed, {r('objective_before', 'objective_after', 'objective_improvement', 'subjective_before', 'subjective_after', 'subjective_improvement')} FROM paired")
def paired_scores(spark, d):
    return rounded(imp.paired(a.scores(spark, d), a.ORIGINAL))


@query("seed_means", f"WITH {a.UNITS} SELECT model, sample_id, benchmark, method, {r('objective', 'subjective')} FROM units")
def seed_means(spark, d):
    return rounded(imp.units(a.scores(spark, d), original=a.ORIGINAL))


@query("paired_summary", f"WITH {a.RAW_UNITS}, j AS (SELECT u.*, b.objective AS ob, b.subjective AS sb FROM raw u JOIN raw b ON u.model = b.model AND u.sample_id = b.sample_id AND b.method = 'm1') SELECT model, benchmark, method, count(*) AS n, "
       + ", ".join(f"round(avg({m[0]}b), 6) + 0.0 AS {m}_before, round(avg({m}), 6) + 0.0 AS {m}_after, round(avg({m} - {m[0]}b), 6) + 0.0 AS {m}_delta, count(*) FILTER ({m} - {m[0]}b > 1e-12) AS {m}_up, count(*) FILTER ({m} - {m[0]}b < -1e-12) AS {m}_down, count(*) FILTER (abs({m} - {m[0]}b) <= 1e-12) AS {m}_unchanged, count(*) FILTER ({m} = 0 AND {m[0]}b = 0) AS {m}_both_zero" for m in imp.METRICS)
       + " FROM j GROUP BY model, benchmark, method")
def paired_summary(spark, d):
    return rounded(imp.paired_summary(imp.raw_units(a.scores(spark, d)), a.ORIGINAL)).select("*")


@query("unit_deltas", f"WITH {a.RAW_UNITS} SELECT u.model, u.sample_id, u.benchmark, u.method, round(u.objective, 6) + 0.0 AS objective_raw, round(u.objective - b.objective, 6) + 0.0 AS objective_delta, round(u.subjective, 6) + 0.0 AS subjective_raw, round(u.subjective - b.subjective, 6) + 0.0 AS subjective_delta FROM raw u JOIN raw b ON u.model = b.model AND u.sample_id = b.sample_id AND b.method = 'm1'")
def unit_deltas(spark, d):
    return rounded(imp.with_deltas(imp.raw_units(a.scores(spark, d)), a.ORIGINAL))


@query("baseline_join", f"WITH {a.SCORES} SELECT s.model, s.sample_id, s.method, s.answer_seed, round(b.objective, 6) + 0.0 AS baseline, round(s.objective, 6) + 0.0 AS optimized, round(s.objective - b.objective, 6) + 0.0 AS delta, CASE WHEN b.objective <> 0 THEN round((s.objective - b.objective) / b.objective * 100, 6) + 0.0 END AS relative_percent FROM scores s JOIN scores b ON s.model = b.model AND s.sample_id = b.sample_id AND s.answer_seed = b.answer_seed AND b.method = 'm1'")
def baseline_join(spark, d):
    j = objective.with_baseline(a.scores(spark, d), a.ORIGINAL, F.col("objective"), "method")
    return rounded(j.select(*KEYS, "paired.*"))


@query("score_join", f"WITH {a.SCORES} SELECT model, sample_id, method, answer_seed, benchmark, {r('objective', 'subjective')} FROM scores WHERE objective > 0.2 AND subjective > 1")
def score_join(spark, d):
    s = a.scores(spark, d)
    return rounded(imp.joined_scores(s.where("objective > 0.2"), s.where("subjective > 1"), KEYS, strict=False))


@query("common_complete", f"WITH {a.UNITS}, c AS (SELECT sample_id FROM units GROUP BY sample_id HAVING count(DISTINCT model || ' ' || method) = 21) SELECT model, sample_id, method, {r('objective')} FROM units WHERE sample_id IN (SELECT sample_id FROM c)")
def common_complete(spark, d):
    return rounded(imp.common_complete(imp.units(a.scores(spark, d), original=a.ORIGINAL), 21).select("model", "sample_id", "method", "objective"))


@query("coverage", f"WITH {a.UNITS}, p AS (SELECT method, sample_id, count(DISTINCT model) AS n FROM units WHERE NOT (model = 'A' AND method = 'm3') GROUP BY method, sample_id) SELECT method, count(*) AS samples, bool_and(n = 3) AS covered FROM p GROUP BY method")
def coverage(spark, d):
    return imp.coverage(imp.units(a.scores(spark, d), original=a.ORIGINAL).where("not (model = 'A' and method = 'm3')"), 3)


LONG = a.SUMMARY + ", long AS (SELECT model, benchmark, method, n, 'objective' AS metric, objective AS score FROM summary WHERE method <> 'm1' UNION ALL SELECT model, benchmark, method, n, 'subjective', subjective FROM summary WHERE method <> 'm1')"


def _summary(spark, d):
    return imp.sample_means(imp.units(a.scores(spark, d), original=a.ORIGINAL))


@query("winners", f"WITH {LONG} SELECT benchmark, model, method, n, metric, {r('score')} FROM (SELECT *, max(score) OVER (PARTITION BY benchmark, model, metric) AS best FROM long) WHERE abs(score - best) <= 1e-12")
def winners(spark, d):
    return rounded(imp.winners(_summary(spark, d), (a.ORIGINAL,)))


@query("rankings", f"WITH {LONG} SELECT benchmark, model, method, n, metric, {r('score')}, CAST(rank AS INTEGER) AS rank, rank = 1 AS is_top FROM (SELECT *, row_number() OVER (PARTITION BY benchmark, model, metric ORDER BY score DESC, method) AS rank FROM long)")
def rankings(spark, d):
    return rounded(imp.rankings(_summary(spark, d), (a.ORIGINAL,)))


WIDE = LONG + """, wide AS (SELECT benchmark, metric, method, max(score) FILTER (model = 'A') AS A, max(score) FILTER (model = 'N') AS N, max(score) FILTER (model = 'R') AS R FROM long GROUP BY benchmark, metric, method),
rev AS (SELECT x.benchmark, x.metric, x.method AS method_a, y.method AS method_b, x.A - y.A AS A, x.N - y.N AS N, x.R - y.R AS R FROM wide x JOIN wide y ON x.benchmark = y.benchmark AND x.metric = y.metric AND x.method < y.method
  WHERE least(x.A - y.A, x.N - y.N, x.R - y.R) < -1e-12 AND greatest(x.A - y.A, x.N - y.N, x.R - y.R) > 1e-12)"""


@query("method_reversals", f"WITH {WIDE} SELECT benchmark, metric, method_a, method_b, {r('A', 'N', 'R')} FROM rev")
def method_reversals(spark, d):
    return rounded(imp.method_reversals(_summary(spark, d), a.MODELS, (a.ORIGINAL,)))


@query("reversal_counts", f"WITH {WIDE} SELECT g.benchmark, g.metric, count(v.method_a) AS reversals FROM (SELECT DISTINCT benchmark, metric FROM long) g LEFT JOIN rev v ON g.benchmark = v.benchmark AND g.metric = v.metric GROUP BY g.benchmark, g.metric")
def reversal_counts(spark, d):
    s = _summary(spark, d)
    return imp.reversal_counts(imp.method_reversals(s, a.MODELS, (a.ORIGINAL,)), imp.long_metrics(s, ["benchmark"]))


@query("rank_reversals", f"""WITH {LONG}, l AS (SELECT x.benchmark, x.metric, x.model, x.method AS method_a, y.method AS method_b, x.score AS sa, y.score AS sb FROM long x JOIN long y ON x.benchmark = y.benchmark AND x.metric = y.metric AND x.model = y.model AND x.method < y.method)
SELECT p.benchmark, p.metric, p.method_a, p.method_b, p.model AS model_a, q.model AS model_b, round(p.sa, 6) + 0.0 AS score_a_x, round(p.sb, 6) + 0.0 AS score_b_x, round(q.sa, 6) + 0.0 AS score_a_y, round(q.sb, 6) + 0.0 AS score_b_y, round(least(abs(p.sa - p.sb), abs(q.sa - q.sb)), 6) + 0.0 AS strength
FROM l p JOIN l q ON p.benchmark = q.benchmark AND p.metric = q.metric AND p.method_a = q.method_a AND p.method_b = q.method_b AND p.model < q.model WHERE (p.sa - p.sb) * (q.sa - q.sb) < 0""")  # fmt: skip
def rank_reversals(spark, d):
    return rounded(imp.rank_reversals(_summary(spark, d), (a.ORIGINAL,)))


@query("heat_table", f"WITH {a.SUMMARY} SELECT benchmark, method, round(max(objective) FILTER (model = 'A'), 6) + 0.0 AS A, round(max(objective) FILTER (model = 'N'), 6) + 0.0 AS N, round(max(objective) FILTER (model = 'R'), 6) + 0.0 AS R FROM summary GROUP BY benchmark, method")
def heat(spark, d):
    return rounded(heat_table(_summary(spark, d), ["benchmark", "method"], "model", "objective"))


@query("bootstrap_ci")
def bootstrap_ci(spark, d):
    return intervals(imp.units(a.scores(spark, d), original=a.ORIGINAL), ["benchmark", "model", "method"], ["objective", "subjective"])


@query("bootstrap_means", f"WITH {a.UNITS} SELECT benchmark, model, method, count(*) AS n, round(avg(objective), 6) + 0.0 AS objective_mean, round(avg(subjective), 6) + 0.0 AS subjective_mean, true AS within FROM units GROUP BY benchmark, model, method")
def bootstrap_means(spark, d):
    """What SQL can say of the intervals: sizes, means, and that both intervals hold their mean."""
    within = F.col("objective_mean").between(F.col("objective_ci_low") - 1e-12, F.col("objective_ci_high") + 1e-12) & F.col("subjective_mean").between(F.col("subjective_ci_low") - 1e-12, F.col("subjective_ci_high") + 1e-12)
    return rounded(bootstrap_ci(spark, d).select("benchmark", "model", "method", "n", "objective_mean", "subjective_mean", within.alias("within")))


# --- accounting ------------------------------------------------------------------------------------------------------

GRID = a.MANIFEST + ", grid AS (SELECT model, sample_id, 'm' || m AS method, CAST(s AS INTEGER) AS answer_seed FROM manifest, (VALUES ('A'), ('N'), ('R')) AS t1(model), range(1, 8) AS t2(m), range(3) AS t3(s))"
OUTCOMES = GRID + ", " + a.SCORES + ", errors AS (SELECT * FROM grid WHERE (CAST(sample_id AS BIGINT) + answer_seed) % 19 = 0)"


def _grid(spark, d):
    return checks.grid(spark, a.manifest(spark, d).select("sample_id"), model=a.MODELS, method=a.METHODS, answer_seed=(0, 1, 2)).select(*KEYS)


def _errors(spark, d):
    return _grid(spark, d).where("(cast(sample_id as bigint) + answer_seed) % 19 = 0")


@query("expected_grid", f"WITH {GRID} SELECT model, sample_id, method, answer_seed FROM grid")
def expected_grid(spark, d):
    return _grid(spark, d)


@query("missing_keys", f"WITH {OUTCOMES} SELECT model, sample_id, method, answer_seed FROM grid EXCEPT SELECT model, sample_id, method, answer_seed FROM scores")
def missing_keys(spark, d):
    return checks.missing(_grid(spark, d), a.scores(spark, d), KEYS)


@query("accounted_keys", f"WITH {OUTCOMES} SELECT model, sample_id, method, answer_seed FROM scores UNION SELECT model, sample_id, method, answer_seed FROM errors")
def accounted_keys(spark, d):
    return checks.accounted(a.scores(spark, d), _errors(spark, d), KEYS)


@query("overlapping_keys", f"WITH {OUTCOMES} SELECT model, sample_id, method, answer_seed FROM scores INTERSECT SELECT model, sample_id, method, answer_seed FROM errors")
def overlapping_keys(spark, d):
    return checks.overlap(a.scores(spark, d), _errors(spark, d), KEYS)


STATUS = OUTCOMES + """, st AS (SELECT model, sample_id, method, answer_seed, sum(e) AS e, sum(s) AS s, sum(f) AS f FROM (
  SELECT model, sample_id, method, answer_seed, 1 AS e, 0 AS s, 0 AS f FROM grid UNION ALL SELECT model, sample_id, method, answer_seed, 0, 1, 0 FROM scores UNION ALL SELECT model, sample_id, method, answer_seed, 0, 0, 1 FROM errors) GROUP BY ALL),
status AS (SELECT *, CASE WHEN e = 0 THEN 'unexpected' WHEN s > 0 AND f > 0 THEN 'overlap' WHEN s + f > 1 THEN 'duplicate' WHEN s > 0 THEN 'success' WHEN f > 0 THEN 'error' ELSE 'missing' END AS status FROM st)"""


@query("accounting", f"WITH {STATUS} SELECT status, count(*) AS n FROM status GROUP BY status")
def accounting(spark, d):
    return checks.accounting(_grid(spark, d), a.scores(spark, d), _errors(spark, d), KEYS)


@query("progress", f"WITH {STATUS}, c AS (SELECT count(*) FILTER (status <> 'unexpected') AS expected, count(*) FILTER (status IN ('success', 'duplicate', 'overlap')) AS completed, count(*) FILTER (status = 'error') AS errors FROM status) SELECT *, expected - completed - errors AS remaining, round(100.0 * (completed + errors) / expected, 4) AS percent FROM c")
def progress(spark, d):
    return checks.progress(_grid(spark, d), a.scores(spark, d), _errors(spark, d), KEYS)


@query("set_equality", f"WITH {OUTCOMES}, x AS (SELECT DISTINCT sample_id, method FROM scores), y AS (SELECT DISTINCT sample_id, method FROM grid), l AS (SELECT count(*) AS n FROM (SELECT * FROM x EXCEPT SELECT * FROM y)), q AS (SELECT count(*) AS n FROM (SELECT * FROM y EXCEPT SELECT * FROM x)) SELECT l.n AS only_left, q.n AS only_right, l.n = 0 AND q.n = 0 AS equal_sets FROM l, q")
def set_equality(spark, d):
    return checks.same_set(a.scores(spark, d), _grid(spark, d), ["sample_id", "method"])


@query("duplicate_count", "SELECT count(*) AS n_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS distinct_keys, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicate_rows FROM lineitem")
def duplicate_count(spark, d):
    return checks.duplicate_count(a.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return checks.duplicates(a.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("flag_counters", f"""WITH {a.SCORES}, f AS (SELECT model, benchmark, objective = 0 AS zero_objective, subjective >= 4.5 AS high_subjective, objective > 1 AS impossible FROM scores),
g AS (SELECT model, benchmark, CAST(grouping(model, benchmark) AS INTEGER) AS grouping, count(*) FILTER (zero_objective) AS z, count(*) FILTER (high_subjective) AS h, count(*) FILTER (impossible) AS i FROM f GROUP BY CUBE (model, benchmark)),
l AS (SELECT model, benchmark, grouping, 'zero_objective' AS flag, z AS n FROM g UNION ALL SELECT model, benchmark, grouping, 'high_subjective', h FROM g UNION ALL SELECT model, benchmark, grouping, 'impossible', i FROM g)
SELECT model, benchmark, grouping, flag, CAST(n AS BIGINT) AS n FROM l WHERE n > 0""")  # fmt: skip
def flag_counters(spark, d):
    s = a.scores(spark, d).select("model", "benchmark", (F.col("objective") == 0).alias("zero_objective"), (F.col("subjective") >= 4.5).alias("high_subjective"), (F.col("objective") > 1).alias("impossible"))
    return checks.counters(s, ["zero_objective", "high_subjective", "impossible"])


@query("disagreements", """WITH x AS (SELECT c_custkey, c_mktsegment AS seg, c_nationkey AS nat FROM customer WHERE c_custkey % 50 <> 1), y AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'X' ELSE c_mktsegment END AS seg, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_nationkey END AS nat FROM customer WHERE c_custkey % 50 <> 2),
j AS (SELECT coalesce(x.c_custkey, y.c_custkey) AS c_custkey, list_filter([CASE WHEN x.c_custkey IS NULL THEN 'missing_left' END, CASE WHEN y.c_custkey IS NULL THEN 'missing_right' END, CASE WHEN x.c_custkey IS NOT NULL AND y.c_custkey IS NOT NULL AND x.seg IS DISTINCT FROM y.seg THEN 'seg' END, CASE WHEN x.c_custkey IS NOT NULL AND y.c_custkey IS NOT NULL AND x.nat IS DISTINCT FROM y.nat THEN 'nat' END], lambda e: e IS NOT NULL) AS differ FROM x FULL JOIN y ON x.c_custkey = y.c_custkey)
SELECT c_custkey, array_to_string(differ, ',') AS differ FROM j WHERE len(differ) > 0""")  # fmt: skip
def disagreements(spark, d):
    c = a.table(spark, d, "customer")
    x = c.where("c_custkey % 50 <> 1").select("c_custkey", F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("nat"))
    y = c.where("c_custkey % 50 <> 2").select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, "X").otherwise(F.col("c_mktsegment")).alias("seg"), F.when(F.col("c_custkey") % 11 != 0, F.col("c_nationkey")).alias("nat"))
    return checks.disagreements(x, y, ["c_custkey"], ["seg", "nat"]).select("c_custkey", F.array_join("differ", ",").alias("differ"))


@query("first_examples", "SELECT event_type, event_id, CAST(example AS INTEGER) AS example FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS example FROM events) WHERE example <= 5")
def first_examples(spark, d):
    return checks.first_examples(a.table(spark, d, "events").select("event_type", "event_id"), ["event_type"], ["event_id"])


@query("defect_preview", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice < 20000 ORDER BY o_orderkey LIMIT 100")
def defect_preview(spark, d):
    return checks.preview(a.table(spark, d, "orders").where("o_totalprice < 20000").select("o_orderkey", "o_orderstatus"), ["o_orderkey"])


@query("integrity", f"WITH {STATUS}, k AS (SELECT 'missing' AS \"check\", count(*) FILTER (status = 'missing') AS defect_count FROM status UNION ALL SELECT 'unexpected', count(*) FILTER (status = 'unexpected') FROM status) SELECT \"check\", CAST(defect_count AS BIGINT) AS defect_count, defect_count = 0 AS passed FROM k")
def integrity(spark, d):
    s = checks.key_status(_grid(spark, d), a.scores(spark, d), _errors(spark, d), KEYS)
    return checks.integrity({n: s.where(F.col("status") == n) for n in ("missing", "unexpected")})


@query("strict_order", "SELECT event_id FROM (SELECT event_id, user_id, event_type, lag((user_id, event_type)) OVER (ORDER BY event_id) AS b FROM events) WHERE b IS NOT NULL AND NOT ((user_id, event_type) > b)")
def strict_order(spark, d):
    return sampling.disordered(a.table(spark, d, "events"), ["user_id", "event_type"], "event_id").select("event_id")


# --- objective scores ------------------------------------------------------------------------------------------------

WS = "[ \\t\\n\\x0B\\x0C\\r]"
#: sentences: paragraphs, then after . ! ? and white space; RE2 has no look-behind, so the end mark is kept by a marker
SENTENCES = a.PIECES + r""", sent AS (
  SELECT doc_id, source_count, target_document_index, row_number() OVER (PARTITION BY doc_id ORDER BY p, q) - 1 AS i, s FROM (
    SELECT doc_id, source_count, target_document_index, p, generate_subscripts(string_split(regexp_replace(para, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), 1) AS q, trim(unnest(string_split(regexp_replace(para, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))), ' ' || chr(10) || chr(13) || chr(9)) AS s
    FROM (SELECT doc_id, source_count, target_document_index, generate_subscripts(string_split(answer, chr(10) || chr(10)), 1) AS p, unnest(string_split(answer, chr(10) || chr(10))) AS para FROM answers)) WHERE s <> ''),
cited AS (
  SELECT *, len(list_filter(regexp_extract_all(s, '[A-Za-z0-9]+'), lambda w: length(w) > 2)) AS words, list_transform(regexp_extract_all(s, '\[[^\w\s]*(\d+)[^\w\s]*\]', 1), lambda x: CAST(x AS INTEGER)) AS cits, count(*) OVER (PARTITION BY doc_id) AS n FROM sent)"""
SOURCES = SENTENCES + """, occ AS (
  SELECT doc_id, i, source_count, words, len(cits) AS k, CASE WHEN n = 1 THEN 1.0 ELSE exp(-(i / (n - 1))) END AS decay, unnest(cits) AS c FROM cited),
cred AS (SELECT doc_id, CASE WHEN c = 0 THEN source_count ELSE c END AS source_index, words / k AS word, decay / k AS position, words * decay / k AS overall FROM occ WHERE c <= source_count),
per AS (SELECT a.doc_id, s AS source_index, coalesce(sum(word), 0) AS word, coalesce(sum(position), 0) AS position, coalesce(sum(overall), 0) AS overall FROM answers a CROSS JOIN range(1, 6) t(s) LEFT JOIN cred c ON c.doc_id = a.doc_id AND c.source_index = s GROUP BY a.doc_id, s),
norm AS (SELECT doc_id, source_index, """ + ", ".join(f"CASE WHEN sum({m}) OVER w = 0 THEN 0 ELSE {m} / sum({m}) OVER w END AS {m}, {m} AS {m}_raw, sum({m}) OVER w AS {m}_sum" for m in objective.METRICS) + " FROM per WINDOW w AS (PARTITION BY doc_id))"


@query("citation_counts", SENTENCES.join(["WITH ", " SELECT doc_id, count(*) AS sentences, CAST(sum(len(cits)) AS BIGINT) AS citations, CAST(sum(words) AS BIGINT) AS eligible_words FROM cited GROUP BY doc_id"]))
def citation_counts(spark, d):
    x = a.answers(spark, d).select("doc_id", citations.sentences("answer").alias("s"))
    return x.where(F.size("s") > 0).select("doc_id", F.size("s").cast("long").alias("sentences"), F.aggregate("s", F.lit(0).cast("long"), lambda n, y: n + F.size(citations.official_citations(y))).alias("citations"), F.aggregate("s", F.lit(0).cast("long"), lambda n, y: n + citations.eligible_words(y)).alias("eligible_words"))


def _scored(spark, d):
    return objective.scored(a.answers(spark, d), source_count="source_count")


@query("objective_scores", SOURCES.join(["WITH ", f" SELECT doc_id, CAST(source_index AS INTEGER) AS source_index, {r('word', 'position', 'overall')} FROM norm"]))
def objective_scores(spark, d):
    return rounded(objective.source_rows(_scored(spark, d), ["doc_id"]))


@query("objective_uniform", SOURCES.join(["WITH ", " SELECT doc_id, CAST(source_index AS INTEGER) AS source_index, " + ", ".join(f"round(CASE WHEN {m}_sum = 0 THEN 0.2 ELSE {m} END, 6) + 0.0 AS {m}" for m in objective.METRICS) + " FROM norm"]))
def objective_uniform(spark, d):
    return rounded(objective.source_rows(_scored(spark, d), ["doc_id"], "official_uniform"))


@query("target_payload", SOURCES.join(["WITH ", " SELECT n.doc_id, " + ", ".join(f"round({m}, 6) + 0.0 AS {m}, round({m} * 100, 6) + 0.0 AS {m}_percent, round({m}_raw, 6) + 0.0 AS {m}_raw, round({m}_sum, 6) + 0.0 AS {m}_sum, {m}_sum = 0 AS {m}_fallback" for m in objective.METRICS) + " FROM norm n JOIN answers a ON n.doc_id = a.doc_id AND n.source_index = a.target_document_index + 1"]))
def target_payload(spark, d):
    s = _scored(spark, d).select("doc_id", objective.target_payload("zero", "target_document_index").alias("t"))
    return rounded(s.select("doc_id", *[F.col(f"t.{m}.{f}").alias(n) for m in objective.METRICS for f, n in (("normalized", m), ("percent", f"{m}_percent"), ("raw", f"{m}_raw"), ("raw_sum", f"{m}_sum"), ("fallback", f"{m}_fallback"))]))


@query("target_cited", a.PIECES.join(["WITH ", " SELECT doc_id, regexp_matches(answer, '\\[0*' || (target_document_index + 1) || '\\]') AS cited FROM answers"]))
def target_cited(spark, d):
    return a.answers(spark, d).select("doc_id", citations.cites("answer", F.col("target_document_index") + 1).alias("cited"))


@query("basic_diagnostics", a.PIECES.join(["WITH ", r""" , b AS (SELECT doc_id, answer, flatten(list_transform(regexp_extract_all(answer, '\[(\d+(?:\s*[-,]\s*\d+)*)\]', 1), lambda x: regexp_split_to_array(x, '\s*[,\-]\s*'))) AS parts, list_filter(list_transform(regexp_extract_all(answer, '\[([^\]\d][^\]]*)\]', 1), lambda x: trim(x)), lambda x: x <> '') AS named FROM answers)
SELECT doc_id, CAST(len(parts) AS INTEGER) AS numeric_citation_count, array_to_string(list_sort(list_distinct(list_filter(list_transform(parts, lambda x: CAST(x AS INTEGER)), lambda x: x < 1 OR x > 5))), ',') AS invalid, CAST(len(named) AS INTEGER) AS named FROM b"""]))
def basic_diagnostics(spark, d):
    x = a.answers(spark, d).select("doc_id", citations.basic_diagnostics("answer", "source_count").alias("b"))
    return x.select("doc_id", "b.numeric_citation_count", F.array_join("b.invalid_numeric_citations", ",").alias("invalid"), F.size("b.named_bracket_citations").alias("named"))


@query("strict_diagnostics", f"WITH {a.STRICT} SELECT doc_id, sentence_count, compliant_sentence_count, contract_compliant FROM v2")
def strict_diagnostics(spark, d):
    return a.answers(spark, d).select("doc_id", citations.strict_diagnostics("answer", "source_count").alias("v")).select("doc_id", "v.sentence_count", "v.compliant_sentence_count", "v.contract_compliant")


@query("optional_contract", f"WITH {a.OPTIONAL} SELECT doc_id, CAST(sentences AS INTEGER) AS sentence_count, CAST(cited AS INTEGER) AS citation_bearing_sentence_count, CAST(malformed AS INTEGER) AS malformed_citation_sentence_count, sentences > 0 AND cited = 0 AS citationless_answer, compliant AS contract_compliant FROM v4")
def optional_contract(spark, d):
    x = a.answers(spark, d).select("doc_id", optional_diagnostics("answer", "source_count").alias("v4"))
    return x.select("doc_id", *[f"v4.{c}" for c in ("sentence_count", "citation_bearing_sentence_count", "malformed_citation_sentence_count", "citationless_answer", "contract_compliant")])


@query("contract_diagnostics")
def contract_diagnostics(spark, d):
    x = a.answers(spark, d).select("doc_id", optional_diagnostics("answer", "source_count").alias("v4"), exact_diagnostics("answer", "source_count").alias("v6"))
    return x.select("doc_id", F.col("v4.contract_compliant").alias("v4_ok"), F.col("v4.malformed_citation_sentence_count").alias("v4_bad"), F.col("v6.contract_compliant").alias("v6_ok"), F.col("v6.noncompliant_sentence_count").alias("v6_bad"))


@query("diagnostic_rollup")
def diagnostic_rollup(spark, d):
    return diagnostics.rollup(a.answers(spark, d).select(all_views("answer", "source_count").alias("d")))


@query("diagnostic_changes", f"WITH {a.STRICT}{a.OPTIONAL.removeprefix(a.STRICT_UNITS)}, f AS (SELECT v2.contract_compliant AS v2, v4.compliant AS v4, doc_id % 2 = 0 AS s2, CASE WHEN doc_id % 3 > 0 THEN true END AS s4 FROM v2 JOIN v4 USING (doc_id)) "
    "SELECT count(*) AS n, count(*) FILTER (s2) AS v2_before, count(*) FILTER (v2) AS v2_after, count(*) FILTER (v2 IS DISTINCT FROM s2) AS v2_changed, count(*) FILTER (s4) AS v4_before, count(*) FILTER (v4) AS v4_after, count(*) FILTER (v4 IS DISTINCT FROM s4) AS v4_changed FROM f")  # fmt: skip
def diagnostic_changes(spark, d):
    x = a.answers(spark, d).withColumns({"stored_v2": F.col("doc_id") % 2 == 0, "stored_v4": F.when(F.col("doc_id") % 3 > 0, F.lit(True))})
    return diagnostics.change_summary(diagnostics.recomputed(x))


@query("score_map", f"WITH {a.SCORES} SELECT model, sample_id, method, answer_seed, benchmark, round(objective, 6) + 0.0 AS score FROM scores")
def score_map(spark, d):
    nested = a.scores(spark, d).withColumn("zero_fallback", F.struct(F.col("objective").alias("overall")))
    return rounded(diagnostics.score_map(nested, KEYS, F.col("zero_fallback.overall"), 0, 1))


@query("token_sums", "SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id END) AS BIGINT) AS input_tokens, CAST(sum(user_id) AS BIGINT) AS output_tokens FROM events GROUP BY event_type")
def token_sums(spark, d):
    e = a.table(spark, d, "events").select("event_type", F.when(F.col("event_id") % 3 != 0, F.col("event_id")).alias("input_tokens"), F.col("user_id").alias("output_tokens"))
    return diagnostics.token_sums(e, "event_type")


@query("failure_kinds", "SELECT CASE event_type WHEN (SELECT min(event_type) FROM events) THEN 'invalid_json' ELSE 'other' END AS kind, count(*) AS n FROM events GROUP BY 1")
def failure_kinds(spark, d):
    e = a.table(spark, d, "events")
    first = e.agg(F.min("event_type").alias("m"))
    x = e.join(first, e["event_type"] == first["m"], "left").select(texts.failure_kind(F.when(F.col("m").isNotNull(), "Invalid JSON at 3").otherwise("timeout")).alias("kind"))
    return x.groupBy("kind").agg(F.count("*").alias("n"))


@query("prompt_families", f"WITH {a.SCORES} SELECT split_part(method || '.' || model, '.', 1) AS family, count(*) AS n FROM scores GROUP BY 1")
def prompt_families(spark, d):
    return a.scores(spark, d).select(keys.prompt_family(F.concat_ws(".", "method", "model")).alias("family")).groupBy("family").agg(F.count("*").alias("n"))


UNRESOLVED = r"""len(list_filter(regexp_extract_all(t, '\[[^\]\n]*\d+[^\]\n]*\]'), lambda x: NOT regexp_matches(x, '^\[\d+\]$'))) + len(regexp_extract_all(t, '(?i)\bSources?\s*\d+\b'))
  + len(list_filter(string_split_regex(t, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), lambda x: regexp_matches(x, '(?i)^\s*(?:#{1,6}\s*)?(?:references|sources|bibliography|citations|参考文献|资料来源|来源)\s*[:：]?\s*$')))"""


@query("canonical_answers", f"WITH RECURSIVE {a.CANON} SELECT doc_id, sha256(t) AS sha256, t <> t0 AS changed, {UNRESOLVED} AS unresolved, CAST({' + '.join(a.CANON_ACTIONS)} + 2 * (CASE WHEN len(k1) > 0 THEN 1 ELSE 0 END + CASE WHEN len(k2) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS actions FROM canon")
def canonical_answers(spark, d):
    x = a.answers(spark, d).select("doc_id", canonical_column("answer", "source_count").alias("c"))
    return x.select("doc_id", F.sha2("c.answer", 256).alias("sha256"), "c.changed", F.size("c.unresolved").alias("unresolved"), F.coalesce(F.aggregate(F.map_values("c.action_counts"), F.lit(0).cast("long"), lambda s, v: s + v), F.lit(0).cast("long")).alias("actions"))


@query("detached_repair")
def detached_repair(spark, d):
    return a.answers(spark, d).select("doc_id", detached_repaired("answer").alias("r"), "answer").select("doc_id", (F.col("r") != F.col("answer")).alias("changed"), F.sha2("r", 256).alias("sha256"))


KINDS = "SELECT doc_id, CASE WHEN len({k}) > 1 THEN 'remove_successive_reference_tails' ELSE 'remove_' || {k}[1] END AS action FROM canon WHERE len({k}) > 0"


@query("canonicalization_counts", f"WITH RECURSIVE {a.CANON}, kinds AS (SELECT doc_id, unnest([action, 'remove_trailing_reference_list']) AS action FROM ({KINDS.format(k='k1')} UNION ALL {KINDS.format(k='k2')})) "
    + " UNION ALL ".join(f"SELECT '{x}' AS action, count(*) AS answers, CAST(sum({x}) AS BIGINT) AS n FROM canon WHERE {x} > 0 HAVING count(*) > 0" for x in a.CANON_ACTIONS)
    + " UNION ALL SELECT action, count(DISTINCT doc_id), count(*) FROM kinds GROUP BY action")
def canonicalization_counts(spark, d):
    x = a.answers(spark, d).select(F.explode(canonical_column("answer", "source_count")["action_counts"]).alias("action", "k"))
    return x.groupBy("action").agg(F.count("*").alias("answers"), F.sum("k").alias("n"))


# --- judge -----------------------------------------------------------------------------------------------------------


@query("parsed_scores", f"WITH {a.PARSED} SELECT sample_id, dimension, judge_seed, raw_output, score, score_parse_method FROM parsed")
def parsed_scores(spark, d):
    return judge.reparsed(a.trials(spark, d)).select("sample_id", "dimension", "judge_seed", "raw_output", "score", "score_parse_method")


@query("parse_methods", f"WITH {a.PARSED} SELECT score_parse_method, count(*) AS n FROM parsed GROUP BY score_parse_method")
def parse_methods(spark, d):
    return checks.histogram(judge.reparsed(a.trials(spark, d)), "score_parse_method")


def _ruled(spark, d):
    return judge.absence_rule(judge.reparsed(a.trials(spark, d)))


@query("absence_rule", f"WITH {a.PARSED} SELECT sample_id, dimension, judge_seed, score, pre_absence_rule_score, score_origin, NOT target_source_cited AND coalesce(pre_absence_rule_score <> 0, true) AS overridden FROM ruled")
def absence_rule(spark, d):
    return _ruled(spark, d).select("sample_id", "dimension", "judge_seed", "score", "pre_absence_rule_score", "score_origin", "overridden")


DIM = a.PARSED + ", dim AS (SELECT model, sample_id, prompt_id, answer_seed, dimension, avg(score) AS mean_score, count(score) AS valid FROM ruled GROUP BY ALL)"


@query("dimension_scores", f"WITH {DIM} SELECT sample_id, dimension, {r('mean_score')}, valid > 0 AS scorable FROM dim")
def dimension_scores(spark, d):
    return rounded(judge.dimension_scores(_ruled(spark, d)).select("sample_id", "dimension", "mean_score", "scorable"))


@query("judge_scores", f"WITH {DIM} SELECT sample_id, round(avg(mean_score), 6) + 0.0 AS subjective_average, count(*) FILTER (valid > 0) AS n_scorable, count(*) FILTER (valid > 0) = 7 AS all_dimensions_scorable FROM dim GROUP BY sample_id")
def judge_scores(spark, d):
    return rounded(judge.judge_scores(_ruled(spark, d), a.DIMENSIONS).select("sample_id", "subjective_average", "n_scorable", "all_dimensions_scorable"))


@query("trial_defects", f"WITH {a.PARSED} SELECT sample_id, dimension, judge_seed FROM ruled WHERE score IS NULL")
def trial_defects(spark, d):
    return judge.trial_defects(_ruled(spark, d), a.DIMENSIONS).select("sample_id", "dimension", "judge_seed")


@query("zero_trials", f"WITH {a.TRIALS} SELECT DISTINCT sample_id, dimension, judge_seed, 0 AS score FROM trials WHERE NOT target_source_cited")
def zero_trials(spark, d):
    t = a.trials(spark, d)
    answers = t.select(*keys.ANSWER_KEY, "target_source_cited").distinct()
    return judge.zero_trials(answers, a.DIMENSIONS).select("sample_id", "dimension", "judge_seed", "score")


@query("expected_trials", f"WITH {a.TRIALS} SELECT model, sample_id, prompt_id, answer_seed, dimension, judge_seed FROM trials")
def expected_trials(spark, d):
    return judge.expected_trials(a.trials(spark, d).select(*keys.ANSWER_KEY).distinct(), a.DIMENSIONS)


@query("judge_targets", f"WITH {a.MANIFEST} SELECT sample_id, target_document_index, CAST(target_document_index + 1 AS INTEGER) AS target_citation_index, candidate_document_count FROM manifest")
def judge_targets(spark, d):
    return judge.targets(a.manifest(spark, d))


ALIGN = a.PIECES + """, al AS (SELECT doc_id, regexp_matches(answer, k) AS before, regexp_matches(c, k) AS after, answer <> c AS changed FROM (SELECT doc_id, answer, '\\[0*' || (target_document_index + 1) || '\\]' AS k, replace(answer, ' [Source ', ' [') AS c FROM answers))"""


def _aligned(spark, d):
    x = a.answers(spark, d).select(F.lit("qwen").alias("model"), F.col("doc_id").cast("string").alias("sample_id"), F.lit("p").alias("prompt_id"), F.lit(0).alias("answer_seed"), F.lit("b").alias("benchmark"), F.lit("d").alias("domain"), "answer", "target_document_index", F.lit(5).alias("candidate_document_count"))
    return judge.alignment(x, x.withColumn("answer", F.replace("answer", F.lit(" [Source "), F.lit(" ["))), x.select("sample_id", "target_document_index", "candidate_document_count"))


@query("alignment", ALIGN.join(["WITH ", " SELECT CAST(doc_id AS VARCHAR) AS sample_id, before AS raw_target_source_cited, after AS canonical_target_source_cited, changed AS canonicalized_text_changed, CASE WHEN NOT after THEN 'deterministic_zero' WHEN changed THEN 'rerun_glm_judge' ELSE 'reuse_old_scores' END AS subjective_score_action FROM al"]))
def alignment(spark, d):
    return _aligned(spark, d).select("sample_id", "raw_target_source_cited", "canonical_target_source_cited", "canonicalized_text_changed", "subjective_score_action")


@query("rerun_plan", ALIGN.join(["WITH ", " SELECT CAST(doc_id AS VARCHAR) AS sample_id, 'd' || x AS dimension, CAST(s AS INTEGER) AS judge_seed FROM al, range(7) t(x), range(3) u(s) WHERE after AND changed"]))
def rerun_plan(spark, d):
    return judge.rerun_plan(_aligned(spark, d), a.DIMENSIONS).select("sample_id", "dimension", "judge_seed")


@query("alignment_actions", ALIGN.join(["WITH ", " SELECT CASE WHEN NOT after THEN 'deterministic_zero' WHEN changed THEN 'rerun_glm_judge' ELSE 'reuse_old_scores' END AS subjective_score_action, count(*) AS n FROM al GROUP BY 1"]))
def alignment_actions(spark, d):
    return checks.histogram(_aligned(spark, d), "subjective_score_action")


@query("merged_trials", ALIGN.join(["WITH ", " SELECT CASE WHEN NOT after THEN 'deterministic_zero' WHEN changed THEN 'rerun_glm_judge' ELSE 'reuse_old_scores' END AS subjective_score_action, count(*) * 21 AS trials, CAST(sum(CASE WHEN NOT after THEN 0 WHEN changed THEN 4 ELSE 3 END) * 21 AS BIGINT) AS total FROM al GROUP BY 1"]))
def merged_trials(spark, d):
    x = _aligned(spark, d)
    every = judge.expected_trials(x, a.DIMENSIONS)
    trials = lambda s: every.withColumns({"score": F.lit(s), "raw_output": F.lit(str(s)), "score_origin": F.lit("glm_judge")})
    return judge.merged_trials(trials(3), trials(4), x, a.DIMENSIONS, strict=False).groupBy("subjective_score_action").agg(F.count("*").alias("trials"), F.sum("score").cast("long").alias("total"))


# --- lengths, conditions, sampling -----------------------------------------------------------------------------------

DESCRIBE = "count({v}) AS n, min({v}) AS min, round(quantile_cont({v}, 0.5), 6) + 0.0 AS p50, round(quantile_cont({v}, 0.9), 6) + 0.0 AS p90, round(quantile_cont({v}, 0.95), 6) + 0.0 AS p95, round(quantile_cont({v}, 0.99), 6) + 0.0 AS p99, max({v}) AS max"


@query("length_distribution", "SELECT lang, " + DESCRIBE.format(v="n_chars") + ", count(*) FILTER (n_chars > 3000) AS over_3000, round(count(*) FILTER (n_chars > 3000) / count(*), 6) + 0.0 AS over_3000_rate FROM documents GROUP BY lang")
def length_distribution(spark, d):
    return rounded(lengths.described(a.table(spark, d, "documents"), "n_chars", ("lang",), (3000,)))


@query("nested_lengths", "SELECT model, benchmark, domain, CAST(grouping(benchmark, domain, model) AS INTEGER) AS grouping, count(DISTINCT (domain, instance_id)) AS instances, " + DESCRIBE.format(v="tokens") + " FROM (SELECT l_returnflag AS model, l_linestatus AS benchmark, CAST(l_linenumber AS VARCHAR) AS domain, l_orderkey AS instance_id, CAST(l_quantity AS INTEGER) AS tokens FROM lineitem) GROUP BY GROUPING SETS ((model), (benchmark, model), (benchmark, domain, model))")
def nested_lengths(spark, d):
    x = a.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("benchmark"), F.col("l_linenumber").cast("string").alias("domain"), F.col("l_orderkey").alias("instance_id"), F.col("l_quantity").cast("int").alias("tokens"))
    return rounded(lengths.nested(x, "tokens"))


LENGTHS = a.MANIFEST + ", conds AS (SELECT sample_id, 'p' || p AS prompt_id, benchmark FROM manifest, range(4) t(p)), lens AS (SELECT model, sample_id, prompt_id, benchmark, CAST(80 + (CAST(sample_id AS BIGINT) * 7 + CAST(right(prompt_id, 1) AS INTEGER) * 13 + length(model)) % 60 AS INTEGER) AS input_tokens FROM conds, (VALUES ('qwen'), ('llama'), ('mistral')) m(model) WHERE NOT (CAST(sample_id AS BIGINT) % 10 = 3 AND model = 'llama'))"


def _lengths(spark, d):
    c = checks.grid(spark, a.manifest(spark, d).select("sample_id", "benchmark"), prompt_id=tuple(f"p{i}" for i in range(4)))
    x = checks.grid(spark, c, model=keys.MODELS).where("not (cast(sample_id as bigint) % 10 = 3 and model = 'llama')")
    tokens = 80 + (F.col("sample_id").cast("long") * 7 + F.right("prompt_id", F.lit(1)).cast("int") * 13 + F.length("model")) % 60
    return c, x.withColumn("input_tokens", tokens.cast("int")).withColumn("over_budget", F.col("input_tokens") > 120)


@query("length_accounting", f"""WITH {LENGTHS}, c AS (SELECT sample_id, prompt_id, count(*) FILTER (input_tokens > 120) AS o, count(DISTINCT model) AS m FROM lens GROUP BY ALL)
SELECT (SELECT count(*) * 3 FROM conds) AS expected, (SELECT count(*) FROM lens) AS observed, CAST(0 AS BIGINT) AS duplicate_keys, (SELECT count(*) * 3 FROM conds) - (SELECT count(*) FROM lens) AS missing, CAST(0 AS BIGINT) AS unexpected, CAST(sum(o) AS BIGINT) AS overflow_records, count(*) FILTER (o > 0) AS overflow_conditions, count(DISTINCT sample_id) FILTER (o > 0) AS overflow_samples, count(*) FILTER (o = 0 AND m = 3) AS common_eligible FROM c""")  # fmt: skip
def length_accounting(spark, d):
    c, x = _lengths(spark, d)
    return lengths.accounting(x, c, keys.MODELS)


@query("grouped_lengths", f"WITH {LENGTHS}, g AS (SELECT input_tokens, 'by_model' AS grouping, model AS key FROM lens UNION ALL SELECT input_tokens, 'by_benchmark_model', benchmark || '::' || model FROM lens UNION ALL SELECT input_tokens, 'by_prompt_model', prompt_id || '::' || model FROM lens) SELECT grouping, key, " + DESCRIBE.format(v="input_tokens") + ", count(*) FILTER (input_tokens > 120) AS over_120, round(round(count(*) FILTER (input_tokens > 120) / count(*), 8), 6) + 0.0 AS over_120_rate FROM g GROUP BY grouping, key")
def grouped_lengths(spark, d):
    return rounded(lengths.grouped(_lengths(spark, d)[1], "input_tokens", 120))


@query("output_caps", "SELECT doc_id, CAST(ceil(n_chars * 1.3) AS INTEGER) + 64 AS cap FROM documents")
def output_caps(spark, d):
    return a.table(spark, d, "documents").select("doc_id", lengths.output_cap("n_chars", 1.3, 64).alias("cap"))


@query("stage_rollup", "SELECT l_linenumber AS stage_id, count(*) AS n, count(*) FILTER (l_quantity > 40) AS overflows, max(l_quantity) AS max_total FROM lineitem GROUP BY l_linenumber")
def stage_rollup(spark, d):
    return lengths.stage_rollup(a.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("stage_id"), (F.col("l_quantity") <= 40).alias("within_context"), F.col("l_quantity").alias("total_tokens")))


@query("hash_shards", f"WITH {a.SCORES}, h AS (SELECT model, sample_id, method, answer_seed, substr(sha256('[\"' || model || '\",\"' || sample_id || '\",\"' || method || '\",' || answer_seed || ']'), 1, 16) AS x FROM scores) SELECT model, sample_id, method, answer_seed, CAST(CAST('0x' || x AS UBIGINT) % 4 AS INTEGER) AS shard FROM h")
def hash_shards(spark, d):
    return a.scores(spark, d).select(*KEYS, keys.shard_of(4, ("model", "sample_id", "method")).alias("shard"))


@query("stride_shard", "SELECT event_id FROM events WHERE event_id % 5 = 2")
def stride_shard(spark, d):
    return sampling.stride_shard(a.table(spark, d, "events").select("event_id"), 2, 5, "event_id")


@query("seeded_sample", "SELECT c_custkey FROM customer ORDER BY sha256('7:' || c_custkey), c_custkey LIMIT 100")
def seeded_sample(spark, d):
    return sampling.sample(a.table(spark, d, "customer").select("c_custkey"), 100, 7, "c_custkey")


@query("balanced_sample", """WITH k AS (SELECT c_mktsegment AS s, row_number() OVER (ORDER BY c_mktsegment) AS i, count(*) OVER () AS k FROM (SELECT DISTINCT c_mktsegment FROM customer)),
r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('7:' || c_custkey), c_custkey) AS draw FROM customer)
SELECT c_custkey, c_mktsegment FROM r JOIN k ON c_mktsegment = s WHERE draw <= 53 // k + CASE WHEN i <= 53 % k THEN 1 ELSE 0 END""")  # fmt: skip
def balanced_sample(spark, d):
    return sampling.balanced(a.table(spark, d, "customer").select("c_custkey", "c_mktsegment"), 53, 7, "c_mktsegment", "c_custkey").select("c_custkey", "c_mktsegment")


@query("shuffled_order", f"WITH {a.MANIFEST} SELECT sample_id, CAST(row_number() OVER (ORDER BY sha256('9:' || sample_id), sample_id) - 1 AS INTEGER) AS manifest_index FROM manifest")
def shuffled_order(spark, d):
    return sampling.shuffled(a.manifest(spark, d).select("sample_id"), 9)


@query("random_targets", f"WITH {a.MANIFEST} SELECT sample_id, CAST(CAST('0x' || substr(sha256('3:' || sample_id), 1, 15) AS BIGINT) % candidate_document_count AS INTEGER) AS target FROM manifest")
def random_targets(spark, d):
    return a.manifest(spark, d).select("sample_id", sampling.random_index("sample_id", "candidate_document_count", 3).alias("target"))


@query("numbered_lines", "SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer")
def numbered_lines(spark, d):
    """JSON lines written in order and read again with their numbers over all files."""
    path = f"{shared_folder(spark)}/customers-{uuid.uuid4().hex[:12]}"
    write_jsonl(a.table(spark, d, "customer").select("c_custkey", "c_name"), path, ["c_custkey"])
    return read_lines(spark, path).select(F.from_json("value", "c_custkey long, c_name string").alias("x"), "place").select("x.*", "place")


@query("manifest_draw")
def manifest_draw(spark, d):
    """A manifest's draws as the sequential generator makes them: a sample, a balanced choice with targets, and the final order of both."""
    c = a.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("domain"), (F.col("c_nationkey") % 6 + 1).cast("int").alias("documents"))
    draws = Draws(7)
    one = draws.sample(c, 100, ["id"])
    two = Draws(8).choices(draws.balanced(c, 53, ["id"]), "documents")
    both = one.withColumn("target", F.lit(None).cast("long")).unionByName(two.withColumn("place", F.col("place") + 100))
    return draws.shuffled(both, name="manifest_index").select("manifest_index", "id", "domain", "target")


@query("first_documents", "SELECT l_suppkey, array_to_string(list(l_partkey ORDER BY i), ',') AS documents FROM (SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS i FROM lineitem) WHERE i <= 10 GROUP BY l_suppkey")
def first_documents(spark, d):
    x = a.table(spark, d, "lineitem").select("l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("o"), F.col("l_partkey").cast("string").alias("p"), F.lit("q").alias("query"))
    return sampling.first_documents(x, ["l_suppkey"], "o", "p").select("l_suppkey", F.array_join("documents", ",").alias("documents"))


@query("excluded_ids", "SELECT count(*) AS n FROM supplier WHERE s_suppkey NOT IN (1, 5, 9)")
def excluded_ids(spark, d):
    return sampling.without_ids(a.manifest(spark, d), ["1", "5", "9"]).agg(F.count("*").alias("n"))


@query("selected_in_order", "SELECT CAST(s_suppkey AS VARCHAR) AS sample_id, CASE s_suppkey WHEN 7 THEN 1 WHEN 3 THEN 2 ELSE 3 END AS place FROM supplier WHERE s_suppkey IN (7, 3, 9)")
def selected_in_order(spark, d):
    return sampling.in_given_order(a.manifest(spark, d), ["7", "3", "9"]).select("sample_id", F.col("place").cast("int").alias("place"))


#: whole texts in three parts of about the same length, short texts included
INSTANCES = "inst AS (SELECT doc_id, [substr(text, 1, k), substr(text, k + 1, k), substr(text, 2 * k + 1)] AS documents, CAST(doc_id % 3 AS INTEGER) AS t FROM (SELECT doc_id, coalesce(text, '') AS text, CAST((length(coalesce(text, '')) + 2) // 3 AS BIGINT) AS k FROM documents))"
CONDITIONS = "c AS (SELECT doc_id, p, list_transform(documents, lambda d, i: CASE WHEN p > 0 AND i = t + 1 THEN 'rewrite ' || p || ': ' || d ELSE d END) AS documents FROM inst, range(3) r(p)) SELECT doc_id AS sample_id, CASE p WHEN 0 THEN 'original.no_rewrite' ELSE 'p' || p END AS prompt_id, md5(array_to_string(documents, '|')) AS digest FROM c"
PROMPTS = "SELECT doc_id, 'Source 1:' || chr(10) || documents[1] || chr(10) || chr(10) || 'Source 2:' || chr(10) || documents[2]"


def _thirds(spark, d):
    t = F.coalesce("text", F.lit(""))
    k = F.ceil(F.length(t) / 3).cast("int")
    return a.table(spark, d, "documents").select("doc_id", F.array(F.substring(t, F.lit(1), k), F.substring(t, k + 1, k), F.substring(t, k * 2 + 1, F.length(t))).alias("documents"))


def _conditions(spark, docs):
    inst = docs.select(F.col("doc_id").alias("sample_id"), F.lit("b").alias("benchmark"), F.lit("d").alias("domain"), F.col("doc_id").cast("string").alias("instance_id"), F.lit("q").alias("query"), "documents", (F.col("doc_id") % 3).cast("int").alias("target_document_index"))
    target = F.get("documents", F.col("target_document_index"))
    rewrites = checks.grid(spark, inst, prompt_id=("p1", "p2")).select("sample_id", "prompt_id", target.alias("source_text"), F.concat(F.lit("rewrite "), F.right("prompt_id", F.lit(1)), F.lit(": "), target).alias("rewritten_text"))
    out = conditions.build(inst.drop("documents"), inst.drop("sample_id", "target_document_index", "query"), rewrites, ("p1", "p2"), imp.ORIGINAL, strict=False)
    return out.select("sample_id", "prompt_id", F.md5(F.array_join("documents", "|")).alias("digest"))


@query("conditions", f"WITH {INSTANCES}, {CONDITIONS}")
def conditions_query(spark, d):
    return _conditions(spark, _thirds(spark, d))


@query("source_prompts", f"WITH {INSTANCES} {PROMPTS} || chr(10) || chr(10) || 'Source 3:' || chr(10) || documents[3] AS sources, '[1], [2], [3]' AS labels FROM inst")
def source_prompts(spark, d):
    return _thirds(spark, d).select("doc_id", source_blocks("documents").alias("sources"), source_labels("documents").alias("labels"))


def _words_of_part(text: str, part: str) -> str:
    return f"coalesce(len(regexp_extract_all(substring({text}, 1, CAST(greatest(floor(length({text}) * {part}), 1) AS BIGINT)), '[^\\x20\\x09-\\x0D]+')), 0)"


TRUNCATION = f"""WITH RECURSIVE d AS (SELECT doc_id, substring(text, 1, CAST(ceil(length(text) / 2) AS BIGINT)) AS x, substring(text, CAST(ceil(length(text) / 2) AS BIGINT) + 1, length(text)) AS y FROM documents),
s AS (SELECT doc_id, x, y, CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high, 0 AS k FROM d UNION ALL
  SELECT doc_id, x, y, CASE WHEN n <= 300 THEN m ELSE low END, CASE WHEN n <= 300 THEN high ELSE m END, k + 1 FROM (SELECT *, {_words_of_part('x', 'm')} + {_words_of_part('y', 'm')} AS n FROM (SELECT *, (low + high) / 2 AS m FROM s WHERE k < 14))),
f AS (SELECT doc_id, x, y, CASE WHEN {_words_of_part('x', '1')} + {_words_of_part('y', '1')} <= 300 THEN CAST(1 AS DOUBLE) ELSE low END AS keep_fraction FROM s WHERE k = 14)
SELECT doc_id, keep_fraction, CAST({_words_of_part('x', 'keep_fraction')} + {_words_of_part('y', 'keep_fraction')} AS INTEGER) AS tokens_after FROM f"""


@query("prefix_truncation", TRUNCATION)
def prefix_truncation(spark, d):
    half = F.ceil(F.length("text") / 2).cast("int")
    x = a.table(spark, d, "documents").select("doc_id", F.array(F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))).alias("documents"))
    return lengths.prefix_truncated(x, "documents", 300).select("doc_id", "keep_fraction", "tokens_after")


# --- texts, registries, restarts, generation -------------------------------------------------------------------------


@query("identity_scan", " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS found FROM documents" for k, p in texts.IDENTITY.items()))
def identity_scan(spark, d):
    return texts.identity_matches(a.table(spark, d, "documents"), "doc_id", "text")


REPEAT = r"""WITH l AS (SELECT doc_id, trim(unnest(regexp_split_to_array(text, '\r\n|[\n\r]')), ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)) AS u FROM documents), p AS (SELECT doc_id, trim(unnest(regexp_split_to_array(text, '\n\s*\n')), ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)) AS u FROM documents),
c AS (SELECT doc_id, 'l' AS kind, u, count(*) AS n FROM l WHERE length(u) >= 80 GROUP BY ALL UNION ALL SELECT doc_id, 'p', u, count(*) FROM p WHERE length(u) >= 80 GROUP BY ALL), g AS (SELECT doc_id, sum(CASE WHEN kind = 'p' THEN n - 1 ELSE 0 END) AS more, max(CASE WHEN n >= 2 THEN n END) AS top FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST((SELECT count(*) FROM p WHERE p.doc_id = d.doc_id AND u <> '') AS INTEGER) AS paragraph_count, CAST(coalesce(more, 0) AS BIGINT) AS duplicate_long_paragraphs, coalesce(top, 0) AS max_identical_units FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id"""


@query("repetition", REPEAT)
def repetition(spark, d):
    return texts.repetition(a.table(spark, d, "documents"), "doc_id", "text").drop("repeated_example")


@query("registry_upsert", "SELECT o.o_orderkey, coalesce(n.s, o.o_orderstatus) AS o_orderstatus, o.o_orderpriority FROM orders o LEFT JOIN (SELECT o_orderkey, 'Z' AS s FROM orders WHERE o_orderkey % 9 = 0) n ON o.o_orderkey = n.o_orderkey UNION ALL SELECT -1, 'Z', NULL")
def registry_upsert(spark, d):
    o = a.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    new = o.where("o_orderkey % 9 = 0").select("o_orderkey").union(spark.range(1).select((F.col("id") - 1).alias("o_orderkey"))).withColumn("o_orderstatus", F.lit("Z"))
    return texts.upserted(o, new, "o_orderkey")


@query("last_rows", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 3")
def last_rows(spark, d):
    return texts.last_rows(a.table(spark, d, "events").select("event_id", "event_type"), "event_id")


@query("resume", "SELECT event_id FROM events WHERE event_id % 3 <> 0")
def resume(spark, d):
    e = a.table(spark, d, "events").select("event_id")
    return remaining(e, e.where("event_id % 3 = 0"), ["event_id"])


@query("changed_texts", "SELECT CASE WHEN doc_id % 10 = 0 THEN 'gone' WHEN doc_id % 10 = 1 THEN 'new' WHEN doc_id % 10 = 2 THEN 'changed' ELSE 'same' END AS state, count(*) AS n FROM documents GROUP BY 1")
def changed_texts(spark, d):
    x = a.table(spark, d, "documents").select("doc_id", "text")
    new = x.where("doc_id % 10 <> 0").withColumn("text", F.when(F.col("doc_id") % 10 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return changed(new, x.where("doc_id % 10 <> 1"), ["doc_id"], "text").groupBy("state").agg(F.count("*").alias("n"))


@query("generation", f"WITH {a.MANIFEST} SELECT CASE WHEN CAST(sample_id AS BIGINT) % 4 = 0 THEN 'input_budget_overflow' END AS error_type, count(*) AS n FROM manifest GROUP BY 1")
def generation_query(spark, d):
    m = a.manifest(spark, d)
    long = F.when(F.col("sample_id").cast("long") % 4 == 0, F.lit("many words in this query")).otherwise(F.lit("two words"))
    rows = m.select("sample_id", F.lit(0).alias("answer_seed"), F.array(F.struct(F.lit("user").alias("role"), long.alias("content"))).alias("messages"))
    return checks.histogram(generation.generated(rows, ["sample_id", "answer_seed"], generation.Stub, "answer", 16, budget=3), "error_type")


def _two_stages():
    return generation.Method("two", [generation.Stage("queries", lambda t, o, i: t), generation.Stage("final", lambda t, o, i: t + o["queries"][0], 2)])


#: The stub's outputs: five queries that carry the digest of their messages, then the first 512 words of the prompt after the digest of the final messages; messages as compact JSON with sorted keys.
STAGES_SQL = r"""WITH q AS (
  SELECT doc_id, t, sha256('[{"content":' || to_json(t) || ',"role":"user"}]') AS h FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
), o AS (
  SELECT doc_id, h, '{"queries": [' || array_to_string(list_transform(range(0, 5), lambda i: '{"query": "query ' || i || ' ' || left(h, 8) || '", "probability": ' || (100 - i) || '}'), ', ') || ']}' AS made, t FROM q
), f AS (
  SELECT doc_id, h, made, t || made AS prompt, sha256('[{"content":' || to_json(t || made) || ',"role":"user"}]') AS h2 FROM o
)
SELECT doc_id AS sample_id, CAST(3 AS INTEGER) AS calls, true AS ok, sha256(concat_ws('|', h, h2, h2)) AS messages_sha256,
  sha256('final ' || left(h2, 8) || ' 0: ' || array_to_string(list_slice(list_filter(string_split_regex(prompt, '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> ''), 1, 512), ' ')) AS output_sha256 FROM f"""


@query("stage_methods", STAGES_SQL)
def stage_methods(spark, d):
    m = _two_stages()
    docs = a.table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), F.lit("two").alias("method_id"), F.coalesce("text", F.lit("")).alias("source_text"))
    out = generation.rewritten(docs, {"two": m}, generation.Stub)
    messages = F.array_join(F.transform("stage_records", lambda r: r["messages_sha256"]), "|")
    return out.select("sample_id", F.size("stage_records").alias("calls"), F.col("error").isNull().alias("ok"), F.sha2(messages, 256).alias("messages_sha256"), F.sha2("rewritten_text", 256).alias("output_sha256"))


# --- trained sentence boundaries -------------------------------------------------------------------------------------


def _boundaries(spark, d):
    docs = a.table(spark, d, "documents").select("doc_id", "text")
    return docs, boundaries.fitted(stored(boundaries.neighbours(docs), "neighbours"))


@query("boundary_model", f"WITH {a.BOUNDARIES} SELECT 'abbreviation' AS kind, '' AS first, word, round(score, 6) + 0.0 AS score FROM abbreviations UNION ALL SELECT 'starter', '', word, 0.0 FROM starters UNION ALL SELECT 'collocation', lft, word, 0.0 FROM collocations")
def boundary_model(spark, d):
    m = _boundaries(spark, d)[1]
    none, zero = F.lit("").alias("first"), F.lit(0.0).alias("score")
    found = m.abbreviations.select(F.lit("abbreviation").alias("kind"), none, "word", "score")
    found = found.unionByName(m.starters.select(F.lit("starter").alias("kind"), none, "word", zero))
    return rounded(found.unionByName(m.collocations.select(F.lit("collocation").alias("kind"), F.col("left").alias("first"), "word", zero)))


@query("trained_sentences", f"WITH {a.BOUNDARIES} {a.BOUNDARY_SENTENCES}")
def trained_sentences(spark, d):
    docs, model = _boundaries(spark, d)
    found = model.sentences(docs)
    s = F.coalesce("sentences", F.array().cast("array<string>"))
    return found.select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.sha2(F.array_join(s, "\n"), 256).alias("sha256"))
