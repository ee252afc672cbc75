"""The evaluation's entities made from the driver's tables by rules that both engines can follow, and the same in SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample for each supplier."""
    n = 3 + F.col("s_suppkey") % 6
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("sample_id"), F.when(F.col("s_suppkey") % 2 == 0, "geo_bench").otherwise("cseo_bench").alias("benchmark"), F.col("s_nationkey").cast("string").alias("domain"),
        F.col("s_name").alias("query"), n.cast("int").alias("candidate_document_count"), (F.col("s_suppkey") % n).cast("int").alias("target_document_index"),
    )


MANIFEST = """manifest AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS sample_id, CASE WHEN s_suppkey % 2 = 0 THEN 'geo_bench' ELSE 'cseo_bench' END AS benchmark, CAST(s_nationkey AS VARCHAR) AS domain,
    s_name AS query, CAST(3 + s_suppkey % 6 AS INTEGER) AS candidate_document_count, CAST(s_suppkey % (3 + s_suppkey % 6) AS INTEGER) AS target_document_index
  FROM supplier)"""

ORIGINAL = "m1"
METHODS = tuple(f"m{i}" for i in range(1, 8))
MODELS = ("A", "N", "R")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both scores of 3 models, 7 methods (m1 is the original) and 3 seeds for each sample, with gaps where (sample + 5 method) % 17 is 0."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag", "l_linenumber", (F.col("l_orderkey") % 3).alias("seed")).agg(F.max("l_discount").alias("d"), F.max("l_quantity").alias("q"))
    rows = rows.where("l_linenumber = 1 or (l_suppkey + 5 * l_linenumber) % 17 <> 0")
    return rows.select(
        F.col("l_returnflag").alias("model"), F.col("l_suppkey").cast("string").alias("sample_id"), F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("method"), F.col("seed").cast("int").alias("answer_seed"),
        F.when(F.col("l_suppkey") % 2 == 0, "geo_bench").otherwise("cseo_bench").alias("benchmark"), (F.col("d") * 10 + 0.0).alias("objective"), (F.col("q") / 10 + 0.0).alias("subjective"),
    )


SCORES = """scores AS (
  SELECT l_returnflag AS model, CAST(l_suppkey AS VARCHAR) AS sample_id, 'm' || l_linenumber AS method, CAST(l_orderkey % 3 AS INTEGER) AS answer_seed,
    CASE WHEN l_suppkey % 2 = 0 THEN 'geo_bench' ELSE 'cseo_bench' END AS benchmark, max(l_discount) * 10 + 0.0 AS objective, max(l_quantity) / 10 + 0.0 AS subjective
  FROM lineitem WHERE l_linenumber = 1 OR (l_suppkey + 5 * l_linenumber) % 17 <> 0
  GROUP BY l_suppkey, l_returnflag, l_linenumber, l_orderkey % 3)"""

PAIRED = SCORES + """, paired AS (
  SELECT s.model, s.sample_id, s.benchmark, s.method, s.answer_seed, b.objective AS objective_before, s.objective AS objective_after, b.subjective AS subjective_before, s.subjective AS subjective_after,
    10 * (s.objective - b.objective) / (b.objective + 1) AS objective_improvement, 10 * (s.subjective - b.subjective) / (b.subjective + 1) AS subjective_improvement
  FROM scores s JOIN scores b ON s.model = b.model AND s.sample_id = b.sample_id AND s.answer_seed = b.answer_seed AND b.method = 'm1')"""

UNITS = PAIRED + """, units AS (
  SELECT model, sample_id, benchmark, method, avg(objective_improvement) AS objective, avg(subjective_improvement) AS subjective
  FROM paired GROUP BY model, sample_id, benchmark, method HAVING count(*) = 3 AND count(DISTINCT answer_seed) = 3)"""

RAW_UNITS = SCORES + """, raw AS (
  SELECT model, sample_id, benchmark, method, avg(objective) AS objective, avg(subjective) AS subjective
  FROM scores GROUP BY model, sample_id, benchmark, method HAVING count(*) = 3 AND count(DISTINCT answer_seed) = 3)"""

SUMMARY = UNITS + """, summary AS (
  SELECT model, benchmark, method, count(*) AS n, avg(objective) AS objective, avg(subjective) AS subjective FROM units GROUP BY model, benchmark, method)"""

#: forms of citation by (doc_id + piece) % 12
FORMS = ("", " [{k}]", " [{k}][{j}]", " [{k},{j}]", " [{k}-{k1}]", ". [{k}]", " [Source {k}]", " (Source {k})", " Source {k}", " [99]", " [0]", " [01]")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as answers: pieces between '. ' get a citation form each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = F.split("text", r"\. ")

    def of(p, i):
        k = ((F.col("doc_id") + i + 1) % 5 + 1).cast("int")
        form = (F.col("doc_id") + i + 1) % 12
        out = F.lit("")
        names = {"{k}": k, "{j}": k % 4 + 1, "{k1}": k + 1}
        for n, f in enumerate(FORMS):
            parts = [names[x].cast("string") if x in names else F.lit(x) for x in re.split(r"(\{k\}|\{j\}|\{k1\})", f)]
            out = F.when(form == n, F.concat(*parts)).otherwise(out)
        return F.concat(p, out)

    return docs.select("doc_id", F.lit(5).alias("source_count"), (F.col("doc_id") % 5).cast("int").alias("target_document_index"), F.array_join(F.transform(pieces, of), ". ").alias("answer"))


def _case() -> str:
    out = ""
    for n, f in enumerate(FORMS):
        e = "'" + f.replace("{k1}", "' || (k + 1) || '").replace("{k}", "' || k || '").replace("{j}", "' || (k % 4 + 1) || '") + "'"
        out += f" WHEN {n} THEN {e}"
    return out


PIECES = f"""pieces AS (
  SELECT doc_id, i, p, CAST((doc_id + i) % 5 + 1 AS INTEGER) AS k, (doc_id + i) % 12 AS form
  FROM (SELECT doc_id, unnest(string_split(text, '. ')) AS p, generate_subscripts(string_split(text, '. '), 1) AS i FROM documents)),
answers AS (
  SELECT doc_id, 5 AS source_count, CAST(doc_id % 5 AS INTEGER) AS target_document_index, string_agg(p || CASE form{_case()} END, '. ' ORDER BY i) AS answer FROM pieces GROUP BY doc_id)"""

#: what a judge may write, by (sample + dimension + seed) % 12; s stands for the score
RAW_FORMS = ("{s}", "[{s}]", "Score: {s}", "Final score: {s}", "{s}/5", "I would rate it a {s}.", "The score could be {s} or 3.", "No rating.", "Therefore {s}", "Because of this\n{s}.", "{s}, clearly", "Final answer: [{s}]")


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials of 7 dimensions and 3 seeds for each sample, with the judge's raw text."""
    m = manifest(spark, sf_dir)
    rows = m.select("sample_id", "target_document_index", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("d")).select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("judge_seed"))
    x = F.col("sample_id").cast("long")
    s = ((x + F.col("d") * 2 + F.col("judge_seed")) % 6).cast("string")
    form = (x + F.col("d") + F.col("judge_seed")) % 12
    raw = F.lit("")
    for n, f in enumerate(RAW_FORMS):
        a, _, b = f.partition("{s}")
        raw = F.when(form == n, F.concat(F.lit(a), s, F.lit(b)) if "{s}" in f else F.lit(f)).otherwise(raw)
    return rows.select(F.lit("qwen").alias("model"), "sample_id", F.lit("p").alias("prompt_id"), F.lit(0).alias("answer_seed"), F.concat(F.lit("d"), F.col("d").cast("string")).alias("dimension"), "judge_seed", (x % 3 != 0).alias("target_source_cited"), raw.alias("raw_output"))


DIMENSIONS = tuple(f"d{i}" for i in range(7))


def _raw_case() -> str:
    out = ""
    for n, f in enumerate(RAW_FORMS):
        e = "'" + f.replace("\n", "' || chr(10) || '").replace("{s}", "' || s || '") + "'"
        out += f" WHEN {n} THEN {e}"
    return out


TRIALS = MANIFEST + f""", trials AS (
  SELECT 'qwen' AS model, sample_id, 'p' AS prompt_id, 0 AS answer_seed, 'd' || d AS dimension, CAST(j AS INTEGER) AS judge_seed, x % 3 <> 0 AS target_source_cited, CASE form{_raw_case()} END AS raw_output
  FROM (SELECT sample_id, d, j, x, (x + d * 2 + j) % 6 AS s, (x + d + j) % 12 AS form
        FROM (SELECT sample_id, CAST(sample_id AS BIGINT) AS x, d, j FROM manifest, range(7) AS t1(d), range(3) AS t2(j))))"""

#: RE2 has no look-around: digits beside digits are told apart by what is around them
PARSED = TRIALS + """, rules AS (
  SELECT *, regexp_matches(raw_output, '^\\s*(\\[[0-5]\\]|[0-5])\\s*$') AS exact, regexp_matches(raw_output, '(?i)\\b(or|either|could|maybe|between)\\b') AS cue,
    regexp_extract_all(raw_output, '(?i)final\\s+(?:score|rating|answer)\\s*(?:is|[:=])?\\s*\\[?\\s*([0-5])\\s*\\]?', 1) AS finals,
    regexp_extract_all(raw_output, '(?i)(?:score|rating|answer)\\s*(?:is|[:=])?\\s*\\[?\\s*([0-5])\\s*\\]?', 1) AS labeled,
    regexp_extract_all(raw_output, '([0-5])\\s*(?:/|out\\s+of)\\s*5', 1) AS ratio, regexp_extract_all(raw_output, '(?i)(?:therefore|thus|hence|so)\\s*([0-5])', 1) AS concluding,
    regexp_extract(raw_output, '\\n\\s*([0-5])\\s*[.!]?\\s*$', 1) AS last_digit, regexp_extract(raw_output, '^\\s*([0-5])[\\s.,]', 1) AS lead_digit, list_distinct(regexp_extract_all(raw_output, '[0-5]')) AS digits
  FROM trials), parsed AS (
  SELECT * EXCLUDE (exact, cue, finals, labeled, ratio, concluding, last_digit, lead_digit, digits),
    CASE WHEN exact THEN CAST(regexp_extract(raw_output, '[0-5]') AS INTEGER)
      WHEN len(finals) > 0 THEN CASE WHEN len(list_distinct(finals)) = 1 THEN CAST(finals[1] AS INTEGER) END
      WHEN len(labeled) > 0 THEN CASE WHEN NOT cue AND len(list_distinct(labeled)) = 1 THEN CAST(labeled[1] AS INTEGER) END
      WHEN len(ratio) > 0 THEN CASE WHEN len(list_distinct(ratio)) = 1 THEN CAST(ratio[1] AS INTEGER) END
      WHEN len(concluding) > 0 THEN CASE WHEN len(list_distinct(concluding)) = 1 THEN CAST(concluding[1] AS INTEGER) END
      WHEN last_digit <> '' THEN CAST(last_digit AS INTEGER) WHEN cue THEN NULL WHEN lead_digit <> '' THEN CAST(lead_digit AS INTEGER) WHEN len(digits) = 1 THEN CAST(digits[1] AS INTEGER) END AS score,
    CASE WHEN exact THEN CASE WHEN contains(raw_output, '[') THEN 'exact_bracketed' ELSE 'exact_bare' END
      WHEN len(finals) > 0 THEN CASE WHEN len(list_distinct(finals)) = 1 THEN 'final_labeled' ELSE 'ambiguous_final_labeled' END
      WHEN len(labeled) > 0 THEN CASE WHEN cue THEN 'ambiguous_language' WHEN len(list_distinct(labeled)) = 1 THEN 'labeled' ELSE 'ambiguous_labeled' END
      WHEN len(ratio) > 0 THEN 'ratio' WHEN len(concluding) > 0 THEN 'concluding' WHEN last_digit <> '' THEN 'last_line' WHEN cue THEN 'ambiguous_language' WHEN lead_digit <> '' THEN 'leading'
      WHEN len(digits) = 1 THEN 'unique_numeric_candidate' ELSE 'ambiguous_or_missing' END AS score_parse_method
  FROM rules), ruled AS (
  SELECT * EXCLUDE (score), CASE WHEN target_source_cited THEN score ELSE 0 END AS score, score AS pre_absence_rule_score,
    CASE WHEN target_source_cited THEN 'glm_judge' ELSE 'deterministic_target_absence' END AS score_origin FROM parsed)"""
PARSED = PARSED.replace("\\\\", "\\")

#: Kiss and Strunk's statistics and decisions over documents, as boundaries.neighbours(), fitted() and decided() make them.
BOUNDARIES = r"""par AS MATERIALIZED (
  SELECT doc_id, unnest(string_split_regex(text, '\n[ \t]*\n')) AS p, generate_subscripts(string_split_regex(text, '\n[ \t]*\n'), 1) AS g FROM documents WHERE text IS NOT NULL
), chk AS MATERIALIZED (
  SELECT doc_id, g, unnest(w) AS c, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, g, list_filter(string_split_regex(p, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM par)
), raw AS MATERIALIZED (
  SELECT *, regexp_replace(bare, '^[^\p{L}\p{N}]+', '') AS rest FROM (SELECT *, regexp_replace(c, '\[\p{N}+\]', '', 'g') AS bare FROM chk)
), cut AS MATERIALIZED (
  SELECT *, regexp_extract(CASE WHEN rest = '' THEN bare ELSE rest END, '[^\p{L}\p{N}]*$', 0) AS tail, regexp_replace(rest, '[^\p{L}\p{N}]+$', '') AS core FROM raw
), tok AS MATERIALIZED (
  SELECT doc_id, g, i, c, CASE WHEN regexp_matches(core, '^\p{N}[\p{N}.,:]*$') THEN '##number##' ELSE lower(core) END AS word,
    CASE WHEN regexp_matches(tail, '[!?。！？]') THEN 'strong' WHEN regexp_matches(tail, '^[^.,;:]*\.\.+[^.,;:]*$') THEN 'dots' WHEN regexp_matches(tail, '^[^.,;:]*\.[^.,;:]*$') THEN 'stop' ELSE 'none' END AS mark,
    CASE WHEN regexp_matches(core, '^\p{Lu}') THEN 'upper' WHEN regexp_matches(core, '^\p{Ll}') THEN 'lower' ELSE 'none' END AS cas, regexp_matches(core, '^\p{L}$') AS ini FROM cut
), pos AS MATERIALIZED (
  SELECT *, coalesce(lag(mark) OVER w, 'start') AS bmark, lag(word) OVER w AS bword, lag(ini) OVER w AS bini FROM tok WINDOW w AS (PARTITION BY doc_id, g ORDER BY i)
), nb AS MATERIALIZED (
  SELECT bmark AS mark, CASE WHEN bmark IN ('stop', 'dots') THEN bword END AS lft, CASE WHEN bmark IN ('stop', 'dots') THEN bini END AS ini, word, cas, mark = 'stop' AS stop, count(*) AS n FROM pos GROUP BY ALL
), tot AS MATERIALIZED (
  SELECT CAST(sum(n) AS DOUBLE) AS words, CAST(coalesce(sum(n) FILTER (stop), 0) AS DOUBLE) AS stops FROM nb WHERE word <> ''
), typ AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS DOUBLE) AS n, CAST(coalesce(sum(n) FILTER (stop), 0) AS DOUBLE) AS ws FROM nb WHERE word <> '' GROUP BY word
), abbreviations AS MATERIALIZED (
  SELECT word, score FROM (
    SELECT word, -2 * ((ws * ln(greatest(stops / words, 1e-300)) + (n - ws) * ln(greatest(1 - stops / words, 1e-300))) - (ws * ln(0.99::DOUBLE) + (n - ws) * ln(1 - 0.99::DOUBLE)))
      * exp(-length(replace(word, '.', ''))) * (length(word) - length(replace(word, '.', '')) + 1) * pow(length(replace(word, '.', '')), -(n - ws)) AS score
    FROM typ, tot WHERE ws > 0 AND word <> '##number##') WHERE score >= 0.3
), seen AS MATERIALIZED (
  SELECT *, (mark = 'stop' AND NOT ab) OR mark = 'strong' AS fin, mark = 'start' OR (((mark = 'stop' AND NOT ab) OR mark = 'strong') AND NOT odd) AS certain, (mark = 'stop' AND (ab OR odd)) OR mark = 'dots' AS loose
  FROM (SELECT nb.*, a.word IS NOT NULL AS ab, coalesce(ini, false) OR coalesce(lft = '##number##', false) AS odd FROM nb LEFT JOIN abbreviations a ON a.word = nb.lft)
), brk AS MATERIALIZED (
  SELECT CAST(coalesce(sum(n), 0) AS DOUBLE) AS breaks FROM seen WHERE fin
), ab1 AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS DOUBLE) AS both_ FROM seen WHERE fin AND NOT odd AND regexp_matches(word, '^\p{L}+$') GROUP BY word
), ll1 AS MATERIALIZED (
  SELECT word, breaks AS a, n AS b, both_, words AS t FROM ab1 JOIN typ USING (word), tot, brk
), starters AS MATERIALIZED (
  SELECT word FROM (SELECT *, {LL} AS ll FROM ll1) WHERE ll >= 30 AND t / a > b / both_
), tg AS MATERIALIZED (
  SELECT lft, word, CAST(sum(n) AS DOUBLE) AS both_ FROM seen WHERE mark = 'stop' AND (ab OR odd) AND word <> '' AND lft <> '' GROUP BY lft, word
), ll2 AS MATERIALIZED (
  SELECT tg.lft, tg.word, x.n AS a, y.n AS b, both_, words AS t FROM tg JOIN typ x ON x.word = tg.lft JOIN typ y ON y.word = tg.word ANTI JOIN starters s ON s.word = tg.word, tot WHERE both_ > 1
), collocations AS MATERIALIZED (
  SELECT lft, word FROM (SELECT *, {LL} AS ll FROM ll2 WHERE a > 1 AND b > 1 AND both_ <= least(a, b)) WHERE ll >= 7.88 AND t / a > b / both_
), spl AS MATERIALIZED (
  SELECT word, bool_or(cas = 'upper') AS cap, bool_or(cas = 'lower') AS low, bool_or(cas = 'upper' AND NOT certain AND NOT loose) AS cap_in, bool_or(cas = 'lower' AND certain) AS low_begin FROM seen WHERE word <> '' GROUP BY word
), ask AS MATERIALIZED (
  SELECT q.*, CASE WHEN word = '' THEN false WHEN cas = 'upper' AND low AND NOT cap_in THEN true WHEN cas = 'lower' AND (cap OR NOT low_begin) THEN false END AS begins FROM (
    SELECT k.*, a.word IS NOT NULL OR k.mark = 'dots' AS ab, coalesce(k.ini, false) AS initial, c.word IS NOT NULL AS tog, s.word IS NOT NULL AS sta, coalesce(p.cap, false) AS cap, coalesce(p.low, false) AS low, coalesce(p.cap_in, false) AS cap_in, coalesce(p.low_begin, false) AS low_begin
    FROM (SELECT DISTINCT mark, lft, ini, word, cas FROM nb WHERE mark IN ('stop', 'dots')) k LEFT JOIN abbreviations a ON a.word = k.lft LEFT JOIN collocations c ON c.lft = k.lft AND c.word = k.word LEFT JOIN starters s ON s.word = k.word LEFT JOIN spl p ON p.word = k.word) q
), dec AS MATERIALIZED (
  SELECT mark, lft, ini, word, cas, CASE WHEN tog THEN false WHEN ab AND NOT initial AND (coalesce(begins, false) OR (cas = 'upper' AND sta)) THEN true
    WHEN (initial OR lft = '##number##') AND NOT coalesce(begins, true) THEN false WHEN initial AND begins IS NULL AND cas = 'upper' AND NOT low THEN false ELSE NOT ab END AS fin FROM ask
)""".replace(
    "{LL}",
    """-2 * (both_ * ln(greatest(b / t, 1e-300)) + (a - both_) * ln(greatest(1 - b / t, 1e-300)) + (b - both_) * ln(greatest(b / t, 1e-300)) + (t - a - b + both_) * ln(greatest(1 - b / t, 1e-300))
      - CASE WHEN a = both_ OR both_ / a <= 0 OR both_ / a >= 1 THEN 0 ELSE both_ * ln(greatest(both_ / a, 1e-300)) + (a - both_) * ln(greatest(1 - both_ / a, 1e-300)) END
      - CASE WHEN b = both_ OR (b - both_) / nullif(t - a, 0) <= 0 OR (b - both_) / nullif(t - a, 0) >= 1 THEN 0 ELSE (b - both_) * ln(greatest((b - both_) / nullif(t - a, 0), 1e-300)) + (t - a - b + both_) * ln(greatest(1 - (b - both_) / nullif(t - a, 0), 1e-300)) END)""",
)

BOUNDARY_SENTENCES = r""", num AS MATERIALIZED (
  SELECT p.doc_id, p.g, p.i, p.c, sum(CASE WHEN bmark IN ('start', 'strong') OR coalesce(dec.fin, false) THEN 1 ELSE 0 END) OVER (PARTITION BY p.doc_id ORDER BY p.g, p.i) AS s
  FROM pos p LEFT JOIN dec ON dec.mark = p.bmark AND dec.lft = p.bword AND dec.ini = p.bini AND dec.word = p.word AND dec.cas = p.cas
), sen AS MATERIALIZED (
  SELECT doc_id, s, string_agg(c, ' ' ORDER BY g, i) AS t FROM num GROUP BY doc_id, s
), fin AS MATERIALIZED (
  SELECT doc_id, count(*) AS n, string_agg(t, chr(10) ORDER BY s) AS t FROM sen GROUP BY doc_id
)
SELECT d.doc_id AS doc_id, coalesce(n, 0) AS n_sentences, sha256(coalesce(t, '')) AS sha256 FROM documents d LEFT JOIN fin ON fin.doc_id = d.doc_id"""


_HEADING = "(?:references|sources|bibliography|citations|参考文献|资料来源|来源)"
_NUMERIC = r"\[\s*\d+(?:\s*(?:,|-)\s*\d+)*\s*\]"
_LABELS = r"\(\s*Sources?\s+\d+(?:\s*[,，]\s*Sources?\s+\d+)+\s*\)"
_LINES = r"(?s).*?(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]|$)"
_UNIT = r"""([.!?。！？])(["''”’）)]*)[ \t]*((?:\[\d+\])+)"""


def _without_tails(source: str, name: str) -> str:
    """name: doc_id, n, t and k (kinds of the tails that went) of the rows doc_id, n, t of source, without reference lists at the end."""
    heading = f"(?i)^\\s*(?:#{{1,6}}\\s*)?{_HEADING}\\s*(?:[:：]?\\s*$|[:：])"
    divider = r"^\s*[-_*=—–]{3,}\s*$"
    bare = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    rstrip = lambda x: f"regexp_replace({x}, '\\s+$', '')"
    upto = lambda lines, stays: rstrip(f"coalesce(array_to_string(list_slice({lines}, 1, list_max(list_filter(range(1, len({lines}) + 1), lambda i: {stays(bare(lines + '[i]'))}))), ''), '')")
    note = r"(?i)(?:\n\s*\n)?\[\s*Sources?\s+not\s+used\s+in\s+the\s+answer\s*:[^\]\n]*\]\s*$"
    only = rf"^\s*(?:{_NUMERIC}(?:\s*[,;，；]?\s*)?)+[.!?。！？]?\s*$"
    placeholder = r"(?i)^\s*(?:[-*]\s*)?\[\s*\d+\s*\]\s*Sources?\s*(?:\[\s*\d+\s*\]|\d+)[.!?。！？]?\s*$"
    entry = r"(?m)^[ \t]*(?:[-*][ \t]+)?\[\d+\][ \t]+"
    evidence = r"(?i)https?://|\bdoi\b|\b(?:18|19|20)\d{2}\b|\(n\.d\.\)|^Sources?\s*\[\d+\]\s*:"
    return f"""{name}_r AS (
  SELECT doc_id, n, t, CAST([] AS VARCHAR[]) AS k FROM {source}
  UNION ALL
  SELECT doc_id, n, kept, list_append(k, kind) FROM (
    SELECT doc_id, n, t, k, CASE WHEN a <> '' AND length(a) < length(t) THEN 'explicit_unused_sources_note' WHEN b <> '' AND length(b) < length(t) THEN 'explicit_reference_section' WHEN c <> '' AND length(c) < length(t) THEN 'standalone_citation_paragraph' ELSE 'unheaded_numbered_bibliography' END AS kind, CASE WHEN a <> '' AND length(a) < length(t) THEN a WHEN b <> '' AND length(b) < length(t) THEN b WHEN c <> '' AND length(c) < length(t) THEN c WHEN d <> '' AND length(d) < length(t) THEN d END AS kept FROM (
      SELECT doc_id, n, t, k, CASE WHEN regexp_matches(t, '{note}') THEN {rstrip(f"regexp_replace(t, '{note}', '')")} END AS a,
        CASE WHEN h IS NOT NULL THEN {upto("list_slice(lines, 1, h - 1)", lambda x: f"{x} <> '' AND NOT regexp_matches({x}, '{divider}')")} END AS b,
        CASE WHEN len(gaps) > 0 AND {bare("last")} <> '' AND (regexp_matches({bare("last")}, '{only}') OR len(list_filter(rows_, lambda x: NOT regexp_matches(x, '{placeholder}'))) = 0) THEN {upto("before", lambda x: f"NOT regexp_matches({x}, '{divider}')")} END AS c,
        CASE WHEN f IS NOT NULL THEN {rstrip("array_to_string(list_transform(range(1, f + 1), lambda j: bodies[j] || CASE WHEN j < f THEN heads[j] ELSE '' END), '')")} END AS d
      FROM (
        SELECT *, list_max(list_filter(range(1, len(lines) + 1), lambda i: regexp_matches({bare("lines[i]")}, '{heading}'))) AS h,
          list_filter(string_split_regex({bare("last")}, '[\\n\\r\\x0b\\x0c\\x1c-\\x1e]'), lambda x: {bare("x")} <> '') AS rows_,
          list_filter(regexp_extract_all({rstrip("left(t, length(t) - length(last) - length(gaps[-1]))")}, '{_LINES}'), lambda x: x <> '') AS before,
          list_min(list_filter(range(1, len(heads)), lambda i: i > coalesce(list_max(list_filter(range(1, len(heads) + 1), lambda j: NOT regexp_matches(bodies[j + 1], '{evidence}'))), 0)
            AND regexp_matches(bodies[i], '\\n[ \\t]*\\n[ \\t]*$') AND (i > 1 OR regexp_matches(bodies[1], '\\S')))) AS f
        FROM (
          SELECT doc_id, n, t, k, list_filter(regexp_extract_all(t, '{_LINES}'), lambda x: x <> '') AS lines, regexp_extract_all(t, '\\n\\s*\\n') AS gaps, string_split_regex(t, '\\n\\s*\\n')[-1] AS last, string_split_regex(t, '{entry}') AS bodies, regexp_extract_all(t, '{entry}') AS heads FROM {name}_r))))
  WHERE kept IS NOT NULL
), {name} AS MATERIALIZED (
  SELECT doc_id, any_value(n) AS n, arg_max(t, len(k)) AS t, arg_max(k, len(k)) AS k FROM {name}_r GROUP BY doc_id
)"""


def _cut(source: str, name: str, pattern: str, token: str, more: str = "") -> str:
    """name: doc_id, n, t and `made`, structs that token makes of each match m with what is before it, b; their o goes into t."""
    return f"""{name}_c AS MATERIALIZED (
  SELECT doc_id, n{more}, string_split_regex(t, '{pattern}') AS segs, regexp_extract_all(t, '{pattern}') AS ms FROM {source}
), {name}_m AS MATERIALIZED (
  SELECT *, list_transform(range(1, len(ms) + 1), lambda i: {token.replace("{m}", "ms[i]").replace("{b}", "segs[i]")}) AS made FROM {name}_c
), {name} AS MATERIALIZED (
  SELECT doc_id, n{more}, made, array_to_string(list_transform(range(1, len(segs) + 1), lambda i: segs[i] || coalesce(made[i].o, '')), '') AS t FROM {name}_m
)"""


_NUMBERS = "list_transform(regexp_extract_all({m}, '\\d+'), lambda x: CAST(x AS BIGINT))"
_PARTS = "list_transform(string_split_regex(regexp_replace({m}, '^\\[\\s*|\\s*\\]$', '', 'g'), '\\s*,\\s*'), lambda p: {'f': CAST(regexp_extract(p, '^\\d+') AS BIGINT), 'l': CAST(regexp_extract(p, '\\d+$') AS BIGINT), 'x': len(string_split(p, '-'))})"
_IS_NUMERIC = "regexp_matches({m}, '^\\[\\s*\\d')"
_INSIDE = f"CASE WHEN {_IS_NUMERIC} THEN flatten(list_transform({_PARTS}, lambda p: CASE WHEN p.x > 2 OR p.f > p.l THEN [] ELSE range(greatest(p.f, 1), least(p.l, n) + 1) END)) ELSE list_filter({_NUMBERS}, lambda x: x BETWEEN 1 AND n) END"
_TEXT = f"array_to_string(list_transform(CASE WHEN {_IS_NUMERIC} THEN list_transform(list_filter(range(1, len({_INSIDE}) + 1), lambda j: list_position({_INSIDE}, ({_INSIDE})[j]) = j), lambda j: ({_INSIDE})[j]) ELSE {_INSIDE} END, lambda x: '[' || x || ']'), '')"
_TOKEN = f"""{{'o': CASE WHEN regexp_matches({{m}}, '(?i)^S') THEN regexp_extract({{m}}, '^\\w+') || CASE WHEN len({_INSIDE}) > 0 THEN ' ' || {_TEXT} ELSE '' END ELSE {_TEXT} END,
    'listed': regexp_matches({{m}}, '(?i)^{_LABELS}$'), 'plain': regexp_matches({{m}}, '(?i)^S'), 'numeric': {_IS_NUMERIC}, 'comma': {_IS_NUMERIC} AND contains({{m}}, ','), 'dash': {_IS_NUMERIC} AND contains({{m}}, '-'),
    'twice': CASE WHEN {_IS_NUMERIC} THEN len({_INSIDE}) - len(list_distinct({_INSIDE})) ELSE 0 END, 'bad': CASE WHEN {_IS_NUMERIC} THEN len(list_filter({_PARTS}, lambda p: p.x > 2 OR p.f > p.l)) ELSE 0 END,
    'gone': CASE WHEN {_IS_NUMERIC} THEN CAST(coalesce(list_sum(list_transform({_PARTS}, lambda p: CASE WHEN p.x > 2 OR p.f > p.l THEN 0 ELSE greatest(0, least(p.l, 0) - p.f + 1) + greatest(0, p.l - greatest(p.f, n + 1) + 1) END)), 0) AS BIGINT) ELSE len({_NUMBERS}) - len({_INSIDE}) END}}"""
_CLUSTER = r"\[\d+\](?:(?:[ \t]*,[ \t]*|[ \t]*)\[\d+\])*"
_ONCE = f"array_to_string(list_transform(list_filter(range(1, len({_NUMBERS}) + 1), lambda j: list_position({_NUMBERS}, ({_NUMBERS})[j]) = j), lambda j: '[' || ({_NUMBERS})[j] || ']'), '')"
_BLANK = """regexp_matches({b}, '[\\p{L}\\p{N})】}”’"'']$')"""
_CLOSED = f"{{'o': CASE WHEN {_BLANK} THEN ' ' ELSE '' END || {_ONCE}, 'twice': len({_NUMBERS}) - len(list_distinct({_NUMBERS})), 'changed': {_ONCE} <> {{m}}, 'blank': {_BLANK}}}"
_TOKENS = rf"(?i){_LABELS}|\[\s*Sources?\s*\d+\s*\]|\(\s*Sources?\s*\d+\s*\)|\bSources?\s+\d+\b|{_NUMERIC}"
_MOVED = f"{{'o': regexp_replace({{m}}, '{_UNIT}', ' \\3\\1\\2', 'g'), 'moved': len(regexp_extract_all({{m}}, '{_UNIT}'))}}"

#: canon: doc_id, t0 (the answer), t (its canonical form) and one column for each action, as canonical_column() makes them. Needs WITH RECURSIVE.
CANON = f"""{PIECES}, c_0 AS (SELECT doc_id, source_count AS n, answer AS t FROM answers), {_without_tails("c_0", "c_1")},
{_cut("c_1", "c_2", _TOKENS, _TOKEN)}, {_cut("c_2", "c_3", _CLUSTER, _CLOSED)}, {_cut("c_3", "c_4", f"(?:{_UNIT})+(?:\\s|$)".replace("((?:", "(?:(?:").replace("([.!", "(?:[.!").replace("(([", "(?:["), _MOVED)}, {_cut("c_4", "c_5", _CLUSTER, _CLOSED)},
c_6 AS MATERIALIZED (
  SELECT c_5.doc_id, c_5.n, regexp_replace(c_5.t, '((?:\\[\\d+\\])+)[ \\t]+([.!?。！？])', '\\1\\2', 'g') AS s, len(regexp_extract_all(c_5.t, '(?:\\[\\d+\\])+[ \\t]+[.!?。！？]')) AS spaced, coalesce(list_sum(list_transform(c_2.made, lambda x: x.gone)), 0) AS gone
  FROM c_5 JOIN c_2 USING (doc_id)
), c_7 AS MATERIALIZED (
  SELECT doc_id, n, spaced, gone, CASE WHEN gone > 0 THEN regexp_replace(s, '[ \\t]+([.!?。！？])', '\\1', 'g') ELSE s END AS t, CASE WHEN gone > 0 THEN len(regexp_extract_all(s, '[ \\t]+[.!?。！？]')) ELSE 0 END AS orphans FROM c_6
), {_without_tails("c_7", "c_8")}, canon AS MATERIALIZED (
  SELECT c_0.doc_id, c_0.t AS t0, regexp_replace(c_8.t, '\\s+$', '') AS t, c_1.k AS k1, c_8.k AS k2, spaced AS remove_space_before_final_punctuation, orphans AS remove_orphaned_space_before_punctuation, CAST(gone AS BIGINT) AS remove_invalid_or_out_of_range_label,
    len(list_filter(c_2.made, lambda x: x.listed)) AS convert_named_source_list, len(list_filter(c_2.made, lambda x: NOT x.listed AND NOT x.plain AND NOT x.numeric)) AS convert_named_source_label, len(list_filter(c_2.made, lambda x: x.plain)) AS convert_plain_source_number,
    len(list_filter(c_2.made, lambda x: x.comma)) AS split_combined_citation, len(list_filter(c_2.made, lambda x: x.dash)) AS expand_ranged_citation, CAST(coalesce(list_sum(list_transform(c_2.made, lambda x: x.bad)), 0) AS BIGINT) AS remove_invalid_range,
    CAST(coalesce(list_sum(list_transform(c_2.made, lambda x: x.twice)), 0) + coalesce(list_sum(list_transform(c_3.made, lambda x: x.twice)), 0) + coalesce(list_sum(list_transform(c_5.made, lambda x: x.twice)), 0) AS BIGINT) AS remove_duplicate_label,
    len(list_filter(c_3.made, lambda x: x.changed)) + len(list_filter(c_5.made, lambda x: x.changed)) AS compact_separate_citation_cluster, len(list_filter(c_3.made, lambda x: x.blank)) + len(list_filter(c_5.made, lambda x: x.blank)) AS insert_space_before_citation_cluster,
    CAST(coalesce(list_sum(list_transform(c_4.made, lambda x: x.moved)), 0) AS BIGINT) AS move_post_punctuation_citation
  FROM c_0 JOIN c_1 USING (doc_id) JOIN c_2 USING (doc_id) JOIN c_3 USING (doc_id) JOIN c_4 USING (doc_id) JOIN c_5 USING (doc_id) JOIN c_7 USING (doc_id) JOIN c_8 USING (doc_id)
)"""

CANON_ACTIONS = ("remove_space_before_final_punctuation", "remove_orphaned_space_before_punctuation", "remove_invalid_or_out_of_range_label", "convert_named_source_list", "convert_named_source_label", "convert_plain_source_number", "split_combined_citation", "expand_ranged_citation", "remove_invalid_range", "remove_duplicate_label", "compact_separate_citation_cluster", "insert_space_before_citation_cluster", "move_post_punctuation_citation")

_NAMED = r"(?i)(?:\[\s*Source\s+\d+\s*\]|\(\s*Source\s+\d+\s*\)|\bSource\s+\d+\b)"
_COMBINED = r"\[\s*\d+(?:\s*[-,]\s*\d+)+\s*\]"
_FINAL = r"""((?:\[\d+\])+)\s*[.!?。！？](?:["''”’)]*)$"""
_LIKE = r"(?i)(?:\[\s*(?:Source\s+)?\d[^\]\n]*\]|\(\s*Source\s+\d+\s*\)|\bSource\s+\d+\b)"

#: units: doc_id, n, answer and u, the sentence units of the strict and the optional contract.
STRICT_UNITS = PIECES + r""", cjk AS MATERIALIZED (
  SELECT doc_id, source_count AS n, answer, flatten(list_transform(string_split_regex(answer, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), lambda x: string_split(regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '([。！？])', '\1' || chr(1), 'g'), chr(1)))) AS p FROM answers
), units AS MATERIALIZED (
  SELECT doc_id, n, answer, list_filter(list_transform(flatten(list_transform(p, lambda x: string_split(regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '([.!?。！？])\s+([A-Z0-9"''“‘])', '\1' || chr(1) || '\2', 'g'), chr(1)))), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS u FROM cjk
)"""

#: v2: what citations.strict_diagnostics() says.
STRICT = STRICT_UNITS + f""", v2 AS MATERIALIZED (
  SELECT *, sentence_count > 0 AND sentence_count = compliant_sentence_count AND len(invalid) = 0 AND len(named) = 0 AND len(combined) = 0 AS contract_compliant FROM (
    SELECT doc_id, n, CAST(len(u) AS INTEGER) AS sentence_count, CAST(len(list_filter(u, lambda x: regexp_matches(x, '{_FINAL}'))) AS INTEGER) AS compliant_sentence_count,
      list_filter(list_transform(flatten(list_transform(regexp_extract_all(answer, '\\[(\\d+(?:\\s*[-,]\\s*\\d+)*)\\]', 1), lambda b: string_split_regex(b, '\\s*[,\\-]\\s*'))), lambda v: CAST(v AS BIGINT)), lambda v: v < 1 OR v > n) AS invalid,
      regexp_extract_all(answer, '{_NAMED}') AS named, regexp_extract_all(answer, '{_COMBINED}') AS combined FROM units)
)"""

#: v4: what contracts.optional_diagnostics() says. All tokens of a unit lie in its final block if there are as many of them in it as in the unit.
OPTIONAL = STRICT_UNITS + f""", each AS MATERIALIZED (
  SELECT doc_id, i, len(regexp_extract_all(x, '{_LIKE}')) AS likes, regexp_extract_all(x, '\\[(\\d+)\\]', 1) AS tokens, len(regexp_extract_all(regexp_extract(x, '{_FINAL}', 1), '\\[\\d+\\]')) AS final, regexp_matches(x, '{_NAMED}') OR regexp_matches(x, '{_COMBINED}') AS other, n
  FROM (SELECT doc_id, n, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM units)
), judged AS MATERIALIZED (
  SELECT *, likes > 0 AND NOT (len(tokens) > 0 AND final = len(tokens) AND likes = len(tokens) AND NOT other AND len(list_filter(tokens, lambda t: CAST(t AS BIGINT) NOT BETWEEN 1 AND n)) = 0) AS bad FROM each
), v4 AS MATERIALIZED (
  SELECT units.doc_id, coalesce(sentences, 0) AS sentences, coalesce(cited, 0) AS cited, coalesce(malformed, 0) AS malformed, coalesce(sentences, 0) > 0 AND malformed = 0 AND len(list_filter(regexp_extract_all(answer, '\\[(\\d+)\\]', 1), lambda t: CAST(t AS BIGINT) NOT BETWEEN 1 AND n)) = 0 AND NOT regexp_matches(answer, '{_NAMED}') AND NOT regexp_matches(answer, '{_COMBINED}')
    AND NOT regexp_matches(answer, '(?im)^\\s*(?:#{{1,6}}\\s*)?(?:references|sources|bibliography|参考文献|资料来源|来源)\\s*:?\\s*$') AND NOT regexp_matches(answer, '(?im)^\\s*(?:[-*+]\\s*)?(?:Source|来源)\\s+\\d+\\s*:\\s*\\S+') AS compliant
  FROM (SELECT doc_id, count(*) AS sentences, count(*) FILTER (likes > 0) AS cited, count(*) FILTER (bad) AS malformed FROM judged GROUP BY doc_id) g RIGHT JOIN units ON units.doc_id = g.doc_id
)"""
