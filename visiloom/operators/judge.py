"""Judge trials: expected grids, zero and rerun plans, parsing, strict checks, scores; alignment of old scores with new text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.citations import cites, separate_citations
from ..functions.keys import ANSWER_KEY, DIMENSIONS, SEEDS, TRIAL_KEY
from ..functions.scores import parsed_score
from ..sources.scratch import stored
from .checks import grid, required, union_all


def targets(manifest: DataFrame) -> DataFrame:
    """sample_id, target_document_index, target_citation_index, candidate_document_count; an index out of range raises."""
    ok = (F.col("target_document_index") >= 0) & (F.col("target_document_index") < F.col("candidate_document_count"))
    index = F.when(ok, F.col("target_document_index") + 1).otherwise(F.raise_error(F.lit("target index out of range")).cast("int"))
    return manifest.select("sample_id", "target_document_index", index.alias("target_citation_index"), "candidate_document_count")


def resolved_query(answers: DataFrame, manifest: DataFrame) -> DataFrame:
    """answers with query and query_source: the answer's own, which must be the manifest's, or else the manifest's."""
    m = manifest.select("sample_id", F.col("query").alias("manifest_query"))
    own = F.col("query")
    query = F.when(own.isNull() | (own == ""), F.col("manifest_query")).when(own == F.col("manifest_query"), own).otherwise(F.raise_error(F.lit("the answer's query is not the manifest's")).cast("string"))
    return answers.join(m, "sample_id").withColumn("query_source", F.when(own.isNull() | (own == ""), "manifest").otherwise("answer")).withColumn("query", query).drop("manifest_query")


def expected_trials(answers: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    return grid(answers.sparkSession, answers.select(*ANSWER_KEY), dimension=dimensions, judge_seed=seeds)


def with_target_cited(answers: DataFrame, manifest: DataFrame, answer: str = "answer") -> DataFrame:
    t = targets(manifest)
    return answers.join(t, "sample_id").withColumn("target_source_cited", cites(answer, "target_citation_index"))


def zero_trials(answers: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """Trials of answers that don't cite the target: score 0 on each dimension and seed, without a model call."""
    rows = grid(answers.sparkSession, answers.where(~F.col("target_source_cited")).select(*ANSWER_KEY), dimension=dimensions, judge_seed=seeds)
    return rows.select("*", F.lit(0).alias("score"), F.lit(None).cast("string").alias("raw_output"), F.lit("deterministic_target_absence").alias("score_origin"))


def rerun_plan(aligned: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    return grid(aligned.sparkSession, aligned.where("subjective_score_action = 'rerun_glm_judge'").select(*ANSWER_KEY), dimension=dimensions, judge_seed=seeds)


def reparsed(trials: DataFrame, raw: str = "raw_output", stored: str = "score") -> DataFrame:
    """Scores parsed anew from the raw output; the stored one is kept as stored_score."""
    df = trials.withColumnRenamed(stored, "stored_score") if stored in trials.columns else trials.withColumn("stored_score", F.lit(None).cast("int"))
    return df.withColumn("p_", parsed_score(raw)).withColumns({"score": F.col("p_.score"), "score_parse_method": F.col("p_.method")}).drop("p_")


def absence_rule(trials: DataFrame) -> DataFrame:
    """Score 0 where the target isn't cited, whatever the judge said; that stays as pre_absence_rule_score."""
    absent = ~F.col("target_source_cited")
    overridden = absent & ~F.coalesce(F.col("score") == 0, F.lit(False))
    return trials.withColumn("pre_absence_rule_score", F.col("score")).withColumn("overridden", overridden).withColumn("score", F.when(absent, 0).otherwise(F.col("score"))).withColumn("score_origin", F.when(absent, "deterministic_target_absence").otherwise("glm_judge"))


def trial_defects(trials: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """Trials outside the grid, without a score from 0 to 5, or whose origin contradicts the citation flag."""
    zero = F.col("score_origin") == "deterministic_target_absence"
    problems = F.array_compact(F.array(
        F.when(~F.col("dimension").isin(*dimensions), "dimension"), F.when(~F.col("judge_seed").isin(*seeds), "judge_seed"),
        F.when(F.coalesce(~F.col("score").between(0, 5), F.lit(True)), "score"), F.when(zero & F.coalesce(F.col("score") != 0, F.lit(True)), "zero_score"), F.when(zero == F.col("target_source_cited"), "origin"),
    ))
    return trials.select(*TRIAL_KEY, problems.alias("problems")).where(F.size("problems") > 0)


def dimension_scores(trials: DataFrame) -> DataFrame:
    """Per answer and dimension: trial scores by seed, the valid ones, their mean, and whether there is any."""
    g = trials.groupBy(*ANSWER_KEY, "dimension").agg(F.array_sort(F.collect_list(F.struct("judge_seed", "score"))).alias("trials"))
    valid = F.filter(F.transform("trials", lambda t: t["score"]), lambda s: s.isNotNull())
    g = g.withColumn("valid_scores", valid)
    mean = F.when(F.size("valid_scores") > 0, F.aggregate("valid_scores", F.lit(0.0), lambda a, x: a + x) / F.size("valid_scores"))
    return g.withColumn("mean_score", mean).withColumn("scorable", F.size("valid_scores") > 0)


def judge_scores(trials: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, seeds: tuple[int, ...] = SEEDS, strict: bool = False) -> DataFrame:
    """Per answer: the dimensions as a map, the mean of their means, and whether all have scores. strict: every dimension has exactly these seeds, all scored."""
    d = dimension_scores(trials)
    if strict:
        required(trial_defects(trials, dimensions, seeds), "trials")
        whole = (F.transform("trials", lambda t: t["judge_seed"].cast("int")) == F.array(*[F.lit(s) for s in sorted(seeds)])) & (F.size("valid_scores") == len(seeds))
        required(d.where(~whole), "seeds of a dimension")
    out = d.groupBy(*ANSWER_KEY).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("dimension", F.struct("trials", "valid_scores", "mean_score", "scorable"))))).alias("dimensions"),
        F.avg("mean_score").alias("subjective_average"), F.count_if("scorable").alias("n_scorable"), F.count("*").alias("n_dimensions"),
    )
    if strict:
        required(out.where(F.col("n_dimensions") != len(dimensions)), "dimensions of an answer")
    return out.withColumn("all_dimensions_scorable", F.col("n_scorable") == len(dimensions))


def alignment(raw: DataFrame, canonical: DataFrame, manifest: DataFrame, strict: bool = True) -> DataFrame:
    """What to do with the old judge scores of each answer once its text has been canonicalised.

    Not cited any more: zeros. Text changed: judge again. Else: reuse. Raw and canonical answers must be the same set and agree in benchmark and domain."""

    def brief(answers: DataFrame, side: str, benchmark: str, domain: str) -> DataFrame:
        """A digest and the separate citations of each text: texts themselves don't move."""
        cited = F.array_distinct(separate_citations("answer"))
        return answers.select(*ANSWER_KEY, F.col("benchmark").alias(benchmark), F.col("domain").alias(domain), F.sha2("answer", 256).alias(f"{side}_sha256"), cited.alias(f"{side}_cited"))

    a, b = brief(raw, "raw", "benchmark", "domain"), brief(canonical, "canonical", "b2", "d2")
    j = a.join(b, ANSWER_KEY, "full")
    if strict:
        required(j.where("raw_sha256 is null or canonical_sha256 is null or not (benchmark <=> b2) or not (domain <=> d2)").select(*ANSWER_KEY), "raw and canonical answers differ")
    j = j.where("raw_sha256 is not null and canonical_sha256 is not null").join(targets(manifest), "sample_id")
    before, after = (F.coalesce(F.array_contains(f"{side}_cited", F.col("target_citation_index")), F.lit(False)) for side in ("raw", "canonical"))
    changed = F.col("raw_sha256") != F.col("canonical_sha256")
    action = F.when(~after, "deterministic_zero").when(changed, "rerun_glm_judge").otherwise("reuse_old_scores")
    return j.select(*ANSWER_KEY, "benchmark", "domain", "target_document_index", "target_citation_index", "candidate_document_count", before.alias("raw_target_source_cited"), after.alias("canonical_target_source_cited"), changed.alias("canonicalized_text_changed"), action.alias("subjective_score_action"), F.col("raw_sha256").alias("source_answer_sha256"), F.col("canonical_sha256").alias("canonicalized_answer_sha256"))


def merged_trials(old: DataFrame, rerun: DataFrame, aligned: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, seeds: tuple[int, ...] = SEEDS, strict: bool = True) -> DataFrame:
    """Old trials of answers to reuse, new ones of answers judged again, zeros of the rest; strict: the whole expected grid, once. The alignment is stored, as each of them reads it."""
    aligned = stored(aligned, "aligned")
    action = aligned.select(*ANSWER_KEY, "subjective_score_action", F.col("canonical_target_source_cited").alias("target_source_cited"))
    columns = [*TRIAL_KEY, "score", "raw_output", "score_origin", "subjective_score_action", "target_source_cited"]

    def of(trials: DataFrame, name: str) -> DataFrame:
        return trials.drop("subjective_score_action", "target_source_cited").join(action.where(F.col("subjective_score_action") == name), ANSWER_KEY).withColumn("score_origin", F.lit("glm_judge")).select(*columns)

    zeros = zero_trials(action, dimensions, seeds).withColumns({"subjective_score_action": F.lit("deterministic_zero"), "target_source_cited": F.lit(False)}).select(*columns)
    out = union_all([of(old, "reuse_old_scores"), of(rerun, "rerun_glm_judge"), zeros])
    if strict:
        n = out.groupBy(*TRIAL_KEY).agg(F.count("*").alias("n"))
        whole = expected_trials(aligned, dimensions, seeds).join(n, TRIAL_KEY, "full")
        required(whole.where("n is null or n <> 1"), "merged trials don't cover the grid once")
    return out


def old_score_defects(scores: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """Stored judge scores that don't follow from their own trials: seeds, range, means (1e-12)."""
    values = F.map_values("dimensions")
    bad_seeds = F.exists(values, lambda d: F.transform(d["trials"], lambda t: t["judge_seed"].cast("int")) != F.array(*[F.lit(s) for s in sorted(seeds)]))
    bad_range = F.exists(values, lambda d: F.exists(d["valid_scores"], lambda s: (s < 0) | (s > 5)))
    bad_mean = F.exists(values, lambda d: F.abs(d["mean_score"] - F.aggregate(d["valid_scores"], F.lit(0.0), lambda a, x: a + x) / F.size(d["valid_scores"])) > 1e-12)
    grand = F.aggregate(values, F.lit(0.0), lambda a, d: a + d["mean_score"]) / F.size(values)
    problems = F.array_compact(F.array(F.when(F.size("dimensions") != len(dimensions), "dimensions"), F.when(bad_seeds, "seeds"), F.when(bad_range, "range"), F.when(bad_mean, "mean"), F.when(F.abs(grand - F.col("subjective_average")) > 1e-12, "average")))
    return scores.select(*ANSWER_KEY, problems.alias("problems")).where(F.size("problems") > 0)


def incremental_plan(new: DataFrame, scored: DataFrame, manifest: DataFrame) -> DataFrame:
    """key, action: only answers that changed since they were scored and cite the target are judged again."""
    a = new.select(*ANSWER_KEY, F.sha2("answer", 256).alias("new_sha256"), F.array_distinct(separate_citations("answer")).alias("cited"))  # texts themselves don't move
    b = scored.select(*ANSWER_KEY, F.sha2("answer", 256).alias("scored_sha256"))
    j = a.join(b, ANSWER_KEY, "full").join(targets(manifest), "sample_id")
    cited = F.coalesce(F.array_contains("cited", F.col("target_citation_index")), F.lit(False))
    action = F.when(F.col("new_sha256").isNull(), "missing").when(F.col("scored_sha256").isNull(), "unscored").when(~cited, "deterministic_zero").when(F.col("new_sha256") != F.col("scored_sha256"), "rerun_glm_judge").otherwise("reuse_old_scores")
    return j.select(*ANSWER_KEY, action.alias("action"))
