"""Relational operators against hand-computed cases, published figures and the standard library."""

import random

import pytest
from pyspark.sql import functions as F

from visiloom.functions import keys, templates
from visiloom.operators import bootstrap, checks, conditions, generation, improvement, judge, lengths, sampling, texts


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


SCORES = "model string, sample_id string, method string, answer_seed int, benchmark string, objective double, subjective double"


def test_improvement_per_seed_then_sample(spark):
    rows = []
    for seed, (before, after) in enumerate([(0.0, 1.0), (1.0, 0.0), (1.0, 1.0)]):
        rows += [("m", "s", "original.no_rewrite", seed, "b", before, before), ("m", "s", "x", seed, "b", after, after)]
    s = frame(spark, rows, SCORES)
    assert improvement.paired(s).count() == 6
    got = {r.method: r.objective for r in improvement.units(s).collect()}
    assert got["x"] == pytest.approx((10 - 5 + 0) / 3) and got["original.no_rewrite"] == 0
    assert improvement.units(s.where("not (method = 'x' and answer_seed = 2)")).where("method = 'x'").count() == 0
    with pytest.raises(checks.IntegrityError):
        improvement.units(s.where("not (method = 'x' and answer_seed = 2)"), strict=True)
    with pytest.raises(checks.IntegrityError):
        improvement.joined_scores(s, s.limit(3), ["model", "sample_id", "method", "answer_seed"])


def test_paired_subset(spark):
    rows = [("m", "s1", "original.no_rewrite", 0, "b", 0.0, 1.0), ("m", "s2", "original.no_rewrite", 0, "b", 1.0, 1.0), ("m", "s1", "x", 0, "b", 1.0, 2.0)]
    u = improvement.raw_units(frame(spark, rows, SCORES), seeds=(0,))
    x = improvement.paired_summary(u).where("method = 'x'").first()
    assert (x.n, x.objective_before, x.subjective_delta, x.objective_up) == (1, 0.0, 1.0, 1)


def test_relative_is_null_at_zero(spark):
    got = frame(spark, [(0.2, 0.3), (0.0, 0.3)], "b double, o double").select(improvement.paired_improvement(F.col("b"), F.col("o")).alias("p")).collect()
    assert got[0].p.relative_percent == pytest.approx(50) and got[1].p.relative_percent is None and got[1].p.delta == 0.3


def test_winners_keep_ties_rankings_do_not(spark):
    s = frame(spark, [("m", "b", x, 1, v, v) for x, v in (("p", 1.0), ("q", 1.0), ("r", 0.5))], "model string, benchmark string, method string, n int, objective double, subjective double")
    assert {r.method for r in improvement.winners(s).where("metric = 'objective'").collect()} == {"p", "q"}
    assert [r.method for r in improvement.rankings(s).where("metric = 'objective' and is_top").collect()] == ["p"]


def test_reversals(spark):
    values = {("a", "p"): 1.0, ("a", "q"): 2.0, ("b", "p"): 2.0, ("b", "q"): 1.0, ("c", "p"): 1.0, ("c", "q"): 1.0}
    s = frame(spark, [(m, "x", k, 1, v, 1.0) for (m, k), v in values.items()], "model string, benchmark string, method string, n int, objective double, subjective double")
    r = improvement.method_reversals(s, ("a", "b", "c")).collect()
    assert [(x.method_a, x.method_b, x.a, x.b, x.c) for x in r] == [("p", "q", -1.0, 1.0, 0.0)]
    assert [(x.model_a, x.model_b, x.strength) for x in improvement.rank_reversals(s).collect()] == [("a", "b", 1.0)]
    assert {(x.metric, x.reversals) for x in improvement.reversal_counts(improvement.method_reversals(s, ("a", "b", "c")), improvement.long_metrics(s, ["benchmark"])).collect()} == {("objective", 1), ("subjective", 0)}


def test_accounting(spark):
    e, s, f = (frame(spark, [(x,) for x in v], "k string") for v in ("abcd", "abbx", "cb"))
    assert {r.status: r.n for r in checks.accounting(e, s, f, ["k"]).collect()} == {"success": 1, "overlap": 1, "error": 1, "missing": 1, "unexpected": 1}
    assert [r.k for r in checks.missing(e, s, ["k"]).orderBy("k").collect()] == ["c", "d"]
    assert checks.same_set(e, e, ["k"]).first().equal_sets and not checks.same_set(e, s, ["k"]).first().equal_sets
    assert [r.k for r in checks.duplicates(s, ["k"]).collect()] == ["b"]
    assert checks.progress(e, s.where("k <> 'x'"), f, ["k"]).first().percent == 75.0
    assert not checks.all_passed(checks.integrity({"d": checks.duplicates(s, ["k"]), "none": e.limit(0)})).first().integrity


@pytest.mark.parametrize("n", [2, 3, 7, 64, 1000])
def test_resamples_of_a_share_are_those_of_the_whole(n):
    values = [random.Random(n * 31 + i).uniform(-3, 5) for i in range(n)]
    rng = random.Random(99)
    want = [sum(values[rng.randrange(n)] for _ in range(n)) / n for _ in range(300)]
    assert [m for first in range(0, 300, 75) for m in bootstrap.resampled_means(values, 99, first, first + 75)] == want


def test_bootstrap_is_that_of_the_standard_library(spark):
    values = [0.1, 0.5, 0.9, 0.4]
    rng = random.Random(bootstrap.stable_seed(7, "('b', 'm'):v"))
    means = sorted(sum(values[rng.randrange(4)] for _ in range(4)) / 4 for _ in range(50))
    df = frame(spark, [("b", "m", f"s{i}", v) for i, v in enumerate(values)], "benchmark string, model string, sample_id string, v double").repartition(3)
    r = bootstrap.intervals(df, ["benchmark", "model"], ["v"], resamples=50, seed=7).first()
    assert (r.v_ci_low, r.v_ci_high) == (bootstrap.linear_percentile(means, 0.025), bootstrap.linear_percentile(means, 0.975))
    one = bootstrap.intervals(df.limit(1), ["benchmark", "model"], ["v"], resamples=5).first()
    assert one.v_ci_low == one.v_ci_high == one.v_mean
    assert bootstrap.linear_percentile([1, 2, 4, 10], 0.9) == pytest.approx(8.2)


def judge_setup(spark):
    manifest = frame(spark, [(s, 3, 1) for s in ("reuse", "rerun", "zero")], "sample_id string, candidate_document_count int, target_document_index int")
    schema = "model string, sample_id string, prompt_id string, answer_seed int, benchmark string, domain string, answer string"
    raw = frame(spark, [("q", "reuse", "p", 0, "b", "d", "A [2]."), ("q", "rerun", "p", 0, "b", "d", "A [Source 2]."), ("q", "zero", "p", 0, "b", "d", "A [1].")], schema)
    canonical = raw.withColumn("answer", F.replace("answer", F.lit("Source "), F.lit("")))
    return manifest, raw, canonical


def test_alignment_and_merge(spark):
    manifest, raw, canonical = judge_setup(spark)
    aligned = judge.alignment(raw, canonical, manifest)
    assert {r.sample_id: r.subjective_score_action for r in aligned.collect()} == {"reuse": "reuse_old_scores", "rerun": "rerun_glm_judge", "zero": "deterministic_zero"}
    assert judge.rerun_plan(aligned).count() == 21
    every = judge.expected_trials(aligned).withColumns({"score": F.lit(3), "raw_output": F.lit("3"), "score_origin": F.lit("glm_judge")})
    merged = judge.merged_trials(every, every, aligned)
    assert merged.count() == 63
    scores = judge.judge_scores(merged, strict=True)
    assert {r.sample_id: r.subjective_average for r in scores.collect()} == {"reuse": 3.0, "rerun": 3.0, "zero": 0.0}
    assert judge.old_score_defects(scores).count() == 0
    with pytest.raises(checks.IntegrityError):
        judge.merged_trials(every, every.limit(5), aligned)
    with pytest.raises(checks.IntegrityError):
        judge.alignment(raw, canonical.limit(2), manifest)
    plan = judge.alignment(raw, canonical, manifest, strict=False)._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join FullOuter") if "Join FullOuter" in plan else plan.index("Join"):].splitlines()
    assert "sha2" in "".join(join[1:]) and "sha2" not in join[0]  # digests are made below the join
    plan = judge.incremental_plan(canonical, raw, manifest)
    assert {r.sample_id: r.action for r in plan.collect()} == {"reuse": "reuse_old_scores", "rerun": "rerun_glm_judge", "zero": "deterministic_zero"}


def test_judge_scores_keep_missing(spark):
    rows = [("q", "s", "p", 0, d, j, None if d == "follow_detailed" else j + 1) for d in keys.DIMENSIONS for j in (0, 1, 2)]
    r = judge.judge_scores(frame(spark, rows, "model string, sample_id string, prompt_id string, answer_seed int, dimension string, judge_seed int, score int")).first()
    assert r.dimensions["follow_detailed"].mean_score is None and not r.all_dimensions_scorable and r.subjective_average == 2.0


def test_conditions(spark):
    manifest = frame(spark, [("s", "b", "d", "i", "q", 1)], "sample_id string, benchmark string, domain string, instance_id string, query string, target_document_index int")
    inst = frame(spark, [("b", "d", "i", ["other", "original", "last"])], "benchmark string, domain string, instance_id string, documents array<string>")
    methods = tuple(f"m{i}" for i in range(7))
    rewrites = frame(spark, [("s", m, "original", f"new {m}") for m in methods], "sample_id string, prompt_id string, source_text string, rewritten_text string")
    out = conditions.build(manifest, inst, rewrites, methods, "original.no_rewrite")
    assert out.count() == 8
    assert {tuple(r.documents) for r in out.collect()} == {("other", f"new {m}", "last") for m in methods} | {("other", "original", "last")}
    declared = frame(spark, [("s", "m0")], "sample_id string, prompt_id string")
    assert conditions.build(manifest, inst, rewrites.where("prompt_id <> 'm0'"), methods, "original.no_rewrite", declared).count() == 7
    bad = [rewrites.unionByName(rewrites.limit(1)), rewrites.where("prompt_id <> 'm0'"), rewrites.withColumn("source_text", F.lit("x")), rewrites.withColumn("sample_id", F.lit("foreign")), rewrites.withColumn("rewritten_text", F.lit(" "))]
    for b in bad:
        with pytest.raises(checks.IntegrityError):
            conditions.build(manifest, inst, b, methods, "original.no_rewrite")
    with pytest.raises(checks.IntegrityError):
        conditions.build(manifest, inst, rewrites, methods, "original.no_rewrite", declared)


def test_truncation(spark):
    from visiloom.functions.jsontext import input_hash

    c = frame(spark, [("s", "p", "b", "d", "q", ["first source", "second source"])], "sample_id string, prompt_id string, benchmark string, domain string, query string, documents array<string>")
    short = c.withColumn("documents", F.array(F.lit("first"), F.lit("second")))
    o = short.withColumn("truncated_input_sha256", input_hash("benchmark", "domain", "query", "documents")).join(c.withColumn("original_input_sha256", input_hash("benchmark", "domain", "query", "documents")).select("sample_id", "original_input_sha256"), "sample_id")
    o = o.select("sample_id", "prompt_id", F.lit("v7").alias("protocol"), "original_input_sha256", "truncated_input_sha256", "documents")
    r = conditions.truncated(c, o, "v7").first()
    assert r.documents == ["first", "second"] and r.source_truncated
    for bad in (o.withColumn("protocol", F.lit("v6")), o.withColumn("documents", F.array(F.lit("irst"), F.lit("second"))), o.withColumn("sample_id", F.lit("other"))):
        with pytest.raises(checks.IntegrityError):
            conditions.truncated(c, bad, "v7").collect()
    assert conditions.truncated(c.withColumn("query", F.lit("changed")), o.limit(0), "v7").first().documents == ["first source", "second source"]


def test_lengths(spark):
    rows = [(m, "s", "p", "b", t, t > 110) for m, t in (("qwen", 100), ("llama", 101), ("mistral", 120))]
    x = frame(spark, rows, "model string, sample_id string, prompt_id string, benchmark string, input_tokens int, over_budget boolean")
    c = frame(spark, [("s", "p")], "sample_id string, prompt_id string")
    r = lengths.accounting(x, c, keys.MODELS).first()
    assert (r.missing, r.overflow_records, r.overflow_conditions, r.common_eligible) == (0, 1, 1, 0)
    assert lengths.accounting(x.where("model = 'qwen'"), c, keys.MODELS).first().missing == 2
    d = lengths.described(frame(spark, [(v,) for v in (1, 2, 4, 10)], "v int"), "v", (), (3,)).first()
    assert d.p90 == pytest.approx(8.2) and d.over_3 == 2 and d.over_3_rate == 0.5
    docs = frame(spark, [(["a b c d e f", "g h i j"],)], "d array<string>")
    t = lengths.prefix_truncated(docs, "d", 5).first()
    assert t.tokens_after <= 5 and t.d[0].startswith(t.documents_kept[0]) and 0 < t.keep_fraction < 1
    assert frame(spark, [([None, 5, 10**12],)], "c array<bigint>").select(lengths.context_limit("c")).first()[0] == 5


def test_nested_lengths(spark):
    rows = [("b", "d", "m", 1, 4), ("b", "d", "m", 1, 4), ("b", "d", "m", 2, 1), ("b", None, "m", 3, 10), ("c", "d", "m", 1, None), ("c", "e", "o", None, None)]
    x = frame(spark, rows, "benchmark string, domain string, model string, instance_id int, v int")
    got = {(r.grouping, r.benchmark, r.domain, r.model): r for r in lengths.nested(x, "v", (3,)).collect()}
    assert len(got) == 9
    m = got[6, None, None, "m"]
    assert (m.instances, m.n, m.min, m.p50, m.max, m.over_3, m.over_3_rate) == (2, 4, 1, 4.0, 10, 3, 0.75)
    none = got[0, "c", "e", "o"]
    assert (none.instances, none.n, none.p50, none.over_3, none.over_3_rate) == (0, 0, None, 0, None)
    assert got[0, "b", None, "m"].p99 == 10.0
    assert lengths.nested(x.limit(0), "v").count() == 0


@pytest.mark.parametrize("task_rows", [7, 40])
def test_nested_instances_are_told_apart_in_shares(spark, task_rows):
    """Instances are dealt out by the number of rows, before anything is made distinct: no task holds a map of them."""
    rng = random.Random(3)
    rows = [tuple(rng.choice(x) for x in (("b", "c", None), ("d", "e", None), ("m", "n", None), (1, 2, 3, 4, 5, 6, None), (1, 2))) for _ in range(150)]
    x = frame(spark, rows, "benchmark string, domain string, model string, instance_id int, v int")
    out = lengths.nested(x, "v", task_rows=task_rows)
    got = {(r.grouping, r.benchmark, r.domain, r.model): r.instances for r in out.collect()}
    want = {}
    for b, d, m, i, _ in rows:
        for key in ((6, None, None, m), (2, b, None, m), (0, b, d, m)):
            want.setdefault(key, set()).update([(d, i)] if d is not None and i is not None else [])
    assert got == {k: len(v) for k, v in want.items()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    n = -(-sum(r[1] is not None and r[3] is not None for r in rows) // task_rows)
    assert f", {n}), REPARTITION_BY_NUM" in plan


def test_shards_match_a_json_library(spark):
    import hashlib
    import json

    rows = [("qwen", 's"1', "p\\é漢", 0), ("llama", "s2", "plain", 2)]
    got = frame(spark, rows, "model string, sample_id string, prompt_id string, answer_seed int").select(keys.shard_of(7)).collect()
    want = [int.from_bytes(hashlib.sha256(json.dumps(r, ensure_ascii=False, separators=(",", ":")).encode()).digest()[:8], "big") % 7 for r in rows]
    assert [r[0] for r in got] == want


def test_sampling(spark):
    df = frame(spark, [(f"s{i}", f"d{i % 3}") for i in range(30)], "sample_id string, domain string")
    assert sampling.sample(df, 5, 1).collect() == sampling.sample(df.repartition(4), 5, 1).collect()
    assert sorted(r["count"] for r in sampling.balanced(df, 10, 1).groupBy("domain").count().collect()) == [3, 3, 4]
    assert [r.sample_id for r in sampling.in_given_order(df, ["s3", "s1"]).collect()] == ["s3", "s1"]
    assert sorted(r.manifest_index for r in sampling.shuffled(df, 3).collect()) == list(range(30))
    with pytest.raises(checks.IntegrityError):
        sampling.with_ids(df, frame(spark, [("nope",)], "sample_id string"))


def test_templates(spark):
    df = frame(spark, [("q {sources}", ["a", "b"], 2)], "q string, d array<string>, k int")
    m = df.select(templates.answer_messages("q", "d", "{query}|{sources}|{labels}", "sys").alias("m")).first().m
    assert [(x.role, x.content) for x in m] == [("system", "sys"), ("user", "q {sources}|Source 1:\na\n\nSource 2:\nb|[1], [2]")]
    assert df.select(templates.rendered("x {{A}} y", A="q")).first()[0] == "x q {sources} y"
    with pytest.raises(ValueError):
        templates.rendered("x {{A}} {{B}}", A="q")
    assert df.select(templates.retargeted("Is Source [1] in {answer} for {query}?", F.lit("Q"), F.lit("A {query}"), "k")).first()[0] == "Is Source [2] in A {query} for Q?"
    assert df.select(templates.last_fenced_block(F.lit("x\n```\none\n```\n```text\ntwo\n```"))).first()[0] == "two"
    assert df.select(templates.without_label(F.lit(" Output: text"), ("Output", "Result"))).first()[0] == "text"
    with pytest.raises(Exception, match="unknown protocol"):
        df.select(templates.by_protocol(F.lit("v0"), {"unified_answer_v7": F.lit("x")})).collect()


def test_texts(spark):
    long = "x" * 90
    df = frame(spark, [(1, f"{long}\n\n{long}\n\nshort"), (2, "mail a.b@c.org and /home/user"), (3, "")], "k int, t string")
    r = {x.k: x for x in texts.repetition(df, "k", "t").collect()}
    assert (r[1].paragraph_count, r[1].duplicate_long_paragraphs, r[1].max_identical_units) == (3, 1, 2) and r[3].max_identical_units == 0
    assert {(x.kind, x.found) for x in texts.identity_matches(df, "k", "t").collect()} == {("email", "a.b@c.org"), ("absolute_path", "/home/user")}
    assert df.select(texts.aliased(F.lit(" Q "), {"q": "qwen"})).first()[0] == "qwen"
    u = texts.upserted(frame(spark, [(1, "a", "b")], "k int, x string, y string"), frame(spark, [(1, None, "c"), (2, "d", None)], "k int, x string, y string"), "k")
    assert {tuple(r) for r in u.collect()} == {(1, "a", "c"), (2, "d", None)}
    assert texts.missing_fields(df, "k", ["t"]).first().missing == ["t"]
    p = texts.capped_profile(frame(spark, [(5, 5, "Done.")], "n int, cap int, t string"), F.col("n"), F.col("cap"), F.col("t")).first()
    assert p.cap_hit and p.sentence_final and not p.native_stop


def test_generation(spark):
    ten = generation.Method("ten", [generation.Stage("queries", lambda t, o, i: t), generation.Stage("suggestions", lambda t, o, i: o["queries"][0] + str(i), 5), *[generation.Stage(f"s{k}", lambda t, o, i: t + str(k)) for k in range(4)]])
    assert ten.calls == 10
    docs = frame(spark, [("a", "ten", "text one"), ("b", "nope", "text two")], "sample_id string, method_id string, source_text string")
    rows = {r.sample_id: r for r in generation.rewritten(docs, {"ten": ten}, generation.Stub).collect()}
    assert len(rows["a"].stage_records) == 10 and rows["a"].error is None and "KeyError" in rows["b"].error
    saved = {(r.stage_id, r.messages_sha256): r.output for r in rows["a"].stage_records}
    replay = generation.Replay(saved)
    assert ten.run(replay, "text one", 0)[0] == rows["a"].rewritten_text and replay.replayed == 10
    with pytest.raises(LookupError):
        ten.run(generation.Replay(saved), "another text", 0)


def test_judged_calls_only_cited(spark):
    class Fixed(generation.Backend):
        def generate(self, stage_id, messages, max_new_tokens, seed):
            return "score: 4"

    answers = frame(spark, [("q", "c", "p", 0, True), ("q", "z", "p", 0, False)], "model string, sample_id string, prompt_id string, answer_seed int, target_source_cited boolean").withColumn("messages", F.array(F.struct(F.lit("user").alias("role"), F.lit("x").alias("content"))))
    out = generation.judged(answers, judge.expected_trials(answers), Fixed, keys.TRIAL_KEY)
    got = {r.sample_id: (r["count(1)"], r["sum(score)"]) for r in out.groupBy("sample_id").agg(F.count("*"), F.sum("score")).collect()}
    assert got == {"c": (21, 84), "z": (21, 0)}


def test_resume(spark, tmp_path):
    from visiloom.streaming.resume import checked_log, run_remaining, stream_once

    work = spark.range(10).withColumnRenamed("id", "k")
    schema = work.withColumn("out", F.lit(0)).schema
    step = lambda df: df.withColumn("out", (F.col("k") * 2).cast("int"))
    path = str(tmp_path / "log")
    assert run_remaining(work.where("k < 4"), path, schema, ["k"], step) == 4
    assert run_remaining(work, path, schema, ["k"], step) == 6
    assert run_remaining(work, path, schema, ["k"], step) == 0
    done = spark.read.schema(schema).json(path)
    checked_log(done, done.limit(0), work, ["k"])
    with pytest.raises(checks.IntegrityError):
        checked_log(done.union(done), done.limit(0), work, ["k"])
    source = str(tmp_path / "in")
    work.write.parquet(source)
    for _ in range(2):
        q = stream_once(spark.readStream.schema(work.schema).parquet(source), str(tmp_path / "out"), str(tmp_path / "cp"), ["k"], step)
        q.awaitTermination()
        work.write.mode("append").parquet(source)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 10


def test_diagnostics(spark):
    from visiloom.functions.contracts import diagnostics as views
    from visiloom.operators import diagnostics

    df = frame(spark, [("Supported [1].", 2), ("Uncited. Claim [3].", 2)], "t string, n int").select("t", "n", views("t", "n").alias("d"))
    r = diagnostics.rollup(df).first()
    assert (r.answers, r.v2_ok, r.v2_fail, r.v4_ok, r.v4_fail, r.invalid_citation, r.v6_ok) == (2, 1, 1, 1, 1, 1, 1)
    x = frame(spark, [("Supported [1].", 2, False, None)], "answer string, source_count int, stored_v2 boolean, stored_v4 boolean")
    s = diagnostics.change_summary(diagnostics.recomputed(x)).first()
    assert (s.v2_before, s.v2_after, s.v2_changed, s.v4_changed) == (0, 1, 1, 1)
    assert frame(spark, [(None, 3, 3)], "a int, b int, c int").select(diagnostics.consistent_count("a", "b", "c")).first()[0] == 3
    with pytest.raises(Exception, match="differ"):
        frame(spark, [(2, 3)], "a int, b int").select(diagnostics.consistent_count("a", "b")).collect()
    scores = frame(spark, [("k", "b", 0.5), ("l", "b", 1.5)], "k string, benchmark string, v double")
    with pytest.raises(checks.IntegrityError):
        diagnostics.score_map(scores, ["k"], F.col("v"), 0, 1)
    assert diagnostics.score_map(scores.limit(1), ["k"], F.col("v"), 0, 1).first().score == 0.5
