"""Queries cover whole tables and whole texts."""

import hashlib
import random

import duckdb
from visiloom.operators import generation, sampling, texts
from visiloom.operators import improvement as imp
from visiloom.operators.bootstrap import interval, stable_seed
from visiloom.plans import adapters as a
from visiloom.plans import catalog


def test_order_of_all_events(spark, tmp_path):
    broken = {4999, 5000, 6001, 11999}
    rows = [(i, 0 if i in broken else i + 1, "view") for i in range(12_000)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    assert {r.event_id for r in catalog.QUERIES["strict_order"](spark, str(tmp_path)).collect()} == broken


def test_order_across_ranges(spark):
    rng = random.Random(4)
    rows = [(p, rng.randrange(6), rng.choice(["x", "y", None])) for p in rng.sample(range(-5_000, 5_000), 300)]
    df = spark.createDataFrame(rows, "p long, a int, b string").repartition(5)
    key = lambda r: (r[1], r[2] is not None, r[2] or "")
    ordered = sorted(rows)
    want = {y[0] for x, y in zip(ordered, ordered[1:]) if not key(y) > key(x)}
    for range_rows in (1, 7, 1000):
        assert {r.p for r in sampling.disordered(df, ["a", "b"], "p", range_rows).collect()} == want
    assert sampling.disordered(df.limit(0), ["a", "b"], "p").count() == 0


def test_truncation_keeps_all_rows_and_whole_texts(spark, tmp_path):
    docs = {1: "ab " * 50, 2: None, 3: "", 4: "x", 5: "abc " * 5_000}
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in catalog.QUERIES["prefix_truncation"](spark, str(tmp_path)).collect()}
    assert {i: (got[i].keep_fraction, got[i].tokens_after) for i in (1, 2, 3, 4)} == {1: (1.0, 50), 2: (1.0, 0), 3: (1.0, 0), 4: (1.0, 1)}
    # of 5,000 words 300 may stay; of the first 8,000 characters it would be 300 of 2,000
    assert got[5].tokens_after == 300 and abs(got[5].keep_fraction - 0.06) < 0.001


def test_conditions_of_whole_texts(spark, tmp_path):
    docs = {0: "é" * 100 + "b" * 100 + "c" * 101, 1: "short", 2: "", 3: None, 4: "xy" * 4_000}
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want, prompts = {}, {}
    for i, t in docs.items():
        t = t or ""
        k = -(-len(t) // 3)
        parts = [t[:k], t[k : 2 * k], t[2 * k :]]
        assert "".join(parts) == t
        prompts[i] = "\n\n".join(f"Source {n + 1}:\n{x}" for n, x in enumerate(parts))
        for p in ("original.no_rewrite", "p1", "p2"):
            new = [f"rewrite {p[1]}: {x}" if p[0] == "p" and n == i % 3 else x for n, x in enumerate(parts)]
            want[i, p] = hashlib.md5("|".join(new).encode()).hexdigest()
    got = catalog.QUERIES["conditions"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r.sample_id, r.prompt_id): r.digest for r in got} == want
    assert {r.doc_id: r.sources for r in catalog.QUERIES["source_prompts"](spark, str(tmp_path)).collect()} == prompts


def test_bootstrap_has_the_reference_resamples(spark):
    d = "/root/testdata/sf0.001"
    units = imp.units(a.scores(spark, d), original=a.ORIGINAL).toPandas()
    got = catalog.QUERIES["bootstrap_ci"](spark, d).where("method <> 'm1'").orderBy("benchmark", "model", "method").first()  # m1 is the original, all 0
    key = (got.benchmark, got.model, got.method)
    g = units[(units.benchmark == key[0]) & (units.model == key[1]) & (units.method == key[2])].sort_values("sample_id")
    assert len(g) == got.n > 1
    assert (got.objective_ci_low, got.objective_ci_high) == interval(g.objective.tolist(), 1000, stable_seed(20260906, f"{key}:objective"))


def test_all_identity_patterns(spark, tmp_path):
    text = "a.b@c.org, https://github.com/some-one/x; /home/user/y and C:\\Users\\me.\nAcknowledgements: a friend"
    spark.createDataFrame([(1, text), (2, "nothing"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.kind, r.found) for r in catalog.QUERIES["identity_scan"](spark, str(tmp_path)).collect()}
    want = {("email", "a.b@c.org"), ("code_host", "https://github.com/some-one"), ("absolute_path", "/home/user"), ("absolute_path", "C:\\Users\\me."), ("acknowledgement", "Acknowledgements")}
    assert got == {(1, *w) for w in want}
    found = duckdb.connect().execute(f"WITH documents AS (FROM '{tmp_path}/documents.parquet/*.parquet') {catalog.ORACLE_SQL['identity_scan']}").fetchall()
    assert set(found) == got


def test_identity_patterns_find_what_the_reference_finds(spark):
    text = "see github.com/some-one, ACKNOWLEDGMENT, AcknowledgeMents and /Users/ here"
    df = spark.createDataFrame([(1, text)], "k long, t string")
    want = {("code_host", "github.com/some-one"), ("acknowledgement", "ACKNOWLEDGMENT"), ("acknowledgement", "AcknowledgeMents"), ("absolute_path", "/Users/")}
    assert {(r.kind, r.found) for r in texts.identity_matches(df, "k", "t").collect()} == want


def test_stages_get_whole_texts(spark, tmp_path, monkeypatch):
    class Whole(generation.Stub):
        def generate(self, stage_id, messages, max_new_tokens, seed):
            if not messages[-1]["content"].startswith("word " * 100):
                raise ValueError("a cut text")
            return super().generate(stage_id, messages, max_new_tokens, seed)

    monkeypatch.setattr(generation, "Stub", Whole)
    spark.createDataFrame([(1, "word " * 100)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.QUERIES["stage_methods"](spark, str(tmp_path)).first()
    assert (got.calls, got.ok) == (3, True)
