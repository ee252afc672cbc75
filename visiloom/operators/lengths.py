"""Length audits and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checks import grid, key_status


PERCENTS = (50, 90, 95, 99)
#: Rows to a task where instances are told apart (some 100 bytes each).
TASK_ROWS = 2_000_000


def describe(value: str, budgets: tuple[int, ...] = (), rows: str | None = None) -> list[Column]:
    """count, min, p50, p90, p95, p99 (linear interpolation), max, and for each budget how many and what part are over it (null where there is no value).

    rows: a column with the number of rows that each row stands for."""
    v = F.col(value)
    weight = F.lit(1) if rows is None else F.col(rows)
    p = F.percentile(v, [q / 100 for q in PERCENTS], weight)  # one map of values for all of them

    def count(condition: Column) -> Column:
        return F.count_if(condition) if rows is None else F.coalesce(F.sum(F.when(condition, weight)), F.lit(0))

    n = count(v.isNotNull())
    over = [c for b in budgets for c in (count(v > b).alias(f"over_{b}"), F.try_divide(count(v > b), n).alias(f"over_{b}_rate"))]
    return [n.alias("n"), F.min(v).alias("min"), *[p[k].alias(f"p{q}") for k, q in enumerate(PERCENTS)], F.max(v).alias("max"), *over]


def described(df: DataFrame, value: str, by: tuple[str, ...] = (), budgets: tuple[int, ...] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*describe(value, budgets))


def nested(df: DataFrame, value: str, budgets: tuple[int, ...] = (), task_rows: int = TASK_ROWS) -> DataFrame:
    """Over (model), (benchmark, model) and (benchmark, domain, model), with the number of distinct instances, which are (domain, instance_id) without nulls.

    Rows are summed by value, and instances told apart, before the three groupings multiply them. Instances are dealt out to as many tasks
    as the rows need, as they come, and sorted there: neither side of the shuffle holds a map of them. The first row of an instance within
    its model, and within its benchmark and model, is marked; counts of marks add up over domains."""
    keys, sets = ["benchmark", "domain", "model"], [("model",), ("benchmark", "model"), ("benchmark", "domain", "model")]

    def over(rows: DataFrame, *what: Column) -> DataFrame:
        return rows.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(F.grouping_id().cast("int").alias("grouping"), *what)

    lengths = over(df.groupBy(*keys, value).agg(F.count("*").alias("_rows")), *describe(value, budgets, "_rows"))
    instance = ("instance_id", "domain", "model")
    rows = df.select(*keys, "instance_id").where("domain is not null and instance_id is not null")
    dealt = rows.repartition(max(1, -(-rows.count() // task_rows)), *instance)
    within = Window.partitionBy(*instance).orderBy("benchmark")
    first, before = F.row_number().over(within) == 1, F.lag("benchmark").over(within)
    marked = dealt.select(*keys, first.alias("_model"), (first | ~F.col("benchmark").eqNullSafe(before)).alias("_benchmark"))
    marks = marked.groupBy(*keys).agg(F.count_if("_model").alias("_model"), F.count_if("_benchmark").alias("_benchmark"))
    counts = over(marks, F.sum("_model").alias("_model"), F.sum("_benchmark").alias("_benchmark"))
    instances = counts.select(*keys, "grouping", F.when(F.col("grouping") == 6, F.col("_model")).otherwise(F.col("_benchmark")).alias("instances"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*keys, "grouping")]
    joined = lengths.alias("a").join(instances.alias("b"), same, "left")
    return joined.select(*[f"a.{c}" for c in (*keys, "grouping")], F.coalesce("b.instances", F.lit(0)).alias("instances"), *[f"a.{c}" for c in lengths.columns if c not in (*keys, "grouping")])


def grouped(df: DataFrame, value: str, budget: int) -> DataFrame:
    """Keyed a::b over model, benchmark x model and prompt x model, rates to 8 decimals."""
    keys = {"by_model": F.col("model"), "by_benchmark_model": F.concat_ws("::", "benchmark", "model"), "by_prompt_model": F.concat_ws("::", "prompt_id", "model")}
    long = df.select(value, F.explode(F.array(*[F.struct(F.lit(n).alias("grouping"), k.alias("key")) for n, k in keys.items()])).alias("g")).select(value, "g.grouping", "g.key")
    out = long.groupBy("grouping", "key").agg(*describe(value, (budget,)))
    return out.withColumn(f"over_{budget}_rate", F.round(f"over_{budget}_rate", 8))


def accounting(lengths: DataFrame, conditions: DataFrame, models: tuple[str, ...]) -> DataFrame:
    """One row: expected and observed keys, duplicates, missing, unexpected, overflow records, conditions and samples, and the conditions that fit for every model."""
    keys = ["model", "sample_id", "prompt_id"]
    expected = grid(conditions.sparkSession, conditions.select("sample_id", "prompt_id"), model=models)
    nothing = lengths.select(*keys).limit(0)
    s = key_status(expected, lengths, nothing, keys).agg(
        F.count_if(F.col("status") != "unexpected").alias("expected"), F.count_if(~F.col("status").isin("missing", "unexpected")).alias("observed"), F.count_if(F.col("status") == "duplicate").alias("duplicate_keys"),
        F.count_if(F.col("status") == "missing").alias("missing"), F.count_if(F.col("status") == "unexpected").alias("unexpected"))
    per = lengths.groupBy("sample_id", "prompt_id").agg(F.max("input_tokens").alias("most"), F.count_if("over_budget").alias("over"), F.count_distinct("model").alias("models"))
    o = per.agg(F.coalesce(F.sum("over"), F.lit(0)).alias("overflow_records"), F.count_if(F.col("over") > 0).alias("overflow_conditions"), F.count_distinct(F.when(F.col("over") > 0, F.col("sample_id"))).alias("overflow_samples"), F.count_if((F.col("over") == 0) & (F.col("models") == len(models))).alias("common_eligible"))
    return s.join(o, F.lit(True))  # one row each


def stage_rollup(stages: DataFrame) -> DataFrame:
    return stages.groupBy("stage_id").agg(F.count("*").alias("n"), F.count_if(~F.col("within_context")).alias("overflows"), F.max("total_tokens").alias("max_total"))


def output_cap(tokens: str | Column, ratio: float, slack: int) -> Column:
    return (F.ceil((F.col(tokens) if isinstance(tokens, str) else tokens) * F.lit(ratio)) + slack).cast("int")


def stage_plan(documents: DataFrame, stages: DataFrame, context: int, margin: int = 64) -> DataFrame:
    """Upper bounds of each stage's tokens: its template, the document, the caps of what it takes from earlier stages, and a margin.

    documents: sample_id, tokens; stages: method_id, stage_id, template_tokens, upstream_caps array<int>, output_cap."""
    j = documents.join(F.broadcast(stages) if stages.isLocal() else stages, F.lit(True))
    bound = F.col("template_tokens") + F.col("tokens") + F.aggregate("upstream_caps", F.lit(0), lambda a, x: a + x) + margin
    total = bound + F.col("output_cap")
    kind = F.when(F.size("upstream_caps") == 0, "exact").otherwise("upper_bound")
    return j.select("sample_id", "method_id", "stage_id", kind.alias("bound_type"), bound.alias("input_bound"), total.alias("total_tokens"), (total <= context).alias("within_context"))


def context_limit(candidates: str | Column, absurd: int = 10**9) -> Column:
    """The least of the limits that a model states; absurdly large ones mean none."""
    c = F.col(candidates) if isinstance(candidates, str) else candidates
    return F.array_min(F.filter(c, lambda x: x.isNotNull() & (x > 0) & (x < absurd)))


def token_count(text: str | Column) -> Column:
    """Words between white space; a model's own count can be given instead wherever this is used."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(r"\S+")), F.lit(0)).cast("int")


def prefix_truncated(df: DataFrame, documents: str, budget: int, steps: int = 14, count=token_count) -> DataFrame:
    """Keeps the same fraction of each document's characters, the largest found by bisection whose tokens fit: documents_kept, keep_fraction, tokens_after.

    All steps are one fold in the row; a document keeps at least one character."""
    docs = F.col(documents)

    def cut(f: Column) -> Column:
        return F.transform(docs, lambda d: d.substr(F.lit(1), F.greatest(F.floor(F.length(d) * f), F.lit(1)).cast("int")))

    def tokens(f: Column) -> Column:
        return F.aggregate(cut(f), F.lit(0), lambda a, d: a + count(d))

    start = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))

    def step(s: Column, _: Column) -> Column:
        middle = (s["low"] + s["high"]) / 2
        fits = tokens(middle) <= budget
        return F.struct(F.when(fits, middle).otherwise(s["low"]).alias("low"), F.when(fits, s["high"]).otherwise(middle).alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["low"]
    whole = F.aggregate(docs, F.lit(0), lambda a, d: a + count(d)) <= budget
    out = df.withColumn("keep_fraction", F.when(whole, 1.0).otherwise(found))
    out = out.withColumn("documents_kept", F.when(F.col("keep_fraction") == 1.0, docs).otherwise(cut(F.col("keep_fraction"))))
    return out.withColumn("tokens_after", F.aggregate("documents_kept", F.lit(0), lambda a, d: a + count(d)))
