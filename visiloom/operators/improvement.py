"""Paired improvement, means over seeds then samples, rankings and reversals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .checks import required

ORIGINAL = "original.no_rewrite"
TIE = 1e-12
METRICS = ("objective", "subjective")


def improvement(after: str | Column, before: str | Column) -> Column:
    """Normalised improvement: 10 (after - before) / (before + 1)."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (after, before))
    return 10 * (a - b) / (b + 1)


def paired_improvement(baseline: Column, optimized: Column) -> Column:
    """Struct of baseline, optimized, delta and relative_percent; the last is null where the baseline is 0."""
    return F.struct(baseline.alias("baseline"), optimized.alias("optimized"), (optimized - baseline).alias("delta"), F.when(baseline != 0, (optimized - baseline) / baseline * 100).alias("relative_percent"))


def joined_scores(objective: DataFrame, subjective: DataFrame, keys: list[str], strict: bool = True) -> DataFrame:
    """Both scores by key. A key of one side only is a defect: raised if strict, else left out."""
    j = objective.select(*keys, "benchmark", "objective").join(subjective.select(*keys, F.col("benchmark").alias("benchmark_s"), "subjective"), keys, "full")
    if strict:
        required(j.where("benchmark is null or benchmark_s is null or benchmark <> benchmark_s"), "objective and subjective keys differ")
    return j.where("benchmark = benchmark_s").drop("benchmark_s")


def baselines(scores: DataFrame, keys: list[str], original: str, method: str = "method") -> DataFrame:
    return scores.where(F.col(method) == original).select(*keys, F.col("benchmark").alias("benchmark_before"), *[F.col(m).alias(f"{m}_before") for m in METRICS])


def paired(scores: DataFrame, original: str = ORIGINAL, method: str = "method", strict: bool = False) -> DataFrame:
    """Every score beside that of the original of its model, sample and seed, before anything is averaged.

    The original's rows go to each key's rows by a window over the key, so both are shuffled once."""
    w = Window.partitionBy("model", "sample_id", "answer_seed")
    base = F.max(F.when(F.col(method) == original, F.struct("benchmark", *METRICS))).over(w)
    out = scores.withColumn("base", base)
    if strict:
        required(out.where("base is null or base.benchmark <> benchmark").select("model", "sample_id", method, "answer_seed"), "no original, or one of another benchmark")
    out = out.where("base.benchmark = benchmark")
    return out.select("model", "sample_id", "benchmark", method, "answer_seed", *[c for m in METRICS for c in (F.col(f"base.{m}").alias(f"{m}_before"), F.col(m).alias(f"{m}_after"), improvement(m, f"base.{m}").alias(f"{m}_improvement"))])


def seed_means(pairs: DataFrame, seeds: tuple[int, ...], columns: dict[str, str], method: str = "method", strict: bool = False) -> DataFrame:
    """Means over seeds of groups with exactly these seeds; other groups are raised (strict) or left out."""
    by = ["model", "sample_id", "benchmark", method]
    g = pairs.groupBy(*by).agg(F.sort_array(F.collect_list(F.col("answer_seed").cast("int"))).alias("seeds"), *[F.avg(c).alias(n) for n, c in columns.items()])
    whole = F.col("seeds") == F.array(*[F.lit(s) for s in sorted(seeds)])
    if strict:
        required(g.where(~whole).select(*by, "seeds"), "seed sets differ")
    return g.where(whole).drop("seeds")


def units(scores: DataFrame, seeds: tuple[int, ...] = (0, 1, 2), original: str = ORIGINAL, method: str = "method", strict: bool = False) -> DataFrame:
    """Mean normalised improvement of each model, sample and method."""
    return seed_means(paired(scores, original, method, strict), seeds, {m: f"{m}_improvement" for m in METRICS}, method, strict)


def sample_means(unit: DataFrame, method: str = "method") -> DataFrame:
    return unit.groupBy("model", "benchmark", method).agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in METRICS])


def raw_units(scores: DataFrame, seeds: tuple[int, ...] = (0, 1, 2), method: str = "method", strict: bool = False) -> DataFrame:
    return seed_means(scores, seeds, {m: m for m in METRICS}, method, strict)


def with_deltas(unit: DataFrame, original: str = ORIGINAL, method: str = "method") -> DataFrame:
    """Raw means and their difference to the original's, of each model and sample."""
    w = Window.partitionBy("model", "sample_id")
    base = F.max(F.when(F.col(method) == original, F.struct(*METRICS))).over(w)
    return unit.withColumn("base", base).where("base is not null").select("model", "sample_id", "benchmark", method, *[c for m in METRICS for c in (F.col(m).alias(f"{m}_raw"), (F.col(m) - F.col(f"base.{m}")).alias(f"{m}_delta"))])


def paired_summary(unit: DataFrame, original: str = ORIGINAL, method: str = "method") -> DataFrame:
    """Before, after and delta means with up, down, unchanged and both-zero counts; a method's baseline covers its own samples only."""
    w = Window.partitionBy("model", "sample_id")
    base = F.max(F.when(F.col(method) == original, F.struct(*METRICS))).over(w)
    d = unit.withColumn("base", base).where("base is not null")
    out = []
    for m in METRICS:
        delta = F.col(m) - F.col(f"base.{m}")
        out += [F.avg(f"base.{m}").alias(f"{m}_before"), F.avg(m).alias(f"{m}_after"), F.avg(delta).alias(f"{m}_delta")]
        out += [F.count_if(delta > TIE).alias(f"{m}_up"), F.count_if(delta < -TIE).alias(f"{m}_down"), F.count_if(F.abs(delta) <= TIE).alias(f"{m}_unchanged"), F.count_if((F.col(m) == 0) & (F.col(f"base.{m}") == 0)).alias(f"{m}_both_zero")]
    return d.groupBy("model", "benchmark", method).agg(F.count("*").alias("n"), *out)


def complete_samples(unit: DataFrame, pairs: int, method: str = "method") -> DataFrame:
    """Relational division: samples that have every (model, method) pair, `pairs` in all."""
    return unit.groupBy("sample_id").agg(F.count_distinct("model", method).alias("n")).where(F.col("n") == pairs).select("sample_id")


def common_complete(unit: DataFrame, pairs: int, method: str = "method") -> DataFrame:
    return unit.join(complete_samples(unit, pairs, method), "sample_id", "left_semi")


def coverage(unit: DataFrame, models: int, method: str = "method") -> DataFrame:
    """method, samples, covered: whether all models have the same samples."""
    per = unit.groupBy(method, "sample_id").agg(F.count_distinct("model").alias("n"))
    return per.groupBy(method).agg(F.count("*").alias("samples"), F.bool_and(F.col("n") == models).alias("covered"))


def long_metrics(summary: DataFrame, keep: list[str]) -> DataFrame:
    return summary.select(*keep, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("score")) for m in METRICS])).alias("x")).select(*keep, "x.metric", "x.score")


def winners(summary: DataFrame, excluded: tuple[str, ...] = (ORIGINAL,), by: tuple[str, ...] = ("benchmark", "model"), method: str = "method") -> DataFrame:
    """The best methods of each group and metric; all that are within 1e-12 of the best."""
    long = long_metrics(summary.where(~F.col(method).isin(*excluded)), [*by, method, "n"])
    best = F.max("score").over(Window.partitionBy(*by, "metric"))
    return long.withColumn("best", best).where(F.abs(F.col("score") - F.col("best")) <= TIE).drop("best")


def rankings(summary: DataFrame, excluded: tuple[str, ...] = (ORIGINAL,), by: tuple[str, ...] = ("benchmark", "model"), method: str = "method") -> DataFrame:
    """Rank by score, best first, ties by method id: one winner a group."""
    long = long_metrics(summary.where(~F.col(method).isin(*excluded)), [*by, method, "n"])
    rank = F.row_number().over(Window.partitionBy(*by, "metric").orderBy(F.desc("score"), method))
    return long.withColumn("rank", rank).withColumn("is_top", F.col("rank") == 1)


def method_reversals(summary: DataFrame, models: tuple[str, ...], excluded: tuple[str, ...] = (ORIGINAL,), by: tuple[str, ...] = ("benchmark",), method: str = "method") -> DataFrame:
    """Method pairs whose order differs between models by more than 1e-12 either way; one column a model, of a's lead over b."""
    long = long_metrics(summary.where(~F.col(method).isin(*excluded)), [*by, "model", method])
    wide = long.groupBy(*by, "metric", method).pivot("model", list(models)).agg(F.first("score"))
    a, b = wide.alias("a"), wide.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*by, "metric")]
    j = a.join(b, [*same, F.col(f"a.{method}") < F.col(f"b.{method}")])
    diff = [(F.col(f"a.{m}") - F.col(f"b.{m}")).alias(m) for m in models]
    out = j.select(*[F.col(f"a.{c}").alias(c) for c in (*by, "metric")], F.col(f"a.{method}").alias("method_a"), F.col(f"b.{method}").alias("method_b"), *diff)
    return out.where((F.least(*models) < -TIE) & (F.greatest(*models) > TIE))


def rank_reversals(summary: DataFrame, excluded: tuple[str, ...] = (ORIGINAL,), by: tuple[str, ...] = ("benchmark",), method: str = "method") -> DataFrame:
    """For every pair of models and pair of methods that the models order differently: the four scores and the strength."""
    long = long_metrics(summary.where(~F.col(method).isin(*excluded)), [*by, "model", method])
    keys = [*by, "metric"]
    a, b = long.alias("a"), long.alias("b")
    leads = a.join(b, [*[F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*keys, "model")], F.col(f"a.{method}") < F.col(f"b.{method}")])
    leads = leads.select(*[F.col(f"a.{c}").alias(c) for c in (*keys, "model")], F.col(f"a.{method}").alias("method_a"), F.col(f"b.{method}").alias("method_b"), F.col("a.score").alias("score_a"), F.col("b.score").alias("score_b"), (F.col("a.score") - F.col("b.score")).alias("lead"))
    x, y = leads.alias("x"), leads.alias("y")
    pair = [*keys, "method_a", "method_b"]
    j = x.join(y, [*[F.col(f"x.{c}") == F.col(f"y.{c}") for c in pair], F.col("x.model") < F.col("y.model"), F.col("x.lead") * F.col("y.lead") < 0])
    return j.select(*[F.col(f"x.{c}").alias(c) for c in pair], F.col("x.model").alias("model_a"), F.col("y.model").alias("model_b"), *[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "xy" for c in ("score_a", "score_b")], F.least(F.abs("x.lead"), F.abs("y.lead")).alias("strength"))


def reversal_counts(reversals: DataFrame, groups: DataFrame, by: tuple[str, ...] = ("benchmark", "metric")) -> DataFrame:
    """Counts of each group, zero where there are none."""
    return groups.select(*by).distinct().join(reversals.groupBy(*by).agg(F.count("*").alias("n")), list(by), "left").select(*by, F.coalesce("n", F.lit(0)).alias("reversals"))
