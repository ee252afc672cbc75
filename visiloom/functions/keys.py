"""Key columns and the entities' schemas. Keys are always several columns, never one concatenated string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANSWER_KEY = ["model", "sample_id", "prompt_id", "answer_seed"]
TRIAL_KEY = [*ANSWER_KEY, "dimension", "judge_seed"]
CONDITION_KEY = ["sample_id", "prompt_id"]

# The frozen domains of the evaluation.
MODELS = ("qwen", "llama", "mistral")
SEEDS = (0, 1, 2)
DIMENSIONS = (
    "diversity_detailed",
    "follow_detailed",
    "influence_detailed",
    "relevance_detailed",
    "subjcount_detailed",
    "subjpos_detailed",
    "uniqueness_detailed",
)
ACTIONS = ("reuse_old_scores", "rerun_glm_judge", "deterministic_zero")

_S, _I, _B, _D = T.StringType(), T.IntegerType(), T.BooleanType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SCHEMAS = {
    "manifest": _struct(manifest_index=_I, sample_id=_S, benchmark=_S, domain=_S, instance_id=_S, query=_S, tags=T.ArrayType(_S), candidate_document_count=_I, target_document_index=_I, target_document_sha256=_S, candidate_document_sha256=T.ArrayType(_S), baseline_input_tokens=T.MapType(_S, _I), input_budget=_I, baseline_budget_eligible=_B, calibration_excluded=_B),
    "instance": _struct(benchmark=_S, domain=_S, instance_id=_S, query=_S, documents=T.ArrayType(_S), target_document_index=_I, tags=T.ArrayType(_S)),
    "rewrite": _struct(sample_id=_S, prompt_id=_S, benchmark=_S, domain=_S, instance_id=_S, query=_S, target_document_index=_I, source_text=_S, rewritten_text=_S),
    "answer": _struct(model=_S, sample_id=_S, prompt_id=_S, seed=_I, answer_seed=_I, benchmark=_S, domain=_S, query=_S, answer_prompt_protocol=_S, input_tokens=_I, output_tokens=_I, max_new_tokens=_I, cap_hit=_B, answer=_S),
    "error": _struct(model=_S, sample_id=_S, prompt_id=_S, seed=_I, answer_seed=_I, error_type=_S, error=_S, input_tokens=_I, input_budget=_I),
    "judge_trial": _struct(model=_S, sample_id=_S, prompt_id=_S, answer_seed=_I, dimension=_S, judge_seed=_I, target_document_index=_I, target_citation_index=_I, target_source_cited=_B, raw_output=_S, answer=_S, score=_I, score_parse_method=_S, score_origin=_S, input_tokens=_I, output_tokens=_I),
    "input_length": _struct(model=_S, sample_id=_S, prompt_id=_S, model_id=_S, benchmark=_S, domain=_S, document_count=_I, document_chars=_I, input_tokens=_I, input_budget=_I, over_budget=_B, model_context_limit=_I),
    "source_truncation": _struct(sample_id=_S, prompt_id=_S, protocol=_S, original_input_sha256=_S, truncated_input_sha256=_S, documents=T.ArrayType(_S)),
    "summary": _struct(part=_S, model=_S, benchmark=_S, method=_S, n=_I, objective=_D, subjective=_D),
}


def with_answer_key(df: DataFrame) -> DataFrame:
    """Casts the key columns; the seed may come as seed or answer_seed and is called answer_seed."""
    seeds = [F.col(c).cast("int") for c in ("answer_seed", "seed") if c in df.columns]
    out = df.withColumn("answer_seed", F.coalesce(*seeds))
    out = out.drop("seed") if "seed" in df.columns else out
    return out.withColumns({c: F.col(c).cast("string") for c in ANSWER_KEY[:3]})


def prompt_family(prompt_id: str | Column) -> Column:
    return F.substring_index(prompt_id, ".", 1)


def sha256(text: str | Column) -> Column:
    return F.sha2(text, 256)


def json_array_of_key(strings: list[str], seed: str) -> Column:
    """The compact JSON array of three strings and a number, byte for byte as a JSON library writes it."""
    texts = F.to_json(F.array(*[F.col(c).cast("string") for c in strings]))
    return F.concat(texts.substr(F.lit(1), F.length(texts) - 1), F.lit(","), F.col(seed).cast("string"), F.lit("]"))


def unsigned_prefix(digest: Column) -> Column:
    """The first eight bytes of a hexadecimal digest as an unsigned number, which needs decimal(20, 0)."""
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def shard_of(n: int, strings: tuple[str, ...] = ("model", "sample_id", "prompt_id"), seed: str = "answer_seed") -> Column:
    return F.pmod(unsigned_prefix(sha256(json_array_of_key(list(strings), seed))), F.lit(n).cast("decimal(20,0)")).cast("int")
