"""Conditions: which documents a model gets for each sample and prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsontext import input_hash
from .checks import required


def replaced(documents: Column, index: Column, text: Column) -> Column:
    """The array with the element at `index` (from 0) replaced; all others byte for byte the same."""
    return F.transform(documents, lambda d, i: F.when(i == index, text).otherwise(d))


def build(manifest: DataFrame, instances: DataFrame, rewrites: DataFrame, prompts: tuple[str, ...], original: str, declared_missing: DataFrame | None = None, prompt: str = "prompt_id", strict: bool = True) -> DataFrame:
    """sample_id, prompt_id, benchmark, domain, instance_id, query, documents: the original and each rewrite of the target.

    Rewrites must be of known samples, once each, of the target's own text and not blank; a missing one must be declared, and a declared one missing."""
    keys = ["benchmark", "domain", "instance_id"]
    base = manifest.select("sample_id", *keys, "query", "target_document_index").join(instances.select(*keys, "documents"), keys)
    if strict:
        required(manifest.join(base, "sample_id", "left_anti"), "samples without an instance")
        required(rewrites.join(manifest, "sample_id", "left_anti"), "rewrites of unknown samples")
        required(rewrites.groupBy("sample_id", prompt).count().where("count > 1"), "duplicate rewrites")
        expected = base.select("sample_id", F.explode(F.array(*[F.lit(p) for p in prompts])).alias(prompt))
        absent = expected.join(rewrites, ["sample_id", prompt], "left_anti")
        if declared_missing is not None:
            required(declared_missing.join(rewrites, ["sample_id", prompt], "left_semi"), "declared missing but there")
            absent = absent.join(declared_missing, ["sample_id", prompt], "left_anti")
        required(absent, "missing rewrites")
        required(rewrites.where(~F.col(prompt).isin(*prompts)), "unknown prompts")
    j = base.join(rewrites.select("sample_id", F.col(prompt).alias("prompt_id"), "source_text", "rewritten_text"), "sample_id")
    target = F.get("documents", F.col("target_document_index"))
    if strict:
        required(j.where(~target.eqNullSafe(F.col("source_text")) | (F.trim("rewritten_text") == "")).select("sample_id", "prompt_id"), "rewrites of another text, or blank")
    out = ["sample_id", "prompt_id", *keys, "query", "documents"]
    done = j.withColumn("documents", replaced(F.col("documents"), F.col("target_document_index"), F.col("rewritten_text"))).select(*out)
    return done.unionByName(base.withColumn("prompt_id", F.lit(original)).select(*out))


def truncated(conditions: DataFrame, overrides: DataFrame, protocol: str, strict: bool = True) -> DataFrame:
    """Conditions with the documents of their overrides, where there are any; source_truncated says which.

    An override must fit the condition's hash and protocol, shorten each document to a prefix that isn't empty, have its own right hash, and be used."""
    keys = ["sample_id", "prompt_id"]
    o = overrides.select(*keys, "protocol", "original_input_sha256", "truncated_input_sha256", F.col("documents").alias("shorter"))
    if strict:
        required(o.groupBy(*keys).count().where("count > 1"), "duplicate overrides")
        required(o.join(conditions, keys, "left_anti"), "overrides that aren't used")
    j = conditions.join(o, keys, "left")
    if strict:
        hit = j.where("shorter is not null")
        prefix = (F.size("shorter") == F.size("documents")) & F.forall(F.zip_with("documents", "shorter", lambda d, s: d.startswith(s) & (s != "")), lambda x: x)
        before, after = (input_hash("benchmark", "domain", "query", c) for c in ("documents", "shorter"))
        checked = hit.withColumn("b_", before).withColumn("a_", after)
        required(checked.where((F.col("protocol") != protocol) | (F.col("b_") != F.col("original_input_sha256")) | ~F.coalesce(prefix, F.lit(False)) | (F.col("a_") != F.col("truncated_input_sha256"))).select(*keys), "overrides that don't fit")
    return j.withColumn("source_truncated", F.col("shorter").isNotNull()).withColumn("documents", F.coalesce("shorter", "documents")).drop("shorter", "protocol", "original_input_sha256", "truncated_input_sha256")
