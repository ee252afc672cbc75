"""A corpus pipeline of five training-data operators: each stage works on all that the stage before it kept.

Stages but the last give the columns of documents. The mix repeats the rows that it takes more than once; the last stage
gives doc_id, lang, source, n_chars (of the text as it is then), n_tokens, ids_sha256, decoded_sha256 and ids of each row.

In every stage an empty table gives an empty one, other columns pass through whatever their names (all but the last stage),
texts of any length are read whole, and ties are settled by id and then by id hash, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from visiloom.llm import bpe, mixing, simhash, substrings, toxicity
from visiloom.llm.common import stored


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go. Null and empty texts score as one sentence without words and stay; rows that repeat are judged alike; without a toxic label nobody goes."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.rejected_removed(docs, model)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id (one without an id only if none has one). Null and empty texts are one group, as are rows that repeat."""
    return simhash.one_of_each(docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 35 words that occur elsewhere too are cut out of the texts, n_chars follows. Every row stays; null texts stay null, and texts without such a window are unchanged."""
    return substrings.deduplicated(docs, n_chars="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them, up to three times. Null sources are one source; rows without words are in no mix and go."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids by byte-level BPE, a row for each row; a null text counts as empty."""
    return bpe.encoded(docs, keep=("doc_id", "lang", "source", "n_chars"), ids=True, chunks=KEPT_CHUNKS)


#: Workers that run all stages keep fewer chunks than those that only encode.
KEPT_CHUNKS = 500_000

STAGES = [
    ("toxicity", remove_toxic),
    ("simhash_near_dedup", remove_near_duplicates),
    ("substring_dedup", remove_repeated_passages),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: SQL can express neither the learnt scores nor the mix; tests hold its stages against brute-force versions (tests/llm).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
