"""Python workers get whole documents in small batches: what they hold doesn't follow the size of a partition."""

import pytest
from pyspark.sql import functions as F

from visiloom.functions import contracts
from visiloom.operators import generation

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture
def large_batches(spark):
    before = spark.conf.get(KEY)
    spark.conf.set(KEY, "10000")
    yield
    spark.conf.set(KEY, before)


@pytest.mark.parametrize("column", [contracts.optional_diagnostics, contracts.exact_diagnostics])
def test_contracts(spark, large_batches, column):
    df = spark.range(5000, numPartitions=1).select(column(F.lit("One [1]."), F.lit(2)).alias("d"))
    assert int(spark.conf.get(KEY)) <= 1000
    assert df.where("d.contract_compliant").count() == 5000


def test_rewritten(spark, large_batches):
    docs = spark.range(3000, numPartitions=1).select(F.col("id").alias("sample_id"), F.lit("one").alias("method_id"), F.lit("a text").alias("source_text"))
    out = generation.rewritten(docs, {"one": generation.Method("one", [generation.Stage("final", lambda t, o, i: t)])}, generation.Stub)
    assert int(spark.conf.get(KEY)) <= 1000
    assert out.where("error is null").count() == 3000


def test_generated(spark, large_batches):
    message = F.array(F.struct(F.lit("user").alias("role"), F.lit("two words").alias("content")))
    rows = spark.range(3000, numPartitions=1).select(F.col("id").alias("k"), F.lit(0).alias("answer_seed"), message.alias("messages"))
    assert generation.generated(rows, ["k"], generation.Stub, "final", 4).where("error is null").count() == 3000
    assert int(spark.conf.get(KEY)) <= 1000
