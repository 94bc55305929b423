"""What the driver gathers: tables are broadcast by what they hold, not by how well their files pack."""

import os

import pytest

import __spark_entry__ as contract
from annalist.session import broadcast_if_small, cut

DATA = "/root/testdata/sf0.001"
FACTOR = "spark.sql.sources.fileCompressionFactor"


def joins(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_counted_tables_that_are_not_small_are_never_broadcast(spark):
    """150,000 rows of 150 keys are a few KB as a file, and were broadcast."""
    rows = cut(spark.range(150_000).selectExpr("id div 1000 AS k", "0L AS n"))
    asked = spark.range(10_000_000).withColumnRenamed("id", "k")
    assert "Broadcast" not in joins(asked.join(broadcast_if_small(rows), "k"))
    assert "BroadcastHashJoin" in joins(asked.join(broadcast_if_small(rows, 150_000), "k"))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
def test_stage_tables_are_guessed_at_their_size_in_memory(spark):
    """Narrow columns of millions of events lie under 10 MB in their files, and several were broadcast at once."""
    rows, before = cut(spark.range(400_000)), spark.conf.get(FACTOR)
    asked = spark.range(10_000_000).join(rows, "id")
    spark.conf.set(FACTOR, "1.0")
    try:
        assert "BroadcastHashJoin" in joins(asked)
        contract.queries()["company_names"](spark, DATA)
        assert "Broadcast" not in joins(spark.range(10_000_000).join(rows, "id"))
        spark.conf.set(FACTOR, "3.0")
        contract.queries()["company_names"](spark, DATA)
        assert spark.conf.get(FACTOR) == "3.0"
    finally:
        spark.conf.set(FACTOR, before)
