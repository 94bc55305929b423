"""Large groups: how they split, and the folders that their streams write.

Rows of a group that hang on each other are read as one stream in order of days; what
it says is written once, each row with the slice that it was in.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, functions as F

from annalist.session import cut, release, stage_folder

#: The slice of rows without a date; it comes after all others.
UNDATED = -1


class Store:
    """What the streams of one run said, in a folder each."""

    def __init__(self, spark: SparkSession, schema: str):
        self.spark, self.path, self.schema, self.runs = spark, stage_folder(spark), schema, 0

    def add(self, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.path}/said/run={self.runs}")
        self.runs += 1

    def said(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/said")


def components(rows: DataFrame, group: list[str]) -> DataFrame:
    """(group, _entity, _domain, _part): connected key pairs get the same part.

    Works on the distinct key pairs, with one label per key; labels shrink to the
    least of their neighbours until nothing changes.
    """
    edges = cut(
        rows.groupBy(*group, "_entity", "_domain")
        .agg(F.min("_id").alias("_part"))
        .where(F.col("_entity").isNotNull() | F.col("_domain").isNotNull())
    )
    while True:
        by_e = edges.where(F.col("_entity").isNotNull()).groupBy(*group, "_entity").agg(F.min("_part").alias("_pe"))
        by_d = edges.where(F.col("_domain").isNotNull()).groupBy(*group, "_domain").agg(F.min("_part").alias("_pd"))
        step = cut(
            edges.join(by_e, [*group, "_entity"], "left")
            .join(by_d, [*group, "_domain"], "left")
            .withColumn("_to", F.least("_part", "_pe", "_pd"))
            .select(*edges.columns, "_to")
        )
        moved = not step.where(F.col("_to") < F.col("_part")).isEmpty()
        release(edges)
        edges = step.withColumn("_part", F.col("_to")).drop("_to")
        if not moved:
            return edges


def in_parts(rows: DataFrame, group: list[str]) -> DataFrame:
    """Rows that have an entity or a domain, with the ``_part`` of the connected keys they belong to."""
    keys = components(rows, group)
    same = [F.col(f"l.{g}") == F.col(f"r.{g}") for g in group] + [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in ("_entity", "_domain")]
    return rows.alias("l").join(keys.alias("r"), reduce(and_, same)).select("l.*", "r._part")
