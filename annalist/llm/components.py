"""Connected components over edges of long ids, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from annalist.llm.tables import discard, stored


def _own(key: Column) -> Column:
    return key.bitwiseXOR(F.lit(0).cast("long"))


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step. ``edges`` (a, b), a > b.

    Large: every neighbour above a node is hung on the least of its neighbourhood.
    Small: every neighbour below it, and the node itself, likewise.
    Minima are combined before the shuffle and joined back, so a hot node is never gathered.
    The joins' keys are computed ones: both sides then get an exchange of their own, whose
    skewed partitions can be split.
    """
    if larger:
        sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select(_own(F.col("u")).alias("w"), F.least("u", "m").alias("m"))
        up = edges.select(F.col("b").alias("w"), F.col("a"))
        hung = up.join(least, "w").select("a", F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m")).select(_own(F.col("a")).alias("w"), "m")
        hung = (
            edges.select(F.col("a").alias("w"), "b").join(least, "w").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select(F.col("w").alias("a"), F.col("m").alias("b")))
        )
    return hung.filter("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is the least node reachable.

    ``edges`` has two long columns, in any order and direction; nulls and loops are
    left out, repeats do not matter, no edges give no rows. Alternates large and small
    stars until a round changes nothing. Each round's edges are written to the shared
    folder and the previous ones removed.
    """
    x, y = (F.col(f"`{c}`").cast("long") for c in edges.columns[:2])
    now = stored(
        edges.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"), x.isNotNull().alias("p"), y.isNotNull().alias("q"))
        .filter("p and q and a <> b").select("a", "b").distinct()
    )
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        after = stored(_stars(_stars(now, True), False))
        discard(now)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b"), F.col("b")).distinct()
    )
