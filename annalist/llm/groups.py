"""Groups of rows by a key: hot keys are split, each group goes to one task, links leave it as spanning edges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from annalist.llm.tables import stored, width

#: Rows of a group that one task takes at once.
GROUP_ROWS = 2048
#: Hot keys that may be broadcast.
HOT_KEYS = 50_000


def split_hot(rows: DataFrame, finer: Callable[[Column], list[Column]] | None = None, most: int = GROUP_ROWS, tile_on: str = "id") -> DataFrame:
    """Rows with column ``key``, where the rows of keys held by more than ``most`` are dealt anew.

    A hot key is first replaced by the finer keys that ``finer`` gives, under one of which two linked
    rows still meet. What is hot after that is cut into blocks by hash of ``tile_on``, and
    each pair of blocks becomes a group. No row and no pair is left out.
    """

    def hot_keys(of: DataFrame) -> DataFrame | None:
        hot = of.groupBy("key").count().filter(F.col("count") > most).select(F.col("key").alias("hot"), F.col("count").alias("held"))
        n = hot.count()
        return None if not n else F.broadcast(hot) if n <= HOT_KEYS else hot

    hot = hot_keys(rows)
    if hot is None:
        return rows
    own = rows.columns
    marked = rows.join(hot, F.col("key") == F.col("hot"), "left")
    cool = marked.filter("hot is null").select(own)
    warm = marked.filter("hot is not null")
    if finer is not None:
        fine = stored(warm.withColumn("key", F.explode(F.array(*finer(F.col("key"))))).select(own))
        return cool.union(split_hot(fine, None, most, tile_on))
    blocks = F.ceil(F.col("held") / most).cast("int")
    mine = F.pmod(F.xxhash64(F.lit(7), tile_on), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.xxhash64("key", F.least(x, mine), F.greatest(x, mine)))
    return cool.union(warm.withColumn("key", F.explode(pairs)).select(own))


def dealt(rows: DataFrame, *order: str) -> DataFrame:
    """All rows of a key in one partition, next to each other, in the given order."""
    return rows.repartition(width(rows.sparkSession), "key").sortWithinPartitions("key", *order)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each key that has at least two; column 0 is the key and sorted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if held and keys[0] != held[-1].column(0)[0].as_py():
            yield from _whole(held)
            held = []
        if not len(cuts):
            held.append(batch)
            continue
        held.append(batch.slice(0, int(cuts[0])))
        yield from _whole(held)
        ends = np.r_[cuts[1:], len(keys)]
        sizes = ends - cuts
        for a, n in zip(cuts[:-1][sizes[:-1] > 1].tolist(), sizes[:-1][sizes[:-1] > 1].tolist()):
            yield pa.Table.from_batches([batch.slice(a, n)])
        held = [batch.slice(int(cuts[-1]))]
    yield from _whole(held)


def _whole(held: list[pa.RecordBatch]) -> Iterator[pa.Table]:
    if sum(b.num_rows for b in held) > 1:
        yield pa.Table.from_batches(held).combine_chunks()


class Union:
    """Disjoint sets of 0..n-1, the least of a set being its root."""

    def __init__(self, n: int):
        self.roots = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        roots = self.roots
        while True:
            ra, rb = roots[a], roots[b]
            open_ = ra != rb
            if not open_.any():
                return
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(roots, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(up := roots[roots], roots):
                roots[:] = up
