"""Near duplicates among embeddings in cells of spherical k-means (operator 6)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from annalist.llm.components import components
from annalist.llm.groups import GROUP_ROWS, Union, dealt, runs
from annalist.llm.tables import drawn, map_rows, stored

#: Vectors of a cell that are aimed at, most cells, and rows and bytes of the sample that the centres are fitted on.
CELL_ROWS, MAX_CELLS, SAMPLE_ROWS, SAMPLE_BYTES = 2048, 1024, 1 << 14, 32 << 20
BLOCK = 512
#: Guests of a group for each row at home there.
GUESTS = 8


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def fit(sample: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centres of spherical k-means: each is the direction of the sum of its vectors; an empty cell keeps its centre."""
    rng = np.random.default_rng(6)
    centres = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        cell = np.concatenate([(sample[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        new = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
        if np.abs(new - centres).max() < 1e-6:
            break
        centres = new
    return centres


def cells(vectors: np.ndarray, centres: np.ndarray, cosine: float) -> list[list[int]]:
    """The cells of each unit vector, its own first, then those across whose border a linked vector may lie.

    Linked vectors are at most a chord apart. If they lie in two cells, one of them is within half a
    chord of the border, and joins the other's cell: so half a chord is the margin, and no link is missed.
    """
    chord = math.sqrt(max(0.0, 2 - 2 * cosine))
    margin = chord / 2 + 1e-9
    apart = np.linalg.norm(centres[:, None] - centres[None], axis=2) if len(centres) <= 256 else np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))
    out: list[list[int]] = []
    for i in range(0, len(vectors), 1024):
        near = vectors[i : i + 1024] @ centres.T
        own = near.argmax(1)
        inside = near[np.arange(len(own)), own][:, None] - near <= margin * apart[own]
        inside[np.arange(len(own)), own] = False
        out += [[o, *np.flatnonzero(x).tolist()] for o, x in zip(own.tolist(), inside)]
    return out


class _Found:
    """Links of a group: weights of the partners of each row, and spanning edges."""

    def __init__(self, weights: np.ndarray):
        self.sets, self.count, self.weights = Union(len(weights)), np.zeros(len(weights), np.int64), weights

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        np.add.at(self.count, a, self.weights[b])
        np.add.at(self.count, b, self.weights[a])
        self.sets.join(a, b)

    def rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        some = np.flatnonzero(self.count)
        return ids[some], self.count[some], ids[self.sets.roots[some]]


def among(found: _Found, vectors: np.ndarray, left: np.ndarray, right: np.ndarray | None, cosine: float) -> None:
    """Links between rows ``left`` and ``right`` of one cell, or among ``left`` alone."""
    for i in range(0, len(left), BLOCK):
        a = left[i : i + BLOCK]
        for j in range(i if right is None else 0, len(left if right is None else right), BLOCK):
            b = (left if right is None else right)[j : j + BLOCK]
            x, y = np.nonzero(vectors[a] @ vectors[b].T >= cosine)
            x, y = a[x], b[y]
            if right is None:
                x, y = x[x < y], y[x < y]
            found.add(x, y)


def across(
    found: _Found, vectors: np.ndarray, homes: np.ndarray, guests: np.ndarray, own: np.ndarray, lists: list[list[int]], cell: int, centres: np.ndarray, cosine: float
) -> None:
    """Links between the rows at home in ``cell`` and its guests, those of one other cell after another.

    Along the axis between two centres linked vectors are at most a chord apart, so a guest is
    compared only with homes that are so close to the border. A pair that both cells hold counts
    in the smaller one.
    """
    chord = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
    for other in np.unique(own[guests]).tolist():
        axis = centres[cell] - centres[other]
        axis = axis / max(float(np.linalg.norm(axis)), 1e-12)
        inside, outside = vectors[homes] @ axis, -(vectors[guests[own[guests] == other]] @ axis)
        near = homes[np.argsort(inside, kind="stable")]
        inside = np.sort(inside)
        come = guests[own[guests] == other][np.argsort(outside, kind="stable")]
        outside = np.sort(outside)
        for i in range(0, len(come), BLOCK):
            b = come[i : i + BLOCK]
            reach = int(np.searchsorted(inside, chord - outside[i], side="right"))
            for j in range(0, reach, BLOCK):
                a = near[j : min(j + BLOCK, reach)]
                x, y = np.nonzero(vectors[a] @ vectors[b].T >= cosine)
                x, y = a[x], b[y]
                if other < cell and len(x):
                    # the home may be a guest of the guest's cell, where the pair counts
                    once = np.array([other not in lists[p] for p in x.tolist()])
                    x, y = x[once], y[once]
                found.add(x, y)


def embedding_links(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.95, cell_rows: int = CELL_ROWS, most: int = GROUP_ROWS
) -> DataFrame:
    """(key, n_links, component, kept): links of cosine at least ``cosine`` and the least key they reach.

    Equal vectors are compared once and count with their number. Centres are fitted on a sample of
    at most ``SAMPLE_ROWS`` rows and ``SAMPLE_BYTES``, chosen by hash; every vector is assigned to its cell and, near a border, to the
    cells beyond it, as a guest. Vectors at home in a cell are compared in double precision with each other and with
    its guests; guests are not compared, as such a pair meets at home. Cells of more
    than ``most`` vectors are cut into blocks by hash, and pairs of blocks are compared. Counts
    and spanning edges leave a task, never pairs. Null, zero and partly null or
    non-finite vectors, and null keys, link with nothing; vectors of different lengths do not
    link; an empty table gives no rows. Keys name one vector each.
    """
    spark = rows.sparkSession
    v = F.col("v")
    given = rows.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    sound = F.coalesce(
        v.isNotNull() & F.col("id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0), F.lit(False)
    )
    given = given.select("id", "v", sound.alias("ok"), F.when(sound, F.xxhash64("v")).alias("h1"), F.when(sound, F.xxhash64(F.reverse(v), F.size(v))).alias("h2"))
    distinct = stored(given.filter("ok").groupBy("h1", "h2").agg(F.min("id").cast("long").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")))
    found = None
    for dim, n in sorted((r[0], r[1]) for r in distinct.groupBy(F.size("v")).count().collect()):
        same = distinct.filter(F.size("v") == dim)
        held = max(1, SAMPLE_BYTES // (8 * dim))
        sample = unit(np.array([r["v"] for r in drawn(same.select("rep", "v"), F.xxhash64("rep"), min(held, SAMPLE_ROWS))]))
        k = max(1, min(MAX_CELLS, -(-n // cell_rows), len(sample)))
        part = _links(same, spark.sparkContext.broadcast(fit(sample, k)), dim, cosine, most)
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], "id long, n long, root long")
    found = stored(found)
    counts = found.groupBy(F.col("id").alias("node")).agg(F.sum("n").alias("n"))
    reached = components(found.select("id", "root"))
    named = (
        distinct.select("h1", "h2", "rep", "copies").join(counts, F.col("rep") == F.col("node"), "left").drop("node").join(reached, F.col("rep") == F.col("node"), "left")
        .select(F.concat_ws(":", "h1", "h2").alias("h"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    own = given.select("id", F.when(F.col("ok"), F.concat_ws(":", "h1", "h2")).alias("g"))
    component = F.coalesce("component", F.col("id").cast("long"))
    return own.join(named, F.col("g") == F.col("h"), "left").select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def _links(same: DataFrame, centres, dim: int, cosine: float, most: int) -> DataFrame:
    """(id, n, root) of all groups of cells."""

    def assign(b: pa.RecordBatch) -> dict:
        vectors = unit(np.array(b.column(2).flatten()).reshape(-1, dim))
        return {"rep": b.column(0), "copies": b.column(1), "v": b.column(2), "cells": pa.array(cells(vectors, centres.value, cosine), pa.list_(pa.int32()))}

    placed = stored(map_rows(same.select("rep", "copies", "v"), lambda: assign, "rep long, copies long, v array<double>, cells array<int>"))
    each = placed.select("rep", "copies", "v", "cells", F.posexplode("cells").alias("place", "cell")).withColumn("home", F.col("place") == 0)
    # at most twice MAX_CELLS rows
    sizes = {(r[0], r[1]): r[2] for r in each.groupBy("cell", "home").count().collect()}

    def blocks(home: bool, rows: int) -> Column:
        known = {c: -(-n // rows) for (c, h), n in sizes.items() if h == home}
        of = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[F.col("cell")] if known else F.lit(None).cast("int")
        return F.coalesce(of, F.lit(0))

    def numbers(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    each = each.withColumns({"homes": blocks(True, most), "guests": blocks(False, GUESTS * most)})
    block = F.pmod(F.xxhash64("rep"), F.greatest(F.lit(1), F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests")))).cast("int")
    each = each.withColumn("block", block)
    mine = F.col("block")

    def task(kind: int, a: Column, b: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))

    # homes meet homes of every block and guests of every block; guests meet homes alone
    with_homes = F.transform(numbers(F.col("homes")), lambda x: task(0, F.least(x, mine), F.greatest(x, mine)))
    with_guests = F.transform(numbers(F.col("guests")), lambda x: task(1, mine, x))
    as_guest = F.transform(numbers(F.col("homes")), lambda x: task(1, x, mine))
    groups = each.withColumn("task", F.explode(F.when(F.col("home"), F.concat(with_homes, with_guests)).otherwise(as_guest))).select(
        F.xxhash64("cell", "task").alias("key"), "cell", "task.kind", "home", "block", "rep", "copies", "v", "cells"
    )

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches):
            lists = run["cells"].to_pylist()
            vectors = unit(np.array(run["v"].combine_chunks().flatten()).reshape(-1, dim))
            found, home, block = _Found(run["copies"].to_numpy()), np.flatnonzero(run["home"].to_numpy()), run["block"].to_numpy()
            if run["kind"][0].as_py():
                own, guests = np.array([x[0] for x in lists]), np.flatnonzero(~run["home"].to_numpy())
                across(found, vectors, home, guests, own, lists, run["cell"][0].as_py(), centres.value, cosine)
            else:
                first = block[home] == block[home].min()
                among(found, vectors, home[first], None if first.all() else home[~first], cosine)
            ids, n, roots = found.rows(run["rep"].to_numpy())
            if len(ids):
                yield pa.RecordBatch.from_pydict({"id": ids, "n": n, "root": roots})

    return dealt(groups, "rep").mapInArrow(linked, "id long, n long, root long")
