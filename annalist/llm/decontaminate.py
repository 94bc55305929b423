"""Benchmark decontamination by Wu-Manber search over words (operator 7)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from annalist.llm.tables import clean_names, map_rows, stored, typed, words

WINDOW = 10
#: Words of a block that the shift tables are keyed by.
BLOCK = 3
#: Texts of the test items that one search table may hold, in bytes; more items are searched in several passes.
TABLE_BYTES = 16 << 20

HITS = "starts array<int>, ends array<int>, items array<long>"


class WuManber:
    """All windows of the test items, in one shift table and one set of suffix buckets for each window length.

    Windows have ``window`` words; an item of fewer words is one window of its own length.
    """

    def __init__(self, items: Iterable[tuple[int, str | None]], window: int = WINDOW):
        owners: dict[int, dict[tuple[bytes, ...], set[int]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            own = words(text)
            size = min(window, len(own))
            for i in range(len(own) - size + 1 if size else 0):
                owners[size][tuple(own[i : i + size])].add(item)
        self.tables = []
        for size, known in sorted(owners.items()):
            block = min(BLOCK, size)
            shift: dict[tuple[bytes, ...], int] = {}
            suffix: dict[tuple[bytes, ...], list[tuple[tuple[bytes, ...], frozenset[int]]]] = defaultdict(list)
            for pattern, of in known.items():
                for end in range(block, size + 1):
                    key = pattern[end - block : end]
                    shift[key] = min(shift.get(key, size), size - end)
                suffix[pattern[size - block :]].append((pattern, frozenset(of)))
            self.tables.append((size, block, shift, dict(suffix)))

    def search(self, own: list[bytes]) -> tuple[list[int], list[int], set[int]]:
        """Start and end of every stretch of hit words, and the items with occurring windows."""
        found: list[tuple[int, int]] = []
        items: set[int] = set()
        for size, block, shift, suffix in self.tables:
            if size > len(own):
                continue
            # block i ends at word i + block - 1
            blocks = list(zip(*(own[k:] for k in range(block))))
            skip = size - block + 1
            at, last, get = size - block, len(blocks), shift.get
            while at < last:
                step = get(blocks[at], skip)
                if step:
                    at += step
                    continue
                start = at + block - size
                for pattern, of in suffix[blocks[at]]:
                    if tuple(own[start : start + size]) == pattern:
                        items |= of
                        found.append((start, start + size))
                        break  # patterns are distinct
                at += 1
        starts: list[int] = []
        ends: list[int] = []
        for a, b in sorted(found):
            if ends and a <= ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                starts.append(a)
                ends.append(b)
        return starts, ends, items


def _scan(docs: DataFrame, items: DataFrame, keep: list[str], text: str, window: int) -> DataFrame:
    """One pass over the documents for items whose texts fit a table: columns ``keep``, n_words and hits."""
    tests = [(r[0], r[1]) for r in items.collect()]  # bounded by TABLE_BYTES
    sent = docs.sparkSession.sparkContext.broadcast(tests)
    rows = clean_names(docs, *dict.fromkeys([*keep, text]))
    at = rows.columns.index(text)

    def make() -> Callable[[pa.RecordBatch], dict]:
        searcher = WuManber(sent.value, window)

        def of(b: pa.RecordBatch) -> dict:
            counts, starts, ends, hit = [], [], [], []
            for t in b.column(at).to_pylist():
                own = words(t)
                s, e, i = searcher.search(own)
                counts.append(len(own))
                starts.append(s)
                ends.append(e)
                hit.append(sorted(i))
            ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
            return {c: b.column(i) for i, c in enumerate(keep)} | {
                "n_words": pa.array(counts, pa.int64()), "starts": pa.array(starts, ints), "ends": pa.array(ends, ints), "items": pa.array(hit, longs)
            }

        return of

    return map_rows(rows, make, f"{typed(rows, keep)}, n_words long, {HITS}")


def _tests(benchmark: DataFrame, item: str, item_text: str, table_bytes: int) -> list[DataFrame]:
    """The items with texts, in blocks whose texts fit a table."""
    tests = benchmark.select(
        F.coalesce(F.col(f"`{item}`").cast("long"), F.lit(-1)).alias("item"), F.col(f"`{item_text}`").alias("t")
    ).filter("t is not null")
    total = tests.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    blocks = -(-total // table_bytes)
    part = F.pmod(F.xxhash64("item", "t"), F.lit(blocks))
    return [tests.filter(part == b) for b in range(blocks)] if blocks > 1 else [tests]


def uncontaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, table_bytes: int = TABLE_BYTES
) -> DataFrame:
    """The documents, with all their columns, in which no test window occurs.

    One pass for each block of items, without a shuffle. Null and empty texts stay, repeated
    rows are judged alike, and an empty benchmark drops nothing.
    """
    kept = docs.columns
    for part in _tests(benchmark, item, item_text, table_bytes):
        inner = docs.select(F.col(f"`{text}`").alias("_t"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"))
        docs = _scan(inner, part, ["_row"], "_t", window).filter("size(starts) = 0").select("_row.*")
    return docs


def contamination(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = WINDOW, table_bytes: int = TABLE_BYTES,
) -> DataFrame:
    """(key, n_words, starts, ends, items): stretches of words of each document that test windows cover.

    Every window of every item is searched in every whole document. Null and empty texts
    have no words, items without words no windows; repeated items and documents are
    searched like others; an empty benchmark hits nothing. Item ids are cast to long and
    a null id counts as -1. The items' texts are measured first: up to ``table_bytes`` they
    go to the executors at once and the documents are read in one pass without a shuffle;
    beyond it they are dealt into blocks of that size, one pass each, and the hits of a
    document are merged by its row; the narrow rows are stored once for that.
    """
    tests = _tests(benchmark, item, item_text, table_bytes)
    if len(tests) == 1:
        return _scan(docs, tests[0], [key], text, window)
    # hits are merged by row, not by key: keys may repeat or be null
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")))
    passes = [_scan(rows, part, ["row"], "t", window) for part in tests]
    found = [p.filter("size(starts) > 0") for p in passes]
    gathered = reduce(DataFrame.union, found).groupBy(F.col("row").alias("hit_row")).agg(
        F.flatten(F.collect_list("starts")).alias("s"), F.flatten(F.collect_list("ends")).alias("e"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("i"),
    )
    ints, none = F.array().cast("array<int>"), F.array().cast("array<long>")
    every = passes[0].select("row", "n_words").join(rows.select(F.col("row").alias("r"), "k"), F.col("row") == F.col("r")).join(gathered, F.col("row") == F.col("hit_row"), "left")
    every = every.select(F.col("k").alias(key), "n_words", F.coalesce("s", ints).alias("s"), F.coalesce("e", ints).alias("e"), F.coalesce("i", none).alias("i"))

    def make() -> Callable[[pa.RecordBatch], dict]:
        def of(b: pa.RecordBatch) -> dict:
            starts, ends = [], []
            for s, e in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                s, e = merged(s, e)
                starts.append(s)
                ends.append(e)
            ints = pa.list_(pa.int32())
            return {key: b.column(0), "n_words": b.column(1), "starts": pa.array(starts, ints), "ends": pa.array(ends, ints), "items": b.column(4)}

        return of

    return map_rows(every, make, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_words long, {HITS}")


def merged(starts: list[int], ends: list[int]) -> tuple[list[int], list[int]]:
    """The union of stretches, in order."""
    if not starts:
        return [], []
    order = np.argsort(starts, kind="stable")
    s, e = np.asarray(starts)[order], np.maximum.accumulate(np.asarray(ends)[order])
    first = np.r_[True, s[1:] > e[:-1]]
    return s[first].tolist(), e[np.r_[np.flatnonzero(first)[1:] - 1, len(s) - 1]].tolist()
