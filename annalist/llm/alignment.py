"""Alignment of the tokens of two vocabularies by sparse products (operator 13)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from annalist.llm.encoders import ByteIds, PieceIds, pair_encoder
from annalist.llm.tables import clean_names, discard, map_rows, pieces, stored, typed

#: Bytes of text whose tokens are multiplied at once; a stretch without a common token end is never cut.
WINDOW = 1 << 20
#: Bytes of text that a task aligns at once; a document is never cut.
BATCH = 4 << 20
#: Pairs of ids, of those in two documents and more, that are broadcast; more are joined.
PAIRS = 4_000_000
#: Pairs of ids that a task counts before it gives them away.
HELD_PAIRS = 1 << 20


class Csr(NamedTuple):
    """Rows of a sparse matrix of counts: those of row i are ``indices[starts[i]:starts[i+1]]``, ``values`` beside them."""

    starts: np.ndarray
    indices: np.ndarray
    values: np.ndarray
    width: int


def incidence(ends: np.ndarray, width: int) -> Csr:
    """Which columns each row covers, rows being neighbouring stretches that end at ``ends``."""
    return Csr(np.r_[0, ends], np.arange(width), np.ones(width, dtype=np.int64), width)


def transposed(m: Csr) -> Csr:
    """Columns as rows; within each the old rows in order."""
    rows = np.repeat(np.arange(len(m.starts) - 1), np.diff(m.starts))
    order = np.argsort(m.indices, kind="stable")
    return Csr(np.r_[0, np.cumsum(np.bincount(m.indices, minlength=m.width))], rows[order], m.values[order], len(m.starts) - 1)


def product(a: Csr, b: Csr) -> Csr:
    """Gustavson's product: row i is the sum of the rows of ``b`` that row i of ``a`` names, equal columns added up."""
    sizes = np.diff(b.starts)[a.indices]
    at = np.repeat(b.starts[a.indices] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    key = np.repeat(np.repeat(np.arange(len(a.starts) - 1), np.diff(a.starts)), sizes) * b.width + b.indices[at]
    value = np.repeat(a.values, sizes) * b.values[at]
    if len(key) and (key[1:] < key[:-1]).any():
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
    rows = key[first] // b.width if b.width else first
    return Csr(
        np.r_[0, np.cumsum(np.bincount(rows, minlength=len(a.starts) - 1))],
        key[first] % max(b.width, 1),
        np.add.reduceat(value, first) if len(first) else first,
        b.width,
    )


class Aligned(NamedTuple):
    """Tokens of some documents one after another, their groups, and the links between overlapping tokens."""

    a_group: np.ndarray
    b_group: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    overlap: np.ndarray

    def shared(self) -> tuple[np.ndarray, np.ndarray]:
        """(first, n): the tokens of B that share a group with each token of A.

        That is the product of both group incidences: a token of A names one group, whose row
        is a run of B, so each row of the product is a run as well and needs no list.
        """
        groups = int(self.a_group[-1]) + 1 if len(self.a_group) else 0
        b_groups = transposed(Csr(np.arange(len(self.b_group) + 1), self.b_group, np.ones(len(self.b_group), dtype=np.int64), groups))
        return b_groups.starts[self.a_group], np.diff(b_groups.starts)[self.a_group]


def align(a_sizes: np.ndarray, b_sizes: np.ndarray, window: int = WINDOW) -> Aligned:
    """Groups and overlaps of two ways to cut the same bytes, given the tokens' lengths in bytes."""
    a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
    a_group, b_group = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)
    found: list[tuple[np.ndarray, ...]] = []
    done = a_at = b_at = 0
    while done < len(cuts):
        start = int(cuts[done - 1]) if done else 0
        done = max(done + 1, int(np.searchsorted(cuts, start + window, side="right")))
        end = int(cuts[done - 1])
        a_to, b_to = int(np.searchsorted(a_ends, end, side="right")), int(np.searchsorted(b_ends, end, side="right"))
        a, b = (incidence(ends - start, end - start) for ends in (a_ends[a_at:a_to], b_ends[b_at:b_to]))
        links = product(a, transposed(b))
        found.append((np.repeat(np.arange(a_at, a_to), np.diff(links.starts)), links.indices + b_at, links.values))
        a_at, b_at = a_to, b_to
    none = np.zeros(0, dtype=np.int64)
    return Aligned(a_group, b_group, *(np.concatenate(x) for x in (zip(*found) if found else ((none,),) * 3)))


class Pair:
    """Two encoders and what aligning their tokens needs."""

    def __init__(self, a: ByteIds, b: PieceIds):
        self.a, self.b = a, b
        self.a_size, self.b_size = (np.array([len(x) for x in e.spelled], dtype=np.int64) for e in (a, b))
        # an id and the mark after it, as text: first those of A, then those of B
        self.marked = np.array(
            [f"{i}{m}" for of, marks in ((a, ",|"), (b, (",", ";", ""))) for m in marks for i in range(len(of.spelled))], dtype=object
        )

    def encode(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both; none for texts that are null or empty or that the ids do not spell."""
        used = [i for i, t in enumerate(texts) if t]
        a: list[list[int]] = [[] for _ in texts]
        b: list[list[int]] = [[] for _ in texts]
        for i, pieces_ in zip(used, self.b.ids([texts[i] for i in used])):
            said = " " + texts[i]
            ids = self.a.ids(said)
            plain = said.encode()
            if all(b"".join([e.spelled[x] for x in own]) == plain for e, own in ((self.a, ids), (self.b, pieces_))):
                a[i], b[i] = ids, pieces_
        return a, b

    def spelled_groups(self, a: np.ndarray, b: np.ndarray, of: Aligned) -> np.ndarray:
        """Places in ``marked`` of ``a1,a2|b1;a3|b2,b3;``, in that order."""
        groups = int(of.a_group[-1]) + 1 if len(a) else 0
        n_a, n_b = (np.bincount(g, minlength=groups) for g in (of.a_group, of.b_group))
        a_ends, b_ends = np.cumsum(n_a), np.cumsum(n_b)
        at = np.empty(len(a) + len(b), dtype=np.int64)
        va, vb = len(self.a_size), len(self.b_size)
        last = np.zeros(len(a), dtype=np.int64)
        last[a_ends - 1] = va
        at[np.arange(len(a)) + (b_ends - n_b)[of.a_group]] = a + last
        last = np.zeros(len(b), dtype=np.int64)
        last[b_ends - 1] = vb
        at[np.arange(len(b)) + a_ends[of.b_group]] = b + last + 2 * va
        return at

    def digests(self, a: np.ndarray, b: np.ndarray, of: Aligned, n_a: np.ndarray, n_b: np.ndarray) -> list[str]:
        """SHA-256 of each document's groups in text, '' without tokens."""
        at = self.spelled_groups(a, b, of)
        ends = np.cumsum(n_a + n_b)
        at[ends[n_a > 0] - 1] += len(self.b_size)  # a document ends without a mark
        text = self.marked[at].tolist()
        return [hashlib.sha256("".join(text[e - n : e]).encode()).hexdigest() if n else "" for e, n in zip(ends.tolist(), (n_a + n_b).tolist())]


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in ids], dtype=np.int64)
    return np.fromiter((i for x in ids for i in x), dtype=np.int64, count=int(sizes.sum())), sizes


def _sums(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(of, weights=values, minlength=n).astype(np.int64)


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    raw = values.astype("<u4").tobytes()
    return pa.array([raw[4 * s : 4 * e] for s, e in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())], pa.binary())


_TOLD = "n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string, pairs binary, times binary"


def _told(pair: Pair, texts: list[str | None]) -> dict:
    """Columns of ``_TOLD`` for some documents."""
    a_ids, b_ids = pair.encode(texts)
    (a, n_a), (b, n_b) = _flat(a_ids), _flat(b_ids)
    n = len(texts)
    of = align(pair.a_size[a], pair.b_size[b])
    doc = np.repeat(np.arange(n), n_a)
    grouped = np.flatnonzero(np.r_[True, of.a_group[1:] != of.a_group[:-1]]) if len(a) else doc
    vocabulary = len(pair.b_size)
    span = len(pair.a_size) * vocabulary
    keys, times = np.unique(doc[of.link_a] * span + a[of.link_a] * vocabulary + b[of.link_b], return_counts=True)
    ends = np.searchsorted(keys, np.arange(1, n + 1) * span)
    return {
        "n_a": pa.array(n_a), "n_b": pa.array(n_b), "n_groups": pa.array(np.bincount(doc[grouped], minlength=n)), "n_links": pa.array(np.bincount(doc[of.link_a], minlength=n)),
        "n_shared": pa.array(_sums(of.shared()[1], doc, n)), "groups_sha256": pa.array(pair.digests(a, b, of, n_a, n_b), pa.string()),
        "pairs": _packed(keys % span, ends), "times": _packed(times, ends),
    }


def told(docs: DataFrame, encoders: Callable[[], tuple[ByteIds, PieceIds]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(uid, key, n_a, n_b, n_groups, n_links, n_shared, groups_sha256, pairs, times) per document.

    ``n_shared`` counts pairs of tokens in one group. ``pairs`` are the distinct linked pairs
    of ids, a * (size of B) + b, and ``times`` their occurrences, packed as 32-bit integers.
    Texts that are null, empty or not spelled by the ids of both have no tokens: zeros and ''.
    Repeated rows and null keys are documents of their own; other columns are left out.
    """
    rows = clean_names(docs, key, text)

    def make() -> Callable[[pa.RecordBatch], dict]:
        pair, context = Pair(*encoders()), TaskContext.get()
        if len(pair.a_size) * len(pair.b_size) >= 1 << 32:
            raise ValueError("pairs of ids of these vocabularies do not fit 32 bits")
        uid = (context.partitionId() if context else 0) << 33

        def of(batch: pa.RecordBatch) -> dict:
            nonlocal uid
            out: dict[str, list] = {}
            for b in pieces(batch, BATCH):
                part = {"uid": pa.array(range(uid, uid + b.num_rows), pa.int64()), key: b.column(0), **_told(pair, b.column(1).to_pylist())}
                uid += b.num_rows
                for c, x in part.items():
                    out.setdefault(c, []).append(x)
            return {c: pa.concat_arrays(x) for c, x in out.items()}

        return of

    return map_rows(rows, make, f"uid long, {typed(rows, [key])}, {_TOLD}")


def alignments(docs: DataFrame, encoders: Callable[[], tuple[ByteIds, PieceIds]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, a, b, a_group, b_group, links, shared): ids of both, the group of each token, and both kinds of links.

    ``links`` holds (a, b, bytes) for tokens, counted from 0, that overlap; ``shared`` holds for each
    token of A the run (first, n) of tokens of B in its group, the pairs themselves being as many
    as the product of the counts. Documents without tokens have empty lists.
    """
    rows = clean_names(docs, key, text)
    ints, link, run = "array<int>", "array<struct<a:int,b:int,bytes:int>>", "array<struct<first:int,n:int>>"

    def make() -> Callable[[pa.RecordBatch], dict]:
        pair = Pair(*encoders())

        def of(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {c: [] for c in ("a", "b", "a_group", "b_group", "links", "shared")}
            for a, b in zip(*pair.encode(batch.column(1).to_pylist())):
                x = align(pair.a_size[a] if a else np.zeros(0, dtype=np.int64), pair.b_size[b] if b else np.zeros(0, dtype=np.int64))
                for c, v in zip(out, (a, b, x.a_group.tolist(), x.b_group.tolist())):
                    out[c].append(v)
                out["links"].append([{"a": i, "b": j, "bytes": k} for i, j, k in zip(x.link_a.tolist(), x.link_b.tolist(), x.overlap.tolist())])
                out["shared"].append([{"first": i, "n": j} for i, j in zip(*(y.tolist() for y in x.shared()))])
            three = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("bytes", pa.int32())]))
            two = pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())]))
            kinds = [*[pa.list_(pa.int32())] * 4, three, two]
            return {key: batch.column(0), **{c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds)}}

        return of

    return map_rows(rows, make, f"{typed(rows, [key])}, a {ints}, b {ints}, a_group {ints}, b_group {ints}, links {link}, shared {run}")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per pair, added up in the task before they are shuffled."""
    held = (np.zeros(0, dtype=np.int64),) * 2

    def given(pairs: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(pairs), 1 << 16):
            yield pa.RecordBatch.from_pydict({"pair": pa.array(pairs[i : i + (1 << 16)]), "docs": pa.array(docs[i : i + (1 << 16)])})

    for batch in batches:
        for part in pieces(batch):
            new, n = np.unique(np.frombuffer(b"".join(part.column(0).to_pylist()), dtype="<u4").astype(np.int64), return_counts=True)
            pairs, back = np.unique(np.r_[held[0], new], return_inverse=True)
            held = pairs, _sums(np.r_[held[1], n], back, len(pairs))
            if len(pairs) > HELD_PAIRS:
                yield from given(*held)
                held = held[0][:0], held[1][:0]
    yield from given(*held)


def pair_counts(of: DataFrame) -> DataFrame:
    """(pair, docs): in how many documents of ``told`` each pair of ids is linked."""
    return of.select("pairs").mapInArrow(_counted, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))


def weighed(of: DataFrame, b_size: int, most: int = PAIRS, keep: tuple[str, ...] = ("uid",)) -> DataFrame:
    """Columns ``keep`` of ``told``'s rows with (n_best, count_sum).

    Every link weighs the documents that hold its pair of ids; ``n_best`` are the links whose
    pair has the largest weight of its id in A, ``count_sum`` is the sum of all weights. A pair that is
    missing among those of two documents and more is in one, so only those are sent to the
    tasks, if a count shows at most ``most`` of them; else pairs are joined with their counts.
    """
    spark = of.sparkSession
    counts = stored(pair_counts(of))
    often = counts.filter("docs > 1")
    if often.count() > most:
        return _joined(of, counts, b_size, keep)
    table = often.toArrow().sort_by("pair")
    discard(counts)
    sent = spark.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("pair", "docs")))

    def make() -> Callable[[pa.RecordBatch], dict]:
        pairs, docs = sent.value
        best = np.ones(int(pairs[-1]) // b_size + 1 if len(pairs) else 1, dtype=np.int64)
        np.maximum.at(best, pairs // b_size, docs)

        def weigh(batch: pa.RecordBatch) -> dict:
            n = len(keep)
            raw = batch.column(n).to_pylist()
            own, times = (np.frombuffer(b"".join(x), dtype="<u4").astype(np.int64) for x in (raw, batch.column(n + 1).to_pylist()))
            row = np.repeat(np.arange(len(raw)), [len(x) // 4 for x in raw])
            at = np.searchsorted(pairs, own)
            at[at == len(pairs)] = 0
            count = np.where(pairs[at] == own, docs[at], 1) if len(pairs) else np.ones(len(own), dtype=np.int64)
            a = own // b_size
            top = np.where(a < len(best), best[np.minimum(a, len(best) - 1)], 1)
            values = {"n_best": times * (count == top), "count_sum": times * count}
            return {c: batch.column(i) for i, c in enumerate(keep)} | {c: pa.array(_exact(v, row, len(raw)), pa.int64()) for c, v in values.items()}

        return weigh

    return map_rows(clean_names(of, *keep, "pairs", "times"), make, f"{typed(of, list(keep))}, n_best long, count_sum long")


def _exact(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Sums per row in whole numbers, whatever their size."""
    run = np.r_[0, np.cumsum(values)]
    ends = np.searchsorted(row, np.arange(n), side="right")
    return run[ends] - run[np.r_[0, ends[:-1]]] if n else run[:0]


def _joined(of: DataFrame, counts: DataFrame, b_size: int, keep: tuple[str, ...]) -> DataFrame:
    """The same by joins, for tables of pairs of any size; a pair of most documents is one key that Spark can split."""

    def make() -> Callable[[pa.RecordBatch], dict]:
        def spread(batch: pa.RecordBatch) -> dict:
            raw = batch.column(1).to_pylist()
            row = np.repeat(np.arange(len(raw)), [len(x) // 4 for x in raw])
            own, times = (np.frombuffer(b"".join(x), dtype="<u4").astype(np.int64) for x in (raw, batch.column(2).to_pylist()))
            return {"uid": batch.column(0).take(pa.array(row)), "pair": pa.array(own), "times": pa.array(times)}

        return spread

    links = map_rows(clean_names(of, "uid", "pairs", "times"), make, "uid long, pair long, times long")
    a = F.floor(F.col("pair") / b_size)
    best = counts.groupBy(a.alias("a")).agg(F.max("docs").alias("best"))
    known = counts.withColumn("a", a).join(best, "a").select(F.col("pair").bitwiseXOR(F.lit(0).cast("long")).alias("own"), "docs", (F.col("docs") == F.col("best")).alias("top"))
    sums = links.join(known, F.col("pair") == F.col("own")).groupBy("uid").agg(
        F.sum(F.when(F.col("top"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum")
    )
    every = of.select(F.col("uid").alias("_uid"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)])
    return every.join(sums, F.col("_uid") == F.col("uid"), "left").select(
        *[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    )


def statistics(docs: DataFrame, bytewise: str, ranks: str, pattern: str, piecewise: str, key: str = "doc_id", text: str = "text", most: int = PAIRS) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_shared, n_best, count_sum, groups_sha256) per document; see ``told`` and ``weighed``.

    ``bytewise`` and ``ranks`` are one byte-level vocabulary in both its forms, ``piecewise`` a
    sentencepiece model, all paths on the driver. Documents are encoded once; their distinct
    pairs are stored, counted over all documents and read again.
    """
    encoders = pair_encoder(docs.sparkSession, bytewise, ranks, pattern, piecewise)
    of = stored(told(docs, encoders, key, text))
    own = (key, "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256")
    b_size = PieceIds(open(piecewise, "rb").read()).model.vocab_size()
    out = stored(weighed(of, b_size, most, own).select(*own[:-1], "n_best", "count_sum", own[-1]))
    discard(of)
    return out
