"""SimHash fingerprints and near duplicates with a Gray-order hierarchical index (operator 1)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from annalist.llm.components import components
from annalist.llm.groups import GROUP_ROWS, Union, dealt, runs, split_hot
from annalist.llm.tables import clean_names, map_rows, spaced, stored

SEED = 42
#: Near duplicates by shingles: words of a shingle, least Jaccard similarity.
SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints of near duplicates that differ in at most so many bits bring their texts together.
NEAR_BITS = 3
#: Bits of the sketch of a set; what two sketches differ in, the sets differ in at least.
SKETCH_BITS = 512
#: Independent least shingles that candidates are brought together by; two texts of similarity s miss with (1 - s) ** LEAST.
LEAST = 8
#: Texts of a group whose sketches one task compares; they are 64 bytes each.
CANDIDATE_ROWS = 1 << 14
#: Children of an index node, and pairs of queries and nodes that are held at once.
FANOUT, FRONTIER = 8, 1 << 20


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words, repeats included; fewer words make one run, none make none."""
    own = spaced(text)
    if not own:
        return np.empty(0, np.uint64)
    line = b" ".join(own)
    if len(own) <= size:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = [0, *(gaps[: len(own) - size] + 1).tolist()]
    ends = [*gaps[size - 1 :].tolist(), len(line)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; none give 0."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def gray_rank(code: Column) -> Column:
    """Place of a code in Gray order, as a signed number."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


class GrayIndex:
    """Codes in Gray order under nodes of ``FANOUT`` children.

    A node's mask holds the bits that all codes below it share and that no node above it
    has already; so differences to a query add up on the way down, and a node is left with
    its whole group as soon as they pass the limit.
    """

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        levels = [(codes, codes)]  # AND and OR of each group, from single codes up
        while len(levels[-1][0]) > FANOUT:
            both, either = levels[-1]
            cuts = np.arange(0, len(both), FANOUT)
            levels.append((np.bitwise_and.reduceat(both, cuts), np.bitwise_or.reduceat(either, cuts)))
        self.levels = []
        above: np.ndarray | None = None
        for both, either in reversed(levels):
            mask = ~(both ^ either)
            fresh = mask if above is None else mask & ~np.repeat(above, FANOUT)[: len(mask)]
            self.levels.append((both, fresh))
            above = mask

    def search(self, queries: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, code) by place, for all pairs that differ in at most ``limit`` bits."""
        n = len(self.levels[0][0])
        q, node = np.repeat(np.arange(len(queries)), n), np.tile(np.arange(n), len(queries))
        acc = np.zeros(len(q), np.int64)
        for depth, (pattern, mask) in enumerate(self.levels):
            if depth:
                q, acc = np.repeat(q, FANOUT), np.repeat(acc, FANOUT)
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                real = node < len(pattern)
                q, acc, node = q[real], acc[real], node[real]
            acc = acc + np.bitwise_count((queries[q] ^ pattern[node]) & mask[node])
            near = acc <= limit
            q, acc, node = q[near], acc[near], node[near]
        return q, node

    def pairs(self, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of different codes within the limit, in parts, each pair once."""
        step = max(1, FRONTIER // max(1, len(self.codes)))
        for at in range(0, len(self.codes), step):
            a, b = self.search(self.codes[at : at + step], limit)
            a = a + at
            yield a[a < b], b[a < b]


def _fingerprints(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    rows = clean_names(docs, key, text)

    def of(b: pa.RecordBatch) -> dict:
        codes = [fingerprint(shingle_hashes(t, size)) for t in b.column(1).to_pylist()]
        return {key: b.column(0), "fp": pa.array(np.array(codes, np.uint64).view(np.int64))}

    return map_rows(rows, lambda: of, f"`{key}` {rows.schema[key].dataType.simpleString()}, fp long")


def _segment(code: Column, start: int, size: int) -> Column:
    """``size`` bits from bit ``start`` on, around the end."""
    start %= 64
    turned = F.shiftrightunsigned(code, start).bitwiseOR(F.shiftleft(code, 64 - start)) if start else code
    return turned.bitwiseAND(F.lit((1 << size) - 1))


def _cuts(start: int, size: int, n: int) -> list[tuple[int, int]]:
    ends = [start + size * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def links(codes: DataFrame, limit: int, most: int = GROUP_ROWS) -> DataFrame:
    """(a, b): edges that span the groups of ``codes`` (fp, rep) linked within ``limit`` bits.

    Codes that differ in at most ``limit`` bits agree in one of ``limit + 1`` segments, so
    equal segments bring them to one task, where the Gray-order index finds all links.
    Segments that very many codes share are cut again over the remaining bits, by the same
    rule, and then into pairs of blocks. A task gives edges to roots, never all pairs.
    """
    rows = codes.withColumn("gray", gray_rank(F.col("fp")))
    keys = [F.struct(F.xxhash64(F.lit(i), _segment(F.col("fp"), a, n)).alias("key"), F.lit(i).alias("part")) for i, (a, n) in enumerate(_cuts(0, 64, limit + 1))]
    rows = rows.withColumn("k", F.explode(F.array(*keys))).select("k.key", "k.part", "gray", "fp", "rep")

    def finer(key: Column) -> list[Column]:
        out = []
        for j in range(limit + 1):
            of = F.lit(0).cast("long")
            for i, (a, n) in enumerate(_cuts(0, 64, limit + 1)):
                start, size = _cuts(a + n, 64 - n, limit + 1)[j]
                of = F.when(F.col("part") == i, _segment(F.col("fp"), start, size)).otherwise(of)
            out.append(F.xxhash64(key, F.lit(j), of))
        return out

    def spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches):
            code, rep = run["fp"].to_numpy().view(np.uint64), run["rep"].to_numpy()
            sets = Union(len(code))
            for a, b in GrayIndex(code).pairs(limit):
                sets.join(a, b)
            low = np.flatnonzero(sets.roots != np.arange(len(code)))
            if len(low):
                yield pa.RecordBatch.from_pydict({"a": rep[low], "b": rep[sets.roots[low]]})

    return dealt(split_hot(rows, finer, most, "fp").select("key", "gray", "fp", "rep"), "gray").mapInArrow(spanning, "a long, b long")


def simhash(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, limit: int = 2, most: int = GROUP_ROWS) -> DataFrame:
    """(key, fp, component): fingerprint of each whole text and the least key reachable by links.

    Fingerprints link at ``limit`` or fewer differing bits. Copies share a fingerprint and
    are compared once. Null and empty texts have no shingles and the fingerprint 0, linked
    like any other; null keys take part but are no component's name; repeated rows stay;
    an empty table gives no rows.
    """
    prints = stored(_fingerprints(docs, key, text, size))
    codes = prints.groupBy("fp").agg(F.min(key).cast("long").alias("rep"))
    reached = components(links(codes.filter("rep is not null"), limit, most))
    # a computed key: both sides of the join get an exchange, and a hot fingerprint is split
    named = codes.join(reached, F.col("rep") == F.col("node"), "left").select(F.col("fp").bitwiseXOR(F.lit(0).cast("long")).alias("code"), F.coalesce("component", "rep").alias("component"))
    return prints.join(named, F.col("fp") == F.col("code")).select(key, "fp", "component")


_TURNS = np.random.default_rng(SEED).integers(1, 2**63, LEAST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_shingles(hashes: np.ndarray) -> np.ndarray:
    """The least hash of a set under each of ``LEAST`` mixings."""
    out = np.zeros(LEAST, np.uint64)
    for i, turn in enumerate(_TURNS if len(hashes) else ()):
        x = hashes * turn
        x ^= x >> np.uint64(29)
        out[i] = (x * np.uint64(0x9E3779B97F4A7C15)).min()
    return out


def sketch(distinct: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """A bit for each value that the first bits of the hashes of a set have."""
    marks = np.zeros(bits, bool)
    marks[(distinct >> np.uint64(65 - bits.bit_length())).astype(np.int64)] = True
    return np.packbits(marks).view(np.uint64)


def _possible(sketches: np.ndarray, size: np.ndarray, i: int, others: np.ndarray, similarity: float) -> np.ndarray:
    """Those of ``others`` whose sets may be as similar to the set ``i``; no pair that is gets lost.

    A bit that one sketch alone has stands for at least one shingle that the other set lacks.
    """
    others = others[np.minimum(size[others], size[i]) >= similarity * np.maximum(size[others], size[i]) - 1e-9]
    mine, theirs = sketches[i], sketches[others]
    shared = np.minimum(size[i] - np.bitwise_count(mine & ~theirs).sum(1, dtype=np.int64), size[others] - np.bitwise_count(theirs & ~mine).sum(1, dtype=np.int64))
    return others[shared >= similarity * (size[i] + size[others] - shared) - 1e-9]


def _by_fingerprint(texts: DataFrame) -> DataFrame:
    """(key, rep): the texts (fp, rep) that links of ``NEAR_BITS`` bits in the Gray-order index bring together."""
    codes = stored(texts.groupBy("fp").agg(F.min("rep").alias("rep")))
    reached = components(links(codes, NEAR_BITS))
    named = codes.join(reached, F.col("rep") == F.col("node"), "left").select(
        F.col("fp").bitwiseXOR(F.lit(0).cast("long")).alias("code"), F.xxhash64(F.lit("fp"), F.coalesce("component", "rep")).alias("key")
    )
    met = stored(texts.join(named, F.col("fp") == F.col("code")).select("key", "rep"))
    return met.join(met.groupBy("key").count().filter("count > 1").select("key"), "key", "left_semi")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY, most: int = CANDIDATE_ROWS
) -> DataFrame:
    """(key, class): the least key of the texts that links of Jaccard similarity reach.

    Texts link if their sets of ``size``-word shingles have a Jaccard similarity of at least
    ``similarity``. Texts with equal sets are one. The others are brought together by the
    SimHash index, where links of ``NEAR_BITS`` bits reach, and those that fingerprints set
    further apart by any of ``LEAST`` least shingles; in such a group of least shingles, sizes and sketches rule out pairs that cannot be
    so similar, and the whole shingle sets of all others decide. Groups of many rows are cut by
    a second least shingle and then into pairs of blocks, so no pair is dropped. Null and
    empty texts form one class; null keys have none; an empty table gives no rows. Keys name
    one text each.
    """
    rows = clean_names(docs, key, text)

    def of(b: pa.RecordBatch) -> dict:
        same, least, sizes, bits, codes = [], [], [], [], []
        for t in b.column(1).to_pylist():
            hashes = shingle_hashes(t, size)
            distinct = np.unique(hashes)
            codes.append(fingerprint(hashes))
            sizes.append(len(distinct))
            bits.append(sketch(distinct).tobytes())
            same.append(xxhash.xxh64_intdigest(distinct.tobytes(), SEED))
            least.append(least_shingles(distinct).view(np.int64))
        return {
            "id": b.column(0).cast(pa.int64()), "same": pa.array(np.array(same, np.uint64).view(np.int64)), "least": pa.array(least, pa.list_(pa.int64())),
            "size": pa.array(sizes, pa.int64()), "bits": pa.array(bits, pa.binary()),
            "fp": pa.array(np.array(codes, np.uint64).view(np.int64)),
        }

    prints = stored(map_rows(rows, lambda: of, "id long, same long, least array<long>, size long, bits binary, fp long"))
    texts = stored(prints.groupBy("same").agg(F.min("id").alias("rep"), F.min("fp").alias("fp"), F.min("least").alias("least"), F.min("size").alias("size"), F.min("bits").alias("bits")).filter("rep is not null"))
    keyed = (
        texts.withColumn("k", F.explode(F.array(*[F.struct(F.xxhash64(F.lit(i), F.get("least", F.lit(i))).alias("key"), F.lit(i).alias("part")) for i in range(LEAST)])))
        .select("k.key", "rep", "least", "size", "bits")
    )
    met = split_hot(keyed, lambda k: [F.xxhash64(k, F.lit(i), F.get("least", F.lit(i))) for i in range(LEAST)], most, "rep")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches):
            rep, sizes = run["rep"].to_numpy(), run["size"].to_numpy()
            sketches = np.frombuffer(b"".join(run["bits"].to_pylist()), np.uint64).reshape(len(rep), -1)
            sets = Union(len(rep))
            for i in range(1, len(rep)):
                near = _possible(sketches, sizes, i, np.flatnonzero(sets.roots[:i] != sets.roots[i]), similarity)
                if len(near):
                    sets.join(near, np.full(len(near), i))
            for root in np.flatnonzero(np.bincount(sets.roots) > 1).tolist():
                members = np.unique(rep[sets.roots == root])
                if len(members) > 1:
                    name = np.uint64(xxhash.xxh64_intdigest(members.tobytes(), SEED)).view(np.int64)
                    yield pa.RecordBatch.from_pydict({"key": pa.array(np.full(len(members), name)), "rep": pa.array(members)})

    # the same members meet under several keys; equal groups are verified once
    by_least = dealt(met.select("key", "rep", "size", "bits"), "rep").mapInArrow(candidates, "key long, rep long")
    found = stored(by_least.unionByName(_by_fingerprint(texts.select("fp", "rep"))).distinct())
    whole = rows.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("t"))
    groups = found.join(whole, F.col("rep") == F.col("id")).select("key", "rep", "t")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches):
            rep = run["rep"].to_pylist()
            edges = _similar([shingle_hashes(t.as_py(), size) for t in run["t"]], similarity)
            if edges:
                yield pa.RecordBatch.from_pydict({"a": pa.array([rep[i] for i, _ in edges], pa.int64()), "b": pa.array([rep[j] for _, j in edges], pa.int64())})

    reached = components(dealt(groups, "rep").mapInArrow(verified, "a long, b long"))
    named = texts.join(reached, F.col("rep") == F.col("node"), "left").select(F.col("same").bitwiseXOR(F.lit(0).cast("long")).alias("s"), F.coalesce("component", "rep").alias("class"))
    return prints.join(named, F.col("same") == F.col("s"), "left").select(F.col("id").cast(rows.schema[key].dataType).alias(key), "class")


def _similar(hashes: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Edges that span the groups of sets linked by Jaccard similarity.

    Nearest fingerprints are tried first, and pairs that are in one group already are passed
    over, so a family of near copies costs about one comparison a text.
    """
    codes = np.array([fingerprint(h) for h in hashes], np.uint64)
    sets = [np.unique(h) for h in hashes]
    size = np.array([len(s) for s in sets])
    sketches = np.array([sketch(s, 4 * SKETCH_BITS) for s in sets])
    roots = np.arange(len(sets))
    edges = []
    for i in range(1, len(sets)):
        near = _possible(sketches, size, i, np.flatnonzero(roots[:i] != roots[i]), similarity)
        near = near[np.argsort(np.bitwise_count(codes[i] ^ codes[near]), kind="stable")]
        while len(near := near[roots[near] != roots[i]]):
            j = int(near[0])
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if shared >= similarity * (size[i] + size[j] - shared) - 1e-9:
                edges.append((i, j))
                roots[roots == max(roots[i], roots[j])] = min(roots[i], roots[j])
            else:
                near = near[1:]
    return edges
