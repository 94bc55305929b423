"""Prefix trie of conversations from vertical bitmaps (operator 12)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from annalist.llm.tables import discard, stored, width

#: Conversations and turns that one index holds; a longer conversation has an index of its own.
SHARD_CONVS = 2048
SHARD_TURNS = 1 << 16
#: Ids of one string of a list of ends.
ENDS = 256

ROOT = bytes(16)
_STEP = ("conv", "depth", "t1", "t2", "size")


def _hashed(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, n, r, t1, t2, size): turns without their texts; rows without a conversation are left out."""
    said = [F.coalesce(F.col(f"`{x}`"), F.lit("")) for x in (role, text)]
    return turns.select(
        F.col(f"`{conv}`").cast("long").alias("c"), F.col(f"`{turn}`").alias("n"), said[0].alias("r"),
        F.xxhash64(F.lit(1), *said).alias("t1"), F.xxhash64(F.lit(2), *said).alias("t2"), F.octet_length(said[1]).cast("long").alias("size"),
    ).filter("c is not null")


def steps(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    block: Callable[[Column], Column] | None = None, head: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """(conv, depth, t1, t2, size): each conversation's turns from depth 1 on, and one row of depth 0 for each.

    Turns are ordered by ``turn``, nulls first, those of one number by role and hash, so ties
    have one order; repeated rows are turns of their own. Null roles and texts count as empty.
    Rows without a conversation belong to none. A turn is 128 bits of hash; texts stay where they are.

    With ``block`` and ``head``, conversation c starts with the first head(c) turns of
    conversation block(c) (all if it has fewer, none if it has no turns), and its own turns
    follow after its first head(c). Blocks are ranges of ids, as small as the caller makes them.
    Rows come sorted, partition after partition, from one shuffle by range.
    """
    rows = _hashed(turns, conv, turn, role, text)
    b = F.col("c") if block is None else block(F.col("c"))
    rows = rows.withColumn("b", b).repartitionByRange(width(turns.sparkSession), "b")
    pos = F.row_number().over(W.partitionBy("b", "c").orderBy(F.col("n").asc_nulls_first(), "r", "t1", "t2"))
    rows = rows.withColumn("pos", pos.cast("long"))

    def at(conv: Column, depth: Column, root: bool = False) -> Column:
        none = F.lit(0).cast("long")
        values = (conv, depth, none, none, none) if root else (conv, depth, F.col("t1"), F.col("t2"), F.col("size"))
        return F.struct(*[v.alias(n) for v, n in zip(values, _STEP)])

    c, p, zero = F.col("c"), F.col("pos"), F.lit(0).cast("long")
    nothing = F.array().cast("array<struct<conv:bigint,depth:bigint,t1:bigint,t2:bigint,size:bigint>>")
    made = [F.when(p == 1, F.array(at(c, zero, True))).otherwise(nothing)]
    if head is None:
        made.append(F.array(at(c, p)))
    else:
        whole = W.partitionBy("b")
        rows = rows.withColumns({"first": F.count_if(c == F.col("b")).over(whole), "all": F.collect_set("c").over(whole)})
        h = head(c)
        made.append(F.when(p > h, F.array(at(c, F.least(h, F.col("first")) + p - h))).otherwise(nothing))
        takers = F.transform(F.filter("all", lambda x: head(x) >= p), lambda x: at(x, p))
        made.append(F.when(c == F.col("b"), takers).otherwise(nothing))
    return rows.select(F.inline(F.concat(*made))).sortWithinPartitions("conv", "depth")


_NODE = (
    "shard long, pre int, end int, up int, key binary, parent binary, depth long, size long, n long, conv long, "
    "n_ends long, ends array<string>"
)
_NODE_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 5, pa.list_(pa.string())]


class Shard:
    """Vertical bitmaps of some conversations: for each (position, turn) the set of those that have it there."""

    def __init__(self, convs: list[int], turns: list[list[tuple[int, int]]], sizes: list[list[int]], ids: int = ENDS):
        self.convs, self.turns, self.sizes, self.listed = convs, turns, sizes, ids
        self.postings: dict[tuple[int, tuple[int, int]], int] = {}
        self.ended: dict[int, int] = {}
        for i, said in enumerate(turns):
            bit = 1 << i
            for at, t in enumerate(said, 1):
                self.postings[at, t] = self.postings.get((at, t), 0) | bit
            self.ended[len(said)] = self.ended.get(len(said), 0) | bit

    def _ids(self, bits: int) -> list[int]:
        if bits.bit_count() < 8:
            out = []
            while bits:
                low = bits & -bits
                out.append(self.convs[low.bit_length() - 1])
                bits ^= low
            return out
        raw = np.frombuffer(bits.to_bytes((len(self.convs) + 7) // 8, "little"), dtype=np.uint8)
        return [self.convs[i] for i in np.flatnonzero(np.unpackbits(raw, bitorder="little"))]

    def nodes(self) -> list[list]:
        """Columns of ``_NODE`` but the shard, in depth-first order."""
        pre, end, up, key, parent, depth, size, n, conv, n_ends, ends = out = [[] for _ in range(11)]
        stack = [((1 << len(self.convs)) - 1, 0, ROOT, None, -1, 0)]
        while stack:
            bits, d, own, above, up_at, bytes_ = stack.pop()
            at = len(pre)
            over = bits & self.ended.get(d, 0)
            ids = self._ids(over)
            for column, value in zip(out, (
                at, at + 1, up_at, own, above, d, bytes_, bits.bit_count(), self.convs[(bits & -bits).bit_length() - 1], len(ids),
                [",".join(map(str, ids[i : i + self.listed])) for i in range(0, len(ids), self.listed)] or None,
            )):
                column.append(value)
            rest = bits ^ over
            while rest:
                # the first conversation left names a turn; its posting takes all that share it
                i = (rest & -rest).bit_length() - 1
                t = self.turns[i][d]
                child = rest & self.postings[d + 1, t]
                below = hashlib.blake2b(own + t[0].to_bytes(8, "little", signed=True) + t[1].to_bytes(8, "little", signed=True), digest_size=16).digest()
                stack.append((child, d + 1, below, own, at, self.sizes[i][d]))
                rest ^= child
        for at in range(len(pre) - 1, 0, -1):
            end[up[at]] = max(end[up[at]], end[at])
        return out


def _shards(most_convs: int, most_turns: int, ids: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Local nodes of consecutive conversations, index by index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convs: list[int] = []
        turns: list[list[tuple[int, int]]] = []
        sizes: list[list[int]] = []
        held = 0

        def ended(last: int | None = None) -> Iterator[pa.RecordBatch]:
            """The index of what is held, but for conversations from ``last`` on."""
            mine = slice(0, last)
            if convs[mine]:
                out = Shard(convs[mine], turns[mine], sizes[mine], ids).nodes()
                for i in range(0, len(out[0]), 4096):
                    part = [[convs[0]] * len(out[0][i : i + 4096]), *[c[i : i + 4096] for c in out]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(part, _NODE_TYPES)], [c.split()[0] for c in _NODE.split(", ")])
                del convs[mine], turns[mine], sizes[mine]

        for batch in batches:
            for c, d, t1, t2, size in zip(*[batch.column(x).to_pylist() for x in _STEP]):
                if not d:
                    if len(convs) >= most_convs or held >= most_turns:
                        yield from ended()
                        held = 0
                    convs.append(c)
                    turns.append([])
                    sizes.append([])
                    continue
                turns[-1].append((t1, t2))
                sizes[-1].append(size)
                held += 1
                if held >= most_turns and len(convs) > 1:
                    yield from ended(-1)
                    held = len(turns[-1])
        yield from ended()

    return run


def _subtrees(rows: pa.Table) -> pa.Table:
    """What each local node adds to its node: children, leaves and savings of the part of the trie its shard owns.

    In depth-first order a subtree is a range, so sums over it are differences of running sums.
    """
    rows = rows.sort_by("pre")
    n, size, owner, end, up = (rows[c].to_numpy() for c in ("n_convs", "size", "owner", "end", "up"))
    conv = rows["conv_id"].to_numpy()

    def below(values: np.ndarray) -> np.ndarray:
        run = np.r_[0, np.cumsum(values)]
        return run[end] - run[:-1]

    own = owner.astype(np.int64)
    children = np.bincount(up[1:], weights=own[1:], minlength=len(up)).astype(np.int64)
    leaf = own * (rows["all_ends"].to_numpy() == n)

    def said(values: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
        """What a node says of itself: only its owner says it."""
        return pa.array(values, pa.int64(), mask=~owner if missing is None else ~owner | missing)

    return pa.table({
        "key": rows["key"], "conv_id": said(conv), "depth": said(rows["depth"].to_numpy()), "parent_conv_id": said(conv[np.maximum(up, 0)], up < 0), "n_convs": said(n),
        "n_children": pa.array(children), "n_leaves": pa.array(below(leaf)), "saved": pa.array(below(own * (n - 1) * size)),
    })


_SUMS = "key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per key over strings that come in order; nothing but the running digest is held."""
    key, digest = None, None

    def done(keys: list, digests: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "ends_sha256": pa.array(digests, pa.string())})

    for batch in batches:
        keys, digests = [], []
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if k != key:
                if key is not None:
                    keys.append(key)
                    digests.append(digest.hexdigest())
                key, digest = k, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield done(keys, digests)
    if key is not None:
        yield done([key], [digest.hexdigest()])


def trie(of: DataFrame, convs: int = SHARD_CONVS, turns: int = SHARD_TURNS, ids: int = ENDS) -> DataFrame:
    """(key, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved, ends_sha256) per node of the trie of ``steps``.

    ``conv_id`` is the least conversation that starts with the node's turns, ``saved`` the bytes
    of texts that the subtree holds once instead of in every conversation, ``ends_sha256`` the
    digest of the ids that end there, comma-joined in ascending order. ``key`` names the path.

    Conversations are indexed range by range of ids. Each index gives the nodes it knows by
    intersecting a parent's bitset with postings depth first; counts of equal paths are added up
    across indexes, so a beginning that all share costs a row per index. Sums over subtrees are
    taken inside each index over the nodes that it owns, those whose least conversation it
    holds, and added up. No conversations give no nodes.
    An index holds at most ``convs`` conversations of ``turns`` turns, or one that is longer.
    """
    local = stored(of.mapInArrow(_shards(convs, turns, ids), _NODE))
    same = W.partitionBy("key")
    known = local.withColumns({
        "n_convs": F.sum("n").over(same), "conv_id": F.min("conv").over(same), "all_ends": F.sum("n_ends").over(same),
    }).select("shard", "pre", "end", "up", "key", "depth", "size", "n_convs", "conv_id", "all_ends", (F.col("conv") == F.col("conv_id")).alias("owner"))
    sums = known.groupBy("shard").applyInArrow(_subtrees, _SUMS).withColumn("ends_sha256", F.lit(None).cast("string"))
    lists = local.filter("n_ends > 0").select("key", "shard", F.posexplode("ends").alias("part", "ids"))
    digests = lists.repartition(width(of.sparkSession), "key").sortWithinPartitions("key", "shard", "part").mapInArrow(_digests, "key binary, ends_sha256 string")
    blank = [F.lit(None).cast("long").alias(c) for c in sums.columns[1:-1]]
    out = sums.union(digests.select("key", *blank, "ends_sha256")).groupBy("key").agg(
        *[F.max(c).alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs")],
        *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved")],
        F.coalesce(F.max("ends_sha256"), F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
    out = stored(out)
    discard(local)
    return out
