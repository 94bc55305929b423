"""Link canonical events into ordered threads.

Canonical events take turns in (date, id) order. An event joins the first thread
(by creation) whose last member is a candidate with a strong enough
``related_distinct`` decision; otherwise the first such event among its ten
nearest unthreaded ones starts a thread with it. A thread carries the id of the
event whose turn created it.

Turns only touch events that share an entity or domain, so a company splits
exactly into islands (date gaps beyond the window) and, where an island is large,
into connected components of its keys. The turns of a component hang on each other, so
one that is still large is read as a stream in order of days: a turn waits until the
events up to one window ahead have arrived, and what lies more than a window behind is
forgotten. So a task holds the two windows around the turn, undated events, and what
these may still meet; each row is read once and written once, with the slice it was in.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from heapq import merge
from sys import intern

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from annalist.functions import text as tx
from annalist.functions.dates import FAR_DAYS
from annalist.operators.clustering import islands, records
from annalist.operators.pairs import (
    CANONICAL_WINDOW,
    DOMAIN_WINDOW,
    FACTS,
    MAX_CANDIDATES,
    RuleClassifier,
    auto_apply_value,
    both_forms,
    classify_pairs,
    keyed,
)
from annalist.operators.slices import UNDATED, Store, in_parts
from annalist.operators.upserts import linked_to, numbered_relationships, relationship_rows
from annalist.session import broadcast_if_small, cut, fits, shuffle_width

SLICE_ROWS = 100_000

# Words that show how far an initiative has come, first family wins.
STAGE_WORDS = {
    "announce": ["announce", "unveil", "reveal", "plan to", "strategy_announcement"],
    "build": ["develop", "build", "invest", "product_development"],
    "pilot": ["pilot", "trial", "test with", "pilot_program"],
    "launch": ["launch", "release", "roll out", "open to the public", "open to public", "product_launch"],
    "scale": ["expand", "scale", "global rollout", "reach", "expansion"],
}
STAGES = ["announce", "build", "pilot", "launch", "scale"]
# The parts of a thread title.
THREAD_TITLE = {"entity": " 확장", "other": " 이니셔티브", "none": "이니셔티브"}


def stage_of(action: Column, event_type: Column, families: dict[str, list[str]] | None = None) -> Column:
    """First stage with a word contained in ``action event_type``; NULL if none is."""
    text = F.lower(F.concat_ws(" ", tx.filled(action), tx.filled(event_type)))
    out = F.lit(None).cast("string")
    for stage, words in reversed(list((families or STAGE_WORDS).items())):
        hit = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))
        out = F.when(hit, stage).otherwise(out)
    return out


def stage_index(stage: Column) -> Column:
    """Position of a stage from 0, NULL if unknown."""
    at = F.array_position(F.array(*[F.lit(s) for s in STAGES]), stage)
    return F.when(at > 0, (at - 1).cast("int"))


def moves_forward(earlier: Column, later: Column) -> Column:
    """Whether the second stage lies after the first; unknown stages never do."""
    return F.coalesce(stage_index(later) > stage_index(earlier), F.lit(False))


def thread_title(entity: Column, domain: Column, words: dict[str, str] | None = None) -> Column:
    w = words or THREAD_TITLE
    named = F.concat(tx.filled(entity), F.lit(w["entity"]))
    other = F.concat(F.coalesce(tx.filled(domain), F.lit(w["none"])), F.lit(w["other"]))
    return F.coalesce(named, other)


class _Open:
    """Unthreaded events by key and day."""

    def __init__(self):
        self.days: dict = {}
        self.at: dict = {}
        self.late: dict = {}

    def add(self, key, row: dict) -> None:
        if key is None:
            return
        slot = (key, row["_d"])
        if slot not in self.at:
            self.at[slot] = []
            insort(self.days.setdefault(key, []), row["_d"])
        insort(self.at[slot], (row["_id"], row["_n"], row))

    def near(self, key, me: dict, window: int, k: int, blanks: bool) -> list[tuple]:
        """At least the k nearest open events of one key (fewer if there are fewer)."""
        days = self.days.get(key, []) if key is not None else []
        day, out = me["_d"], []

        def take(d: int, gap: int) -> int:
            here = self.at[(key, d)]
            first, end = [], 0
            while end < len(here) and len(first) <= k:
                if not here[end][2]["_gone"]:
                    first.append(here[end])
                end += 1
            if end > len(first):  # those in threads go, the rest stays where it is
                here[:end] = first
            hits = [(gap, d, *x) for x in first if x[0] != me["_id"]]
            out.extend(hits)
            return len(hits)

        if day == FAR_DAYS:
            for d in days if blanks else ():
                if len(out) >= k:
                    break
                take(d, FAR_DAYS)
            return out
        hi = bisect_left(days, day)
        for step, spot, edge in ((-1, hi - 1, -1), (1, hi, len(days))):
            got = 0
            while spot != edge and got < k:
                d = days[spot]
                if d == FAR_DAYS or abs(d - day) > window:
                    break
                got += take(d, abs(d - day))
                spot += step
        if blanks and days and days[-1] == FAR_DAYS:
            take(FAR_DAYS, FAR_DAYS)
        return out

    def forget(self, day: int, kept: set) -> None:
        """Events before ``day`` go; those of the kept keys are laid aside."""
        for key, days in list(self.days.items()):
            for d in days[: bisect_left(days, day)]:
                here = self.at.pop((key, d))
                if key in kept:
                    self.late.setdefault(key, []).append((d, here))
            del days[: bisect_left(days, day)]
            if not days:
                del self.days[key]

    def recall(self) -> None:
        for key, old in self.late.items():
            self.at.update({(key, d): here for d, here in old})
            self.days[key] = sorted([*self.days.get(key, ()), *(d for d, _ in old)])
        self.late = {}


class _Lasts:
    """Last members of threads, found by key; threads are ranked by creation."""

    def __init__(self):
        self.threads: dict = {}
        self.by_entity: dict = {}
        self.by_domain: dict = {}
        self.late: dict = {}

    def _lists(self, thread: dict) -> list[tuple[dict, object]]:
        last, out = thread["last"], []
        if last["_entity"] is not None:
            out.append((self.by_entity, last["_entity"]))
        if last["_domain"] is not None and last["_d"] < FAR_DAYS:
            out.append((self.by_domain, (last["_domain"], last["_d"])))
        return out

    def put(self, thread: dict) -> None:
        self.threads[thread["n"]] = thread
        for lists, key in self._lists(thread):
            insort(lists.setdefault(key, []), (thread["rank"], thread["n"]))

    def drop(self, thread: dict) -> None:
        for lists, key in self._lists(thread):
            if key in lists:  # a day's domain list may be forgotten while the entity is kept
                del lists[key][bisect_left(lists[key], (thread["rank"], thread["n"]))]

    def matching(self, me: dict, window: int):
        """Threads whose last member is a candidate, in order of creation; read only as far as they are asked for."""
        day, near = me["_d"], min(window, DOMAIN_WINDOW)
        entity, domain = me["_entity"], me["_domain"] if me["_d"] < FAR_DAYS else None
        lists = [self.by_entity.get(entity, ())] if entity is not None else []
        if domain is not None:
            lists += [self.by_domain.get((domain, d), ()) for d in range(day - near, day + near + 1)]
        before = None
        for mark in merge(*[x for x in lists if x]):
            if mark == before:
                continue
            before, thread = mark, self.threads[mark[1]]
            d = thread["last"]["_d"]
            by_entity = entity is not None and thread["last"]["_entity"] == entity
            if by_entity and (d == FAR_DAYS or day == FAR_DAYS or abs(d - day) <= window):
                yield thread
            elif domain is not None and thread["last"]["_domain"] == domain and abs(d - day) <= near:
                yield thread

    def forget(self, day: int, kept: set) -> None:
        """Threads that ended before ``day`` go; those of the kept entities are laid aside."""
        ended = {m for slot in [x for x in self.by_domain if x[1] < day] for m in self.by_domain.pop(slot)}
        ended = {m for m in ended if self.threads[m[1]]["last"]["_entity"] is None}
        for entity, marks in list(self.by_entity.items()):
            old = [m for m in marks if self.threads[m[1]]["last"]["_d"] < day]
            if old:
                gone = set(old)
                self.by_entity[entity] = [m for m in marks if m not in gone]
                if entity in kept:
                    self.late.setdefault(entity, []).extend(old)
                else:
                    ended |= gone
        for _, n in ended:
            del self.threads[n]

    def recall(self) -> None:
        for entity, old in self.late.items():
            self.by_entity[entity] = sorted([*self.by_entity.get(entity, ()), *old])
        self.late = {}


OUT = (
    "kind string, canonical_id long, thread_id long, sequence_index long, action string, "
    "rank_day long, rank_id long, next_index long"
)
_OUT_NAMES = [c.split()[0] for c in OUT.split(", ")]
NARROW = ["_id", "_company", "_d", "_entity", "_domain", "_text", *FACTS]
STATE = ["_role", "_thread", "_rank_day", "_rank_id", "_next"]
#: What a stream keeps of a row: what turns and rules read.
HELD = ["_id", "_d", "_entity", "_domain", "_text", *FACTS]
_WHOLE = {c: "Int64" for c in ("thread_id", "sequence_index", "rank_day", "rank_id", "next_index")}
#: Rows that a stream holds back at most before it gives them out.
_GIVEN = 10_000


class _Group:
    """Threads and unthreaded events of one group, and what its turns say (``out``, with the slice ``by``)."""

    def __init__(self, window: int, k: int, rule: RuleClassifier, out: list[tuple]):
        self.window, self.k, self.rule, self.out, self.by = window, k, rule, out, 0
        self.lasts, self.by_entity, self.by_domain, self.n = _Lasts(), _Open(), _Open(), 0

    def know(self, r: dict) -> None:
        """The last member of an existing thread."""
        self._start(r["_thread"], (r["_rank_day"], r["_rank_id"]), r, r["_next"])

    def see(self, r: dict) -> None:
        """An unthreaded event, before its turn."""
        r["_n"], r["_gone"] = self.n, False
        self.n += 1
        self.by_entity.add(r["_entity"], r)
        self.by_domain.add(r["_domain"], r)

    def _start(self, thread_id, rank, last, size) -> dict:
        thread = {"n": self.n, "id": thread_id, "rank": rank, "last": last, "size": size}
        self.n += 1
        self.lasts.put(thread)
        return thread

    def _linked(self, a: dict, b: dict) -> bool:
        kind, confidence = self.rule.decide(a, b)
        holds = kind == "related_distinct" and auto_apply_value(kind, confidence)
        self.out.append(("pair", a["_id"], None, None, "auto_applied" if holds else "pending", None, b["_id"], None, self.by))
        return holds

    def _member(self, thread: dict, row: dict, index: int) -> None:
        row["_gone"] = True
        self.out.append(("member", row["_id"], thread["id"], index, None, None, None, None, self.by))

    def _action(self, r: dict, action: str, thread: dict | None = None) -> None:
        self.out.append(("action", r["_id"], thread and thread["id"], None, action, None, None, None, self.by))

    def turn(self, r: dict) -> None:
        if r["_gone"]:
            return self._action(r, "already_threaded")
        met = (t for t in self.lasts.matching(r, self.window) if t["last"]["_id"] != r["_id"])
        joined = next((t for t in met if self._linked(t["last"], r)), None)
        if joined is not None:
            self.lasts.drop(joined)
            self._member(joined, r, joined["size"])
            joined.update(last=r, size=joined["size"] + 1)
            self.lasts.put(joined)
            return self._action(r, "appended_to_thread", joined)
        near = {x[3]: x for x in self.by_entity.near(r["_entity"], r, self.window, self.k, True)}
        near.update({x[3]: x for x in self.by_domain.near(r["_domain"], r, min(self.window, DOMAIN_WINDOW), self.k, False)})
        few = sorted(near.values(), key=lambda x: x[:4])[: self.k]
        mate = next((x[4] for x in few if self._linked(x[4], r)), None)
        if mate is None:
            return self._action(r, "standalone")
        two = sorted([mate, r], key=lambda e: e["_text"] or "")
        thread = self._start(r["_id"], (r["_d"], r["_id"]), two[1], 2)
        for index, row in enumerate(two):
            self._member(thread, row, index)
        self._action(r, "created_thread", thread)


class _Stream(_Group):
    """A group whose rows arrive by day, undated ones first; a turn waits for the events one window ahead.

    What lies more than a window before the turns is forgotten, or laid aside for undated
    events of its entity, whose turns come last.
    """

    def __init__(self, window: int, k: int, rule: RuleClassifier, out: list[tuple], slice_rows: int):
        super().__init__(window, k, rule, out)
        self.waiting: deque = deque()
        self.undated: list[dict] = []
        self.kept: set = set()
        self.slice_rows, self.taken, self.clean = slice_rows, 0, None

    def arrive(self, row: dict) -> None:
        # a component may be millions of rows, of few words
        r = {c: intern(v) if isinstance(v := row[c], str) else v for c in HELD}
        if row["_role"] == "last":
            self._start(row["_thread"], (row["_rank_day"], row["_rank_id"]), r, row["_next"])
            return
        if r["_d"] == FAR_DAYS:
            self.undated.append(r)
            self.kept.add(r["_entity"])
        else:
            while self.waiting and self.waiting[0]["_d"] < r["_d"] - self.window:
                self._next()
            self.waiting.append(r)
        self.see(r)

    def _next(self) -> None:
        r = self.waiting.popleft()
        self.by, self.taken = self.taken // self.slice_rows, self.taken + 1
        self.turn(r)
        day = r["_d"] - self.window
        if self.clean is None or day > self.clean + self.window:
            for part in (self.lasts, self.by_entity, self.by_domain):
                part.forget(day, self.kept if part is not self.by_domain else set())
            self.clean = day

    def close(self) -> None:
        while self.waiting:
            self._next()
        for part in (self.lasts, self.by_entity):
            part.recall()
        self.by = UNDATED
        for r in self.undated:
            self.turn(r)


def _given(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=[*_OUT_NAMES, "_by"], dtype=object).astype(_WHOLE)


def _turns(group: list[str], window: int, k: int, rule: RuleClassifier):
    """Take the turns of groups that arrive one after another, in order; a group is whole before its first turn."""

    def run(frames):
        key, rows, out = None, [], []

        def take() -> None:
            one = _Group(window, k, rule, out)
            for r in rows:
                (one.know if r["_role"] == "last" else one.see)(r)
            for r in rows:
                if r["_role"] == "turn":
                    one.turn(r)
            rows.clear()

        for pdf in frames:
            for r in records(pdf):
                mine = tuple(r[g] for g in group)
                if mine != key:
                    take()
                    key = mine
                    if len(out) >= _GIVEN:
                        yield _given(out).drop(columns="_by")
                        out.clear()
                rows.append(r)
        take()
        yield _given(out).drop(columns="_by")

    return run


def _streamed(group: list[str], window: int, k: int, rule: RuleClassifier, slice_rows: int):
    """Take the turns of groups that arrive one after another."""

    def run(frames):
        key, one, out = None, None, []
        for pdf in frames:
            for r in records(pdf):
                mine = tuple(r[g] for g in group)
                if one is None or mine != key:
                    if one is not None:
                        one.close()
                    key, one = mine, _Stream(window, k, rule, out, slice_rows)
                one.arrive(r)
                if len(out) >= _GIVEN:
                    yield _given(out)
                    out.clear()
        if one is not None:
            one.close()
        for at in range(0, len(out), _GIVEN):
            yield _given(out[at : at + _GIVEN])

    return run


def _with_role(df: DataFrame, role: str) -> DataFrame:
    blank = {c: F.lit(0).cast("long") for c in STATE[1:]}  # no nulls: whole numbers stay exact in pandas
    return df.withColumns({"_role": F.lit(role), **blank})


def _sliced(rows: DataFrame, group: list[str], window: int, k: int, rule: RuleClassifier, slice_rows: int) -> DataFrame:
    """Turns of large groups, each read once in order of days."""
    cols = list(dict.fromkeys([*group, *NARROW, *STATE]))
    in_order = (
        rows.select(*cols)
        .repartition(shuffle_width(rows.sparkSession), *group)
        .sortWithinPartitions(*group, (F.col("_d") < FAR_DAYS), "_d", "_role", "_id")
    )
    store = Store(rows.sparkSession, f"{OUT}, _by int")
    store.add(in_order.mapInPandas(_streamed(group, window, k, rule, slice_rows), store.schema))
    return store.said().select(*_OUT_NAMES)


def _reported(action: str) -> list[Column]:
    none = F.lit(None).cast("long")
    return [
        F.lit("action").alias("kind"),
        F.col("_id").alias("canonical_id"),
        none.alias("thread_id"),
        none.alias("sequence_index"),
        F.lit(action).alias("action"),
        none.alias("rank_day"),
        none.alias("rank_id"),
        none.alias("next_index"),
    ]


def link_threads(
    canonical: DataFrame,
    last_members: DataFrame | None = None,
    window_days: int = CANONICAL_WINDOW,
    k: int = MAX_CANDIDATES,
    classifier: RuleClassifier | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Rows of kind ``action`` (one per canonical event), ``member`` (thread_id, sequence_index) and ``pair``.

    A ``pair`` row keeps a decision that was taken: canonical_id and rank_id were compared,
    action says whether it was applied.

    ``canonical`` holds the unthreaded canonical events; ``last_members`` the last
    member of every existing thread (canonical columns plus thread_id, next_index).
    """
    rule = both_forms(classifier or RuleClassifier())
    names = {"id": "canonical_id", "date": "canonical_date"}
    turns = _with_role(keyed(canonical, **names).withColumn("_text", F.col("canonical_date")).select(*NARROW), "turn")
    rows = turns
    if last_members is not None:
        old = keyed(last_members, **names).select(
            *[c for c in NARROW if c != "_text"],
            F.col("canonical_date").alias("_text"),
            F.lit("last").alias("_role"),
            F.col("thread_id").cast("long").alias("_thread"),
            # existing threads come before new ones, in order of their ids
            F.lit(-1).cast("long").alias("_rank_day"),
            F.col("thread_id").cast("long").alias("_rank_id"),
            F.col("next_index").cast("long").alias("_next"),
        )
        rows = rows.unionByName(old)
    loners = F.col("_entity").isNull() & F.col("_domain").isNull()
    alone = rows.where(loners & (F.col("_role") == "turn")).select(*_reported("standalone"))
    rows = rows.where(~loners)
    parts = cut(islands(rows, window_days))
    placed = rows.join(broadcast_if_small(parts), ["_company", "_d"])
    island = ["_company", "_island"]
    small = (
        placed.where(F.col("_size") <= slice_rows)
        .select(*dict.fromkeys([*island, *NARROW, *STATE]))
        .repartition(shuffle_width(canonical.sparkSession), *island)
        .sortWithinPartitions(*island, "_d", "_id")
        .mapInPandas(_turns(island, window_days, k, rule), OUT)
    )
    out = small.unionByName(alone)
    if fits(parts.where(F.col("_size") > slice_rows), 0):
        return out
    large = placed.where(F.col("_size") > slice_rows).drop("_size")
    return out.unionByName(_sliced(cut(in_parts(large, island)), [*island, "_part"], window_days, k, rule, slice_rows))


def actions(linked: DataFrame) -> DataFrame:
    return linked.where(F.col("kind") == "action").select("canonical_id", "action", "thread_id")


def relationships(linked: DataFrame, canonical: DataFrame, classifier: RuleClassifier | None = None) -> DataFrame:
    """Every pair decision that threading took, one row per pair (a_id < b_id), with its reasons.

    A pair that was applied stays applied; the others wait for review.
    """
    rule = classifier or RuleClassifier()
    pairs = linked.where(F.col("kind") == "pair").select(
        F.least("canonical_id", "rank_id").alias("a_id"), F.greatest("canonical_id", "rank_id").alias("b_id"), "action"
    )
    once = pairs.groupBy("a_id", "b_id").agg(F.min("action").alias("review_status"))  # auto_applied sorts before pending
    for side in ("a", "b"):
        facts = canonical.select(F.col("canonical_id").alias(f"{side}_id"), *[F.col(c).alias(f"{side}_{c}") for c in FACTS])
        once = once.join(facts, f"{side}_id")
    return numbered_relationships(relationship_rows(classify_pairs(once, rule), F.col("review_status")))


def thread_events(linked: DataFrame, canonical: DataFrame) -> DataFrame:
    """Membership with sequence index and stage."""
    rows = linked.where(F.col("kind") == "member").select("thread_id", "canonical_id", "sequence_index")
    facts = canonical.select("canonical_id", stage_of(F.col("action"), F.col("event_type")).alias("stage"))
    return rows.join(facts, "canonical_id").select("thread_id", "canonical_id", "sequence_index", "stage")


def linked_rows(linked: DataFrame, canonical: DataFrame, pairs: DataFrame) -> DataFrame:
    """Thread rows with the relationship_id of the decision that put them there.

    The rows that open a thread, and each appended one, stand next to the member they were
    linked with: the one before in the thread, or after for the first.
    """
    rows = thread_events(linked, canonical)
    order = W.partitionBy("thread_id").orderBy("sequence_index")
    beside = F.when(F.col("sequence_index") == 0, F.lead("canonical_id").over(order)).otherwise(F.lag("canonical_id").over(order))
    return linked_to(rows.withColumn("_beside", beside), pairs, "canonical_id", "_beside").drop("_beside")


def last_members(thread_events: DataFrame, canonical: DataFrame) -> DataFrame:
    """The last member of every stored thread: its canonical columns, thread_id and next_index."""
    last = thread_events.groupBy("thread_id").agg(
        F.max_by("canonical_id", "sequence_index").alias("canonical_id"), (F.max("sequence_index") + 1).alias("next_index")
    )
    return canonical.join(last, "canonical_id")


def new_threads(linked: DataFrame, canonical: DataFrame) -> DataFrame:
    """Threads created in this run, named after the event that created them."""
    made = linked.where((F.col("kind") == "action") & (F.col("action") == "created_thread")).select("thread_id")
    return made.join(canonical, made["thread_id"] == canonical["canonical_id"]).select(
        "thread_id",
        "company_id",
        thread_title(F.col("entity"), F.col("domain")).alias("title"),
        "domain",
        "entity",
        F.lit("auto_applied").alias("review_status"),
    )


def tally(linked: DataFrame) -> DataFrame:
    """Canonical events per action, with a zero for actions that did not occur."""
    act = linked.where(F.col("kind") == "action")
    names = ["appended_to_thread", "created_thread", "standalone", "already_threaded"]
    return act.agg(*[F.count_if(F.col("action") == n).alias(n) for n in names])
