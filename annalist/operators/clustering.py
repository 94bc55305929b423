"""Greedy seed clustering of dated events into canonical events.

Events are taken in (date, id) order, undated ones last. An event joins the best
``same_event`` seed among its ten nearest candidates; if there is none that is
strong enough it becomes a seed itself when its source is official, and stays
unclustered otherwise. A canonical event carries the id of its seed event.

Two exact ways are used together. A date gap longer than the window can never be
bridged, so it cuts a company into islands; islands of moderate size are folded
one per group. Larger islands are split into connected components of their keys. The
events of a component hang on each other, so it is read once as a stream in order of
days: an event depends only on seeds within the window around it, and seeds further back
are forgotten. Undated events come last and meet the first seeds of their entity alone,
so they go through entity by entity.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from annalist.functions import text as tx
from annalist.functions.dates import FAR_DAYS
from annalist.operators.pairs import (
    AUTO_SAME_EVENT,
    DOMAIN_WINDOW,
    EVENT_WINDOW,
    FACTS,
    MAX_CANDIDATES,
    RuleClassifier,
    auto_apply_value,
    both_forms,
    classify_pairs,
    keyed,
    nearest_candidates,
)
from annalist.operators.slices import UNDATED, Store, in_parts
from annalist.operators.upserts import numbered_relationships, relationship_rows
from annalist.session import broadcast_if_small, cut, fits, shuffle_width

ISLAND_ROWS = 100_000


def title_text(entity: Column, subject: Column, action: Column, event_type: Column) -> Column:
    """``label: action``, or only the action if both are the same."""
    label = F.coalesce(tx.filled(entity), tx.filled(subject), tx.filled(event_type))
    deed = F.coalesce(tx.filled(action), event_type)
    return F.when(label.isNotNull() & (label != deed), F.concat(label, F.lit(": "), deed)).otherwise(deed)


def islands(rows: DataFrame, window_days: int) -> DataFrame:
    """(_company, _d, _island, _size): days of a company cut where the gap exceeds the window.

    Built from one row per company and day. A company with undated rows is one
    island, since those match by entity whatever the date.
    """
    days = rows.groupBy("_company", "_d").agg(F.count("*").alias("_n"))
    in_order = W.partitionBy("_company").orderBy("_d")
    whole = W.partitionBy("_company")
    gap = F.col("_d") - F.lag("_d").over(in_order)
    opened = days.withColumn("_new", F.when(gap > window_days, 1).otherwise(0)).withColumn(
        "_open", F.max("_d").over(whole) == FAR_DAYS
    )
    numbered = opened.withColumn(
        "_island", F.when(F.col("_open"), F.lit(0).cast("long")).otherwise(F.sum("_new").over(in_order))
    )
    return numbered.select(
        "_company", "_d", "_island", F.sum("_n").over(W.partitionBy("_company", "_island")).alias("_size")
    )


def records(pdf: pd.DataFrame) -> list[dict]:
    """Rows as dicts with None for missing values."""
    columns = {}
    for c in pdf.columns:
        values, blank = pdf[c].tolist(), pdf[c].isna()
        columns[c] = [None if b else v for v, b in zip(values, blank)] if blank.any() else values
    return [dict(zip(columns, row)) for row in zip(*columns.values())]


class _Shelf:
    """Seeds of one group by key and day, at most k per day: enough to list the k nearest."""

    def __init__(self, k: int):
        self.k = k
        self.days: dict = {}
        self.at: dict = {}

    def add(self, key, day: int, seed: dict) -> None:
        if key is None:
            return
        days = self.days.setdefault(key, [])
        spot = bisect_left(days, day)
        if spot == len(days) or days[spot] != day:
            days.insert(spot, day)
        here = self.at.setdefault((key, day), [])
        if len(here) < self.k:
            here.append(seed)

    def near(self, key, day: int, window: int, blanks: bool) -> list[tuple[int, int, int, dict]]:
        days = self.days.get(key, ()) if key is not None else ()
        out: list = []

        def take(d: int, gap: int) -> None:
            out.extend((gap, d, s["_id"], s) for s in self.at[(key, d)])

        if day == FAR_DAYS:
            for d in days if blanks else ():
                if len(out) >= self.k:
                    break
                take(d, FAR_DAYS)
            return out
        hi = bisect_left(days, day)
        lo = hi - 1
        # walk outwards from the day; both directions are read until each has given k
        for step, spot, edge in ((-1, lo, -1), (1, hi, len(days))):
            got = 0
            while spot != edge and got < self.k:
                d = days[spot]
                if d == FAR_DAYS or abs(d - day) > window:
                    break
                got += len(self.at[(key, d)])
                take(d, abs(d - day))
                spot += step
        if blanks and days and days[-1] == FAR_DAYS:
            take(FAR_DAYS, FAR_DAYS)
        return out

    def forget(self, before: int) -> None:
        """Seeds of earlier days go."""
        for key, days in list(self.days.items()):
            spot = bisect_left(days, before)
            for d in days[:spot]:
                del self.at[(key, d)]
            del days[:spot]
            if not days:
                del self.days[key]


def _nearest(shelves: list[tuple[_Shelf, _Shelf]], row: dict, window: int, k: int) -> list[dict]:
    found: dict = {}
    for by_entity, by_domain in shelves:
        for hit in by_entity.near(row["_entity"], row["_d"], window, True):
            found[hit[2]] = hit
        for hit in by_domain.near(row["_domain"], row["_d"], min(window, DOMAIN_WINDOW), False):
            found[hit[2]] = hit
    return [h[3] for h in sorted(found.values(), key=lambda h: h[:3])[:k]]


def _best_match(rule: RuleClassifier, row: dict, near: list[dict]) -> tuple[int | None, float | None, bool]:
    best, score, doubt = None, None, False
    for seed in near:
        kind, confidence = rule.decide(row, seed)
        if kind != "same_event":
            continue
        if score is None or confidence > score:
            best, score = seed["_id"], confidence
        if not auto_apply_value(kind, confidence):
            doubt = True
    return best, score, doubt


RESULT = "event_id long, company_id {company}, action string, canonical_id long, confidence double, uncertain boolean"
_RESULT_NAMES = ["event_id", "company_id", "action", "canonical_id", "confidence", "uncertain"]
_TYPES = {"canonical_id": "Int64", "confidence": "Float64"}


class _Pass:
    """Events of one group in turn, against the seeds known so far."""

    def __init__(self, window: int, k: int, rule: RuleClassifier):
        self.window, self.k, self.rule = window, k, rule
        self.old, self.new = (_Shelf(k), _Shelf(k)), (_Shelf(k), _Shelf(k))

    def know(self, seed: dict, prior: bool) -> None:
        by_entity, by_domain = self.old if prior else self.new
        by_entity.add(seed["_entity"], seed["_d"], seed)
        by_domain.add(seed["_domain"], seed["_d"], seed)

    def decide(self, r: dict) -> tuple:
        best, score, doubt = _best_match(self.rule, r, _nearest([self.old, self.new], r, self.window, self.k))
        if best is not None and score >= AUTO_SAME_EVENT:
            return r["_id"], r["_company"], "merged", best, score, doubt
        if r["is_official"]:
            self.know(r, False)
            return r["_id"], r["_company"], "new", r["_id"], None, doubt
        return r["_id"], r["_company"], "deferred", None, None, doubt

    def forget(self, before: int) -> None:
        for shelf in (*self.old, *self.new):
            shelf.forget(before)


def _dated(group: list[str], window: int, k: int, rule: RuleClassifier, slice_rows: int):
    """Decide dated events as they come, group by group and in order; known seeds come a window before their day."""

    def run(frames):
        key, one, n, clean = None, None, 0, None
        for pdf in frames:
            out = []
            for r in records(pdf):
                mine = tuple(r[g] for g in group)
                if one is None or mine != key:
                    key, one, n, clean = mine, _Pass(window, k, rule), 0, None
                if r["_role"] == "prior":
                    one.know(r, True)
                    continue
                out.append(("event", *one.decide(r), n // slice_rows))
                n += 1
                if clean is None or r["_d"] > clean + window:
                    one.forget(r["_d"] - window)
                    clean = r["_d"]
            yield pd.DataFrame(out, columns=["kind", *_RESULT_NAMES, "_by"], dtype=object).astype(_TYPES)

    return run


def _one_by_one(group: list[str], window: int, k: int, rule: RuleClassifier):
    """Decide events as they come, group by group and in order; the known seeds of a group come before its first turn."""

    def run(frames):
        key, one = None, None
        for pdf in frames:
            out = []
            for r in records(pdf):
                mine = tuple(r[g] for g in group)
                if one is None or mine != key:
                    key, one = mine, _Pass(window, k, rule)
                if r["_role"] == "turn":
                    out.append(one.decide(r))
                else:
                    one.know(r, r["_role"] == "prior")
            yield pd.DataFrame(out, columns=_RESULT_NAMES, dtype=object).astype(_TYPES)

    return run


def _taken(rows: DataFrame, group: list[str], window: int, k: int, rule: RuleClassifier, result: str) -> DataFrame:
    """Turns of groups that one task may hold; tasks read many small groups as one stream."""
    late = (F.col("_role") == "turn").cast("int")
    return (
        rows.select(*dict.fromkeys([*group, *COLUMNS, "_role"]))
        .repartition(shuffle_width(rows.sparkSession), *group)  # few bytes, much work
        .sortWithinPartitions(*group, late, "_d", "_id")
        .mapInPandas(_one_by_one(group, window, k, rule), result)
    )


COLUMNS = ["_id", "_company", "_d", "_entity", "_domain", *FACTS, "is_official"]


def _sliced(rows: DataFrame, group: list[str], window: int, k: int, rule: RuleClassifier, slice_rows: int, company: str) -> DataFrame:
    """Events of large groups, each read once in order of days; undated ones then, entity by entity."""
    cols = list(dict.fromkeys([*group, *COLUMNS, "_role"]))
    width, result = shuffle_width(rows.sparkSession), RESULT.format(company=company)
    turns = rows.where(F.col("_role") == "turn").select(*cols)
    prior = rows.where(F.col("_role") == "prior").select(*cols)
    # of undated known seeds only the first of an entity can be listed
    lowest = F.row_number().over(W.partitionBy(*group, "_entity").orderBy("_id"))
    few = prior.where((F.col("_d") == FAR_DAYS) & F.col("_entity").isNotNull()).withColumn("_n", lowest).where(F.col("_n") <= k).drop("_n")
    dated = turns.where(F.col("_d") < FAR_DAYS).withColumn("_comes", F.col("_d"))
    known = prior.where(F.col("_d") < FAR_DAYS).withColumn("_comes", F.col("_d") - window)
    in_order = (
        dated.unionByName(known).unionByName(few.withColumn("_comes", F.lit(-FAR_DAYS)))
        .repartition(width, *group).sortWithinPartitions(*group, "_comes", "_role", "_d", "_id")
    )
    store = Store(rows.sparkSession, f"kind string, {result}, _by int")
    store.add(in_order.mapInPandas(_dated(group, window, k, rule, slice_rows), store.schema))
    done = store.said().select(*_RESULT_NAMES)

    last = turns.where(F.col("_d") == FAR_DAYS)
    if last.isEmpty():
        return done
    # undated events meet the first k seeds of their entity, whatever those seeds' dates
    made = done.where(F.col("action") == "new").select(F.col("event_id").alias("_id"))
    seeds = dated.join(made, "_id", "left_semi").select(*COLUMNS).withColumn("_role", F.lit("seed"))
    asked = last.select("_company", "_entity").distinct()
    per = W.partitionBy("_company", "_entity", "_role").orderBy("_d", "_id")
    first = seeds.unionByName(prior.select(*COLUMNS, "_role")).join(asked, ["_company", "_entity"], "left_semi").withColumn("_n", F.row_number().over(per))
    first = first.where(F.col("_n") <= k).drop("_n")
    stream = _taken(last.select(*COLUMNS, "_role").unionByName(first), ["_company", "_entity"], window, k, rule, result)
    store.add(stream.select(F.lit("event").alias("kind"), "*", F.lit(UNDATED).alias("_by")))
    return store.said().select(*_RESULT_NAMES)


def assign_events(
    events: DataFrame,
    prior: DataFrame | None = None,
    window_days: int = EVENT_WINDOW,
    k: int = MAX_CANDIDATES,
    classifier: RuleClassifier | None = None,
    island_rows: int = ISLAND_ROWS,
    slice_rows: int = ISLAND_ROWS,
) -> DataFrame:
    """One row per event: action (new, merged, deferred), canonical_id, confidence, uncertain.

    ``events`` holds event_id, company_id, event_date, event_type, entity, domain and
    is_official; ``prior`` holds the seed events of canonical events that already exist.
    Whatever the size of an island, the rule's ``decide`` decides.
    """
    rule = both_forms(classifier or RuleClassifier())
    rows = keyed(events).select(*COLUMNS).withColumn("_role", F.lit("turn"))
    both = rows
    if prior is not None:
        seeds = keyed(prior.withColumn("is_official", F.lit(True))).select(*COLUMNS).withColumn("_role", F.lit("prior"))
        both = rows.unionByName(seeds)
    parts = cut(islands(both, window_days))
    placed = both.join(broadcast_if_small(parts), ["_company", "_d"])
    company = next(f.dataType.simpleString() for f in events.schema.fields if f.name == "company_id")
    result = RESULT.format(company=company)
    folded = _taken(placed.where(F.col("_size") <= island_rows), ["_company", "_island"], window_days, k, rule, result)
    if fits(parts.where(F.col("_size") > island_rows), 0):
        return folded
    large = placed.where(F.col("_size") > island_rows).drop("_size")
    loners = F.col("_entity").isNull() & F.col("_domain").isNull()
    alone = large.where(loners & (F.col("_role") == "turn")).select(
        F.col("_id").alias("event_id"),
        F.col("_company").alias("company_id"),
        F.when(F.col("is_official"), "new").otherwise("deferred").alias("action"),
        F.when(F.col("is_official"), F.col("_id")).alias("canonical_id"),
        F.lit(None).cast("double").alias("confidence"),
        F.lit(False).alias("uncertain"),
    )
    split = in_parts(large.where(~loners), ["_company", "_island"])
    group = ["_company", "_island", "_part"]
    return folded.unionByName(alone).unionByName(_sliced(cut(split), group, window_days, k, rule, slice_rows, company))


def relationships(
    events: DataFrame,
    assigned: DataFrame,
    prior: DataFrame | None = None,
    window_days: int = EVENT_WINDOW,
    k: int = MAX_CANDIDATES,
    classifier: RuleClassifier | None = None,
) -> DataFrame:
    """Every pair decision that clustering took, one row per pair (a_id < b_id).

    An event was compared with its k nearest seeds among those before it; the seeds are
    known once all events are assigned, so the decisions come from one pass over bounded
    lists, whatever way assigned them. The pair by which an event joined its cluster is
    applied, the others wait for review.
    """
    rule = classifier or RuleClassifier()
    cols = ["_id", "_company", "_d", "_entity", "_domain", *FACTS]
    rows = keyed(events).select(*cols)
    made = assigned.where(F.col("action") == "new").select(F.col("event_id").alias("_id"))
    near = nearest_candidates(rows, rows.join(made, "_id", "left_semi"), window_days, k, earlier_only=True)
    if prior is not None:
        older = nearest_candidates(near.withColumnRenamed("near", "_new"), keyed(prior).select(*cols), window_days, k)
        near = older.withColumn("near", F.slice(F.array_sort(F.concat("near", "_new")), 1, k)).drop("_new")
    pairs = near.select("_id", *[F.col(c).alias(f"a_{c}") for c in FACTS], F.explode("near").alias("s")).select(
        "_id", *[f"a_{c}" for c in FACTS], F.col("s.id").alias("_seed"), *[F.col(f"s.{c}").alias(f"b_{c}") for c in FACTS]
    )
    joined = assigned.where(F.col("action") == "merged").select(F.col("event_id").alias("_id"), F.col("canonical_id").alias("_joined"))
    known = pairs.join(joined, "_id", "left").select(
        F.least("_id", "_seed").alias("a_id"),
        F.greatest("_id", "_seed").alias("b_id"),
        *[f"{s}_{c}" for s in ("a", "b") for c in FACTS],
        F.when(F.col("_joined") == F.col("_seed"), "auto_applied").otherwise("pending").alias("review_status"),
    )
    return numbered_relationships(relationship_rows(classify_pairs(known, rule), F.col("review_status")))


def tally(assigned: DataFrame) -> DataFrame:
    """new_canonical, merged, flagged_for_review, deferred as one row."""
    new = F.col("action") == "new"
    return assigned.agg(
        F.count_if(new).alias("new_canonical"),
        F.count_if(F.col("action") == "merged").alias("merged"),
        F.count_if(new & F.col("uncertain")).alias("flagged_for_review"),
        F.count_if(F.col("action") == "deferred").alias("deferred_news_event"),
    )


def seed_events(events: DataFrame, members: DataFrame) -> DataFrame:
    """The seed events of stored clusters: what new events are compared with."""
    return events.join(members.where("is_seed").select("event_id"), "event_id", "left_semi")


def members(assigned: DataFrame) -> DataFrame:
    """Cluster membership: canonical_id, event_id, is_seed."""
    return assigned.where(F.col("canonical_id").isNotNull()).select(
        "canonical_id", "event_id", (F.col("action") == "new").alias("is_seed")
    )


def canonical_events(events: DataFrame, assigned: DataFrame) -> DataFrame:
    """Canonical events from their seeds: fields copied, title made, quote as summary."""
    seeds = assigned.where(F.col("action") == "new").select("event_id", "uncertain")
    return events.join(seeds, "event_id").select(
        F.col("event_id").alias("canonical_id"),
        "company_id",
        "event_type",
        "subject",
        F.col("action"),
        F.col("event_date").alias("canonical_date"),
        "date_precision",
        "lifecycle_status",
        "domain",
        "entity",
        title_text(F.col("entity"), F.col("subject"), F.col("action"), F.col("event_type")).alias("title"),
        F.col("raw_quote").alias("summary"),
        F.lit(None).cast("string").alias("stage"),
        F.when(F.col("uncertain"), "pending").otherwise("auto_applied").alias("review_status"),
    )
