"""Review queue and human decisions, taken as a batch over a decisions table.

Decisions are (record_id, decision 'approve'|'reject', actor, decision_no); earlier
numbers act first, as if taken one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from annalist.operators.clustering import title_text
from annalist.operators.threading import stage_of, thread_title
from annalist.session import cut


def pending_evidence(evidence: DataFrame, events: DataFrame, company_id=None) -> DataFrame:
    """Evidence waiting for review, with its event."""
    facts = events.select("event_id", "company_id", "event_type", "event_date", "entity")
    rows = evidence.where(F.col("review_status") == "pending").join(facts, "event_id")
    return rows if company_id is None else rows.where(F.col("company_id") == company_id)


def pending_pairs(
    relationships: DataFrame, records: DataFrame, key: str, facts: list[str], relationship_type: str | None = None
) -> DataFrame:
    """Pairs waiting for review, with both records."""
    rows = relationships.where(F.col("review_status") == "pending")
    if relationship_type:
        rows = rows.where(F.col("relationship_type") == relationship_type)
    for side in ("a", "b"):
        own = records.select(F.col(key).alias(f"{side}_id"), *[F.col(c).alias(f"{side}_{c}") for c in facts])
        rows = rows.join(own, f"{side}_id")
    return rows


def review_summary(
    evidence: DataFrame, relationships: DataFrame, canonical_relationships: DataFrame, companies: DataFrame
) -> DataFrame:
    """Per company: its pending evidence, and the pending pairs of all companies.

    ``evidence`` carries company_id.
    """
    waiting = F.col("review_status") == "pending"
    mine = evidence.where(waiting).groupBy("company_id").agg(F.count("*").alias("pending_evidence"))
    same = relationships.where(waiting & (F.col("relationship_type") == "same_event")).agg(
        F.count("*").alias("pending_duplicate_relationships")
    )
    linked = canonical_relationships.where(waiting).agg(F.count("*").alias("pending_thread_relationships"))
    return (
        companies.select("company_id")
        .join(mine, "company_id", "left")
        .fillna({"pending_evidence": 0})
        .withColumns({"pending_duplicate_relationships": same.scalar(), "pending_thread_relationships": linked.scalar()})
    )


def _actor(c: Column) -> Column:
    return F.concat(F.lit("human:"), c)


def _last(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("record_id").agg(
        F.max_by(F.struct("decision", "actor", "decision_no"), "decision_no").alias("_d")
    )


def _steps(decisions: DataFrame) -> DataFrame:
    """Every decision as ``_d``, with the one taken on the same record just before as ``_prior``."""
    order = W.partitionBy("record_id").orderBy("decision_no")
    return decisions.select(
        "record_id", F.struct("decision", "actor", "decision_no").alias("_d"), F.lag("decision").over(order).alias("_prior")
    )


def _status_of(decision: Column, before: Column) -> Column:
    return F.when(decision.isNull(), before).when(decision == "approve", "approved").otherwise("rejected")


def _numbered(decisions: DataFrame) -> DataFrame:
    """The decisions, whose numbers must differ: they are the order in which decisions act."""
    if not decisions.groupBy("decision_no").count().where("count > 1").isEmpty():
        raise ValueError("decision_no must be unique")
    return decisions


def unknown_records(decisions: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Decisions about records that do not exist."""
    return decisions.join(table.select(F.col(key).alias("record_id")), "record_id", "left_anti")


def _audit(rows: DataFrame, table_name: str, record: str, before: Column, after: Column) -> DataFrame:
    return rows.select(
        F.lit(table_name).alias("table_name"),
        F.col(record).alias("record_id"),
        F.col("_d.decision").alias("action"),
        _actor(F.col("_d.actor")).alias("actor"),
        before.alias("before"),
        after.alias("after"),
    )


SPAN = ["matched_text", "start_offset", "end_offset"]


def decide_evidence(evidence: DataFrame, decisions: DataFrame, key: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """(new evidence, audit changes). Approval may bring a corrected span in its own columns."""
    spans = [c for c in SPAN if c in decisions.columns]
    kept = [c for c in evidence.columns if c != "embedding"]
    # the spans that stand after and before each decision: the latest that an approval brought
    order = W.partitionBy("record_id").orderBy("decision_no")
    brought = {c: F.when(F.col("decision") == "approve", F.col(c)) for c in spans}
    steps = decisions.select(
        F.col("record_id").alias(key),
        F.struct("decision", "actor", "decision_no").alias("_d"),
        F.lag("decision").over(order).alias("_prior"),
        *[F.last(x, True).over(order.rowsBetween(W.unboundedPreceding, 0)).alias(f"_{c}_now") for c, x in brought.items()],
        *[F.last(x, True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias(f"_{c}_old") for c, x in brought.items()],
    )

    def at(decision: Column, moment: str) -> Column:
        values = {
            "is_valid": F.when(decision.isNull(), F.col("is_valid")).otherwise(decision == "approve"),
            "review_status": _status_of(decision, F.col("review_status")),
            **{c: F.coalesce(f"_{c}_{moment}", c) for c in spans},
        }
        return F.struct(*[values.get(c, F.col(c)).alias(c) for c in kept])

    each = evidence.join(steps, key)
    audit = _audit(each, "evidence_spans", key, at(F.col("_prior"), "old"), at(F.col("_d.decision"), "now"))
    now = F.struct("_d", *[f"_{c}_now" for c in spans])
    last = steps.groupBy(key).agg(F.max_by(now, F.col("_d.decision_no")).alias("_last")).select(key, "_last.*")
    joined = evidence.join(last, key, "left")
    values = at(F.col("_d.decision"), "now")
    state = joined.withColumn("_state", values).select(*[F.col(f"_state.{c}").alias(c) if c in kept else F.col(c) for c in evidence.columns])
    return state, audit


def _resolve(pairs: DataFrame, start: DataFrame) -> DataFrame:
    """Targets of approved pairs taken in order of decision_no: adds target, a_known, b_known.

    ``start`` maps record x to the target it has from before. An approval leaves both
    of its records with a target, so every other record gets its own from its first
    approval; a pair takes the target of a, else of b, else opens one named after a.
    Chains of such references are followed by doubling.
    """
    pairs = cut(pairs)  # read three times, and dear to make
    ends = pairs.select("decision_no", F.explode(F.array("a_id", "b_id")).alias("x"))
    first = ends.join(start.select("x"), "x", "left_anti").groupBy("x").agg(F.min("decision_no").alias("n"))
    rows = pairs
    for side in ("a", "b"):
        rows = rows.join(start.select(F.col("x").alias(f"{side}_id"), F.col("target").alias(f"_{side}0")), f"{side}_id", "left")
        rows = rows.join(first.select(F.col("x").alias(f"{side}_id"), F.col("n").alias(f"_{side}1")), f"{side}_id", "left")
    seen = {s: F.coalesce(F.col(f"_{s}1") < F.col("decision_no"), F.lit(False)) for s in ("a", "b")}
    known = {s: F.col(f"_{s}0").isNotNull() | seen[s] for s in ("a", "b")}
    placed = rows.select(
        *pairs.columns,
        known["a"].alias("a_known"),
        known["b"].alias("b_known"),
        F.when(known["a"], F.col("_a0")).when(known["b"], F.col("_b0")).otherwise(F.col("a_id")).alias("target"),
        F.when(seen["a"], F.col("_a1")).when(~known["a"] & seen["b"], F.col("_b1")).alias("_via"),
    )
    state = cut(placed.withColumn("target", F.when(F.col("_via").isNull(), F.col("target"))))
    while not (waiting := state.where(F.col("_via").isNotNull())).isEmpty():
        up = state.select(F.col("decision_no").alias("_via"), F.col("target").alias("_t"), F.col("_via").alias("_u"))
        moved = waiting.join(up, "_via", "left").select(
            *pairs.columns,
            "a_known",
            "b_known",
            F.coalesce("target", "_t").alias("target"),
            F.when(F.col("target").isNull() & F.col("_t").isNull(), F.col("_u")).alias("_via"),
        )
        # placed rows stay out of the join: their null keys would all meet in one task
        state = cut(state.where(F.col("_via").isNull()).unionByName(moved))
    return state.drop("_via")


def _with_status(relationships: DataFrame, decisions: DataFrame) -> DataFrame:
    last = _last(decisions).withColumnRenamed("record_id", "relationship_id")
    return relationships.join(last, "relationship_id", "left")


def _status_after() -> Column:
    return _status_of(F.col("_d.decision"), F.col("review_status"))


def _approved(relationships: DataFrame, decisions: DataFrame, kind: str) -> DataFrame:
    """Approved pairs at their first approval; a later one finds both records placed and changes nothing."""
    yes = decisions.where(F.col("decision") == "approve").groupBy(F.col("record_id").alias("relationship_id")).agg(
        F.min("decision_no").alias("decision_no")
    )
    return relationships.where(F.col("relationship_type") == kind).join(yes, "relationship_id").select(
        "relationship_id", "a_id", "b_id", "decision_no"
    )


def _pair_audit(relationships: DataFrame, decisions: DataFrame, done: DataFrame, table_name: str, named: str) -> DataFrame:
    """One change per decision: the pair as it stood, and its new status with where an approval put it."""
    targets = done.select("relationship_id", F.col("target").alias("_target"))
    steps = _steps(decisions).withColumnRenamed("record_id", "relationship_id")
    rows = relationships.join(steps, "relationship_id").join(targets, "relationship_id", "left")
    before = F.struct(
        *[
            _status_of(F.col("_prior"), F.col(c)).alias(c) if c == "review_status" else F.col(c)
            for c in relationships.columns
        ]
    )
    approved = F.col("_d.decision") == "approve"
    after = F.struct(
        F.when(approved, "approved").otherwise("rejected").alias("review_status"), F.when(approved, F.col("_target")).alias(named)
    )
    return _audit(rows, table_name, "relationship_id", before, after)


def wrong_kind(relationships: DataFrame, decisions: DataFrame, kind: str) -> DataFrame:
    """Approvals of pairs of another kind: refused."""
    yes = decisions.where(F.col("decision") == "approve")
    return yes.join(
        relationships.where(F.col("relationship_type") != kind).select(F.col("relationship_id").alias("record_id")),
        "record_id",
        "left_semi",
    )


def decide_event_pairs(
    relationships: DataFrame, decisions: DataFrame, members: DataFrame, events: DataFrame
) -> dict[str, DataFrame]:
    """Apply decisions on same-event pairs.

    An approved pair joins the cluster of a, else of b, else a new one seeded by a; two
    different clusters are left apart. Gives relationships, event_cluster_members, the
    new canonical_events and audit changes.
    """
    refused = wrong_kind(relationships, decisions, "same_event")
    taken = _numbered(decisions).join(refused.select("record_id", "decision_no"), ["record_id", "decision_no"], "left_anti")
    pairs = _approved(relationships, taken, "same_event")
    start = members.select(F.col("event_id").alias("x"), F.col("canonical_id").alias("target"))
    done = _resolve(pairs, start)
    fresh = done.select(
        "target",
        "relationship_id",
        "decision_no",
        F.explode(
            F.array(
                F.struct(F.col("a_id").alias("event_id"), F.col("a_known").alias("known")),
                F.struct(F.col("b_id").alias("event_id"), F.col("b_known").alias("known")),
            )
        ).alias("e"),
    ).where(~F.col("e.known"))
    first = fresh.groupBy(F.col("e.event_id").alias("event_id")).agg(
        F.min_by(F.struct("target", "relationship_id"), "decision_no").alias("_m")
    )
    added = first.select(
        F.col("_m.target").alias("canonical_id"), "event_id", (F.col("_m.target") == F.col("event_id")).alias("is_seed")
    )
    seeds = added.where("is_seed").select("event_id")
    made = events.join(seeds, "event_id").select(
        F.col("event_id").alias("canonical_id"),
        "company_id",
        "event_type",
        F.col("event_date").alias("canonical_date"),
        "domain",
        "entity",
        title_text(F.col("entity"), F.col("subject"), F.col("action"), F.col("event_type")).alias("title"),
        F.col("raw_quote").alias("summary"),
        F.lit("approved").alias("review_status"),
    )
    joined = _with_status(relationships, taken)
    audit = _pair_audit(relationships, taken, done, "event_relationships", "merged_into")
    return {
        "relationships": joined.withColumn("review_status", _status_after()).select(*relationships.columns),
        "event_cluster_members": members.select("canonical_id", "event_id", "is_seed").unionByName(added),
        "canonical_events": made,
        "audit": audit,
        "refused": refused,
    }


def decide_canonical_pairs(
    relationships: DataFrame, decisions: DataFrame, thread_events: DataFrame, canonical: DataFrame
) -> dict[str, DataFrame]:
    """Apply decisions on related-distinct pairs.

    An approved pair appends to the first thread of a, else of b, else opens a thread of
    both by date. Gives relationships, thread_events, new threads and audit changes.
    """
    refused = wrong_kind(relationships, decisions, "related_distinct")
    taken = _numbered(decisions).join(refused.select("record_id", "decision_no"), ["record_id", "decision_no"], "left_anti")
    pairs = _approved(relationships, taken, "related_distinct")
    start = thread_events.groupBy(F.col("canonical_id").alias("x")).agg(F.min("thread_id").alias("target"))
    done = _resolve(pairs, start)
    when = canonical.select(F.col("canonical_id"), F.coalesce("canonical_date", F.lit("")).alias("_when"))
    new_pair = ~F.col("a_known") & ~F.col("b_known")
    wanted = F.when(new_pair, F.array("a_id", "b_id")).when(F.col("a_known"), F.array("b_id")).otherwise(F.array("a_id"))
    rows = done.select(
        F.col("target").alias("thread_id"), "relationship_id", "decision_no", F.posexplode(wanted).alias("_side", "canonical_id")
    )
    first = rows.groupBy("thread_id", "canonical_id").agg(
        F.min(F.struct("decision_no", "_side", "relationship_id")).alias("_f")
    )
    fresh = first.join(thread_events.select("thread_id", "canonical_id"), ["thread_id", "canonical_id"], "left_anti")
    ends = thread_events.groupBy("thread_id").agg((F.max("sequence_index") + 1).alias("_next"))
    order = W.partitionBy("thread_id").orderBy("_f.decision_no", "_when", "_f._side")
    placed = (
        fresh.join(when, "canonical_id")
        .join(ends, "thread_id", "left")
        .withColumn("sequence_index", F.coalesce("_next", F.lit(0)) + F.row_number().over(order) - 1)
    )
    added = placed.join(
        canonical.select("canonical_id", stage_of(F.col("action"), F.col("event_type")).alias("stage")), "canonical_id"
    ).select("thread_id", "canonical_id", F.col("sequence_index").cast("long").alias("sequence_index"), "stage")
    opened = done.where(new_pair).select(F.col("target").alias("canonical_id"))
    threads = canonical.join(opened, "canonical_id", "left_semi").select(
        F.col("canonical_id").alias("thread_id"),
        "company_id",
        thread_title(F.col("entity"), F.col("domain")).alias("title"),
        "domain",
        "entity",
        F.lit("approved").alias("review_status"),
    )
    joined = _with_status(relationships, taken)
    audit = _pair_audit(relationships, taken, done, "canonical_event_relationships", "thread_id")
    return {
        "relationships": joined.withColumn("review_status", _status_after()).select(*relationships.columns),
        "thread_events": thread_events.select("thread_id", "canonical_id", "sequence_index", "stage").unionByName(added),
        "threads": threads,
        "audit": audit,
        "refused": refused,
    }
