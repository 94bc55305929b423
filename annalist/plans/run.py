"""A full run from documents to threads, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from annalist.operators import clustering, dedupe, evidence, threading
from annalist.operators.chunking import chunk_documents, unknown_sources
from annalist.operators.extraction import keyword_events
from annalist.operators.pairs import RuleClassifier
from annalist.operators.upserts import event_rows, linked_to, upsert_relationships
from annalist.session import cut

DOCS_PER_BUCKET = 10_000


def ordered_ids(df: DataFrame, group: str, order: list[str], out: str, per: int = DOCS_PER_BUCKET, start: int = 0) -> DataFrame:
    """Dense ids from ``start`` + 1 in (group, order) order for a numeric ``group``.

    Only one row (group, count) per group is numbered: ranges of ``per`` groups on their
    own, after the counts of the ranges before them. Rows are then numbered inside their group.
    """
    counts = df.groupBy(group).agg(F.count("*").alias("_n")).withColumn("_b", F.floor(F.col(group) / F.lit(per)))
    ranges = counts.groupBy("_b").agg(F.sum("_n").alias("_m"))
    before = F.sum("_m").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    inside = F.sum("_n").over(W.partitionBy("_b").orderBy(group).rowsBetween(W.unboundedPreceding, -1))
    offsets = ranges.select("_b", F.coalesce(before, F.lit(0)).alias("_off"))
    first = counts.join(offsets, "_b").select(F.col(group).alias("_g"), (F.col("_off") + F.coalesce(inside, F.lit(0))).alias("_first"))
    own = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return df.withColumn("_own", own).join(first, F.col(group) == F.col("_g")).withColumn(
        out, F.lit(start) + F.col("_first") + F.col("_own")
    ).drop("_g", "_first", "_own")


def _largest(table: DataFrame, id: str) -> int:
    return table.agg(F.max(id)).first()[0] or 0


def _merged_pairs(pairs: DataFrame, old: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(pairs, all pairs): decisions of this run under the ids their pairs have, and stored ones with them.

    A pair that a person decided keeps that decision.
    """
    if old is None:
        return pairs, pairs
    known = old.select("a_id", "b_id", F.col("relationship_id").alias("_known"))
    kept = cut(
        pairs.join(known, ["a_id", "b_id"], "left")
        .withColumn("relationship_id", F.coalesce("_known", F.col("relationship_id") + _largest(old, "relationship_id")))
        .select(*pairs.columns)
    )
    return kept, upsert_relationships(old, kept.withColumn("_run", F.lit(1)), "_run")


def _renamed(assigned: DataFrame, names: DataFrame) -> DataFrame:
    """Assignments to the canonical events ``_now`` in place of ``_seed``."""
    return assigned.join(names, assigned["canonical_id"] == names["_seed"], "left").select(
        *[F.coalesce("_now", "canonical_id").alias(c) if c == "canonical_id" else F.col(c) for c in assigned.columns]
    )


STATE = ["event_relationships", "canonical_event_relationships", "chunks", "events", "evidence_spans", "event_cluster_members", "canonical_events", "threads", "thread_events"]


def run(
    documents: DataFrame,
    companies: DataFrame,
    classifier: RuleClassifier | None = None,
    deduplicate: bool = False,
    state: dict[str, DataFrame] | None = None,
    **extraction,
) -> dict[str, DataFrame]:
    """Chunks, events, evidence, clusters and threads of ``documents``, with every pair decision.

    Extraction and clustering are written out before what follows them: the one is
    costly, the other depends on order. ``state`` holds the tables of an earlier run
    (``STATE``): documents it has chunks of are not read again, events it has evidence of
    are not validated again, new events are compared with its seeds and new canonical events with
    the last members of its threads. The result then holds old and new rows together.
    With ``deduplicate``, one map of merges rewrites all tables: no row of the result names a removed event.
    """
    old = state or {}
    start = {c: _largest(old[t], c) if t in old else 0 for t, c in (("chunks", "chunk_id"), ("events", "event_id"))}

    def with_old(name: str, rows: DataFrame) -> DataFrame:
        return old[name].unionByName(rows, allowMissingColumns=True) if name in old else rows

    fresh = documents.join(old["chunks"].select("doc_id").distinct(), "doc_id", "left_anti") if "chunks" in old else documents
    chunks = cut(ordered_ids(chunk_documents(fresh), "doc_id", ["chunk_index"], "chunk_id", start=start["chunk_id"]))
    facts = fresh.select("doc_id", "company_id", "published_date", "is_official").join(
        companies.select("company_id", F.col("name").alias("company")), "company_id"
    )
    found = keyword_events(
        chunks.join(facts, "doc_id"), keep=["chunk_id", "doc_id", "company_id", "is_official"], **extraction
    )
    numbered = ordered_ids(found, "doc_id", ["chunk_id", "sentence_no"], "event_id", start=start["event_id"]).drop("sentence_no")
    made = cut(event_rows(numbered, "rule", "v1"))
    events = with_old("events", made)
    spans = with_old("evidence_spans", cut(evidence.validate_events(made, chunks)))
    valid = events.join(spans.where("is_valid").select("event_id"), "event_id", "left_semi")
    prior = None
    open_events = valid
    if "event_cluster_members" in old:
        prior = clustering.seed_events(events, old["event_cluster_members"])
        open_events = valid.join(old["event_cluster_members"].select("event_id"), "event_id", "left_anti")
    assigned = clustering.assign_events(open_events, prior=prior, classifier=classifier)
    if prior is not None:
        # a seed whose canonical event was merged away stands for the one that stayed
        now = old["event_cluster_members"].where("is_seed").select(F.col("event_id").alias("_seed"), F.col("canonical_id").alias("_now"))
        assigned = _renamed(assigned, now.where("_seed <> _now"))
    assigned = cut(assigned)
    decided = cut(clustering.relationships(open_events, assigned, prior=prior, classifier=classifier))
    event_pairs, all_event_pairs = _merged_pairs(decided, old.get("event_relationships"))
    joined = linked_to(clustering.members(assigned), event_pairs, "event_id", "canonical_id")
    members = with_old("event_cluster_members", joined)
    canonical = with_old("canonical_events", cut(clustering.canonical_events(open_events, assigned)))
    kept = None
    if deduplicate:
        merges = cut(dedupe.dedupe(canonical, classifier))
        none = canonical.sparkSession.createDataFrame([], "thread_id long, canonical_id long, sequence_index long, stage string, relationship_id long")
        no_pairs = canonical.sparkSession.createDataFrame([], "relationship_id long, a_id long, b_id long")
        decided_pairs = old.get("canonical_event_relationships", no_pairs)
        kept = dedupe.apply_merges(merges, members, with_old("thread_events", none), decided_pairs, canonical)
        members, canonical = kept["event_cluster_members"], cut(kept["canonical_events"])
        assigned = _renamed(assigned, merges.select(F.col("remove_id").alias("_seed"), F.col("keep_id").alias("_now")))
    stored = kept["thread_events"] if kept else old.get("thread_events")
    last = threading.last_members(stored, canonical) if "thread_events" in old else None
    waiting = canonical.join(stored.select("canonical_id"), "canonical_id", "left_anti") if "thread_events" in old else canonical
    linked = cut(threading.link_threads(waiting, last_members=last, classifier=classifier))
    known_pairs = old.get("canonical_event_relationships")
    if kept is not None and known_pairs is not None:
        known_pairs = cut(kept["relationships"])
    thread_pairs, all_thread_pairs = _merged_pairs(cut(threading.relationships(linked, canonical, classifier)), known_pairs)
    rows = threading.linked_rows(linked, canonical, thread_pairs)
    staged = canonical.withColumn("stage", threading.stage_of(F.col("action"), F.col("event_type")))
    out = {
        "quarantine": unknown_sources(documents),
        "chunks": with_old("chunks", chunks),
        "events": events,
        "evidence_spans": spans,
        "assigned": assigned,
        "event_relationships": all_event_pairs,
        "event_cluster_members": members,
        "canonical_events": staged,
        "canonical_event_relationships": all_thread_pairs,
        "threads": with_old("threads", threading.new_threads(linked, canonical)),
        "thread_events": stored.unionByName(rows, allowMissingColumns=True) if "thread_events" in old else rows,
        "thread_actions": threading.actions(linked),
    }
    if kept is not None:
        out |= {"merges": merges, "audit": kept["audit"]}
    return out
