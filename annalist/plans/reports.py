"""Report queries over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from annalist.operators.lookups import in_range, official_canonical_ids, same_word, threads_by_event


def timeline(
    canonical: DataFrame,
    thread_events: DataFrame | None = None,
    threads: DataFrame | None = None,
    members: DataFrame | None = None,
    event_sources: DataFrame | None = None,
    company_id=None,
    start: str | None = None,
    end: str | None = None,
    domain: str | None = None,
    official_only: bool = False,
) -> DataFrame:
    """Canonical events in date order (unknown last), optionally filtered, with their threads."""
    rows = canonical.where(in_range(F.col("canonical_date"), start, end))
    if company_id is not None:
        rows = rows.where(F.col("company_id") == F.lit(company_id))
    if domain:
        rows = rows.where(same_word(F.col("domain"), domain))
    if official_only:
        rows = rows.join(official_canonical_ids(members, event_sources), "canonical_id", "left_semi")
    if thread_events is not None:
        rows = rows.join(threads_by_event(thread_events, threads), "canonical_id", "left")
    return rows.orderBy(F.asc_nulls_last("canonical_date"), "canonical_id")


def thread_cards(threads: DataFrame, thread_events: DataFrame, canonical: DataFrame) -> DataFrame:
    """Per thread: members, and the first and last dated member with the date's precision."""
    facts = canonical.select("canonical_id", "canonical_date", "date_precision")
    dated = F.when(F.length("canonical_date") > 0, F.struct("canonical_date", "date_precision", "canonical_id"))
    per_thread = (
        thread_events.join(facts, "canonical_id")
        .groupBy("thread_id")
        .agg(
            F.count("*").alias("members"),
            F.min_by(dated, F.when(dated.isNotNull(), F.struct("canonical_date", "sequence_index"))).alias("s"),
            F.max_by(dated, F.when(dated.isNotNull(), F.struct("canonical_date", "sequence_index"))).alias("e"),
        )
    )
    return threads.join(per_thread, "thread_id", "left").select(
        "thread_id",
        "company_id",
        "title",
        F.coalesce("members", F.lit(0).cast("long")).alias("members"),
        F.col("s.canonical_date").alias("start_date"),
        F.col("s.date_precision").alias("start_precision"),
        F.col("e.canonical_date").alias("end_date"),
        F.col("e.date_precision").alias("end_precision"),
    )


def thread_detail(threads: DataFrame, thread_events: DataFrame, canonical: DataFrame, thread_id=None) -> DataFrame:
    """Members of threads in sequence."""
    rows = thread_events if thread_id is None else thread_events.where(F.col("thread_id") == F.lit(thread_id))
    facts = canonical.select("canonical_id", "canonical_date", "event_type", F.col("title").alias("event_title"))
    return (
        rows.join(threads.select("thread_id", F.col("title").alias("thread_title")), "thread_id")
        .join(facts, "canonical_id")
        .orderBy("thread_id", "sequence_index")
    )


def evidence_drilldown(
    members: DataFrame, events: DataFrame, evidence: DataFrame, documents: DataFrame, canonical_id=None
) -> DataFrame:
    """Events behind canonical events with evidence (if any) and source document."""
    rows = members if canonical_id is None else members.where(F.col("canonical_id") == F.lit(canonical_id))
    spans = evidence.select("event_id", "match_method", "match_score", "matched_text")
    docs = documents.select("doc_id", "source_type", F.col("title").alias("doc_title"), "published_date")
    facts = events.select("event_id", "doc_id", "event_type", "event_date")
    return rows.join(facts, "event_id").join(spans, "event_id", "left").join(docs, "doc_id")


def by_relevance(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """Timeline with matched events first by score; the rest keeps its order by date."""
    scored = rows.join(scores.select("canonical_id", "score"), "canonical_id", "left")
    return scored.orderBy(
        F.desc(F.coalesce("score", F.lit(-1.0))), F.asc_nulls_last("canonical_date"), "canonical_id"
    )


def search_queries(canonical: DataFrame, companies: DataFrame) -> DataFrame:
    """News search text per company and distinct entity, in order."""
    named = canonical.where(F.length("entity") > 0).select("company_id", "entity").distinct()
    return (
        named.join(companies.select("company_id", "name"), "company_id")
        .select("company_id", "entity", F.concat_ws(" ", "name", "entity").alias("query"))
        .orderBy("company_id", "entity")
    )


def require_entities(queries: DataFrame) -> DataFrame:
    """Raise if there is nothing to search for."""
    if queries.isEmpty():
        raise ValueError("no canonical events with an entity yet; ingest and cluster official sources first")
    return queries
