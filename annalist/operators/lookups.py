"""Filters, lookups and lineage joins over the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from annalist.session import broadcast_if_small


def by_id(table: DataFrame, key: str, value) -> DataFrame:
    """The row with this id."""
    return table.where(F.col(key) == F.lit(value))


def require(table: DataFrame, key: str, value) -> DataFrame:
    """``by_id``, raising KeyError if there is no such row."""
    found = by_id(table, key, value)
    if found.isEmpty():
        raise KeyError(f"no row with {key} = {value}")
    return found


def by_ids(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose id is in ``ids``; none for an empty list."""
    return table.join(broadcast_if_small(ids.select(key).distinct()), key, "left_semi")


def documents_of(documents: DataFrame, company_id=None, source_type: str | None = None) -> DataFrame:
    """Documents by publication date, undated last."""
    rows = documents if company_id is None else documents.where(F.col("company_id") == F.lit(company_id))
    rows = rows if source_type is None else rows.where(F.col("source_type") == source_type)
    return rows.orderBy(F.asc_nulls_last("published_date"), "doc_id")


def ordered_part(table: DataFrame, key: str, value, order: str) -> DataFrame:
    """Rows of one parent in order: snapshots by version, chunks by index, members by sequence."""
    return by_id(table, key, value).orderBy(order)


def in_range(date: Column, start: str | None = None, end: str | None = None) -> Column:
    """Optional range on a date kept as text; unknown dates always pass."""
    ok = F.lit(True)
    if start:
        ok = ok & (date.isNull() | (date >= start))
    if end:
        ok = ok & (date.isNull() | (date <= end))
    return ok


def same_word(c: Column, wanted: str) -> Column:
    """Equality without regard to case, NULL counting as ''."""
    return F.lower(F.coalesce(c, F.lit(""))) == wanted.lower()


def facet(table: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-empty values."""
    return table.where(F.length(column) > 0).select(column).distinct().orderBy(column)


def company_names(companies: DataFrame) -> DataFrame:
    return companies.select("name").orderBy("name")


def default_company(companies: DataFrame) -> DataFrame:
    """The company with the least id."""
    return companies.orderBy("company_id").limit(1)


def lineage(events: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Events with the company, document and officialness of their source."""
    narrow = documents.select("doc_id", "company_id", "is_official")
    return events.join(chunks.select("chunk_id", "doc_id"), "chunk_id").join(narrow, "doc_id")


def without(table: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that have no counterpart in ``done`` yet."""
    return table.join(done.select(key), key, "left_anti")


def unclustered_events(events: DataFrame, evidence: DataFrame, members: DataFrame) -> DataFrame:
    """Events with valid evidence that belong to no canonical event, by date then id."""
    valid = evidence.where("is_valid").select("event_id")
    return without(events.join(valid, "event_id", "left_semi"), members, "event_id").orderBy(
        F.asc_nulls_last("event_date"), "event_id"
    )


def unthreaded_events(canonical: DataFrame, thread_events: DataFrame) -> DataFrame:
    return without(canonical, thread_events, "canonical_id").orderBy(F.asc_nulls_last("canonical_date"), "canonical_id")


def pending(table: DataFrame, relationship_type: str | None = None) -> DataFrame:
    rows = table.where(F.col("review_status") == "pending")
    return rows if relationship_type is None else rows.where(F.col("relationship_type") == relationship_type)


def valid_evidence(evidence: DataFrame, missing_embedding: bool = False) -> DataFrame:
    rows = evidence.where("is_valid")
    return rows.where(F.col("embedding").isNull()) if missing_embedding else rows


def canonical_of_events(members: DataFrame, canonical: DataFrame) -> DataFrame:
    """event_id -> canonical_id with the company."""
    return members.select("event_id", "canonical_id").join(canonical.select("canonical_id", "company_id"), "canonical_id")


def seed_events(canonical: DataFrame, members: DataFrame, events: DataFrame) -> DataFrame:
    """The seed event of every canonical event."""
    seeds = members.where("is_seed").select("canonical_id", "event_id")
    return canonical.select("canonical_id").join(seeds, "canonical_id").join(events, "event_id")


def official_canonical_ids(members: DataFrame, event_sources: DataFrame) -> DataFrame:
    """Canonical events with at least one official source.

    ``event_sources`` gives is_official per event_id (see ``lineage``).
    """
    official = event_sources.where("is_official").select("event_id")
    return members.join(official, "event_id", "left_semi").select("canonical_id").distinct()


def threads_by_event(thread_events: DataFrame, threads: DataFrame) -> DataFrame:
    """canonical_id -> its threads in order of thread id."""
    named = thread_events.select("thread_id", "canonical_id").join(threads.select("thread_id", "title"), "thread_id")
    return named.groupBy("canonical_id").agg(
        F.array_sort(F.collect_list(F.struct("thread_id", "title"))).alias("threads")
    )
