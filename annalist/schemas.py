"""Stored tables, their allowed words, and checks of both."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, functions as F

# Columns of the stored tables.
TABLES = {
    "companies": "company_id long, name string, code string, aliases array<string>",
    "documents": "doc_id long, company_id long, source_type string, is_official boolean, title string, url string, "
    "published_date string, external_id string, file_path string, raw_text string, content_hash string, version long, "
    "fetched_at string, metadata map<string,string>",
    "document_snapshots": "company_id long, source_type string, external_id string, version long, raw_text string, content_hash string",
    "ingestion_log": "source string, company_id long, status string, detail string, error_message string, occurred_at string",
    "chunks": "chunk_id long, doc_id long, chunk_index int, heading string, text string, start_offset long, end_offset long",
    "events": "event_id long, chunk_id long, event_type string, subject string, action string, event_date string, "
    "date_precision string, lifecycle_status string, domain string, entity string, raw_quote string, extraction_model string, "
    "prompt_version string, raw_response_json string, created_at string",
    "evidence_spans": "event_id long, chunk_id long, raw_quote string, matched_text string, start_offset long, end_offset long, "
    "match_score double, match_method string, is_valid boolean, review_status string, embedding array<double>",
    "event_relationships": "relationship_id long, a_id long, b_id long, relationship_type string, rationale string, "
    "confidence double, decided_by string, review_status string",
    "canonical_events": "canonical_id long, company_id long, event_type string, subject string, action string, "
    "canonical_date string, date_precision string, lifecycle_status string, domain string, entity string, title string, "
    "summary string, stage string, review_status string",
    "event_cluster_members": "canonical_id long, event_id long, is_seed boolean, relationship_id long",
    "threads": "thread_id long, company_id long, title string, domain string, entity string, review_status string",
    "canonical_event_relationships": "relationship_id long, a_id long, b_id long, relationship_type string, rationale string, "
    "confidence double, decided_by string, review_status string",
    "thread_events": "thread_id long, canonical_id long, sequence_index long, stage string, relationship_id long",
    "user_jds": "job_id long, company_id long, raw_text string, role string, role_subtype string, domain string, "
    "entities array<string>, tasks array<string>, created_at string",
    "audit_log": "table_name string, record_id long, action string, actor string, before_json string, after_json string, occurred_at string",
}
# Words a column may hold, per table.
WORDS = {
    ("documents", "source_type"): ["dart", "ir", "press_release", "tech_blog", "ceo_letter", "news"],
    ("ingestion_log", "source"): ["dart", "news", "manual"],
    ("ingestion_log", "status"): ["success", "failed"],
    ("events", "date_precision"): ["day", "month", "quarter", "year", "unknown"],
    ("events", "lifecycle_status"): ["planned", "completed", "cancelled", "unknown"],
    ("evidence_spans", "match_method"): ["exact", "fuzzy_rapidfuzz", "rejected"],
    ("evidence_spans", "review_status"): ["auto_valid", "pending", "approved", "rejected"],
    ("event_relationships", "relationship_type"): ["same_event", "related_distinct", "unrelated", "insufficient_info"],
    ("event_relationships", "decided_by"): ["llm", "human"],
    ("event_relationships", "review_status"): ["auto_applied", "pending", "approved", "rejected"],
    ("canonical_events", "stage"): ["announce", "build", "pilot", "launch", "scale"],
    ("canonical_events", "review_status"): ["auto_applied", "pending", "approved", "rejected"],
    ("thread_events", "stage"): ["announce", "build", "pilot", "launch", "scale"],
}
# Columns that together name one row.
UNIQUE = {
    "companies": [["name"]],
    "documents": [["company_id", "source_type", "external_id"]],
    "document_snapshots": [["company_id", "source_type", "external_id", "version"]],
    "chunks": [["doc_id", "chunk_index"]],
    "evidence_spans": [["event_id"]],
    "event_relationships": [["a_id", "b_id"]],
    "event_cluster_members": [["event_id"]],
    "canonical_event_relationships": [["a_id", "b_id"]],
    "thread_events": [["thread_id", "canonical_id"], ["thread_id", "sequence_index"]],
}


def bad_words(table: str, df: DataFrame) -> DataFrame:
    """Rows with a word outside its list (NULL passes)."""
    checks = [~F.col(c).isin(words) for (t, c), words in WORDS.items() if t == table and c in df.columns]
    return df.where(reduce(or_, checks)) if checks else df.where("false")


def repeated_keys(table: str, df: DataFrame) -> DataFrame:
    """Keys that name more than one row."""
    found = None
    for columns in UNIQUE.get(table, []):
        again = df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")
        row = again.select(F.lit(", ".join(columns)).alias("key"), F.to_json(F.struct(*columns)).alias("value"), "n")
        found = row if found is None else found.unionByName(row)
    return found if found is not None else df.select(F.lit("").alias("key"), F.lit("").alias("value"), F.lit(0).cast("long").alias("n")).where("false")
