"""Check that quotes really occur in the chunk they claim to come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from annalist.functions import text as tx
from annalist.functions.similarity import locate_approx

# Decision thresholds and stored words.
ACCEPT_SCORE = 0.85
REVIEW_SCORE = 0.60
MIN_MATCH = 15
MAX_LENGTH_RATIO = 2.0
EXACT, APPROX, REJECTED = "exact", "fuzzy_rapidfuzz", "rejected"


def _sane(length: Column, quote_length: Column) -> Column:
    return (length >= MIN_MATCH) & (length <= quote_length * MAX_LENGTH_RATIO)


def _slice(text: Column, span: Column) -> Column:
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])


def locate_quotes(df: DataFrame, quote: str = "raw_quote", text: str = "text", base: str | None = None) -> DataFrame:
    """Add match columns for ``quote`` in ``text`` (both on the row, as event joined to chunk).

    Adds matched_text, start_offset, end_offset (plus ``base``, the chunk's own
    start), match_score, match_method, is_valid and review_status. The exact search
    is an expression; only rows it misses carry strings into the Python scorer.
    """
    stripped = F.coalesce(tx.ustrip(F.col(quote)), F.lit(""))
    with_norm = df.withColumns(
        {
            "_len": F.length(stripped),
            "_q": tx.filled(tx.ustrip(tx.normalise(stripped))),
            "_t": tx.filled(tx.normalise(F.col(text))),
        }
    )
    hit = F.expr("locate(_q, _t)") - 1
    with_hit = with_norm.withColumn("_at", hit).withColumn(
        "_span", F.when(F.col("_at") >= 0, tx.normalised_span(F.col(text), F.col("_at"), F.col("_at") + F.length("_q")))
    )
    exact = F.coalesce(_sane(F.col("_span.end") - F.col("_span.start"), F.col("_len")), F.lit(False))
    flagged = with_hit.withColumn("_exact", exact)
    missed = ~F.col("_exact")
    scored = flagged.withColumn("_w", locate_approx(F.when(missed, F.col("_q")), F.when(missed, F.col("_t"))))
    approx_span = F.when(
        F.col("_w.score").isNotNull(), tx.normalised_span(F.col(text), F.col("_w.start"), F.col("_w.end"))
    )
    placed = scored.withColumn("_span", F.when(F.col("_exact"), F.col("_span")).otherwise(approx_span))
    score = F.when(F.col("_exact"), F.lit(1.0)).otherwise(F.coalesce(F.col("_w.score"), F.lit(0.0)))
    keep = F.col("_exact") | (
        (score >= REVIEW_SCORE)
        & F.coalesce(_sane(F.col("_span.end") - F.col("_span.start"), F.col("_len")), F.lit(False))
    )
    origin = F.lit(0) if base is None else F.col(base)
    decided = placed.withColumns({"match_score": score, "_keep": keep})
    method = (
        F.when(F.col("_exact"), EXACT).when(F.col("_keep"), APPROX).otherwise(REJECTED)
    )
    valid = F.col("_exact") | (F.col("_keep") & (F.col("match_score") >= ACCEPT_SCORE))
    out = decided.withColumns(
        {
            "matched_text": F.when(F.col("_keep"), _slice(F.col(text), F.col("_span"))),
            "_start": F.when(F.col("_keep"), (origin + F.col("_span.start")).cast("long")),
            "_end": F.when(F.col("_keep"), (origin + F.col("_span.end")).cast("long")),
            "match_method": method,
            "is_valid": valid,
            "review_status": F.when(valid, "auto_valid").when(F.col("_keep"), "pending").otherwise("rejected"),
        }
    )
    mine = ["matched_text", "match_score", "match_method", "is_valid", "review_status"]
    kept = [c for c in df.columns if c not in (*mine, "start_offset", "end_offset")]
    return out.select(
        *kept, *mine, F.col("_start").alias("start_offset"), F.col("_end").alias("end_offset")
    )


def validate_events(events: DataFrame, chunks: DataFrame) -> DataFrame:
    """Evidence rows for events (event_id, chunk_id, raw_quote) from their chunks."""
    joined = events.select("event_id", "chunk_id", "raw_quote").join(
        chunks.select("chunk_id", F.col("text").alias("_text"), F.col("start_offset").alias("_base")), "chunk_id"
    )
    return locate_quotes(joined, "raw_quote", "_text", "_base").drop("_text", "_base")


def status_counts(evidence: DataFrame) -> DataFrame:
    """Rows per review status."""
    return evidence.groupBy("review_status").agg(F.count("*").alias("n"))


def evidence_text(evidence_valid: Column, matched: Column, raw: Column) -> Column:
    """The verified text if there is one, else the claimed quote."""
    return F.when(F.coalesce(evidence_valid, F.lit(False)), matched).otherwise(raw)


def usable_text(matched: Column, raw: Column) -> Column:
    return F.coalesce(tx.filled(matched), raw)
