"""State transitions: each takes the current table and a change set and gives the new table.

Parquet has no row updates, so every function returns whole new state to be written
to a new path. Run timestamps are parameters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

DOC_KEY = ["company_id", "source_type", "external_id"]


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def dense_ids(df: DataFrame, key: str, out: str, start: Column | int = 0) -> DataFrame:
    """Number rows from ``start`` + 1 without gaps and without one task seeing them all.

    Rows are spread over 256 hash buckets; each bucket numbers its own rows after the
    counts of the buckets before it.
    """
    slots = df.withColumn("_b", F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 2))
    counts = slots.groupBy("_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("_b", F.coalesce(before, F.lit(0)).alias("_off"))  # at most 256 rows
    own = F.row_number().over(W.partitionBy("_b").orderBy(key))
    base = F.lit(start) if isinstance(start, int) else start
    return slots.join(F.broadcast(offsets), "_b").withColumn(out, base + F.col("_off") + own).drop("_b", "_off")


def get_or_create(current: DataFrame, wanted: DataFrame, name: str = "name", id: str = "company_id") -> DataFrame:
    """Dimension rows for every wanted name; existing rows stay as they are."""
    fresh = wanted.join(current.select(name), name, "left_anti").dropDuplicates([name])
    top = current.agg(F.coalesce(F.max(id), F.lit(0)).alias("_top"))
    made = dense_ids(fresh.withColumn("_top", top.scalar()), name, id, F.col("_top")).drop("_top")
    return current.unionByName(made, allowMissingColumns=True)


def document_versions(
    incoming: DataFrame, current: DataFrame | None = None, order: str = "delivery", bucket: int = 100_000
) -> DataFrame:
    """Version and changed flag of every delivery of a document.

    A delivery is a new version if its text hash differs from the delivery before it
    (or from the current row). Versions are a running count per document, done in two
    levels: inside stretches of ``bucket`` deliveries, and over one row per stretch, so
    a document delivered very often is not sorted by one task. Texts stay behind; only
    hashes move.
    """
    rows = incoming.select(
        *DOC_KEY, order, F.floor(F.col(order) / F.lit(bucket)).alias("_b"), content_hash(F.col("raw_text")).alias("content_hash")
    )
    inside = W.partitionBy(*DOC_KEY, "_b").orderBy(order)
    stepped = rows.withColumn("_prev", F.lag("content_hash").over(inside)).withColumn(
        "_step", F.when(F.col("_prev").isNotNull() & (F.col("_prev") != F.col("content_hash")), 1).otherwise(0)
    )
    stretch = stepped.groupBy(*DOC_KEY, "_b").agg(
        F.min_by("content_hash", order).alias("_first"),
        F.max_by("content_hash", order).alias("_last"),
        F.sum("_step").alias("_steps"),
    )
    if current is None:
        known = stretch.withColumns({"_hash0": F.lit(None).cast("string"), "_v0": F.lit(0).cast("long")})
    else:
        base = current.select(*DOC_KEY, F.col("content_hash").alias("_hash0"), F.col("version").cast("long").alias("_v0"))
        known = stretch.join(base, DOC_KEY, "left").fillna({"_v0": 0})
    over = W.partitionBy(*DOC_KEY).orderBy("_b")
    linked = known.withColumn("_before", F.coalesce(F.lag("_last").over(over), "_hash0")).withColumn(
        "_open", F.when(F.col("_before").eqNullSafe(F.col("_first")), 0).otherwise(1)
    )
    earlier = F.coalesce(
        F.sum(F.col("_steps") + F.col("_open")).over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    bases = linked.select(*DOC_KEY, "_b", "_open", (F.col("_v0") + earlier + F.col("_open")).alias("_base"))
    return (
        stepped.join(bases, [*DOC_KEY, "_b"])
        .withColumn("version", F.col("_base") + F.sum("_step").over(inside))
        .withColumn("changed", F.when(F.col("_prev").isNull(), F.col("_open") == 1).otherwise(F.col("_step") == 1))
        .select(*DOC_KEY, order, "content_hash", "version", "changed")
    )


def document_snapshots(incoming: DataFrame, versions: DataFrame, order: str = "delivery") -> DataFrame:
    """One snapshot per new version, with its text."""
    fresh = versions.where("changed").select(*DOC_KEY, order, "content_hash", "version")
    return fresh.join(incoming.select(*DOC_KEY, order, "raw_text"), [*DOC_KEY, order])


def upsert_documents(
    incoming: DataFrame,
    current: DataFrame | None = None,
    order: str = "delivery",
    versions: DataFrame | None = None,
    bucket: int = 100_000,
) -> DataFrame:
    """New document table: latest changed delivery per key; unchanged keys keep every field.

    ``is_official`` is set once, by the first delivery of a key.
    """
    seen = versions if versions is not None else document_versions(incoming, current, order, bucket)
    fresh = seen.where("changed")
    last = fresh.groupBy(*DOC_KEY).agg(F.max(order).alias(order), F.max("version").alias("version"))
    first = fresh.groupBy(*DOC_KEY).agg(F.min(order).alias(order))
    fields = [c for c in incoming.columns if c not in (*DOC_KEY, order, "is_official")]
    latest = last.join(incoming, [*DOC_KEY, order]).select(*DOC_KEY, "version", *fields)
    official = first.join(incoming, [*DOC_KEY, order]).select(*DOC_KEY, F.col("is_official").alias("_first_official"))
    rows = latest.join(official, DOC_KEY).withColumn("content_hash", content_hash(F.col("raw_text")))
    if current is None:
        return rows.withColumnRenamed("_first_official", "is_official")
    old = current.select(*DOC_KEY, F.col("is_official").alias("_old_official"))
    kept = current.join(rows.select(*DOC_KEY), DOC_KEY, "left_anti")
    moved = rows.join(old, DOC_KEY, "left").withColumn(
        "is_official", F.coalesce("_old_official", "_first_official")
    )
    return kept.unionByName(moved.drop("_old_official", "_first_official"), allowMissingColumns=True)


def ingest_tally(versions: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """ingested, unchanged and failed counts as one row."""
    done = versions.agg(F.count_if("changed").alias("ingested"), F.count_if(~F.col("changed")).alias("unchanged"))
    if failed is None:
        return done.withColumn("failed", F.lit(0).cast("long"))
    return done.withColumn("failed", failed.agg(F.count("*")).scalar())


# The column that a source's log names a delivery by.
LOGGED = {"dart": "external_id", "manual": "file_path"}


def query_log(answers: DataFrame, failed: DataFrame | None, occurred_at: str | None = None) -> DataFrame:
    """Log rows of news: one per query (company_id, query) that was answered and one per failure."""
    done = answers.select("company_id", F.col("query").alias("external_id")).distinct()
    return ingestion_log(done, failed, "news", occurred_at)


def ingestion_log(versions: DataFrame, failed: DataFrame | None, source: str, occurred_at: str | None = None) -> DataFrame:
    """Log rows to append: one per delivery and one per failure (detail, error).

    A filing is named by its id, a manual document by its path; news is logged by query
    (``query_log``), without the note on changes.
    """
    if source == "news":
        label = F.col("external_id")
    else:
        label = F.concat(F.col(LOGGED[source]), F.lit(" (changed="), F.initcap(F.col("changed").cast("string")), F.lit(")"))
    none = F.lit(None).cast("string")
    good = versions.select(
        F.lit(source).alias("source"),
        "company_id",
        F.lit("success").alias("status"),
        label.alias("detail"),
        none.alias("error_message"),
        F.lit(occurred_at).cast("string").alias("occurred_at"),
    )
    if failed is None:
        return good
    return good.unionByName(
        failed.select(
            F.lit(source).alias("source"),
            "company_id",
            F.lit("failed").alias("status"),
            "detail",
            F.col("error").alias("error_message"),
            F.lit(occurred_at).cast("string").alias("occurred_at"),
        )
    )


def latest_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last row per key by ``order``, as an aggregate (combined before the shuffle)."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return best.select(*keys, "_r.*")


def upsert_evidence(current: DataFrame, incoming: DataFrame, order: str = "delivery") -> DataFrame:
    """One evidence row per event; an update keeps only the stored embedding."""
    fresh = latest_by(incoming, ["event_id"], order).drop(order)
    old = current.select("event_id", F.col("embedding").alias("_old"))
    moved = fresh.drop("embedding").join(old, "event_id", "left").withColumnRenamed("_old", "embedding")
    return current.join(fresh, "event_id", "left_anti").unionByName(moved, allowMissingColumns=True)


def upsert_relationships(
    current: DataFrame | None, incoming: DataFrame, order: str, overwrite_human: bool = False
) -> DataFrame:
    """One row per unordered pair (a_id < b_id), latest decision wins.

    A human decision survives a rerun of the model unless ``overwrite_human``.
    """
    paired = incoming.withColumns({"_a": F.least("a_id", "b_id"), "_b": F.greatest("a_id", "b_id")})
    fresh = latest_by(
        paired.drop("a_id", "b_id").withColumnsRenamed({"_a": "a_id", "_b": "b_id"}), ["a_id", "b_id"], order
    ).drop(order)
    if current is None:
        return fresh
    if not overwrite_human:
        fixed = current.where(F.col("decided_by") == "human").select("a_id", "b_id")
        fresh = fresh.join(fixed, ["a_id", "b_id"], "left_anti")
    return current.join(fresh, ["a_id", "b_id"], "left_anti").unionByName(fresh, allowMissingColumns=True)


def relationship_rows(decided: DataFrame, review_status: Column | str = "pending") -> DataFrame:
    """Classified pairs as relationship rows decided by the model."""
    return decided.select(
        "a_id",
        "b_id",
        "relationship_type",
        "rationale",
        "confidence",
        F.lit("llm").alias("decided_by"),
        (F.lit(review_status) if isinstance(review_status, str) else review_status).alias("review_status"),
    )


def numbered_relationships(rows: DataFrame, start: Column | int = 0) -> DataFrame:
    """Relationship rows with a ``relationship_id``, numbered from ``start`` + 1 without gaps."""
    keyed = rows.withColumn("_pair", F.concat_ws("-", "a_id", "b_id"))
    return dense_ids(keyed, "_pair", "relationship_id", start).select("relationship_id", *rows.columns)


def linked_to(rows: DataFrame, pairs: DataFrame, one: str, other: str) -> DataFrame:
    """``rows`` with the relationship_id of the applied pair of the ids in columns ``one`` and ``other``, else null."""
    applied = pairs.where(F.col("review_status").isin("auto_applied", "approved"))
    named = applied.select(F.col("a_id").alias("_a"), F.col("b_id").alias("_b"), "relationship_id")
    low, high = F.least(one, other), F.greatest(one, other)
    return rows.join(named, (low == F.col("_a")) & (high == F.col("_b")), "left").drop("_a", "_b")


def event_rows(candidates: DataFrame, model: str, prompt_version: str, created_at: str | None = None) -> DataFrame:
    """Event candidates with the record of how they were extracted."""
    fields = ["event_type", "subject", "action", "event_date", "date_precision", "lifecycle_status", "domain", "entity", "raw_quote"]
    return candidates.withColumns(
        {
            "extraction_model": F.lit(model),
            "prompt_version": F.lit(prompt_version),
            "raw_response_json": F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}),
            "created_at": F.lit(created_at).cast("string"),
        }
    )


def audit_rows(changes: DataFrame, occurred_at: str | None = None) -> DataFrame:
    """Audit rows from (table_name, record_id, action, actor, before, after), structs as JSON."""
    options = {"ignoreNullFields": "false"}
    return changes.select(
        "table_name",
        F.col("record_id").cast("long").alias("record_id"),
        "action",
        "actor",
        F.to_json("before", options).alias("before_json"),
        F.to_json("after", options).alias("after_json"),
        F.lit(occurred_at).cast("string").alias("occurred_at"),
    )


def audit_history(log: DataFrame, table_name: str | None = None, record_id: int | None = None) -> DataFrame:
    """Audit rows, newest first, optionally of one table or record."""
    wanted = []
    if table_name:
        wanted.append(F.col("table_name") == table_name)
    if record_id is not None:
        wanted.append(F.col("record_id") == record_id)
    rows = log.where(reduce(lambda a, b: a & b, wanted)) if wanted else log
    return rows.orderBy(F.desc("occurred_at"), "table_name", "record_id")


def set_columns(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Overwrite the columns of ``changes`` in the rows of ``table`` it names."""
    names = [c for c in changes.columns if c != key]
    marked = changes.select(key, F.struct(*names).alias("_new"))
    joined = table.join(marked, key, "left")
    return joined.select(
        *[
            F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c)
            for c in table.columns
        ]
    )
