"""The given test tables in the shapes the operators expect.

Every rule is written once for Spark and once as SQL; both keep all rows and whole
texts and only derive columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from annalist.session import cut, spread

SOURCE_TYPES = ["dart", "ir", "press_release", "tech_blog", "ceo_letter", "news"]


KEY = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id", "events": "event_id"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows, KEY[name]) if name in KEY else rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(s) for s in SOURCE_TYPES])
    kind = F.element_at(kinds, (F.col("doc_id") % len(SOURCE_TYPES) + 1).cast("int"))
    return read(spark, sf_dir, "documents").select(
        "doc_id",
        F.substring("source", 4, 10).cast("long").alias("company_id"),
        kind.alias("source_type"),
        (kind != "news").alias("is_official"),
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 10).cast("int")).cast("string").alias("published_date"),
        F.col("doc_id").cast("string").alias("external_id"),
        F.col("text").alias("raw_text"),
    )


DOCUMENTS_SQL = """docs AS (
  SELECT doc_id, CAST(substr(source, 4) AS BIGINT) AS company_id,
    (['dart','ir','press_release','tech_blog','ceo_letter','news'])[doc_id % 6 + 1] AS source_type,
    doc_id % 6 <> 5 AS is_official, 'doc ' || doc_id AS title,
    strftime(DATE '2024-01-01' + CAST(doc_id % 10 AS INTEGER), '%Y-%m-%d') AS published_date,
    CAST(doc_id AS VARCHAR) AS external_id, text AS raw_text
  FROM documents)"""


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("company_id").distinct()
    return rows.withColumn("name", F.concat(F.lit("company "), F.col("company_id").cast("string")))


COMPANIES_SQL = "comps AS (SELECT DISTINCT company_id, 'company ' || company_id AS name FROM docs)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted events; doc_id spreads them over all documents."""
    n_docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    key = F.col("event_id")
    entity = F.regexp_extract("props", r'"k":\s*(\d+)', 1)
    return read(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("company_id"),
        "event_type",
        F.col("event_type").alias("action"),
        F.lit(None).cast("string").alias("subject"),
        F.when(key % 11 != 0, entity).alias("entity"),
        F.when(key % 13 != 0, F.concat(F.lit("d"), (key % 7).cast("string"))).alias("domain"),
        F.when(key % 17 != 0, F.date_format("ts", "yyyy-MM-dd")).alias("event_date"),
        F.when(key % 17 != 0, "day").otherwise("unknown").alias("date_precision"),
        F.when(F.col("event_type") == "purchase", "completed").otherwise("planned").alias("lifecycle_status"),
        (key % 4 != 0).alias("is_official"),
        (key % n_docs).alias("doc_id"),
        F.concat_ws(" ", F.col("event_type"), F.lit("of"), F.col("props")).alias("raw_quote"),
    )


EVENTS_SQL = """ev AS (
  SELECT event_id, user_id AS company_id, event_type, event_type AS action, CAST(NULL AS VARCHAR) AS subject,
    CASE WHEN event_id % 11 <> 0 THEN regexp_extract(props, '"k":\\s*(\\d+)', 1) END AS entity,
    CASE WHEN event_id % 13 <> 0 THEN 'd' || (event_id % 7) END AS domain,
    CASE WHEN event_id % 17 <> 0 THEN strftime(ts, '%Y-%m-%d') END AS event_date,
    CASE WHEN event_id % 17 <> 0 THEN 'day' ELSE 'unknown' END AS date_precision,
    CASE WHEN event_type = 'purchase' THEN 'completed' ELSE 'planned' END AS lifecycle_status,
    event_id % 4 <> 0 AS is_official, event_id % (SELECT count(*) FROM documents) AS doc_id,
    event_type || ' of ' || props AS raw_quote
  FROM events)"""


def review_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the review state its label gives it."""
    labels = read(spark, sf_dir, "labels")
    return documents(spark, sf_dir).join(labels, "doc_id", "left").withColumn(
        "review_status",
        F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "approved").otherwise("pending"),
    )


STATES_SQL = """states AS (
  SELECT d.*, CASE WHEN l.toxic = 1 THEN 'rejected' WHEN l.quality = 1 THEN 'approved' ELSE 'pending' END AS review_status
  FROM docs d LEFT JOIN labels l USING (doc_id))"""


_STAGES: dict[tuple, DataFrame] = {}


def stage(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A stage table of a full run: written once per session, then read by the reports on it."""
    slot = (spark.sparkContext.applicationId, sf_dir, name)
    if slot not in _STAGES:
        _STAGES[slot] = cut(build())
    return _STAGES[slot]
