"""Rank evidence, and the threads and events behind it, against job tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from annalist.functions.vectors import cosine, hashed_vector
from annalist.operators.evidence import usable_text

KEEP_MATCHES = 3
#: Most bytes of task vectors and texts that are sent to every executor.
BROADCAST_BYTES = 32 << 20


def embed_missing(evidence: DataFrame, embed: Callable[[Column], Column] = hashed_vector) -> DataFrame:
    """Fill the embedding of valid evidence that has none; other rows pass unchanged.

    ``embed`` may wrap a pandas UDF; Arrow then sends it batches of rows.
    """
    wanted = F.col("is_valid") & F.col("embedding").isNull()
    text = usable_text(F.col("matched_text"), F.col("raw_quote"))
    return evidence.withColumn("embedding", F.coalesce("embedding", F.when(wanted, embed(text))))


def task_vectors(jobs: DataFrame, embed: Callable[[Column], Column] = hashed_vector) -> DataFrame:
    """One row per task of each job: job_id, company_id, task_no, task, vector."""
    rows = jobs.select("job_id", "company_id", F.posexplode("tasks").alias("task_no", "task"))
    return rows.withColumn("vector", embed(F.col("task")))


def score_evidence(evidence: DataFrame, tasks: DataFrame) -> DataFrame:
    """Best task per job and canonical event: score, task, text.

    ``evidence`` has company_id, canonical_id, span_id, text, embedding (rows without an
    embedding or a canonical event are skipped). The tasks of a job travel as one array
    and the best is taken on the evidence row, so no task x evidence pairs are formed;
    the reduction to canonical events is an aggregate combined before the shuffle.
    Ties go to the earlier span, then the earlier task.
    """
    ready = evidence.where(F.col("embedding").isNotNull() & F.col("canonical_id").isNotNull())
    jobs = tasks.groupBy("job_id", "company_id").agg(
        F.array_sort(F.collect_list(F.struct("task_no", "task", "vector"))).alias("_tasks")
    )
    vectors = F.aggregate("_tasks", F.lit(0).cast("long"), lambda n, t: n + 8 * F.size(t["vector"]) + F.octet_length(t["task"]))
    # beyond the bound a plain join, whose hot companies Spark splits: the aggregate has other keys
    held = jobs.agg(F.sum(vectors)).first()[0] or 0
    joined = ready.join(F.broadcast(jobs) if held <= BROADCAST_BYTES else jobs, "company_id")
    best = F.array_max(
        F.transform(
            "_tasks",
            lambda t: F.struct(
                cosine(F.col("embedding"), t["vector"]).alias("score"),
                (-F.col("span_id")).alias("span"),
                (-t["task_no"]).alias("turn"),
                t["task"].alias("task"),
                F.col("text").alias("text"),
            ),
        )
    )
    top = joined.groupBy("job_id", "canonical_id").agg(F.max(best).alias("_b"))
    return top.select("job_id", "canonical_id", "_b.score", "_b.task", F.col("_b.text").alias("evidence_text"))


def rank_candidates(
    best: DataFrame, thread_events: DataFrame, titles: DataFrame, thread_titles: DataFrame, top_n: int = 3
) -> DataFrame:
    """The ``top_n`` threads and lone events of each job: kind, id, title, score, matches.

    A thread scores as its best event and shows its three best; an event in several
    threads counts in each. Ties put threads first, then lower ids.
    """
    named = best.join(titles.select("canonical_id", F.col("title").alias("event_title")), "canonical_id")
    linked = named.join(thread_events.select("canonical_id", "thread_id").distinct(), "canonical_id")
    match = F.struct("task", "evidence_text", "canonical_id", "event_title", "score")
    order = W.partitionBy("job_id", "thread_id").orderBy(F.desc("score"), "canonical_id")
    kept = linked.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= KEEP_MATCHES)
    threads = (
        kept.groupBy("job_id", "thread_id")
        .agg(
            F.max("score").alias("score"),
            F.transform(F.array_sort(F.collect_list(F.struct("_n", match.alias("m")))), lambda x: x["m"]).alias("matches"),
        )
        .join(thread_titles.select("thread_id", "title"), "thread_id")
        .select("job_id", F.lit("thread").alias("kind"), F.col("thread_id").alias("id"), "title", "score", "matches")
    )
    lone = named.join(thread_events.select("canonical_id").distinct(), "canonical_id", "left_anti").select(
        "job_id",
        F.lit("event").alias("kind"),
        F.col("canonical_id").alias("id"),
        F.col("event_title").alias("title"),
        "score",
        F.array(match).alias("matches"),
    )
    first = W.partitionBy("job_id").orderBy(F.desc("score"), F.desc("kind"), "id")
    ranked = threads.unionByName(lone).withColumn("rank", F.row_number().over(first))
    return ranked.where(F.col("rank") <= top_n)


def related_scores(ranked: DataFrame) -> DataFrame:
    """Best score per canonical event over the matches of all ranked candidates."""
    rows = ranked.select("job_id", F.explode("matches").alias("m"))
    return rows.groupBy("job_id", F.col("m.canonical_id").alias("canonical_id")).agg(F.max("m.score").alias("score"))


def check_ready(evidence: DataFrame, tasks: DataFrame) -> None:
    """Raise if there is nothing to rank."""
    if tasks.isEmpty():
        raise ValueError("the job description has no tasks to match")
    if evidence.where(F.col("embedding").isNotNull()).isEmpty():
        raise ValueError("no embedded evidence; run embed_missing first")
