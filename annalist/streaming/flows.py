"""Streaming forms: new documents to evidence, versioned state, and incremental clusters."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from annalist.functions.dates import FAR_DAYS
from annalist.operators.chunking import chunk_documents
from annalist.operators.clustering import _best_match, _nearest, _Shelf, records
from annalist.operators.evidence import locate_quotes
from annalist.operators.extraction import keyword_events
from annalist.operators.pairs import AUTO_SAME_EVENT, EVENT_WINDOW, FACTS, MAX_CANDIDATES, RuleClassifier, keyed
from annalist.operators.upserts import DOC_KEY, upsert_documents


def stream_documents(spark: SparkSession, folder: str, schema: str, fmt: str = "json") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(folder)


def stream_evidence(documents: DataFrame, **extraction) -> DataFrame:
    """Chunk, extract and verify documents as they arrive; stateless, so it appends.

    ``documents`` holds doc_id, company, source_type, title, published_date, raw_text.
    """
    chunks = chunk_documents(documents, keep=["doc_id", "company", "published_date"])
    keep = ["doc_id", "chunk_index", "text", "start_offset"]
    events = keyword_events(chunks, keep=keep, **extraction).withColumnRenamed("start_offset", "_base")
    return locate_quotes(events, "raw_quote", "text", "_base").drop("_base", "text")


def first_links(documents: DataFrame, time: str | None = None, delay: str = "30 days") -> DataFrame:
    """Each external id once.

    With a ``time`` column an id is forgotten ``delay`` after it was seen, so the state is
    bounded; without one the stream's state holds every id.
    """
    if time is None:
        return documents.dropDuplicates(["external_id"])
    return documents.withWatermark(time, delay).dropDuplicatesWithinWatermark(["external_id"])


#: Buckets of a versioned table; a batch rewrites only those that its keys fall into.
BUCKETS = 256


class BucketTable:
    """A table in folders by key bucket: copies on write, and one small file that says which copy of each bucket holds.

    ``rows/v=N/bucket=B`` is the copy of bucket B that batch N wrote, ``pointer/v=N`` names the valid
    copy of every bucket after batch N. The pointer is renamed into place after the copies are
    there, so a reader sees all of a batch or nothing of it, and a batch whose pointer exists is done.
    """

    def __init__(self, spark: SparkSession, state: str):
        self.spark, self.state = spark, state
        self.paths = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.paths(state).getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointer(self, version: int) -> str:
        return f"{self.state}/pointer/v={version}"

    def has(self, version: int) -> bool:
        return self.files.exists(self.paths(self._pointer(version)))

    def newest(self) -> int:
        """The last version, -1 if there is none."""
        root = self.paths(f"{self.state}/pointer")
        names = [f.getPath().getName() for f in self.files.listStatus(root)] if self.files.exists(root) else []
        return max((int(n.removeprefix("v=")) for n in names if n.startswith("v=")), default=-1)

    def copies(self, version: int) -> dict[int, int]:
        """Bucket -> the batch that wrote its valid copy; at most as many entries as buckets."""
        if version < 0:
            return {}
        return {int(b): int(v) for b, v in (r[0].split(" ") for r in self.spark.read.text(self._pointer(version)).collect())}

    def read(self, version: int, buckets: set[int] | None = None) -> DataFrame | None:
        """Rows of all or some buckets as of a version; None if it holds none of them."""
        paths = [f"{self.state}/rows/v={v}/bucket={b}" for b, v in sorted(self.copies(version).items()) if buckets is None or b in buckets]
        return self.spark.read.option("mergeSchema", "true").parquet(*paths) if paths else None

    def write(self, version: int, rows: DataFrame | None, buckets: set[int]) -> None:
        """Copies of some buckets, then the pointer to them and to the others' older ones."""
        if rows is not None:
            rows.write.partitionBy("bucket").mode("overwrite").parquet(f"{self.state}/rows/v={version}")
        now = self.copies(version - 1) | {b: version for b in buckets}
        temporary = f"{self.state}/pointer/_{uuid.uuid4().hex}"
        self.spark.createDataFrame([(f"{b} {v}",) for b, v in sorted(now.items())], "value string").coalesce(1).write.text(temporary)
        if not self.files.rename(self.paths(temporary), self.paths(self._pointer(version))):
            raise RuntimeError(f"{self._pointer(version)} is there already")

    def forget(self, version: int) -> None:
        """Remove copies that ``version`` - 1 still named and ``version`` does not: readers of the last two versions are safe."""
        now = self.copies(version)
        for b, v in self.copies(version - 1).items():
            if now.get(b) != v:
                self.files.delete(self.paths(f"{self.state}/rows/v={v}/bucket={b}"), True)


def _first_version(table: BucketTable, checkpoint: str) -> int:
    """The version that batch 0 of this checkpoint writes: after those that the table held when it began.

    The number is kept beside the checkpoint, so a restart counts on from the same one.
    """
    note = table.paths(f"{checkpoint}/first_version")
    if note.getFileSystem(table.spark._jsc.hadoopConfiguration()).exists(note):
        return int(table.spark.read.text(note.toString()).first()[0])
    first = table.newest() + 1
    table.spark.createDataFrame([(str(first),)], "value string").coalesce(1).write.text(note.toString())
    return first


def bucket_of(*key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def upsert_stream(incoming: DataFrame, state: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep a versioned document table under ``state``; see ``documents_of`` for reading it.

    A batch reads and writes the buckets of its own documents only. A batch that is run again
    changes nothing; a new checkpoint goes on from the last version that is there. The number
    of buckets belongs to the table and must stay the same.
    """
    first = _first_version(BucketTable(incoming.sparkSession, state), checkpoint)

    def merge(batch: DataFrame, number: int) -> None:
        table, version = BucketTable(batch.sparkSession, state), first + number
        if table.has(version):
            return
        bucket = bucket_of(*DOC_KEY, buckets=buckets)
        touched = {r[0] for r in batch.select(bucket.alias("b")).distinct().collect()}  # at most ``buckets``
        rows = upsert_documents(batch, table.read(version - 1, touched)).withColumn("bucket", bucket) if touched else None
        table.write(version, rows, touched)
        if version > 1:
            table.forget(version - 1)

    return (
        incoming.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def documents_of(spark: SparkSession, state: str, version: int | None = None) -> DataFrame | None:
    """The document table that ``upsert_stream`` keeps, as of its last or the given version; None before the first."""
    table = BucketTable(spark, state)
    return table.read(table.newest() if version is None else version)


SEED = "id long, d long, entity_key string, domain_key string, event_type string, entity string, domain string"
OUT = "event_id long, company_id long, action string, canonical_id long"


_INNER = {"id": "_id", "d": "_d", "entity_key": "_entity", "domain_key": "_domain"}


class SeedClusters(StatefulProcessor):
    """Greedy clusters of one company; the state is its live seeds.

    Rows of a batch are taken in (date, id) order. Seeds older than the window behind
    the newest date can no longer be joined and are dropped; rows that are older still
    come out as ``late``. Undated seeds stay.
    """

    def __init__(self, window: int, k: int, rule: RuleClassifier):
        self.window, self.k, self.rule = window, k, rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seeds = handle.getListState("seeds", SEED)
        self.newest = handle.getValueState("newest", "d long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # plain names outside: the stateful API renames columns with a leading underscore
        batch = [{_INNER.get(c, c): v for c, v in r.items()} for pdf in rows for r in records(pdf)]
        batch.sort(key=lambda r: (r["_d"], r["_id"]))
        live = [
            {"_id": s[0], "_d": s[1], "_entity": s[2], "_domain": s[3], "event_type": s[4], "entity": s[5], "domain": s[6]}
            for s in (self.seeds.get() if self.seeds.exists() else [])
        ]
        newest = self.newest.get()[0] if self.newest.exists() else -FAR_DAYS
        shelf = (_Shelf(self.k), _Shelf(self.k))
        for s in live:
            shelf[0].add(s["_entity"], s["_d"], s)
            shelf[1].add(s["_domain"], s["_d"], s)
        out = []
        for r in batch:
            if r["_d"] < newest - self.window:
                out.append((r["_id"], key[0], "late", None))
                continue
            if r["_d"] < FAR_DAYS:
                newest = max(newest, r["_d"])
            best, score, _ = _best_match(self.rule, r, _nearest([shelf], r, self.window, self.k))
            if best is not None and score >= AUTO_SAME_EVENT:
                out.append((r["_id"], key[0], "merged", best))
            elif r["is_official"]:
                shelf[0].add(r["_entity"], r["_d"], r)
                shelf[1].add(r["_domain"], r["_d"], r)
                live.append(r)
                out.append((r["_id"], key[0], "new", r["_id"]))
            else:
                out.append((r["_id"], key[0], "deferred", None))
        kept = [s for s in live if s["_d"] >= newest - self.window]
        self.newest.update((newest,))
        names = ("_id", "_d", "_entity", "_domain", *FACTS)
        if kept:
            self.seeds.put([tuple(s[n] for n in names) for s in kept])
        else:
            self.seeds.clear()
        yield pd.DataFrame(out, columns=["event_id", "company_id", "action", "canonical_id"]).astype({"canonical_id": "Int64"})

    def close(self) -> None:
        pass


def stream_clusters(
    events: DataFrame, window_days: int = EVENT_WINDOW, k: int = MAX_CANDIDATES, classifier: RuleClassifier | None = None
) -> DataFrame:
    """Incremental form of ``assign_events`` for events that arrive roughly in date order."""
    rows = keyed(events).select(
        F.col("_company").cast("long").alias("company"),
        F.col("_id").cast("long").alias("id"),
        F.col("_d").cast("long").alias("d"),
        F.col("_entity").alias("entity_key"),
        F.col("_domain").alias("domain_key"),
        *FACTS,
        "is_official",
    )
    return rows.groupBy("company").transformWithStateInPandas(
        SeedClusters(window_days, k, classifier or RuleClassifier()), OUT, "Append", "None"
    )
