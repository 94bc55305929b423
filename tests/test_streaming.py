"""Streaming forms give what the batch operators give."""

import json
import os

from annalist.operators import clustering as cl
from annalist.operators.pairs import RuleClassifier
from annalist.streaming import flows
from tests.test_linking import frame, sample

DOC = "doc_id long, company string, source_type string, title string, published_date string, raw_text string"


def drain(df, name, checkpoint, mode="append"):
    query = (
        df.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination(180)
    return df.sparkSession.table(name).collect()


def test_documents_become_evidence(spark, tmp_path):
    text = "Acme announces the Blue Box today for everyone.\n\nIt will launch the service in spring for everyone."
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps(dict(doc_id=1, company="Acme", source_type="press_release", title="t", published_date="2025-01-01", raw_text=text)))
    docs = flows.stream_documents(spark, str(tmp_path / "in"), DOC)
    rows = drain(flows.stream_evidence(docs), "evidence_out", str(tmp_path / "ck"))
    assert len(rows) == 2 and all(r.is_valid for r in rows)
    assert all(text[r.start_offset : r.end_offset] == r.matched_text for r in rows)


def test_versions_survive_batches_and_restarts(spark, tmp_path):
    schema = "company_id long, source_type string, external_id string, delivery long, title string, is_official boolean, raw_text string"
    folder = tmp_path / "in"
    folder.mkdir()
    docs = flows.stream_documents(spark, str(folder), schema)
    for n, body in enumerate(["one", "two", "two"]):
        row = dict(company_id=1, source_type="news", external_id="k", delivery=n, title=f"t{n}", is_official=False, raw_text=body)
        (folder / f"{n}.json").write_text(json.dumps(row))
        flows.upsert_stream(docs, str(tmp_path / "state"), str(tmp_path / "ck")).awaitTermination(120)
    last = flows.documents_of(spark, str(tmp_path / "state")).collect()
    assert [(r.external_id, r.version, r.title) for r in last] == [("k", 2, "t1")]
    # a new checkpoint goes on from the stored versions
    flows.upsert_stream(docs, str(tmp_path / "state"), str(tmp_path / "other")).awaitTermination(120)
    again = flows.documents_of(spark, str(tmp_path / "state")).collect()
    assert [r.external_id for r in again] == ["k"] and again[0].version > 2
    assert flows.first_links(docs).isStreaming


def test_a_batch_rewrites_the_buckets_of_its_documents_alone(spark, tmp_path):
    schema = "company_id long, source_type string, external_id string, delivery long, title string, is_official boolean, raw_text string"
    folder, state = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()
    docs = flows.stream_documents(spark, str(folder), schema)
    row = lambda k, n, body: dict(company_id=1, source_type="news", external_id=k, delivery=n, title=f"t{n}", is_official=False, raw_text=body)

    def deliver(name, rows, checkpoint="ck"):
        (folder / name).write_text("\n".join(json.dumps(r) for r in rows))
        flows.upsert_stream(docs, state, str(tmp_path / checkpoint), buckets=16).awaitTermination(120)

    def held():
        return {r.external_id: (r.version, r.raw_text) for r in flows.documents_of(spark, state).collect()}

    deliver("a.json", [row(f"k{i}", i, f"text {i}") for i in range(60)])
    before = flows.BucketTable(spark, state).copies(0)
    deliver("b.json", [row("k7", 100, "new")])
    after = flows.BucketTable(spark, state).copies(1)
    assert [b for b in after if after[b] != before[b]] == [b for b, v in after.items() if v == 1] and len(before) > 8
    assert sum(v == 1 for v in after.values()) == 1
    want = {f"k{i}": (1, f"text {i}") for i in range(60)} | {"k7": (2, "new")}
    assert held() == want and {r.external_id for r in flows.documents_of(spark, state, 0).collect()} == set(want)
    # a batch whose copies were written but whose pointer was not is written again; one with a pointer is left alone
    table = flows.BucketTable(spark, state)
    table.files.delete(table.paths(f"{state}/pointer/v=1"), True)
    for log in ("commits/1", "commits/.1.crc"):
        (tmp_path / "ck" / log).unlink(missing_ok=True)
    flows.upsert_stream(docs, state, str(tmp_path / "ck"), buckets=16).awaitTermination(120)
    assert held() == want
    (tmp_path / "ck" / "commits/1").unlink()
    (tmp_path / "ck" / "commits/.1.crc").unlink(missing_ok=True)
    flows.upsert_stream(docs, state, str(tmp_path / "ck"), buckets=16).awaitTermination(120)
    assert held() == want and table.newest() == 1
    deliver("c.json", [row("k7", 101, "new"), row("k8", 102, "x"), row("z", 103, "y")])
    deliver("d.json", [row("k8", 104, "x2")])
    assert held() == want | {"k8": (3, "x2"), "z": (1, "y")}
    kept = {(int(p.parent.name[2:]), int(p.name[7:])) for p in (tmp_path / "state" / "rows").glob("v=*/bucket=*")}
    named = {(v, b) for n in (2, 3) for b, v in table.copies(n).items()}
    assert kept == named


def test_links_are_forgotten_behind_the_watermark(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for n, day in enumerate(("2024-01-01", "2024-01-02", "2024-03-01", "2024-03-02")):
        (folder / f"{n}.json").write_text(json.dumps({"external_id": "k", "seen": f"{day} 00:00:00"}))
        os.utime(folder / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))  # files are read by age
    docs = spark.readStream.schema("external_id string, seen timestamp").option("maxFilesPerTrigger", 1).json(str(folder))
    rows = drain(flows.first_links(docs, "seen", "10 days"), "links_out", str(tmp_path / "ck"))
    days = sorted(str(r.seen)[:10] for r in rows)
    assert days[0] == "2024-01-01" and "2024-01-02" not in days


def test_clusters_in_date_order_equal_the_batch(spark, tmp_path):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    rows = [r for r in sample(8, 120, span=40, companies=2) if r["date"] and r["date"][0] == "2" and "13-" not in r["date"]]
    rows.sort(key=lambda r: (r["date"], r["id"]))
    folder = tmp_path / "in"
    for n in range(0, len(rows), 40):
        part = frame(spark, rows[n : n + 40])
        part.coalesce(1).write.mode("append").json(str(folder / f"b={n}"))
    schema = "event_id long, company_id long, event_date string, entity string, domain string, event_type string, is_official boolean"
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder / "*"))
    got = {r.event_id: (r.action, r.canonical_id) for r in drain(flows.stream_clusters(events, 7), "cluster_out", str(tmp_path / "ck"))}
    want = {r.event_id: (r.action, r.canonical_id) for r in cl.assign_events(frame(spark, rows), window_days=7, classifier=RuleClassifier()).collect()}
    assert got == want
