"""Ingestion state, files, extraction, ranking, review and reports."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from annalist import schemas
from annalist.functions import dates, vectors
from annalist.operators import extraction as ex, lookups as lk, ranking as rk, review as rv, upserts as up
from annalist.operators.pairs import RuleClassifier
from annalist.plans import reports as rp
from annalist.plans.run import run
from annalist.sources import files

DELIVERY = "company_id long, source_type string, external_id string, delivery long, title string, is_official boolean, raw_text string"


def deliveries(spark, rows):
    return spark.createDataFrame([(1, "news", k, n, f"t{n}", n % 2 == 0, text) for n, k, text in rows], DELIVERY)


def test_versions_in_stretches_equal_one_pass(spark):
    texts = ["a", "a", "b", "b", "a", "c", "c", "c", "d", "a"]
    df = deliveries(spark, [(n, "k", t) for n, t in enumerate(texts)] + [(50, "other", "x")])
    for bucket in (1, 3, 100):
        got = {(r.external_id, r.delivery): (r.version, r.changed) for r in up.document_versions(df, bucket=bucket).collect()}
        version = 0
        for n, t in enumerate(texts):
            changed = n == 0 or t != texts[n - 1]
            version += changed
            assert got[("k", n)] == (version, changed)
        assert got[("other", 50)] == (1, True)


def test_upsert_is_idempotent_and_keeps_fields_of_unchanged_rows(spark):
    first = deliveries(spark, [(1, "a", "one"), (2, "b", "two")])
    state = up.upsert_documents(first)
    again = deliveries(spark, [(3, "a", "one"), (4, "b", "new"), (5, "c", "three")])
    seen = up.document_versions(again, state)
    assert up.ingest_tally(seen).first().asDict() == {"ingested": 2, "unchanged": 1, "failed": 0}
    new = {r.external_id: r for r in up.upsert_documents(again, state).collect()}
    assert (new["a"].version, new["a"].title) == (1, "t1")
    assert (new["b"].version, new["b"].title, new["b"].is_official) == (2, "t4", True)
    assert new["c"].version == 1
    assert sorted((r.external_id, r.version) for r in up.document_snapshots(again, seen).collect()) == [("b", 2), ("c", 1)]
    log = up.ingestion_log(seen, spark.createDataFrame([(1, "x", "bad")], "company_id long, detail string, error string"), "dart")
    assert sorted((r.status, r.detail) for r in log.collect()) == [
        ("failed", "x"), ("success", "a (changed=False)"), ("success", "b (changed=True)"), ("success", "c (changed=True)")
    ]
    paths = up.ingestion_log(seen.withColumn("file_path", F.concat(F.lit("/in/"), "external_id")), None, "manual")
    assert {r.detail for r in paths.collect()} == {"/in/a (changed=False)", "/in/b (changed=True)", "/in/c (changed=True)"}
    asked = spark.createDataFrame([(1, "q"), (1, "q"), (2, "r")], "company_id long, query string")
    assert sorted((r.source, r.company_id, r.status, r.detail) for r in up.query_log(asked, None).collect()) == [("news", 1, "success", "q"), ("news", 2, "success", "r")]


def test_archive_members_are_read_in_their_declared_encoding():
    korean = "카카오 사업 보고서"
    for name, head in (("euc-kr", '<?xml version="1.0" encoding="EUC-KR"?>'), ("utf-8", ""), ("cp949", '<html><meta charset="ks_c_5601-1987">'), ("utf-16", "")):
        assert files.decoded((head + korean).encode(name)) == head + korean
    with pytest.raises(UnicodeDecodeError):
        files.decoded(korean.encode("cp949"))
    with pytest.raises(LookupError):
        files.decoded(b'<?xml encoding="no-such"?>')


def test_dense_ids_continue_after_the_largest(spark):
    old = spark.createDataFrame([("a", 4)], "name string, company_id long")
    new = up.get_or_create(old, spark.createDataFrame([("a",), ("b",), ("c",), ("b",)], "name string"))
    got = {r.name: r.company_id for r in new.collect()}
    assert got["a"] == 4 and sorted(got.values()) == [4, 5, 6]


def test_pair_and_evidence_upserts(spark):
    schema = "a_id long, b_id long, relationship_type string, decided_by string, n long"
    old = spark.createDataFrame([(1, 2, "unrelated", "human"), (3, 4, "unrelated", "llm")], schema.rsplit(",", 1)[0])
    new = spark.createDataFrame([(2, 1, "same_event", "llm", 1), (4, 3, "same_event", "llm", 1), (3, 4, "related_distinct", "llm", 2)], schema)
    kept = {(r.a_id, r.b_id): r.relationship_type for r in up.upsert_relationships(old, new, "n").collect()}
    assert kept == {(1, 2): "unrelated", (3, 4): "related_distinct"}
    forced = {(r.a_id, r.b_id): r.relationship_type for r in up.upsert_relationships(old, new, "n", overwrite_human=True).collect()}
    assert forced[(1, 2)] == "same_event"
    spans = spark.createDataFrame([(1, "x", [0.5]), (2, "y", None)], "event_id long, matched_text string, embedding array<double>")
    fresh = spark.createDataFrame([(1, "z", None, 1), (3, "w", None, 1)], "event_id long, matched_text string, embedding array<double>, delivery long")
    got = {r.event_id: (r.matched_text, r.embedding) for r in up.upsert_evidence(spans, fresh).collect()}
    assert got == {1: ("z", [0.5]), 2: ("y", None), 3: ("w", None)}


def test_front_matter(spark, tmp_path):
    good = tmp_path / "acme" / "press_release"
    good.mkdir(parents=True)
    (good / "one.md").write_text("---\ntitle: 'Acme: opens'\nsource_type: press_release\npublished_date: 2025-06-10\n---\n\nBody text.\n\nMore.\n", encoding="utf-8")
    (good / "two.md").write_text("---\ntitle: T\n---\nBody", encoding="utf-8")
    (good / "three.md").write_text("---\ntitle: T\nsource_type: news\n---\n  \n", encoding="utf-8")
    rows, failed = files.read_front_matter(spark, str(tmp_path), 1)
    r = rows.first()
    assert (r.title, r.published_date, r.external_id, r.is_official, r.raw_text) == ("Acme: opens", "2025-06-10", "manual:one", True, "Body text.\n\nMore.")
    errors = sorted(x.error.split(": ", 1)[1] for x in failed.collect())
    assert any("source_type" in e for e in errors) and any("empty" in e for e in errors) and len(errors) == 2
    none, bad = files.read_front_matter(spark, str(tmp_path / "absent"), 1)
    assert none.isEmpty() and bad.isEmpty()


def test_disclosures(spark, tmp_path):
    (tmp_path / "codes.xml").write_text(
        "<result><list><corp_code> 001 </corp_code><corp_name> Acme </corp_name></list><list><corp_code>002</corp_code><corp_name>Acme</corp_name></list>"
        "<list><corp_code>003</corp_code><corp_name/></list></result>", encoding="utf-8")
    codes = files.read_company_codes(spark, str(tmp_path / "codes.xml"))
    assert [(r.name, r.code) for r in codes.collect()] == [("Acme", "002")]
    known, unknown = files.resolve_codes(spark.createDataFrame([("Acme",), ("Nix",)], "name string"), codes)
    assert known.count() == 1 and "Nix" in unknown.first().error

    filing = lambda n, t: {"rcept_no": n, "report_nm": t, "rcept_dt": "20250601", "corp_name": "Acme"}
    for cat, body in {
        "A": {"status": "000", "list": [filing("1", "old"), filing("2", "two")]},
        "B": {"status": "000", "list": [filing("1", "new")]},
        "D": {"status": "000", "list": [filing("9", "ownership")]},
    }.items():
        folder = tmp_path / "lists" / f"category={cat}"
        folder.mkdir(parents=True)
        (folder / "1.json").write_text(json.dumps(body))
    (tmp_path / "lists" / "category=B" / "2.json").write_text(json.dumps({"status": "013", "message": "none"}))
    (tmp_path / "lists" / "category=B" / "3.json").write_text(json.dumps({"status": "020", "message": "limit"}))
    filings, failed = files.read_listings(spark, str(tmp_path / "lists"))
    assert sorted((r.rcept_no, r.title, r.published_date) for r in filings.collect()) == [("1", "new", "2025-06-01"), ("2", "two", "2025-06-01")]
    assert [r.error for r in failed.collect()] == ["listing error 020: limit"]

    folder = tmp_path / "zips"
    folder.mkdir()
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a.html", "<h1>1. Overview</h1><p>Acme grew.</p>")
        z.writestr("b.xml", "<doc><p>Second</p></doc>")
    (folder / "1.zip").write_bytes(buffer.getvalue())
    (folder / "2.zip").write_bytes(b"no archive")
    bodies, broken = files.read_archives(spark, str(folder))
    assert [(r.rcept_no, r.raw_text) for r in bodies.collect()] == [("1", "1. Overview\nAcme grew.\n\nSecond")]
    assert [r.detail for r in broken.collect()] == ["2"]
    docs, lost = files.filing_documents(filings, bodies, 1)
    assert docs.count() == 1 and [r.detail for r in lost.collect()] == ["2"]


def test_news(spark, tmp_path):
    item = lambda link, d, title="<b>A</b> news": {"title": title, "link": link, "description": d, "pubDate": "Mon, 01 Jun 2025 09:00:00 +0900"}
    answers = [
        {"query": "q2", "items": [item("l1", "late"), item("l2", "<i>two</i>")]},
        {"query": "q1", "items": [item("l1", "first"), item("l3", "")]},
        {"query": "q3", "error": "returned 500"},
    ]
    (tmp_path / "n.json").write_text("\n".join(json.dumps(a) for a in answers))
    rows, failed = files.read_news(spark, str(tmp_path / "n.json"), 1)
    got = {r.external_id: r for r in rows.collect()}
    assert set(got) == {"l1", "l2"} and got["l1"].raw_text == "first" and got["l2"].raw_text == "two"
    assert got["l1"].title == "A news" and got["l1"].published_date == "2025-06-01" and not got["l1"].is_official
    assert [r.detail for r in failed.collect()] == ["q3"]


def test_dates_and_labels(spark):
    rows = [(None, None), ("", "day"), ("2020-01-01", "year"), ("2025-04-01", "quarter"), ("2025-07-01", "month"), ("2025-07-15", "day"), ("2025-07-15", "unknown"), ("2025-07", "day"), ("2025-xx-01", "day")]
    df = spark.createDataFrame(rows, "d string, p string")
    got = [r.x for r in df.select(dates.date_label(F.col("d"), F.col("p")).alias("x")).collect()]
    assert got == ["날짜 미상", "날짜 미상", "2020년", "2025년 2분기", "2025년 7월", "2025년 7월 15일", "2025년 7월 15일", "2025-07", "2025-xx-01"]
    values = ["2025-06", "20250601", "2025-02-30", "2025-06-01T10:00", None]
    days = [r.x for r in spark.createDataFrame([(v,) for v in values], "d string").select(dates.iso_date(F.col("d")).cast("string").alias("x")).collect()]
    assert days == [None, None, None, "2025-06-01", None]
    mails = [r.x for r in spark.createDataFrame([("Mon, 1 Jun 2025 23:59:00 -0800",), ("nonsense",), ("",)], "d string").select(dates.mail_date(F.col("d")).alias("x")).collect()]
    assert mails == ["2025-06-01", None, None]
    r = df.select(dates.word_for(F.lit("launch"), dates.STAGE_WORDS, "-").alias("a"), dates.word_for(F.lit("zz"), dates.STAGE_WORDS, "-").alias("b"), dates.word_for(F.lit("zz"), dates.MATCH_METHOD_WORDS).alias("c")).first()
    assert (r.a, r.b, r.c) == ("출시", "-", "zz")


def test_extraction(spark):
    text = 'We plan to launch "Blue Box" soon. Nothing here! The Acme Cloud Suite X will expand.\nRelease notes: "a" Widget ships'
    df = spark.createDataFrame([(1, text, "Acme", "2025-01-01"), (2, "invest", "Acme", None)], "chunk_id int, text string, company string, published_date string")
    got = ex.keyword_events(df, keep=["chunk_id"], excluded=["Acme"]).orderBy("chunk_id", "sentence_no").collect()
    assert [(r.event_type, r.action, r.entity) for r in got] == [
        ("strategy_announcement", "announce", "Blue Box"),
        ("expansion", "scale", "The Acme Cloud"),
        ("product_launch", "launch", "Release"),
        ("product_development", "build", None),
    ]
    assert [r.lifecycle_status for r in got] == ["planned", "planned", "completed", "planned"]
    assert (got[3].date_precision, got[0].date_precision) == ("unknown", "day")
    rows = up.event_rows(ex.keyword_events(df, keep=["chunk_id"]), "rule", "v1").first()
    assert json.loads(rows.raw_response_json)["domain"] is None


def test_jobs_and_titles(spark):
    df = spark.createDataFrame([("Run servers. Ok. Build search features!",)], "raw_text string")
    assert ex.parse_jobs(df).first().tasks == ["Run servers.", "Build search features!"]
    parser = lambda c: F.struct(*[F.lit(None).cast("string").alias(n) for n in ("role", "role_subtype", "domain")], F.array(F.lit("x"), F.lit(" ")).alias("tasks"), F.array(F.lit(" Go"), F.lit("Rust")).alias("entities"), F.array(F.lit("go "), F.lit("SQL")).alias("skills"))
    r = ex.parse_jobs(df, parser=parser).first()
    assert (r.tasks, r.entities) == (["x"], ["Go", "Rust", "SQL"])
    titles = ["제품 확장", "Product: launch", "제품: launched", "제품 Expansion", "Acme 클라우드 출시하였습니다"]
    got = [r.n for r in spark.createDataFrame([(t,) for t in titles], "title string").select(ex.needs_rewriting(F.col("title")).alias("n")).collect()]
    assert got == [False, True, True, True, False]
    table = spark.createDataFrame([("X launch", "X", "d", "e", "launch")], "title string, entity string, domain string, event_type string, action string")
    once = ex.rewrite_titles(table, F.lit("새 제목"))
    assert once.first().title == "새 제목" and ex.rewrite_titles(table).first().title == "X: launch"
    assert not ex.rewrite_titles(once.drop("rewritten"), F.lit("새 제목")).first().rewritten


def test_vectors_and_ranking(spark):
    r = spark.createDataFrame([("Cloud cloud search", "")], "a string, b string").select(vectors.hashed_vector(F.col("a")).alias("a"), vectors.hashed_vector(F.col("b")).alias("b")).first()
    assert abs(sum(x * x for x in r.a) - 1) < 1e-9 and r.b == [0.0] * 32
    c = spark.createDataFrame([([1.0, 0.0, 5.0], [2.0, 0.0]), ([0.0], [1.0])], "a array<double>, b array<double>").select(vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert abs(c[0].c - 1 / 26**0.5) < 1e-9 and c[1].c == 0.0
    evidence = spark.createDataFrame(
        [(1, 10, 1, "a", [1.0, 0.0]), (1, 11, 2, "b", [0.6, 0.8]), (1, 12, 3, "c", [0.0, 1.0]), (1, 13, None, "d", [1.0, 1.0]), (1, 14, 1, "e", [0.9, 0.1])],
        "company_id long, span_id long, canonical_id long, text string, embedding array<double>")
    tasks = spark.createDataFrame([(1, 1, 0, "t0", [1.0, 0.0]), (1, 1, 1, "t1", [0.0, 1.0])], "job_id long, company_id long, task_no int, task string, vector array<double>")
    best = rk.score_evidence(evidence, tasks)
    assert {r.canonical_id: (r.task, r.evidence_text, round(r.score, 3)) for r in best.collect()} == {1: ("t0", "a", 1.0), 2: ("t1", "b", 0.8), 3: ("t1", "c", 1.0)}
    rows = spark.createDataFrame([(2, 7), (3, 7)], "canonical_id long, thread_id long")
    titles = spark.createDataFrame([(1, "e1"), (2, "e2"), (3, "e3")], "canonical_id long, title string")
    names = spark.createDataFrame([(7, "th")], "thread_id long, title string")
    ranked = rk.rank_candidates(best, rows, titles, names, 2).orderBy("rank").collect()
    assert [(r.kind, r.id) for r in ranked] == [("thread", 7), ("event", 1)]
    assert [m.canonical_id for m in ranked[0].matches] == [3, 2]
    spans = spark.createDataFrame([(1, True, "cloud", "q", None), (2, True, "", "quote", [9.0]), (3, False, "x", "q", None)], "id int, is_valid boolean, matched_text string, raw_quote string, embedding array<double>")
    done = {r.id: r.embedding for r in rk.embed_missing(spans).collect()}
    assert len(done[1]) == 32 and done[2] == [9.0] and done[3] is None
    with pytest.raises(ValueError):
        rk.check_ready(evidence, tasks.where("false"))
    with pytest.raises(ValueError):
        rk.check_ready(evidence.where("false"), tasks)


DEC = "record_id long, decision string, actor string, decision_no long"


def test_evidence_decisions(spark):
    spans = spark.createDataFrame([(1, "m", 0, 5, False, "pending"), (2, "n", 1, 2, True, "auto_valid"), (3, "o", 1, 2, True, "auto_valid")], "event_id long, matched_text string, start_offset long, end_offset long, is_valid boolean, review_status string")
    dec = spark.createDataFrame([(1, "approve", "kim", 1, "better"), (2, "reject", "kim", 2, None), (9, "reject", "kim", 3, None)], DEC + ", matched_text string")
    state, changes = rv.decide_evidence(spans, dec)
    got = {r.event_id: (r.matched_text, r.is_valid, r.review_status) for r in state.collect()}
    assert got == {1: ("better", True, "approved"), 2: ("n", False, "rejected"), 3: ("o", True, "auto_valid")}
    log = up.audit_rows(changes, "2025-01-01")
    assert sorted((r.record_id, r.action, r.actor, json.loads(r.before_json)["review_status"]) for r in log.collect()) == [(1, "approve", "human:kim", "pending"), (2, "reject", "human:kim", "auto_valid")]
    assert up.audit_history(log, "evidence_spans", 1).count() == 1 and up.audit_history(log, "threads").isEmpty()
    assert [r.record_id for r in rv.unknown_records(dec, spans, "event_id").collect()] == [9]


def test_each_evidence_decision_is_audited(spark):
    spans = spark.createDataFrame([(1, "m", 0, 5, False, "pending")], "event_id long, matched_text string, start_offset long, end_offset long, is_valid boolean, review_status string")
    dec = spark.createDataFrame([(1, "approve", "kim", 1, "better"), (1, "reject", "lee", 2, None), (1, "approve", "kim", 3, None)], DEC + ", matched_text string")
    state, changes = rv.decide_evidence(spans, dec)
    assert [(r.matched_text, r.is_valid, r.review_status) for r in state.collect()] == [("better", True, "approved")]
    got = [(r.actor, r.before.review_status, r.before.matched_text, r.before.is_valid, r.after.review_status, r.after.matched_text, r.after.is_valid) for r in changes.collect()]
    assert sorted(got) == sorted([
        ("human:kim", "pending", "m", False, "approved", "better", True),
        ("human:lee", "approved", "better", True, "rejected", "better", False),
        ("human:kim", "rejected", "better", False, "approved", "better", True),
    ])


REL = "relationship_id long, a_id long, b_id long, relationship_type string, review_status string"


def test_repeated_pair_decisions_do_not_multiply(spark):
    rels = spark.createDataFrame([(1, 10, 11, "same_event", "pending"), (2, 12, 13, "related_distinct", "pending")], REL)
    dec = spark.createDataFrame([(k, d, "k", 10 * k + n) for k in (1, 2) for n, d in enumerate(("approve", "reject", "approve"))], DEC)
    members = spark.createDataFrame([], "canonical_id long, event_id long, is_seed boolean")
    events = spark.createDataFrame([(i, 1, "t", None, "launch", None, "d", f"E{i}", "q") for i in (10, 11, 12, 13)], "event_id long, company_id long, event_type string, subject string, action string, event_date string, domain string, entity string, raw_quote string")
    canon = spark.createDataFrame([(i, 1, None, "t", "x", "E", "d") for i in (12, 13)], "canonical_id long, company_id long, canonical_date string, event_type string, action string, entity string, domain string")
    rows = spark.createDataFrame([], "thread_id long, canonical_id long, sequence_index long, stage string")
    for out, where, target in (
        (rv.decide_event_pairs(rels, dec, members, events), "merged_into", 10),
        (rv.decide_canonical_pairs(rels, dec, rows, canon), "thread_id", 12),
    ):
        assert out["relationships"].count() == 2
        log = sorted((r.record_id, r.before.review_status, r.action, r.after.review_status, r.after[where]) for r in out["audit"].collect())
        mine = 1 if where == "merged_into" else 2
        approved = [x for x in log if x[0] == mine]
        assert approved == sorted([(mine, "pending", "approve", "approved", target), (mine, "approved", "reject", "rejected", None), (mine, "rejected", "approve", "approved", target)])
    assert sorted((r.event_id, r.canonical_id) for r in rv.decide_event_pairs(rels, dec, members, events)["event_cluster_members"].collect()) == [(10, 10), (11, 10)]
    with pytest.raises(ValueError):
        rv.decide_event_pairs(rels, dec.withColumn("decision_no", F.lit(1)), members, events)


def test_event_pair_decisions_chain_in_order(spark):
    rels = spark.createDataFrame(
        [(1, 10, 11, "same_event", "pending"), (2, 11, 12, "same_event", "pending"), (3, 12, 13, "same_event", "pending"), (4, 1, 2, "same_event", "pending"), (5, 14, 15, "same_event", "pending"), (6, 1, 10, "related_distinct", "pending")], REL)
    dec = spark.createDataFrame([(1, "approve", "k", 1), (2, "approve", "k", 2), (3, "approve", "k", 3), (4, "approve", "k", 4), (5, "reject", "k", 5), (6, "approve", "k", 6)], DEC)
    members = spark.createDataFrame([(1, 1, True), (2, 2, True)], "canonical_id long, event_id long, is_seed boolean")
    events = spark.createDataFrame([(i, 1, "t", None, "launch", None, "d", f"E{i}", "q") for i in (1, 2, 10, 11, 12, 13, 14, 15)], "event_id long, company_id long, event_type string, subject string, action string, event_date string, domain string, entity string, raw_quote string")
    out = rv.decide_event_pairs(rels, dec, members, events)
    got = {r.event_id: (r.canonical_id, r.is_seed) for r in out["event_cluster_members"].collect()}
    assert got == {1: (1, True), 2: (2, True), 10: (10, True), 11: (10, False), 12: (10, False), 13: (10, False)}
    assert [(r.canonical_id, r.title) for r in out["canonical_events"].collect()] == [(10, "E10: launch")]
    status = {r.relationship_id: r.review_status for r in out["relationships"].collect()}
    assert status == {1: "approved", 2: "approved", 3: "approved", 4: "approved", 5: "rejected", 6: "pending"}
    assert [r.record_id for r in out["refused"].collect()] == [6]


def test_thread_pair_decisions(spark):
    rels = spark.createDataFrame([(1, 1, 2, "related_distinct", "pending"), (2, 2, 3, "related_distinct", "pending"), (3, 8, 9, "related_distinct", "pending"), (4, 5, 8, "related_distinct", "pending")], REL)
    dec = spark.createDataFrame([(1, "approve", "k", 1), (2, "approve", "k", 2), (3, "approve", "k", 3), (4, "reject", "k", 4)], DEC)
    rows = spark.createDataFrame([(7, 8, 0, None), (7, 5, 1, None)], "thread_id long, canonical_id long, sequence_index long, stage string")
    canon = spark.createDataFrame([(1, 1, "2025-02-01", "t", "launch", "E", "d"), (2, 1, None, "t", "pilot", None, "d"), (3, 1, "2025-01-01", "t", "x", "F", "d"), (5, 1, None, "t", "x", None, None), (8, 1, None, "t", "x", None, None), (9, 1, None, "t", "expand", None, None)], "canonical_id long, company_id long, canonical_date string, event_type string, action string, entity string, domain string")
    out = rv.decide_canonical_pairs(rels, dec, rows, canon)
    got = sorted((r.thread_id, r.sequence_index, r.canonical_id, r.stage) for r in out["thread_events"].collect())
    assert got == [(1, 0, 2, "pilot"), (1, 1, 1, "launch"), (1, 2, 3, None), (7, 0, 8, None), (7, 1, 5, None), (7, 2, 9, "scale")]
    assert [(r.thread_id, r.title) for r in out["threads"].collect()] == [(1, "E 확장")]


def test_review_lists_and_summary(spark):
    evidence = spark.createDataFrame([(1, 1, "pending"), (2, 1, "rejected"), (3, 2, "pending")], "event_id long, company_id long, review_status string")
    rels = spark.createDataFrame([(1, 1, 2, "same_event", "pending"), (2, 1, 3, "unrelated", "pending"), (3, 2, 3, "same_event", "approved")], REL)
    companies = spark.createDataFrame([(1,), (2,), (3,)], "company_id long")
    got = {r.company_id: tuple(r)[1:] for r in rv.review_summary(evidence, rels, rels, companies).collect()}
    assert got == {1: (1, 1, 2), 2: (1, 1, 2), 3: (0, 1, 2)}
    assert lk.pending(rels).count() == 2 and lk.pending(rels, "same_event").count() == 1


def test_timeline_filters_and_order(spark):
    canon = spark.createDataFrame([(1, 1, "2025-02-01", "AI"), (2, 1, None, "ai"), (3, 1, "2025-01-01", None), (4, 2, "2024-01-01", "x")], "canonical_id long, company_id long, canonical_date string, domain string")
    ids = lambda df: [r.canonical_id for r in df.collect()]
    assert ids(rp.timeline(canon, company_id=1)) == [3, 1, 2]
    assert ids(rp.timeline(canon, start="2025-01-15")) == [1, 2]
    assert ids(rp.timeline(canon, domain="Ai")) == [1, 2]
    members = spark.createDataFrame([(1, 10), (3, 30)], "canonical_id long, event_id long")
    sources = spark.createDataFrame([(10, True), (30, False)], "event_id long, is_official boolean")
    assert ids(rp.timeline(canon, members=members, event_sources=sources, official_only=True)) == [1]
    scores = spark.createDataFrame([(2, 0.4), (1, 0.9)], "canonical_id long, score double")
    assert ids(rp.by_relevance(canon, scores)) == [1, 2, 4, 3]
    assert [r.domain for r in lk.facet(canon, "domain").collect()] == ["AI", "ai", "x"]
    with pytest.raises(KeyError):
        lk.require(canon, "canonical_id", 99)
    with pytest.raises(ValueError):
        rp.require_entities(canon.where("false"))
    assert ids(lk.by_ids(canon, spark.createDataFrame([(4,), (9,)], "canonical_id long"), "canonical_id")) == [4]


def test_an_incremental_run_goes_on_from_stored_tables(spark):
    text = "Acme announces the {0} Box today. It will launch in spring for everyone.\n\nAcme plans to expand the {0} Box service to new regions."
    schema = "doc_id long, company_id long, source_type string, is_official boolean, title string, published_date string, raw_text string"
    rows = [(n, 1, "press_release" if n % 2 else "tech_blog", True, f"t{n}", f"2025-01-0{n}", text.format(c)) for n, c in enumerate(("Blue", "Red", "Blue", "Green"), 1)]
    companies = spark.createDataFrame([(1, "Acme")], "company_id long, name string")
    rule = RuleClassifier(related=0.8)
    first = run(spark.createDataFrame(rows[:2], schema), companies, classifier=rule)
    second = run(spark.createDataFrame(rows, schema), companies, classifier=rule, state=first)
    ids = lambda t, c: [r[0] for r in t.select(c).orderBy(c).collect()]
    for name, key in (("chunks", "chunk_id"), ("events", "event_id"), ("event_relationships", "relationship_id"), ("canonical_event_relationships", "relationship_id")):
        had, has = ids(first[name], key), ids(second[name], key)
        assert set(had) <= set(has) and len(has) == len(set(has)), name
    assert len(ids(second["chunks"], "chunk_id")) == 2 * len(ids(first["chunks"], "chunk_id"))
    for name in ("event_relationships", "canonical_event_relationships", "event_cluster_members", "evidence_spans"):
        assert schemas.repeated_keys(name, second[name]).isEmpty(), name
    # every member that joined a cluster, and every thread row, names the decision behind it
    pairs = {(r.a_id, r.b_id): r for r in second["event_relationships"].collect()}
    for m in second["event_cluster_members"].where("not is_seed").collect():
        r = pairs[min(m.event_id, m.canonical_id), max(m.event_id, m.canonical_id)]
        assert m.relationship_id == r.relationship_id and r.review_status == "auto_applied"
    applied = {r.relationship_id for r in second["canonical_event_relationships"].where("review_status = 'auto_applied'").collect()}
    assert all(r.relationship_id in applied for r in second["thread_events"].collect())
    third = run(spark.createDataFrame(rows, schema), companies, classifier=rule, state=second)
    for name in ("chunks", "events", "evidence_spans", "event_cluster_members", "event_relationships", "canonical_event_relationships", "threads"):
        assert sorted(map(str, third[name].collect())) == sorted(map(str, second[name].select(*third[name].columns).collect())), name


class TypeRule(RuleClassifier):
    """Events of one type are the same, others of one domain belong together."""

    def columns(self, a, b):
        said = lambda kind, c: F.struct(F.lit(kind).alias("relationship_type"), F.lit(c).alias("confidence"), F.lit("").alias("rationale"))
        return F.when(a["event_type"] == b["event_type"], said("same_event", 0.9)).otherwise(said("related_distinct", 0.8))

    def decide(self, a, b):
        return ("same_event", 0.9) if a["event_type"] == b["event_type"] else ("related_distinct", 0.8)


def test_merges_of_a_later_run_reach_every_stored_table(spark):
    text = "{0} announces the {0} Box today.\n\n{0} plans to expand the {0} Box service to new regions."
    schema = "doc_id long, company_id long, source_type string, is_official boolean, title string, published_date string, raw_text string"
    rows = [(n, 1, "press_release", True, f"t{n}", f"2025-01-0{n}", text.format(c)) for n, c in enumerate(("Blue", "Blu", "Blue", "Bluu"), 1)]
    companies = spark.createDataFrame([(1, "Acme")], "company_id long, name string")
    part, whole = spark.createDataFrame(rows[:2], schema), spark.createDataFrame(rows, schema)
    # the first run keeps what the second one merges
    first = run(part, companies, classifier=RuleClassifier(related=0.8))
    second = run(whole, companies, classifier=TypeRule(), state=first, deduplicate=True)
    gone = {r.remove_id for r in second["merges"].collect()}
    assert gone and gone & {r.canonical_id for r in first["canonical_events"].collect()}
    names = {"assigned": ["canonical_id"], "event_cluster_members": ["canonical_id"], "canonical_events": ["canonical_id"], "thread_events": ["canonical_id"], "canonical_event_relationships": ["a_id", "b_id"], "thread_actions": ["canonical_id"]}
    for table, columns in names.items():
        for c in columns:
            assert not gone & {r[0] for r in second[table].select(c).collect()}, (table, c)
    known = {r.relationship_id for r in second["canonical_event_relationships"].collect()}
    assert {r.relationship_id for r in second["thread_events"].collect()} <= known | {None}
    live = {r.canonical_id for r in second["canonical_events"].collect()}
    assert {r.canonical_id for r in second["event_cluster_members"].collect()} <= live
    third = run(whole, companies, classifier=TypeRule(), state=second, deduplicate=True)
    assert third["merges"].count() == 0
    for name in ("chunks", "events", "event_cluster_members", "canonical_events", "canonical_event_relationships", "threads", "thread_events"):
        assert sorted(map(str, third[name].collect())) == sorted(map(str, second[name].select(*third[name].columns).collect())), name


def test_a_full_run_holds_its_invariants(spark):
    text = "Acme announces the Blue Box today. It will launch in spring for everyone.\n\nAcme plans to expand the Blue Box service to new regions."
    docs = spark.createDataFrame(
        [(1, 1, "press_release", True, "a", "2025-01-01", text), (2, 1, "tech_blog", True, "b", "2025-01-02", text), (3, 1, "news", False, "c", "2025-01-03", text), (4, 1, "odd", True, "d", None, text)],
        "doc_id long, company_id long, source_type string, is_official boolean, title string, published_date string, raw_text string")
    companies = spark.createDataFrame([(1, "Acme")], "company_id long, name string")
    out = run(docs, companies, deduplicate=True)
    texts = {r.doc_id: r.raw_text for r in docs.collect()}
    chunks = out["chunks"].collect()
    assert all(texts[c.doc_id][c.start_offset : c.end_offset] == c.text for c in chunks)
    spans = {r.event_id: r for r in out["evidence_spans"].collect()}
    events = {r.event_id: r for r in out["events"].collect()}
    assert len(events) == len(spans) > 0 and all(s.is_valid for s in spans.values())
    assert all(texts[events[i].doc_id][s.start_offset : s.end_offset] == s.matched_text for i, s in spans.items())
    members = out["event_cluster_members"].collect()
    assert {m.event_id for m in members} <= set(events) and len({m.event_id for m in members}) == len(members)
    assert not any(events[m.canonical_id].doc_id == 3 for m in members)
    assert schemas.repeated_keys("thread_events", out["thread_events"]).isEmpty()
    for table in ("events", "evidence_spans", "canonical_events"):
        assert schemas.bad_words(table, out[table]).isEmpty()
    assert [r.doc_id for r in out["quarantine"].collect()] == [4]
    again = run(docs, companies, deduplicate=True)
    assert sorted(map(tuple, again["event_cluster_members"].collect())) == sorted(map(tuple, members))
