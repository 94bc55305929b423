"""Pairs, clusters, threads and merges against sequential models."""

import random
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from annalist.functions import similarity
from annalist.functions.similarity import _codes, lcs_of_pairs, ratio
from annalist.operators import clustering as cl, dedupe as dd, pairs as pr, slices as sl, threading as th
from tests import models as md

EVENT = "event_id long, company_id long, event_date string, entity string, domain string, event_type string, is_official boolean"


def sample(seed, n, span=60, entities=12, start=0, companies=3):
    rng = random.Random(seed)
    names = [None, "", " ", "A", "a ", "B"] + [f"E{i}" for i in range(entities)]
    rows = []
    for i in range(start, start + n):
        when = str(date(2024, 1, 1) + timedelta(days=rng.randint(0, span)))
        rows.append(
            dict(
                id=i,
                company=rng.randint(0, companies - 1),
                date=rng.choice([None, "bad", "2024-13-01"] + [when] * 40),
                entity=rng.choice(names),
                domain=rng.choice([None, "", "x", "X ", "y", "z"]),
                event_type=rng.choice(["t1", "t2", "t3"]),
                official=rng.random() < 0.8,
            )
        )
    return rows


def frame(spark, rows, names=("event_id", "event_date")):
    data = [(r["id"], r["company"], r["date"], r["entity"], r["domain"], r["event_type"], r["official"]) for r in rows]
    return spark.createDataFrame(data, EVENT).withColumnsRenamed(dict(zip(("event_id", "event_date"), names)))


@pytest.mark.parametrize("window", [30, 1])
def test_candidate_pairs_and_nearest(spark, window):
    rows = sample(5, 300, entities=4)
    df = frame(spark, rows)
    wanted = {
        (a["id"], b["id"])
        for a in rows
        for b in rows
        if a["id"] < b["id"] and a["company"] == b["company"] and md.gap(a, b, window) is not None
    }
    got = [(r.a_id, r.b_id) for r in pr.candidate_pairs(df, window).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted
    top = set()
    for a in rows:
        pool = [b for b in rows if b["company"] == a["company"]]
        for n, (g, b) in enumerate(md.nearest(a, pool, window)):
            top.add((a["id"], n + 1, b["id"], g if g < 10**9 else None))
    assert {(r.item_id, r["rank"], r.candidate_id, r.days) for r in pr.top_candidates(df, window).collect()} == top


def test_hot_key_lists_stay_bounded(spark):
    rows = [dict(id=i, company=1, date="2024-01-05", entity="hot", domain="d", event_type="t", official=True) for i in range(400)]
    got = pr.top_candidates(frame(spark, rows)).groupBy("item_id").count().collect()
    assert len(got) == 400 and {r["count"] for r in got} == {10}


def test_rule_decisions_agree_in_plan_and_task(spark):
    values = [None, "", "A", "a"]
    rows = [(x, y, d, e, s, t) for x in values for y in values for d in (None, "x") for e in ("x", "y") for s in ("t",) for t in ("t", "u")]
    df = spark.createDataFrame(rows, "a_entity string, b_entity string, a_domain string, b_domain string, a_event_type string, b_event_type string")
    rule = pr.RuleClassifier()
    for r in pr.classify_pairs(df).collect():
        side = lambda p: {c: r[f"{p}_{c}"] for c in ("entity", "domain", "event_type")}
        assert rule.decide(side("a"), side("b")) == (r.relationship_type, r.confidence)
        assert pr.auto_apply_value(r.relationship_type, r.confidence) == r.auto_apply


@pytest.mark.parametrize("window,limit,size,share", [(30, 10**6, 10, 0), (30, 0, 120, 0), (7, 0, 60, 0.1), (7, 150, 10**6, 0), (7, 0, 60, 0.4)])
def test_clusters_equal_the_sequential_pass(spark, window, limit, size, share):
    rows, prior = blanked(sample(1, 350, start=1000), share), blanked(sample(2, 60), share)
    rule = pr.RuleClassifier()
    for old in ((), prior):
        said = {}
        wanted = md.clusters(rows, window, rule, old, said)
        df, before = frame(spark, rows), frame(spark, old) if old else None
        got = cl.assign_events(df, before, window, island_rows=limit, slice_rows=size).cache()
        assert {r.event_id: (r.action, r.canonical_id) for r in got.collect()} == wanted
        kept = cl.relationships(df, got, before, window).collect()
        assert {(r.a_id, r.b_id): (r.relationship_type, r.review_status == "auto_applied") for r in kept} == said
        assert sorted(r.relationship_id for r in kept) == list(range(1, len(said) + 1))


def test_a_ten_year_chain_is_decided_once(spark, tmp_path, monkeypatch):
    rule, said = pr.RuleClassifier(), []
    for n in (300, 1200):
        folders = (tmp_path / f"{n}-{i}" for i in range(9))
        made = []
        monkeypatch.setattr(sl, "stage_folder", lambda _, made=made, folders=folders: made.append(str(next(folders))) or made[-1])
        rows = chain(n)
        got = cl.assign_events(frame(spark, rows), island_rows=0, slice_rows=100).collect()
        assert {r.event_id: (r.action, r.canonical_id) for r in got} == md.clusters(rows, 30, rule)
        said.append(spark.read.parquet(f"{made[0]}/said").groupBy("kind").count().collect())
        assert dict(map(tuple, said[-1]))["event"] == n
    few, many = (sum(r["count"] for r in x) for x in said)
    assert many < 4.4 * few


def test_half_a_model_is_refused(spark):
    rows = [dict(id=1, company=1, date="2024-01-05", entity="A", domain=None, event_type="t", official=True)]
    with pytest.raises(ValueError, match="both"):
        cl.assign_events(frame(spark, rows), classifier=DomainRule())


def test_weak_same_event_scores_flag_instead_of_merging(spark):
    rows = [dict(id=i, company=1, date="2024-01-05", entity="A", domain=None, event_type="t", official=True) for i in (1, 2)]
    got = cl.assign_events(frame(spark, rows), classifier=pr.RuleClassifier(same_event=0.8))
    assert {r.event_id: (r.action, r.uncertain) for r in got.collect()} == {1: ("new", False), 2: ("new", True)}
    assert cl.tally(got).first().flagged_for_review == 1


def test_unofficial_events_join_but_never_seed(spark):
    news = dict(id=1, company=1, date="2024-01-05", entity="A", domain=None, event_type="t", official=False)
    plain = dict(news, id=2, date="2024-01-06", official=True)
    late = dict(news, id=3, date="2024-01-07")
    got = {r.event_id: (r.action, r.canonical_id) for r in cl.assign_events(frame(spark, [news, plain, late])).collect()}
    assert got == {1: ("deferred", None), 2: ("new", 2), 3: ("merged", 2)}


def blanked(rows, share, seed=9):
    """The rows, some of them without a date."""
    rng = random.Random(seed)
    return [dict(r, date=None) if rng.random() < share else r for r in rows]


@pytest.mark.parametrize("window,limit,share", [(180, 10**6, 0), (20, 60, 0), (20, 40, 0.3)])
def test_threads_equal_the_sequential_pass(spark, window, limit, share):
    rows = blanked(sample(3, 260, span=120, entities=4 if share else 20), share)
    rule = pr.RuleClassifier(related=0.8)
    said = {}
    acts, spots = md.threads(rows, window, rule, said)
    df = frame(spark, rows, ("canonical_id", "canonical_date"))
    linked = th.link_threads(df, window_days=window, classifier=rule, slice_rows=limit).cache()
    out = linked.collect()
    kept = th.relationships(linked, df, rule).collect()
    assert {(r.a_id, r.b_id): r.review_status == "auto_applied" for r in kept} == said and said
    assert {r.canonical_id: r.action for r in out if r.kind == "action"} == acts
    assert {r.canonical_id: (r.thread_id, r.sequence_index) for r in out if r.kind == "member"} == spots


def chain(n, days=2):
    """One company, one entity, an event every few days: no date cuts it."""
    kinds = ["t1", "t2", "t3", "t1", "t1"]
    return [dict(id=i, company=1, date=str(date(2014, 1, 1) + timedelta(days=days * i)), entity="A" if i % 3 else "B", domain="x", event_type=kinds[i % 5], official=True) for i in range(n)]


def test_slices_write_each_row_a_bounded_number_of_times(spark, tmp_path, monkeypatch):
    rule = pr.RuleClassifier(related=0.8)
    written = []
    for n in (150, 600):
        at = tmp_path / str(n)
        monkeypatch.setattr(sl, "stage_folder", lambda _, at=at: str(at))
        rows = chain(n)
        acts, spots = md.threads(rows, 20, rule)
        out = th.link_threads(frame(spark, rows, ("canonical_id", "canonical_date")), window_days=20, classifier=rule, slice_rows=50).collect()
        assert {r.canonical_id: r.action for r in out if r.kind == "action"} == acts
        assert {r.canonical_id: (r.thread_id, r.sequence_index) for r in out if r.kind == "member"} == spots
        said = spark.read.parquet(f"{at}/said")
        assert said.select("_by").distinct().count() == n // 50
        written.append(said.count())
    assert written[1] < 4.4 * written[0]


def test_jobs_do_not_grow_with_slices(spark):
    rows, rule, jobs = chain(240), pr.RuleClassifier(related=0.8), spark.sparkContext.statusTracker()
    try:
        for name, run in (
            ("clusters", lambda: cl.assign_events(frame(spark, rows), island_rows=0, slice_rows=3)),
            ("threads", lambda: th.link_threads(frame(spark, rows, ("canonical_id", "canonical_date")), window_days=20, classifier=rule, slice_rows=3)),
        ):
            spark.sparkContext.setJobGroup(name, name)
            run().collect()
            assert 0 < len(jobs.getJobIdsForGroup(name)) < 60  # 80 slices
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_slices_go_on_from_existing_threads(spark):
    """A run over later events with the last members of earlier threads equals one run, undated ones apart."""
    rule, rows = pr.RuleClassifier(related=0.8), sample(11, 200, span=150, entities=5, companies=1)
    rows = [r for r in rows if md.day(r["date"])]
    first = sorted(rows, key=md.place)[:80]
    cols = ("canonical_id", "canonical_date")
    one = th.link_threads(frame(spark, first, cols), window_days=20, classifier=rule).where("kind = 'member'").collect()
    tops = {}
    for r in one:
        tops[r.thread_id] = max(tops.get(r.thread_id, (-1, None)), (r.sequence_index, r.canonical_id))
    by_id = {r["id"]: r for r in rows}
    lasts = [(i, *[by_id[i][c] for c in ("company", "date", "entity", "domain", "event_type")], t, n + 1) for t, (n, i) in tops.items()]
    old = spark.createDataFrame(lasts, "canonical_id long, company_id long, canonical_date string, entity string, domain string, event_type string, thread_id long, next_index long")
    rest = frame(spark, [r for r in rows if r["id"] not in {x["id"] for x in first}], cols)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(th.link_threads(rest, old, 20, classifier=rule, slice_rows=30)) == key(th.link_threads(rest, old, 20, classifier=rule))


def test_new_events_extend_existing_threads(spark):
    last = [(5, 1, "2024-01-05", "A", "x", "t1", 5, 2)]
    old = spark.createDataFrame(last, "canonical_id long, company_id long, canonical_date string, entity string, domain string, event_type string, thread_id long, next_index long")
    row = dict(id=9, company=1, date="2024-02-01", entity="A", domain=None, event_type="t2", official=True)
    df = frame(spark, [row], ("canonical_id", "canonical_date"))
    out = th.link_threads(df, old, classifier=pr.RuleClassifier(related=0.8)).collect()
    assert [(r.thread_id, r.sequence_index) for r in out if r.kind == "member"] == [(5, 2)]


def test_large_ids_of_threads_stay_exact(spark):
    """Rows of many small companies share a batch, those of old threads and those of events."""
    big = 2**60 + 1
    last = [(big + i, i, "2024-01-05", "A", "x", "t1", big + i, 2) for i in range(40)]
    old = spark.createDataFrame(last, "canonical_id long, company_id long, canonical_date string, entity string, domain string, event_type string, thread_id long, next_index long")
    rows = [dict(id=i, company=i, date="2024-02-01", entity="A", domain=None, event_type="t2", official=True) for i in range(40)]
    linked = th.link_threads(frame(spark, rows, ("canonical_id", "canonical_date")), old, classifier=pr.RuleClassifier(related=0.8))
    assert {r.canonical_id: (r.thread_id, r.sequence_index) for r in linked.collect() if r.kind == "member"} == {i: (big + i, 2) for i in range(40)}
    events = [dict(id=big + i, company=i % 20, date="2024-02-01", entity="A", domain=None, event_type="t2", official=i % 3 > 0) for i in range(40)]
    for size in (100, 0):
        seeds = cl.assign_events(frame(spark, events), island_rows=size).where("action = 'new'").collect()
        assert seeds and all(r.canonical_id == r.event_id for r in seeds)


def test_small_groups_are_read_as_one_stream(spark, capsys):
    """A table made per group costs more than its few turns: tasks read many groups in a row."""
    rows = sample(5, 120, companies=30)
    for df in (cl.assign_events(frame(spark, rows)), th.link_threads(frame(spark, rows, ("canonical_id", "canonical_date")))):
        df.explain()
        plan = capsys.readouterr().out
        assert "MapInPandas" in plan and "FlatMapGroups" not in plan
    acts, spots = md.threads(rows, 20, pr.RuleClassifier(related=0.8))
    out = th.link_threads(frame(spark, rows, ("canonical_id", "canonical_date")), window_days=20, classifier=pr.RuleClassifier(related=0.8)).collect()
    assert {r.canonical_id: r.action for r in out if r.kind == "action"} == acts
    assert {r.canonical_id: (r.thread_id, r.sequence_index) for r in out if r.kind == "member"} == spots


def test_default_scores_leave_events_alone(spark):
    df = frame(spark, sample(4, 40), ("canonical_id", "canonical_date"))
    assert th.tally(th.link_threads(df)).first().standalone == 40


def test_stages(spark):
    df = spark.createDataFrame([("plan to launch", "x"), (None, "product_launch"), ("", None), ("global rollout", None), ("zzz", "y")], "a string, t string")
    stages = [r.s for r in df.select(th.stage_of(F.col("a"), F.col("t")).alias("s")).collect()]
    assert stages == ["announce", "launch", None, "scale", None]
    r = df.select(th.stage_index(F.lit("pilot")).alias("i"), th.moves_forward(F.lit("build"), F.lit("launch")).alias("f"), th.moves_forward(F.lit("build"), F.lit(None)).alias("g")).first()
    assert (r.i, r.f, r.g) == (2, True, False)


def test_lcs_of_pairs_equals_the_plain_table():
    rng = random.Random(4)
    texts = ["", "a", "\U0001f600b"] + ["".join(rng.choices("abcdé가 ", k=n)) for n in (3, 40, 63, 64, 65, 100, 128, 129, 200)]

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(row[k] + 1 if x == y else max(new[k], row[k + 1]))
            row = new
        return row[-1]

    codes = [_codes(t) for t in texts]
    i, j = (np.array(x) for x in zip(*[(a, b) for a in range(len(texts)) for b in range(len(texts))]))
    for chunk in (7, 1 << 15):
        assert lcs_of_pairs(codes, codes, i, j, chunk).tolist() == [plain(texts[a], texts[b]) for a, b in zip(i, j)]
    assert len(lcs_of_pairs(codes, codes, i[:0], j[:0])) == 0


def test_streams_keep_of_a_row_what_turns_read():
    """Every row was held with its company, island, part and the blank fields of threads, and with words of its own."""
    one = th._Stream(180, 10, pr.RuleClassifier(), [], 100)
    rest = dict(_company=1, _island=0, _part=7, _role="turn", _thread=0, _rank_day=0, _rank_id=0, _next=0)
    for n in (1, 2):
        words = {c: "".join(["a long ", "word"]) for c in ("_entity", "_domain", "_text", *pr.FACTS)}
        one.arrive(dict(_id=n, _d=100 + n, **words, **rest))
    first, second = one.waiting
    assert set(first) == {*th.HELD, "_n", "_gone"} and all(first[c] is second[c] for c in ("_entity", "_text", *pr.FACTS))
    one.arrive(dict(_id=3, _d=103, _entity=None, _domain="d", _text=None, event_type="t", entity=None, domain="d", **{**rest, "_role": "last", "_thread": 5, "_next": 2}))
    one.close()
    assert [(x[0], x[1]) for x in one.out if x[0] == "action"] == [("action", 1), ("action", 2)]


def test_lcs_of_few_long_pairs_and_of_many_agree(monkeypatch):
    """A lone pair of long texts took a step over arrays for each word and letter; now one integer has its row."""
    rng = random.Random(6)
    codes = [_codes("".join(rng.choices("abcdé가 \U0001f600", k=n))) for n in (0, 1, 62, 63, 64, 126, 127, 500, 2_000)]
    i, j = (np.array(x) for x in zip(*[(a, b) for a in range(len(codes)) for b in range(len(codes))]))
    got = []
    for steps, cells in ((0, 1 << 18), (0, 500), (1 << 30, 1 << 18)):
        monkeypatch.setattr(similarity, "ROW_STEPS", steps)
        monkeypatch.setattr(similarity, "MASK_CELLS", cells)
        got.append(lcs_of_pairs(codes, codes, i, j).tolist())
    assert got[0] == got[1] == got[2]
    assert [got[0][k] for k in range(len(i)) if i[k] == j[k]] == [len(c) for c in codes]
    monkeypatch.undo()
    monkeypatch.setattr(similarity, "_lcs_of_width", None)
    assert lcs_of_pairs(codes, codes, np.array([8]), np.array([8])).tolist() == [2_000]


def test_tiles_are_listed_in_strips_and_two_titles_are_scored_once(monkeypatch):
    """All pairs of a tile were listed at once, and titles were scored again in each."""
    rng = random.Random(7)
    rows = [(i, rng.randrange(9), "T " + " ".join(rng.choices(WORDS, k=rng.randint(1, 3))), "S " + " ".join(rng.choices(WORDS, k=12)), rng.choice("LR")) for i in range(150)]
    table = pa.table(dict(zip(["_id", "_d", "_title", "_summary", "_side"], zip(*rows))))
    scored, plain = [], dd.lcs_of_pairs

    def counted(left, right, i, j):
        scored.extend(frozenset((left[a].tobytes(), right[b].tobytes())) for a, b in zip(i, j))
        return plain(left, right, i, j)

    monkeypatch.setattr(dd, "lcs_of_pairs", counted)
    monkeypatch.setattr(dd, "STRIP_CELLS", 200)
    monkeypatch.setattr(dd, "STEP_CELLS", 400)
    found = list(dd._similar(table, np.zeros(len(rows), dtype=np.int64), 55.0))
    assert len(found) > 20 and max(len(i) for i, _, _ in found) <= 200
    got = {(rows[a][0], rows[b][0]): s for i, j, score in found for a, b, s in zip(i.tolist(), j.tolist(), score.tolist())}
    wanted = {}
    for a in (r for r in rows if r[4] == "L"):
        for b in (r for r in rows if r[4] == "R" and abs(r[1] - a[1]) <= dd.WINDOW_DAYS):
            title, summary = (100 * ratio(a[c], b[c]) for c in (2, 3))
            if max(title, summary) >= 55:
                wanted[a[0], b[0]] = title if title >= 55 else summary
    assert got.keys() == wanted.keys() and all(abs(got[k] - wanted[k]) < 1e-9 for k in got)
    assert sum(len(i) for i, _, _ in found) == len(got) and any(0 < s < 100 for s in got.values())
    titles = [x for x in scored if all(t[:4] == _codes("T").tobytes() for t in x)]
    assert titles and len(titles) == len(set(titles))


WORDS = "alpha beta gamma delta launch expand build service cloud search".split()
CANON = "canonical_id long, company_id long, canonical_date string, entity string, domain string, event_type string, title string, summary string"


def canon_rows(seed=0, n=140):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        when = str(date(2024, 1, 1) + timedelta(days=rng.randint(0, 15)))
        title = " ".join(rng.choices(WORDS, k=rng.randint(0, 5)))
        text = rng.choice([None, " ".join(rng.choices(WORDS, k=rng.randint(3, 9)))])
        rows.append((i, rng.randint(0, 1), rng.choice([None, "bad", ""] + [when] * 15), rng.choice([None, "", "A", "B"]), "x", rng.choice(["t1", "t2"]), title, text))
    ids = list(range(n))
    rng.shuffle(ids)
    rows = [(ids[i], *r[1:]) for i, r in enumerate(rows)]
    return rows + [(1000 + i, *rows[i % 20][1:]) for i in range(50)]


def similar(a, b):
    if a[2] is None or b[2] is None:
        close = a[2] == b[2]
    elif md.day(a[2]) and md.day(b[2]):
        close = abs((md.day(a[2]) - md.day(b[2])).days) <= 3
    else:
        close = a[2][:10] == b[2][:10]
    words = lambda s: " ".join(sorted((s or "").split()))
    return close and max(ratio(words(a[6]), words(b[6])), ratio(words(a[7]), words(b[7]))) >= 0.55


def test_similar_pairs_and_merges(spark):
    rows = canon_rows()
    df = spark.createDataFrame(rows, CANON)
    wanted = {
        (min(a[0], b[0]), max(a[0], b[0]))
        for i, a in enumerate(rows)
        for b in rows[i + 1 :]
        if a[1] == b[1] and similar(a, b)
    }
    got = [(r.a_id, r.b_id) for r in dd.expand_pairs(*dd.similar_pairs(df, tile_rows=9)).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted

    root = {r[0]: r[0] for r in rows}

    def least(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in wanted:
        x, y = least(x), least(y)
        root[max(x, y)] = min(x, y)
    classes = dd.similar_classes(df, tile_rows=9).collect()
    assert {r.canonical_id: (r.class_id, r.n_links) for r in classes} == {r[0]: (least(r[0]), sum(r[0] in p for p in wanted)) for r in rows}

    order = sorted(rows, key=lambda r: (r[2] is None, r[2] or "", r[0]))
    spot, by_id, keep = {r[0]: n for n, r in enumerate(order)}, {r[0]: r for r in rows}, {}
    for x, y in sorted((sorted(p, key=spot.get) for p in wanted), key=lambda p: (spot[p[0]], spot[p[1]])):
        a, b = by_id[x], by_id[y]
        if x not in keep and y not in keep and a[3] and a[3] == b[3] and a[5] == b[5]:
            keep[max(x, y)] = min(x, y)

    def root(x):
        while x in keep:
            x = keep[x]
        return x

    merges = dd.dedupe(df, tile_rows=20)
    assert {r.remove_id: r.keep_id for r in merges.collect()} == {x: root(x) for x in keep}


def test_small_tiles_share_a_stream(spark):
    rows = [(i, i % 40, *r[2:]) for i, r in enumerate(canon_rows())]
    df = spark.createDataFrame(rows, CANON)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        pairs, members = dd.similar_pairs(df, tile_rows=3)
        assert "FlatMapGroups" not in pairs._jdf.queryExecution().toString()
        got = [(r.a_id, r.b_id) for r in dd.expand_pairs(pairs, members).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    wanted = {(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if a[1] == b[1] and similar(a, b)}
    assert len(got) == len(set(got)) and set(got) == wanted and wanted


def test_settled_pairs_leave_the_rounds(spark, monkeypatch):
    sizes, plain = [], dd.cut

    def counted(df):
        out = plain(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(dd, "cut", counted)
    pairs = [(0, i) for i in range(1, 31)] + [(i, i + 1) for i in range(100, 110)] + [(3, 105), (50, 104)]
    keep = {}
    for a, b in pairs:
        if a not in keep and b not in keep:
            keep[b] = a
    df = spark.createDataFrame([(n, *p) for n, p in enumerate(pairs)], "order long, a_id long, b_id long")
    got = dd.accepted_merges(df)
    assert {r.remove_id: r.keep_id for r in got.collect()} == keep
    assert sizes[-1] <= 2 < 30 < sizes[0]
    assert dd.accepted_merges(df.where("a_id < 0")).count() == 0


class DomainRule(pr.RuleClassifier):
    """Events of one domain are the same, whatever their entity and type."""

    def columns(self, a, b):
        same = F.coalesce((F.length(a["domain"]) > 0) & (a["domain"] == b["domain"]), F.lit(False))
        out = lambda kind, c: F.struct(F.lit(kind).alias("relationship_type"), F.lit(c).alias("confidence"), F.lit("").alias("rationale"))
        return F.when(same, out("same_event", 0.9)).otherwise(out("unrelated", 0.6))


def test_a_model_may_merge_across_entities(spark):
    rng = random.Random(7)
    rows = [(*r[:4], rng.choice(["x", "y", None]), *r[5:]) for r in canon_rows(3, 90)]
    df = spark.createDataFrame(rows, CANON)
    order = sorted(rows, key=lambda r: (r[2] is None, r[2] or "", r[0]))
    keep, candidates, checked = {}, 0, 0
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if a[1] == b[1] and similar(a, b):
                candidates += 1
                if a[0] not in keep and b[0] not in keep:
                    checked += 1
                    if a[4] and a[4] == b[4]:
                        keep[max(a[0], b[0])] = min(a[0], b[0])

    def root(x):
        while x in keep:
            x = keep[x]
        return x

    got = {r.remove_id: r.keep_id for r in dd.dedupe(df, DomainRule(), tile_rows=20).collect()}
    assert got == {x: root(x) for x in keep}
    entity = {r[0]: r[3] for r in rows}
    assert any(entity[a] != entity[b] for a, b in got.items())
    assert dd.dedupe_tally(df, DomainRule()).first().asDict() == {"candidates": candidates, "checked": checked, "merged": len(keep)}


def test_one_title_settles_a_group_without_its_summaries(spark, monkeypatch):
    rng, rows = random.Random(8), []
    for i in rng.sample(range(500), 150):
        day = rng.choice([None, *[f"2024-01-{d:02}" for d in range(1, 9)]])
        rows.append((i, 1, day, rng.choice("AB"), rng.choice("xy"), "t1", "A: t1", "".join(rng.choices("abcdefgh ", k=40))))
    df = spark.createDataFrame(rows, "canonical_id long, company_id long, canonical_date string, entity string, domain string, event_type string, title string, summary string")
    read = []
    monkeypatch.setattr(dd, "similar_pairs", lambda rows, by=dd.similar_pairs, **o: read.append(by(rows, **o)) or read[-1])
    got = {r.remove_id: r.keep_id for r in dd.dedupe(df).collect()}

    order, keep = sorted(rows, key=lambda r: (r[2] is None, r[2] or "", r[0])), {}
    for n, a in enumerate(order):
        for b in order[n + 1 :]:
            near = a[2] == b[2] or (a[2] and b[2] and int(b[2][-2:]) - int(a[2][-2:]) <= 3)
            if near and a[3] == b[3] and a[0] not in keep and b[0] not in keep:
                keep[max(a[0], b[0])] = min(a[0], b[0])

    def root(x):
        while x in keep:
            x = keep[x]
        return x

    assert got == {x: root(x) for x in keep}
    texts = read[0][1].select("text_id").distinct().count()
    assert texts == len({(r[2], r[3], r[4]) for r in rows}) < 40


def test_merges_rewrite_every_table(spark):
    merges = spark.createDataFrame([(2, 1)], "remove_id long, keep_id long")
    members = spark.createDataFrame([(1, 10, True), (2, 20, True)], "canonical_id long, event_id long, is_seed boolean")
    rows = spark.createDataFrame([(7, 1, 0, None, 5), (7, 2, 1, None, 6), (8, 2, 0, None, 6)], "thread_id long, canonical_id long, sequence_index long, stage string, relationship_id long")
    rels = spark.createDataFrame([(5, 1, 3), (6, 2, 3)], "relationship_id long, a_id long, b_id long")
    canon = spark.createDataFrame([(1,), (2,), (3,)], "canonical_id long")
    out = dd.apply_merges(merges, members, rows, rels, canon)
    assert sorted((r.canonical_id, r.event_id) for r in out["event_cluster_members"].collect()) == [(1, 10), (1, 20)]
    assert sorted((r.thread_id, r.canonical_id, r.sequence_index, r.relationship_id) for r in out["thread_events"].collect()) == [(7, 1, 0, 5), (8, 1, 0, None)]
    assert [r.relationship_id for r in out["relationships"].collect()] == [5]
    assert sorted(r.canonical_id for r in out["canonical_events"].collect()) == [1, 3]
    assert [(r.record_id, r.action, r.actor) for r in out["audit"].collect()] == [(2, "merge", "system:dedupe")]
