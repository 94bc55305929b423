"""Every query with SQL beside it, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from annalist.operators import dedupe as dd
from annalist.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    return str(v)


def as_set(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = contract.queries()[name](spark, DATA)
    answer = duck.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in answer.description]
    assert sorted(df.columns) == sorted(columns)
    assert as_set(df.columns, df.collect()) == as_set(columns, answer.fetchall())


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    """Their values are compared with sequential models elsewhere; here they run on the given tables."""
    df = contract.queries()[name](spark, DATA)
    rows = df.collect()
    assert rows
    assert len(set(df.columns)) == len(df.columns) and len(set(map(str, rows))) == len(rows)


def test_near_duplicates_count_links_and_name_classes(spark):
    events = catalog._sentence_events(spark, DATA)
    kind = {r.canonical_id: r.event_type for r in events.collect()}
    pairs = [(r.a_id, r.b_id) for r in dd.expand_pairs(*dd.similar_pairs(events)).collect()]
    links, root = dict.fromkeys(kind, 0), {k: k for k in kind}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        links[a] += 1
        links[b] += 1
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.canonical_id: (r.n_links, r.class_id) for r in contract.queries()["near_duplicates"](spark, DATA).collect()}
    assert got == {k: (links[k], find(k)) for k in kind}
    assert any(kind[a] != kind[b] for a, b in pairs) and any(k != c for k, (_, c) in got.items())


def test_pairs_of_large_ids_keep_numbers_of_their_own(spark, tmp_path):
    """1 with 10,000,005 and 2 with 5 had one number when the first id was multiplied by ten million."""
    os.symlink(f"{DATA}/documents.parquet", tmp_path / "documents.parquet")
    rows = [(i, "2024-01-02", c, "view", 1.0, '{"k": 7}') for i, c in ((1, 1), (10_000_005, 1), (2, 2), (5, 2))]
    kinds = "event_id long, ts string, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, kinds).selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "value", "props").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(1, 0, 1), (2, 0, 1)], "doc_id long, toxic long, quality long").write.parquet(f"{tmp_path}/labels.parquet")
    pairs, decided = catalog._pair_decisions(spark, str(tmp_path), "same_event")
    assert pairs.count() == decided.select("decision_no").distinct().count() == 2
    assert contract.queries()["approve_event_pairs"](spark, str(tmp_path)).count() == 4


def test_entry(spark):
    assert contract.entry(spark).count() > 0
