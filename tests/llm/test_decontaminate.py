import random

import pytest
from tests.llm import brute

from annalist.llm.decontaminate import WuManber, contamination
from annalist.llm.queries import QUERIES


def expected(text, items, window=10):
    own = brute.words(text)
    hit, found = set(), set()
    for k, t in items:
        w = brute.words(t)
        size = min(window, len(w))
        windows = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if size else set()
        for i in range(len(own) - size + 1 if size else 0):
            if tuple(own[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(-1 if k is None else k)
    return len(own), len(hit), sorted(found)


def spread(r):
    return r.n_words, sum(b - a for a, b in zip(r.starts, r.ends)), list(r["items"])


def test_search_equals_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        word = lambda: rng.choice("ab") if rng.random() < 0.7 else rng.choice("cdef")
        items = [(k, " ".join(word() for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 10, 11, 14])))) for k in range(4)]
        text = " ".join(word() for _ in range(rng.randrange(60)))
        own = [w.encode() for w in brute.words(text)]
        s, e, i = WuManber(items).search(own)
        assert (len(own), sum(b - a for a, b in zip(s, e)), sorted(i)) == expected(text, items)


ITEMS = [(1, "one"), (2, "Same TEXT here"), (3, None), (4, ""), (5, "word " * 12), (5, "word " * 12), (None, "two")]


@pytest.mark.parametrize("table_bytes", [1 << 20, 40, 8])
def test_odd_rows_in_one_and_many_passes(spark, table_bytes):
    rows = [*brute.ODD, (None, "word two"), (None, "one"), (908, "same text here, two of it")]
    benchmark = spark.createDataFrame([(*r, 1) for r in ITEMS], "item_id long, text string, doc_id int")
    got = contamination(brute.docs(spark, rows), benchmark, table_bytes=table_bytes).collect()
    assert len(got) == len(rows)
    assert sorted(((r.doc_id or -1), *spread(r)) for r in got) == sorted((k or -1, *expected(t, ITEMS)) for k, t in rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(brute.docs(spark, []), none).count() == 0
    assert all(not r.starts for r in contamination(brute.docs(spark), none).collect())


def test_query(spark, sf):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = {r.doc_id: r for r in QUERIES["op7_decontamination"](spark, sf).collect()}
    assert len(rows) == len(docs)
    for d in docs:
        n, hit, found = expected(d.text, items)
        r = rows[d.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(found), hit > 0)
        assert r.items_sha256 == brute.sha(",".join(sorted(map(str, found))))
    assert any(r.contaminated for r in rows.values())
