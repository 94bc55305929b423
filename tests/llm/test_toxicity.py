import random
import zlib

import numpy as np
from tests.llm import brute

from annalist.llm import toxicity as T
from annalist.llm.queries import QUERIES


def test_index_equals_brute_force():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(400):
        ks = np.sort(rng.choice(30, rng.integers(1, 6), replace=False))
        ws = rng.integers(1, 4, len(ks)).astype(float)
        rows.append((ks, ws / np.linalg.norm(ws)))
    index = T.BlockMaxIndex(rows, 30)
    dense = np.zeros((400, 30))
    for i, (ks, ws) in enumerate(rows):
        dense[i, ks] = ws
    for q in range(100):
        cos = dense @ dense[q]
        cos[q] = 0
        order = np.lexsort((np.arange(400), -np.round(cos, 12)))
        want = [i for i in order[:15].tolist() if cos[i] > 0]
        ids, got = index.nearest(*rows[q], 15, but=q)
        assert ids.tolist() == want and np.allclose(got, cos[want])


def sample(spark, n=400):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(n):
        own = [f"w{rng.randrange(2000)}" for _ in range(80)]
        bad = k % 5 == 0
        if bad:
            own[rng.randrange(80)] = rng.choice(["nasty", "vileness", "vileful", "vilest"])
        rows.append((k, " ".join(own)))
        labels.append((k, int(bad)))
    return rows, labels


def test_learns_words_and_beginnings(spark):
    rows, labels = sample(spark)
    rows += [(9001, "a VILEOUS thing"), (9002, "a kind thing"), (9003, None), (9004, "")]
    model = T.fit(brute.docs(spark, rows), spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in T.score(brute.docs(spark, rows), model).collect()}
    assert all((got[k].score >= 0.5) == bool(y) for k, y in labels)
    assert got[9001].score >= 0.5 and got[9001].evidence and got[9001].evidence[0].label == 1
    assert got[9002].score == got[9003].score == got[9004].score < 0.1


def test_odd_rows_and_no_labels(spark):
    for labels in ([], [(907, 1)], [(907, 0), (904, 1)]):
        model = T.fit(brute.docs(spark), spark.createDataFrame(labels, "doc_id long, toxic int"))
        out = T.score(brute.docs(spark), model).collect()
        assert len(out) == len(brute.ODD) and all(0 <= r.score <= 1 for r in out)
    none = brute.docs(spark, [])
    assert T.score(none, T.fit(none, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in QUERIES["op3_toxicity"](spark, sf).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for k, r in rows.items())
    labels = [(rows[r.doc_id].score, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert sum((s >= 0.5) == (y == 1) for s, y in labels) / len(labels) >= 0.95
