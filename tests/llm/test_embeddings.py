import math

import numpy as np
import pytest
from tests.llm import brute

from annalist.llm.embeddings import cells, embedding_links, fit, unit
from annalist.llm.queries import QUERIES


def expected(rows, cosine=0.95):
    good = [(k, np.array(v, float)) for k, v in rows if k is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    units = [v / np.linalg.norm(v) for _, v in good]

    def linked(i, j):
        return len(units[i]) == len(units[j]) and i != j and units[i] @ units[j] >= cosine

    root = brute.classes(len(good), linked)
    out = {k: (0, k, True) for k, _ in rows if k is not None}
    for i, (k, _) in enumerate(good):
        first = good[root[i]][0]
        out[k] = (sum(linked(i, j) for j in range(len(good))), first, first == k)
    return out


def check(spark, rows, **given):
    df = spark.createDataFrame([(k, v, 1, 2) for k, v in rows], "vec_id long, embedding array<double>, label int, component int")
    got = [(r.vec_id, (r.n_links, r.component, r.kept)) for r in embedding_links(df, **given).collect()]
    assert len(got) == len(rows)
    assert dict(x for x in got if x[0] is not None) == expected(rows)


@pytest.mark.parametrize("given", [{}, {"cell_rows": 20, "most": 7}])
def test_equals_brute_force(spark, given):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 16))
    rows = [(int(i), (base[i % 12] + rng.normal(size=16) * (0.12 + 0.02 * (i % 3))).tolist()) for i in range(240)]
    rows += [(500 + i, base[3].tolist()) for i in range(30)] + [(600 + i, rng.normal(size=16).tolist()) for i in range(40)]
    check(spark, rows, **given)


def turned(rng, n, dim=64, cosine=0.952):
    """Vectors that spread mostly in eight directions, and each turned within those."""
    spread = np.r_[np.full(8, 4.0), np.ones(dim - 8)]
    one = unit(rng.normal(size=(n, dim)) * spread)
    way = np.zeros((n, dim))
    way[:, :8] = rng.normal(size=(n, 8))
    way = unit(way - (way * one).sum(1, keepdims=True) * one)
    return one, cosine * one + math.sqrt(1 - cosine**2) * way


@pytest.mark.parametrize("k", [16, 64, 256])
def test_linked_vectors_share_a_cell(k):
    one, other = turned(np.random.default_rng(11), 2000)
    both = np.vstack([one, other])
    lists = cells(both, fit(both, k), 0.95)
    apart = [i for i in range(2000) if lists[i][0] not in lists[2000 + i] and lists[2000 + i][0] not in lists[i]]
    assert not apart


def test_turns_that_are_not_random_equal_brute_force(spark):
    one, other = turned(np.random.default_rng(12), 300)
    check(spark, [(i, v.tolist()) for i, v in enumerate(np.vstack([one, other]))], cell_rows=20, most=50)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    check(spark, [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [1.0]), (None, [1.0, 0.0]), (11, [-1.0, 0.0]), (12, [1.0, 0.0])])
    check(spark, [])
    check(spark, [(1, None)])


def test_query_and_recall(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = expected(rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in QUERIES["op6_embeddings"](spark, sf).collect()}
    assert got == want
