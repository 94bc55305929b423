import random

import numpy as np
import pytest
from tests.llm import brute

from annalist.llm import simhash as S
from annalist.llm.components import components
from annalist.llm.queries import QUERIES


def test_index_finds_all_pairs():
    rng = np.random.default_rng(1)
    for n, limit in ((1, 2), (2, 2), (9, 2), (300, 2), (700, 12), (65, 64)):
        codes = rng.integers(0, 2**63, max(1, n // 3), dtype=np.uint64)[rng.integers(0, max(1, n // 3), n)]
        for _ in range(4):
            codes = codes ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
        found = sorted((a, b) for x, y in S.GrayIndex(codes).pairs(limit) for a, b in zip(x.tolist(), y.tolist()))
        assert found == [(i, j) for i in range(n) for j in range(i + 1, n) if int(codes[i] ^ codes[j]).bit_count() <= limit]


def test_components_equal_brute_force(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2400)] + [(5, 5), (7, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    nodes = sorted({v for a, b in edges if b is not None and a != b for v in (a, b)})
    at = {v: i for i, v in enumerate(nodes)}
    linked = {frozenset((at[a], at[b])) for a, b in edges if b is not None and a != b}
    root = list(range(len(nodes)))
    for _ in nodes:
        for e in linked:
            a, b = tuple(e)
            root[a] = root[b] = min(root[a], root[b])
    assert got == {v: nodes[root[i]] for v, i in at.items()}
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


def family(rng, n, words=60):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(3)):
            own[rng.randrange(words)] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("most", [2048, 3])
def test_contract_equals_brute_force(spark, most):
    rng = random.Random(5)
    texts = [t for n in (1, 1, 8, 25) for t in family(rng, n)] + ["", None, "a", "A", "a b"]
    rows = list(enumerate(texts, 10))
    got = {r.doc_id: (r.fp % 2**64, r.component) for r in S.simhash(brute.docs(spark, rows), most=most).collect()}
    codes = [brute.fingerprint(t) for t in texts]
    want = brute.classes(len(texts), lambda i, j: (codes[i] ^ codes[j]).bit_count() <= 2)
    assert got == {k: (codes[i], 10 + want[i]) for i, (k, _) in enumerate(rows)}


@pytest.mark.parametrize("most", [2048, 4])
def test_near_duplicates_equal_brute_force(spark, most):
    rng = random.Random(6)
    texts = [t for n in (1, 1, 6, 20) for t in family(rng, n, 150)] + ["", None, "  ", "a", "A", "a b c d e f", "a b c d e g"]
    rows = list(enumerate(texts, 10))
    sets = [set(S.shingle_hashes(t, 5).tolist()) for t in texts]

    def linked(i, j):
        both = len(sets[i] | sets[j])
        return not both or len(sets[i] & sets[j]) / both >= 0.8

    want = brute.classes(len(texts), linked)
    got = {r.doc_id: r["class"] for r in S.near_duplicates(brute.docs(spark, rows), most=most).collect()}
    assert got == {k: 10 + want[i] for i, (k, _) in enumerate(rows)}


@pytest.mark.parametrize("most", [2048, 30])
def test_repeated_lines_and_short_texts_stay_near(spark, most):
    rng = random.Random(8)
    word = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for times in (10, 40) * 20:
        own, line = word(200), word(12)
        texts += [" ".join(own + line), " ".join(own + line * times)]
    for n in (8, 9, 10) * 100:
        own = word(n)
        texts += [" ".join(own), " ".join(own + word(1))]
    # one shingle of all, hardly alike otherwise
    common = word(5)
    texts += [" ".join(word(20) + common + word(20)) for _ in range(40)]
    sets = [set(S.shingle_hashes(t, 5).tolist()) for t in texts]
    want = list(range(len(texts)))
    for i in range(0, 680, 2):
        if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1]):
            want[i + 1] = i
    assert sum(w != i for i, w in enumerate(want)) == 340
    got = {r.doc_id: r["class"] for r in S.near_duplicates(brute.docs(spark, list(enumerate(texts))), most=most).collect()}
    assert got == dict(enumerate(want))


def test_odd_rows(spark):
    out = S.simhash(brute.docs(spark)).collect()
    assert len(out) == len(brute.ODD)
    by = {r.doc_id: r.component for r in out}
    assert by[900] == by[901] == by[902] == 900 and by[904] == by[905] == 904 and by[908] == 907
    assert S.simhash(brute.docs(spark, [])).count() == 0
    near = S.near_duplicates(brute.docs(spark)).collect()
    assert len(near) == len(brute.ODD)
    assert S.near_duplicates(brute.docs(spark, [])).count() == 0


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    codes = [brute.fingerprint(t) for _, t in docs]
    want = brute.classes(len(docs), lambda i, j: (codes[i] ^ codes[j]).bit_count() <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op1_simhash"](spark, sf).collect()}
    assert got == {k: (f"{codes[i]:016x}", docs[want[i]][0]) for i, (k, _) in enumerate(docs)}
