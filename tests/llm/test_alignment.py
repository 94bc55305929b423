import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tests.llm import brute
from tokenizers import Tokenizer

from annalist.llm import alignment as al
from annalist.llm.bpe import byte_letters
from annalist.llm.encoders import ByteIds, PieceIds, pair_encoder
from annalist.llm.queries import QUERIES

PATHS = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")]
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def public():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[2])


@pytest.fixture(scope="module")
def own():
    return ByteIds(open(PATHS[0]).read(), open(PATHS[1], "rb").read(), public_tokenizers.PATTERN), PieceIds(open(PATHS[2], "rb").read())


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x32F, exclude_categories=["Cs"]), max_size=40))
def test_ids_of_texts(public, own, text):
    assert own[0].ids(" " + text) == public[0].encode(" " + text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "I'll", "日本", "a1²", "\x1c", " ", "\n \n", "\x85", "\xa0", "x" * 600, " " * 600, "▁", "<s>", "<0x0A>", "😀", "\r\n"]), max_size=8))
def test_ids_of_odd_marks(public, own, parts):
    text = "".join(parts)
    assert own[0].ids(" " + text) == public[0].encode(" " + text, add_special_tokens=False).ids


def spans(tokens):
    out, at = [], 0
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


def plain(public, text):
    """(a, b, groups, links): token by token, links as places."""
    letters = {c: b for b, c in enumerate(byte_letters())}
    a = public[0].encode(" " + (text or ""), add_special_tokens=False).ids if text else []
    b = public[1].encode(text) if text else []
    as_ = [bytes(letters[c] for c in public[0].id_to_token(i)) for i in a]
    pieces = [public[1].id_to_piece(i) for i in b]
    bs = [bytes([int(p[3:5], 16)]) if public[1].is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
    said = (" " + (text or "")).encode()
    if not text or b"".join(as_) != said or b"".join(bs) != said:
        return [], [], [], []
    sa, sb = spans(as_), spans(bs)
    cuts = sorted({e for _, e in sa} & {e for _, e in sb})
    groups, start = [], 0
    for c in cuts:
        groups.append(([i for i, (s, e) in enumerate(sa) if start <= s and e <= c], [j for j, (s, e) in enumerate(sb) if start <= s and e <= c]))
        start = c
    links, j0 = [], 0
    for i, (s, e) in enumerate(sa):
        while sb[j0][1] <= s:
            j0 += 1
        j = j0
        while j < len(sb) and sb[j][0] < e:
            links.append((i, j, min(e, sb[j][1]) - max(s, sb[j][0])))
            j += 1
    return a, b, groups, links


def expected(public, texts):
    docs = [plain(public, t) for t in texts]
    held = Counter(p for a, b, _, links in docs for p in {(a[i], b[j]) for i, j, _ in links})
    best = {}
    for (a, _), n in held.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for a, b, groups, links in docs:
        text = ";".join(",".join(str(a[i]) for i in x) + "|" + ",".join(str(b[j]) for j in y) for x, y in groups)
        weights = [(a[i], held[a[i], b[j]]) for i, j, _ in links]
        out.append((len(a), len(b), len(groups), len(links), sum(w == best[i] for i, w in weights), sum(w for _, w in weights), brute.sha(text) if a else ""))
    return out


def got(df, key="doc_id"):
    return sorted((r[key] if r[key] is not None else -1, *(r[c] for c in COLUMNS)) for r in df.collect())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.booleans(), min_size=7, max_size=7), min_size=5, max_size=5), st.lists(st.lists(st.integers(0, 3), min_size=4, max_size=4), min_size=7, max_size=7))
def test_product_equals_dense(a, b):
    def sparse(m):
        m = np.array(m, dtype=np.int64)
        rows, cols = np.nonzero(m)
        return al.Csr(np.r_[0, np.cumsum(np.bincount(rows, minlength=len(m)))], cols, m[rows, cols], m.shape[1])

    def dense(m):
        out = np.zeros((len(m.starts) - 1, m.width), dtype=np.int64)
        out[np.repeat(np.arange(len(out)), np.diff(m.starts)), m.indices] = m.values
        return out

    assert (dense(al.product(sparse(a), sparse(b))) == np.array(a, dtype=np.int64) @ np.array(b)).all()
    assert (dense(al.transposed(sparse(b))) == np.array(b).T).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 5), max_size=30), st.randoms(use_true_random=False), st.integers(1, 20))
def test_align_equals_all_pairs(a, rng, window):
    total, b = sum(a), []
    while sum(b) < total:
        b.append(min(rng.randint(1, 6), total - sum(b)))
    of = al.align(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64), window)
    sa, sb = spans(["x" * n for n in a]), spans(["x" * n for n in b])
    links = [(i, j, min(e, f) - max(s, t)) for i, (s, e) in enumerate(sa) for j, (t, f) in enumerate(sb) if s < f and t < e]
    assert list(zip(of.link_a.tolist(), of.link_b.tolist(), of.overlap.tolist())) == links
    first, n = of.shared()
    shared = [(i, j) for i, g in enumerate(of.a_group) for j, h in enumerate(of.b_group) if g == h]
    assert [(i, j) for i, (f, k) in enumerate(zip(first.tolist(), n.tolist())) for j in range(f, f + k)] == shared
    assert {(i, j) for i, j, _ in links} <= set(shared)


def test_odd_rows_and_both_ways_to_weigh(spark, public):
    texts = [*brute.ODD, (920, "a▁b"), (921, "naïve 日本語 😀 <s></s><|endoftext|> <0x0A>"), (922, "tokenisation " * 400), (923, "the the The")]
    docs = brute.docs(spark, texts)
    want = sorted((k if k is not None else -1, *x) for (k, _), x in zip(texts, expected(public, [t for _, t in texts])))
    args = (*PATHS[:2], public_tokenizers.PATTERN, PATHS[2])
    assert got(al.statistics(docs, *args)) == want
    assert got(al.statistics(docs, *args, most=0).withColumnRenamed("n_shared", "x")) == want
    assert al.statistics(brute.docs(spark, []), *args).count() == 0
    rows = {r.doc_id: r for r in al.alignments(docs, pair_encoder(spark, *args)).collect()}
    for k, t in texts[1:]:
        a, b, groups, links = plain(public, t)
        r = rows[k]
        assert (r.a, r.b, [tuple(x) for x in r.links]) == (a, b, links)
        assert [tuple(x) for x in r.shared] == [(y[0], len(y)) for x, y in groups for _ in x]
        assert r.a_group == [g for g, (x, _) in enumerate(groups) for _ in x]


def test_query(spark, public, sf):
    given_docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((d.doc_id, *x) for d, x in zip(given_docs, expected(public, [d.text for d in given_docs])))
    assert got(QUERIES["op13_alignment"](spark, sf)) == want
