"""The pipeline against a sequential version of its stages."""

import hashlib
import re
import struct

import corpus_pipeline as P
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tests.llm import brute
from tests.llm.test_decontaminate import expected as contaminated
from tokenizers import Tokenizer

from annalist.llm import simhash as S, toxicity as T


def without_shared_windows(docs, least=25):
    """Words of each document outside any 25 words in a row that an earlier document has as well."""
    seen, out = set(), {}
    for k in sorted(docs):
        own = (docs[k] or "").split()
        runs = [tuple(own[i : i + least]) for i in range(len(own) - least + 1)]
        gone = {j for i, x in enumerate(runs) if x in seen for j in range(i, i + least)}
        seen.update(runs)
        out[k] = [w for j, w in enumerate(own) if j not in gone]
    return out


def near_dedup(docs):
    """The first of each class of documents whose sets of five words in a row are alike to 0.8."""
    keys = sorted(docs)
    own = [re.findall(r"[^\x20\x09-\x0D]+", (docs[k] or "").translate(brute.LOWER)) for k in keys]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in own]

    def linked(i, j):
        both = len(sets[i] | sets[j])
        return not both or len(sets[i] & sets[j]) / both >= 0.8

    root = brute.classes(len(keys), linked)
    return {k: docs[k] for i, k in enumerate(keys) if root[i] == i}


@pytest.fixture(scope="module")
def stages(spark, sf):
    """What each stage returns, by doc_id."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in P.STAGES:
        docs = stage(spark, docs, sf).cache()
        out.append((name, docs))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def got(spark, sf, stages):
    """Texts before the first stage and after each that returns texts."""
    return [texts(spark.read.parquet(f"{sf}/documents.parquet")), *(texts(df) for _, df in stages[:4])]


def test_toxicity_keeps_what_the_model_passes(spark, sf, got):
    model = T.fit(spark.read.parquet(f"{sf}/documents.parquet"), T.learnable(spark.read.parquet(f"{sf}/labels.parquet")))
    assert got[1] == {k: t for k, t in got[0].items() if model.score(t)[0] < 0.5}


def test_line_dedup_leaves_the_words_of_the_window_model(got):
    model = without_shared_windows(got[1])
    gone = {k for k in got[1] if not model[k] and (got[1][k] or "").split()}
    assert {k: (t or "").split() for k, t in got[2].items()} == {k: w for k, w in model.items() if k not in gone}
    unchanged = {k for k, w in model.items() if w == (got[1][k] or "").split()}
    assert all(got[2][k] == got[1][k] for k in unchanged) and gone and len(unchanged) < len(model)


def test_near_dedup_keeps_the_first_of_each_class(got):
    assert got[3] == near_dedup(got[2])


def test_near_dedup_of_uncut_texts(spark, sf, got):
    assert texts(P.one_of_each(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)) == near_dedup(got[0]) != got[0]


def test_near_dedup_goes_through_the_simhash_index(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "end"])), (3, " ".join(words[::-1])), (4, None), (5, "w1")]
    met = []
    monkeypatch.setattr(S, "_by_fingerprint", lambda texts, by=S._by_fingerprint: met.append(by(texts)) or met[-1])
    assert texts(P.one_of_each(spark, brute.docs(spark, rows), "")) == near_dedup(dict(rows)) != dict(rows)
    assert {r.rep for r in met[0].collect()} == {1, 2}


def test_decontamination_keeps_documents_without_windows(spark, sf, got):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert got[4] == {k: t for k, t in got[3].items() if not contaminated(t, items)[1]} != got[3]


def test_bpe_gives_the_ids_of_the_public_library(stages, got):
    public = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = stages[4][1].collect()
    assert {r.doc_id for r in rows} == set(got[4])
    for r in rows:
        ids = public.encode(got[4][r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest() and bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids)
        assert r.n_tokens == len(ids) and r.decoded_sha256 == brute.sha(public.decode(ids, skip_special_tokens=False))


def test_stages_keep_the_columns(spark, sf, stages):
    given = spark.read.parquet(f"{sf}/documents.parquet")
    for _, df in stages[:4]:
        assert df.dtypes == given.dtypes
        assert df.filter(F.col("n_chars") != F.char_length("text")).count() == 0


def test_run_equals_the_stages(spark, sf, stages):
    whole = {r.doc_id: r.ids_sha256 for r in P.run(spark, sf).collect()}
    assert whole == {r.doc_id: r.ids_sha256 for r in stages[-1][1].collect()}


def test_odd_and_no_rows(spark, sf):
    given = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(k, t, None, None, None) for k, t in brute.ODD], given.schema)
    for rows in (odd, odd.limit(0)):
        n = rows.count()
        for name, stage in P.STAGES:
            rows = stage(spark, rows, sf)
            assert rows.count() <= n, name
    kept = odd
    for _, stage in P.STAGES[:4]:
        kept = stage(spark, kept, sf)
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert {None, 900, 903, 904, 906, 907, 909} <= ids and not {901, 902, 905, 908} & ids
