import hashlib
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tests.llm import brute
from tokenizers import Tokenizer

from annalist.llm import bpe
from annalist.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def public():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.Bpe(open(PATH, encoding="utf-8").read())


def same(public, own, text):
    ids = public.encode(text, add_special_tokens=False).ids
    packed = own.encode(text)
    assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == ids
    assert own.decode(packed) == public.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x2FF), max_size=40))
def test_latin_texts(public, own, text):
    same(public, own, text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|", "I'll", "ΑΣ", "é", "日本", "a1²", "\x1c", " ", "\n", "...!"]), max_size=8))
def test_special_tokens_and_marks(public, own, parts):
    same(public, own, "".join(parts))


def test_long_words_merge_alike(public, own, monkeypatch):
    for n in (1, 2, 399, 400, 401, 3000):
        same(public, own, "theinandreonstou" * n)
    monkeypatch.setattr(bpe, "SHORT_WORD", 0)
    same(public, bpe.Bpe(open(PATH, encoding="utf-8").read()), "internationalisation of thelonging words")


def test_round_trip_of_odd_rows(spark, public):
    out = bpe.decode(bpe.encode(brute.docs(spark), PATH), PATH).collect()
    assert len(out) == len(brute.ODD)
    expected = sorted((k or -1, public.encode(t or "", add_special_tokens=False).ids) for k, t in brute.ODD)
    assert sorted((r.doc_id or -1, list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids))) for r in out) == expected
    assert all(r.decoded == public.decode(list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids)), skip_special_tokens=False) for r in out)
    once = bpe.encode(brute.docs(spark), PATH, decoded=True).collect()
    assert sorted(map(str, once)) == sorted(map(str, out))
    assert bpe.encode(brute.docs(spark, []), PATH).count() == 0


def test_query(spark, public, sf):
    rows = {r.doc_id: r for r in QUERIES["op5_bpe"](spark, sf).collect()}
    given_docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(given_docs)
    for d in given_docs:
        ids = public.encode(d.text or "", add_special_tokens=False).ids
        r = rows[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == brute.sha(public.decode(ids, skip_special_tokens=False))
