import itertools
import random
import struct
import zlib

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tests.llm import brute
from tokenizers import Tokenizer

from annalist.llm import packing
from annalist.llm.encoders import WordIds
from annalist.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def public():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return WordIds(open(PATH, encoding="utf-8").read())


def ids_of(public, text):
    return [*public.encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x32F, exclude_categories=["Cs"]), max_size=40))
def test_ids_of_texts(public, own, text):
    assert own.ids(text) == public.encode(text, add_special_tokens=False).ids


def test_ids_of_all_plain_characters_beside_marks_and_letters(public, own):
    for c in map(chr, range(1, 0x300)):
        for text in (c, f":{c}", f"a{c}", f"{c}a", f"1{c}", f" {c} "):
            assert own.ids(text) == public.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|", "I'll", "ΑΣ", "é", "日本", "a1²", "\x1c", " ", "\n", "...!", "x" * 600, " " * 600, "ª", "_"]), max_size=8))
def test_ids_of_odd_marks(public, own, parts):
    text = "".join(parts)
    assert own.ids(text) == public.encode(text, add_special_tokens=False).ids


def best_exchange(bins, sizes, capacity):
    """Largest gain of any exchange from a bin to one that is not emptier, by trying all."""
    gain = 0
    for a, b in itertools.permutations(range(len(bins)), 2):
        fill = [sum(sizes[i] for i in bins[x]) for x in (a, b)]
        if fill[0] > fill[1] or fill[1] == capacity:
            continue
        for n, m in ((1, 0), (1, 1), (2, 1), (1, 2)):
            for come in itertools.combinations(bins[a], n):
                for go in itertools.combinations(bins[b], m):
                    d = sum(sizes[i] for i in come) - sum(sizes[i] for i in go)
                    if d <= capacity - fill[1]:
                        gain = max(gain, d)
    return gain


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=14), st.randoms(use_true_random=False))
def test_search_ends_where_no_exchange_is_left(sizes, rng):
    order = list(range(len(sizes)))
    rng.shuffle(order)
    bins = [[i] for i in order]
    out = packing.LocalSearch(sizes, bins, 40).run()
    assert sorted(i for b in out for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 40 for b in out)
    assert best_exchange(out, sizes, 40) == 0
    if len(sizes) <= 9:
        assert len(out) <= len(packing.best_fit(sizes, order, 40)) + 1


def test_exchanges_empty_bins_and_raise_squared_fill():
    rng = random.Random(5)
    sizes = [rng.randint(200, 1200) for _ in range(1500)]
    first = packing.best_fit(sizes, range(1500), 2048)
    search = packing.LocalSearch(sizes, first, 2048)
    squares, total = [sum(f * f for f in search.fill)], search._hand

    def hand(a, b, taken):
        total(a, b, taken)
        squares.append(sum(f * f for f in search.fill))

    search._hand = hand
    out = search.run()
    # an exchange hands over twice: what comes and what goes
    assert all(x < y for x, y in zip(squares[::2], squares[2::2]))
    assert set(search.changes) == {"move", "one_for_one", "two_for_one", "one_for_two"}
    assert len(out) < len(first) and len(out) <= 1.01 * sum(sizes) / 2048 + 1


def laid_out(rows):
    """Sequences as lists of (offset, length), checked to be gapless and not too long."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    return by


@pytest.mark.parametrize("block", [packing.BLOCK, 32])
def test_levels_of_blocks_lose_nothing(spark, block):
    of = spark.range(3000).select(F.col("id").alias("uid"), (F.pmod(F.xxhash64("id"), F.lit(1400)) + 1).cast("int").alias("length"))
    rows = packing.placed(of, block=block).join(of, "uid").collect()
    assert sorted(r.uid for r in rows) == list(range(3000))
    by = laid_out(rows)
    least = sum(r.length for r in rows) / 2048
    assert len(by) <= (1.01 if block == packing.BLOCK else 1.1) * least + 1


def test_odd_rows(spark, public):
    docs = brute.docs(spark)
    rows = packing.packed(docs, PATH, capacity=64).collect()
    expected = []
    for k, t in brute.ODD:
        ids = ids_of(public, t)
        expected += [(k or -1, i, at, ids[at : at + 64]) for i, at in enumerate(range(0, len(ids), 64))]
    assert sorted((r.doc_id or -1, r.piece, r.start, list(struct.unpack(f"<{r.length}I", r.ids))) for r in rows) == sorted(expected)
    laid_out(rows)
    assert packing.packed(brute.docs(spark, []), PATH).count() == 0
    whole = {r.sequence: r for r in packing.sequences(packing.packed(docs, PATH)).collect()}
    assert sum(r.length for r in whole.values()) == sum(len(ids_of(public, t)) for _, t in brute.ODD)
    assert all(len(r.ids) == 4 * r.length == 4 * sum(p.length for p in r.parts) for r in whole.values())


def test_query(spark, public, sf):
    rows = QUERIES["op11_packing"](spark, sf).withColumnRenamed("sequence_id", "sequence").collect()
    expected = []
    for d in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = ids_of(public, d.text)
        for i, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            expected.append((d.doc_id, i, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(expected)
    by = laid_out(rows)
    assert len(by) <= -(-sum(r.length for r in rows) // 2048) + 2
