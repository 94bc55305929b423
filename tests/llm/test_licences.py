from tests.llm import brute

from annalist.llm import licences as L
from annalist.llm.queries import QUERIES

TEXTS = [
    (1, "Licensed under CC BY-NC 4.0."), (2, "cc by cc by cc-by"), (3, "This work is licensed under the GNU General Public License, version 3."),
    (4, "All rights reserved. all  RIGHTS, reserved"), (5, "Released under the MIT License."), (6, "general public licence all rights"),
    (7, "x " * 5000 + "Licensed under the Apache License, Version 2.0."), (8, "by cc"), (9, "license license license mit license"),
    (10, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
]


def expected(text):
    own = brute.words(text)
    found = []
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(own)) if own[i : i + len(p)] == p]
    return len(own), sorted(found)


def check(rows, texts):
    for k, t in texts:
        n, found = expected(t)
        for r in rows.get(k, []):
            assert r.n_words == n
            assert sorted((m["first"], m["label"]) for m in r.matches if m["base"]) == found
            assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.matches)


def test_base_phrases_and_notices(spark):
    got = {}
    for r in L.licences(brute.docs(spark, TEXTS)).collect():
        got.setdefault(r.doc_id, []).append(r)
    check(got, TEXTS)
    labels = {k: {m["label"] for m in v[0].matches} for k, v in got.items()}
    assert labels[1] == {"cc-by", "cc-by-nc"} and labels[3] == {"gpl", "gpl-3.0"} and labels[5] == {"mit"} and labels[7] == {"apache-2.0"}
    assert labels[10] == {"mit"} and not labels[6] and not labels[8]


def test_odd_rows(spark):
    got = {}
    for r in L.licences(brute.docs(spark)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(brute.ODD)
    check(got, brute.ODD)
    assert L.licences(brute.docs(spark, [])).count() == 0


def test_counts_cover_all_documents(spark):
    counts, n = L.word_counts(brute.docs(spark, TEXTS))
    assert n == len(TEXTS) and counts[b"cc"] == 3 and counts[b"license"] == 4


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = {r.doc_id: r for r in QUERIES["op9_licences"](spark, sf).collect()}
    for d in docs:
        n, found = expected(d.text)
        r = rows[d.doc_id]
        assert (r.n_words, r.n_base) == (n, len(found))
        assert (r.first_word, r.last_word) == ((found[0][0], found[-1][0]) if found else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in found})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert any(r.n_base for r in rows.values())
