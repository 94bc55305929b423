"""Licence scans with a positional index of rare words (operator 9)."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from annalist.llm.tables import clean_names, map_rows, pieces, words

# The base phrases, and opening words of public licence notices with the
# phrases that must stand in them word for word.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["free software", "gnu general public license"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
]

#: Highest-IDF words of a template that are looked up in a file.
RARE_WORDS = 6
#: Share of a notice's words that must stand at their places.
COVERAGE = 0.6


class Template:
    def __init__(self, label: str, text: str, phrases: list[str], base: bool):
        self.label, self.words, self.base = label, words(text), base
        self.phrases = []
        for p in map(words, phrases):
            at = next(i for i in range(len(self.words)) if self.words[i : i + len(p)] == p)
            self.phrases.append((at, p))


def templates() -> list[Template]:
    """The base phrases, which are wholly mandatory, then the notices."""
    return [Template(label, p, [p], True) for p, label in PHRASES.items()] + [Template(label, t, p, False) for label, t, p in NOTICES]


class Index:
    """Postings (template, place in it) of each template's words of highest IDF.

    A template's rare words are taken from its mandatory phrases first, so that a place
    that can pass always holds one of them; ties go to the earlier word.
    """

    def __init__(self, df: dict[bytes, int], n_docs: int):
        self.templates = templates()
        idf = {w: math.log((1 + n_docs) / (1 + df.get(w, 0))) for t in self.templates for w in t.words}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, t in enumerate(self.templates):
            at, phrase = t.phrases[0]
            anchor = max(range(at, at + len(phrase)), key=lambda i: (idf[t.words[i]], -i))
            others = sorted((i for i in range(len(t.words)) if i != anchor), key=lambda i: (-idf[t.words[i]], i))
            for i in [anchor, *others[: RARE_WORDS - 1]]:
                self.postings[t.words[i]].append((k, i))
            t.anchor = anchor
        self.rare = frozenset(self.postings)

    def scan(self, own: list[bytes]) -> tuple[list[tuple[str, int, int, float, bool]], float]:
        """Matches (label, first word, end, share of the template at its place, base) and the file's score."""
        matches = []
        present = self.rare.intersection(own)
        if present:
            # agreeing looked-up words of each template at each place where it would begin
            agree: dict[tuple[int, int], int] = defaultdict(int)
            anchored = set()
            for w in present:
                i = -1
                for _ in range(own.count(w)):
                    i = own.index(w, i + 1)
                    for k, at in self.postings[w]:
                        agree[k, i - at] += 1
                        if self.templates[k].anchor == at:
                            anchored.add((k, i - at))
            for k, start in sorted(anchored):
                t = self.templates[k]
                if not t.base and agree[k, start] < 2:
                    continue
                if any(start + at < 0 or own[start + at : start + at + len(p)] != p for at, p in t.phrases):
                    continue
                size = len(t.words)
                lo = max(start, 0)
                here = sum(a == b for a, b in zip(own[lo : start + size], t.words[lo - start :])) / size
                if t.base or here >= COVERAGE:
                    matches.append((t.label, lo, min(start + size, len(own)), here, t.base))
        whole = max((m[3] for m in matches if not m[4]), default=0.0)
        return matches, max(whole, 0.5 if matches else 0.0)


def word_counts(docs: DataFrame, text: str = "text") -> tuple[dict[bytes, int], int]:
    """Documents that hold each word of the templates, and all documents; the whole table is counted.

    Partial counts are summed per task and then by Spark; what reaches the driver is one row
    per template word.
    """
    known = frozenset(w for t in templates() for w in t.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = defaultdict(int)
        for batch in batches:
            for part in pieces(batch):
                for t in part.column(0).to_pylist():
                    total[b""] += 1
                    for w in known.intersection(words(t)):
                        total[w] += 1
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.binary()), "n": pa.array(list(total.values()), pa.int64())})

    rows = clean_names(docs, text).mapInArrow(run, "word binary, n long").groupBy("word").sum("n").collect()
    counts = {bytes(r[0]): r[1] for r in rows}
    return counts, counts.pop(b"", 0)


MATCHES = "array<struct<label:string,first:long,end:long,share:double,base:boolean>>"


def licences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, matches, score): licence notices and base phrases in each whole text.

    A template is looked up by its words of highest IDF over all documents; looked-up words
    must agree on where it begins, its mandatory phrases must stand there word for word,
    and a notice needs ``COVERAGE`` of its words in place. A base phrase counts at every
    place it stands. ``score`` is the best share of a notice, at least 0.5 where a base
    phrase stands, else 0. Null and empty texts have no words and no matches; ties and
    repeated rows are scored alike; an empty table gives no rows.
    """
    df, n = word_counts(docs, text)
    rows = clean_names(docs, key, text)

    def make() -> Callable[[pa.RecordBatch], dict]:
        index = Index(df, n)
        kind = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("share", pa.float64()), ("base", pa.bool_())]))

        def of(b: pa.RecordBatch) -> dict:
            counts, found, scores = [], [], []
            for t in b.column(1).to_pylist():
                own = words(t)
                matches, score = index.scan(own)
                counts.append(len(own))
                found.append([dict(zip(("label", "first", "end", "share", "base"), m)) for m in matches])
                scores.append(score)
            return {key: b.column(0), "n_words": pa.array(counts, pa.int64()), "matches": pa.array(found, kind), "score": pa.array(scores, pa.float64())}

        return of

    return map_rows(rows, make, f"`{key}` {rows.schema[key].dataType.simpleString()}, n_words long, matches {MATCHES}, score double")
