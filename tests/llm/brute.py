"""Plain sequential versions of the operators, and odd rows for them."""

from __future__ import annotations

import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}

#: (doc_id, text) with every odd case: null, empty, blank, very long, ties, repeats.
ODD = [
    (None, "a text without an id"), (900, None), (901, ""), (902, "   \n\t "), (903, "one"), (904, "one two"), (905, "ONE two"),
    (906, "x" * 5000 + " " + "word " * 3000), (907, "same text here again"), (908, "same text here again"), (908, "same text here again"),
    (909, "éÉİ 你好 \x1c\x85 ퟿"), (910, "\x00\x7f[]{}"),
]


def docs(spark, rows=None, extra=True):
    """Documents with columns whose names clash with the operators' own."""
    rows = ODD if rows is None else rows
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    return spark.createDataFrame([(*r, "en", "s", 1, [2], "k") for r in rows], "doc_id long, text string, lang string, source string, fp int, ids array<int>, key string")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def fingerprint(text, size=3):
    own = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(own[i : i + size]) for i in range(max(1, len(own) - size + 1))] if own else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(n, linked):
    """Least index reachable by links, for each index."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
