"""Hashed bag-of-words vectors and cosine scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BUCKETS = 32
_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def hashed_vector(text: Column) -> Column:
    """32 word counts by the first sha-256 byte of each word, scaled to length one.

    Each word becomes one symbol of a 32-letter alphabet, so the counts are string
    length differences instead of one pass over an array per word.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    symbol = lambda w: F.substring(
        F.lit(_SYMBOLS), F.conv(F.substring(F.sha2(w, 256), 1, 2), 16, 10).cast("int") % BUCKETS + 1, F.lit(1)
    )
    row = F.array_join(F.transform(words, symbol), "")
    counted = lambda r: F.array(
        *[(F.length(r) - F.length(F.replace(r, F.lit(s), F.lit("")))).cast("double") for s in _SYMBOLS]
    )
    # the one-element array makes the symbol row, then the counts, a value that is computed once
    return F.transform(F.transform(F.array(row), counted), scaled)[0]


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def scaled(v: Column) -> Column:
    """Divide by the norm; a zero vector stays zero."""
    packed = F.struct(v.alias("v"), norm(v).alias("n"))
    return F.transform(
        F.array(packed),
        lambda p: F.transform(p["v"], lambda x: x / F.when(p["n"] == 0, F.lit(1.0)).otherwise(p["n"])),
    )[0]


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, cut to the shorter one for the dot product; 0 for a zero norm."""
    n = F.least(F.size(a), F.size(b))
    dot = F.aggregate(
        F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda s, x: s + x,
    )
    size_a = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size_b = F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((size_a == 0) | (size_b == 0), F.lit(0.0)).otherwise(dot / (size_a * size_b))
