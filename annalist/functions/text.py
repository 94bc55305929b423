"""Text helpers as column expressions; every offset is a code-point offset."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, functions as F

# The white-space class of a Unicode strip, in Java syntax.
SPACE = r"[\s\x1c-\x1f]"
# Quote characters and what they normalise to.
CURLY = "“”‘’«»"
STRAIGHT = "\"\"''\"\""

_MARK = "\u0001"
_BLOCK = 256


def ustrip(c: Column) -> Column:
    """Strip Unicode white space on both sides."""
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def ulstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+", "")


def urstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){SPACE}+\z", "")


def key(c: Column) -> Column:
    """Blocking key: trimmed and lower-cased; '' counts as missing *before* trimming."""
    return F.when(F.length(c) > 0, F.lower(ustrip(c)))


def filled(c: Column) -> Column:
    """NULL for an empty string."""
    return F.when(F.length(c) > 0, c)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and build on it (a let-binding)."""
    return F.transform(F.array(value), use)[0]


def numbered(df: DataFrame, keep: list[str], items: Column, pos: str, item: str) -> DataFrame:
    """One row per array element with its position from 0.

    The outer form plus a filter gives the rows of ``posexplode``, but keeps the optimizer
    from adding a check of the array below the shuffle, which would compute it again there.
    """
    return df.select(*keep, F.posexplode_outer(items).alias(pos, item)).where(F.col(pos).isNotNull())


def running_starts(lengths: Column) -> Column:
    """Exclusive prefix sums of an int array, in blocks so that long arrays stay cheap."""

    def scan(items: Column, base: Column) -> Column:
        first = F.struct(base.cast("long").alias("at"), F.array().cast("array<long>").alias("out"))
        return F.aggregate(
            items,
            first,
            lambda acc, n: F.struct(
                (acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")
            ),
            lambda acc: acc["out"],
        )

    def total(items: Column) -> Column:
        return F.aggregate(items, F.lit(0).cast("long"), lambda a, n: a + n)

    def build(ns: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(ns) - 1) / F.lit(_BLOCK)).cast("int")),
            lambda b: F.slice(ns, b * _BLOCK + 1, F.lit(_BLOCK)),
        )
        bases = scan(F.transform(blocks, total), F.lit(0))
        return (
            F.when(F.size(ns) == 0, F.array().cast("array<long>"))
            .when(F.size(ns) <= _BLOCK, scan(ns, F.lit(0)))
            .otherwise(F.flatten(F.zip_with(blocks, bases, scan)))
        )

    return once(lengths, build)


def pieces_at_paragraphs(text: Column) -> Column:
    """Cut after every run of two or more newlines; concatenation gives the text back."""
    return F.split(text, r"(?<=\n\n)(?=[^\n])", -1)


def pieces_at(text: Column, heading: str) -> Column:
    """Cut before every (non-overlapping) match of ``heading``.

    Element 0 is what stands before the first match; concatenation gives the text
    back. A text that already holds the mark is cut with a stand-in of equal length
    and its pieces are then taken from the original.
    """
    safe = F.translate(text, _MARK, "\u0002")
    marked = F.regexp_replace(safe, f"(?Udm){heading}", _MARK + "$0")
    pieces = F.split(marked, _MARK, -1)
    original = once(
        pieces,
        lambda ps: F.zip_with(
            ps,
            running_starts(F.transform(ps, F.length)),
            lambda p, s: F.substring(text, (s + 1).cast("int"), F.length(p)),
        ),
    )
    return F.when(F.contains(text, F.lit(_MARK)), original).otherwise(pieces)


def lead_match(piece: Column, heading: str) -> Column:
    """The heading a piece of ``pieces_at`` begins with, untrimmed."""
    return F.regexp_extract(piece, rf"(?Udm)\A(?:{heading})", 0)


def sentences(text: Column) -> Column:
    """Split after . ! ? or newline followed by white space; trimmed, blanks dropped."""
    parts = F.transform(F.split(text, rf"(?U)(?<=[.!?\n]){SPACE}+", -1), ustrip)
    return F.filter(parts, lambda s: F.length(s) > 0)


def normalise(text: Column) -> Column:
    """Straight quotes, white-space runs as one space, lower case (not stripped)."""
    spaced = F.regexp_replace(F.translate(text, CURLY, STRAIGHT), rf"(?U){SPACE}+", " ")
    return F.lower(spaced)


def normalised_span(text: Column, start: Column, end: Column) -> Column:
    """Map a half-open span of ``normalise(text)`` back to ``text``.

    Texts without a run of two white-space characters map one to one; only the
    others pay for the index array.
    """

    def kept_places(chars: Column) -> Column:
        blanks = F.transform(chars, lambda ch: ch.rlike(rf"(?U)\A{SPACE}\z"))
        return once(
            blanks,
            lambda bs: F.filter(
                F.sequence(F.lit(0), F.size(bs) - 1), lambda i: (i == 0) | ~(F.get(bs, i) & F.get(bs, i - 1))
            ),
        )

    stop = F.greatest(end, start + 1)
    simple = ~text.rlike(rf"(?U){SPACE}{SPACE}")
    n = F.length(text)

    def span(first: Column, last: Column) -> Column:
        return F.struct(first.cast("int").alias("start"), (last + 1).cast("int").alias("end"))

    mapped = once(
        once(F.split(text, ""), kept_places),
        lambda ks: span(F.get(ks, F.least(start, F.size(ks) - 1)), F.get(ks, F.least(stop, F.size(ks)) - 1)),
    )
    return F.when(simple, span(F.least(start, n - 1), F.least(stop, n) - 1)).otherwise(mapped)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def unescape(text: Column, names: dict[str, int] = name2codepoint) -> Column:
    """Resolve named and numeric character references in one pass; unknown ones stay."""
    table = F.create_map(*[F.lit(x) for name, code in names.items() for x in (name, chr(code))], F.lit("apos"), F.lit("'"))

    def resolve(part: Column, i: Column) -> Column:
        name = F.regexp_extract(part, r"\A(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        digits = F.substr(name, F.lit(2))
        code = F.when(F.lower(digits).startswith("x"), F.conv(F.substr(digits, F.lit(2)), 16, 10)).otherwise(digits)
        number = F.decode(F.unhex(F.lpad(F.hex(code.try_cast("long")), 8, "0")), "UTF-32")
        char = F.when(name.startswith("#"), number).otherwise(table[name])
        found = F.concat(char, F.substr(part, F.length(name) + 2))
        return F.when(i == 0, part).otherwise(F.coalesce(found, F.concat(F.lit("&"), part)))

    fixed = F.array_join(F.transform(F.split(text, "&", -1), resolve), "")
    return F.when(F.contains(text, F.lit("&")), fixed).otherwise(text)


def html_to_text(html: Column) -> Column:
    """Text nodes, stripped, blanks dropped, one per line; scripts, styles and comments go."""
    bare = F.regexp_replace(
        html, r"(?is)<!--.*?-->|<!doctype[^>]*>|<script\b.*?</script\s*>|<style\b.*?</style\s*>", "<x>"
    )
    nodes = F.transform(F.split(bare, "<[^>]*>", -1), lambda s: ustrip(unescape(s)))
    return F.array_join(F.filter(nodes, lambda s: F.length(s) > 0), "\n")
