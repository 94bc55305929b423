"""Segmentation of documents into chunks that are exact slices of their text.

A chunker is a function ``Column(text) -> Column(array<struct<heading, text,
start_offset, end_offset>>)``. Being plain expressions they need no shuffle: the
whole document is cut where it was read, and ``posexplode`` numbers the chunks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from annalist.functions import text as tx

Chunker = Callable[[Column], Column]

# Sizes that decide where chunks begin and end.
MIN_PARAGRAPH = 20
OVERLAP = 80
MAX_SECTION = 1500
MIN_SECTION_BODY = 40

# Heading patterns; a heading is one line, so a number or mark alone in its line is none.
_GAP = r"[^\S\n]+"
MARKDOWN_HEADING = rf"^#{{1,6}}{_GAP}.+$"
SECTION_HEADING = rf"^(?:#{{1,6}}{_GAP}.+|[IVXLCDM]+\.{_GAP}.+|\d+(?:\.\d+)*\.?{_GAP}.+|[가-힣]\.{_GAP}.+|【.+?】.*)$"
ROMAN_HEADING = rf"^([IVXLCDM]+)\.{_GAP}(.+)$"
PERIODIC_TITLE = r"(사업보고서|분기보고서|반기보고서)"
BUSINESS_SECTION = "사업의 내용"

CHUNK_TYPE = "array<struct<heading:string,text:string,start_offset:bigint,end_offset:bigint>>"


def _chunk(heading: Column, text: Column, start: Column, end: Column) -> Column:
    return F.struct(
        heading.cast("string").alias("heading"),
        text.alias("text"),
        start.cast("long").alias("start_offset"),
        end.cast("long").alias("end_offset"),
    )


def _trimmed(piece: Column, start: Column, heading: Column) -> Column:
    """The chunk of one piece: white space outside its span is shaved off."""

    def cut(left: Column) -> Column:
        begin = start + F.length(piece) - F.length(left)
        return tx.once(tx.urstrip(left), lambda core: _chunk(heading, core, begin, begin + F.length(core)))

    return tx.once(tx.ulstrip(piece), cut)


def _starts(pieces: Column) -> Column:
    return tx.running_starts(F.transform(pieces, F.length))


def paragraphs(text: Column, min_length: int = 0, heading: Column | None = None, base: Column | None = None) -> Column:
    """Chunks of the runs of lines between empty lines, at least ``min_length`` long."""
    head = F.lit(None) if heading is None else heading
    origin = F.lit(0) if base is None else base
    cut = tx.once(
        tx.pieces_at_paragraphs(text),
        lambda ps: F.zip_with(ps, _starts(ps), lambda p, s: _trimmed(p, s + origin, head)),
    )
    return F.filter(cut, lambda c: F.length(c["text"]) >= max(min_length, 1))


def paragraph_chunks(text: Column, min_length: int = MIN_PARAGRAPH) -> Column:
    return paragraphs(text, min_length)


def overlap_chunks(text: Column, overlap: int = OVERLAP, min_length: int = MIN_PARAGRAPH) -> Column:
    """Paragraphs whose start reaches back into the end of the one before."""

    def located(pieces: Column) -> Column:
        rows = F.zip_with(
            F.zip_with(pieces, _starts(pieces), lambda p, s: F.struct(p.alias("piece"), s.alias("begin"))),
            F.sequence(F.lit(1), F.size(pieces)),
            lambda x, at: F.struct(
                at.alias("at"), x["begin"].alias("begin"), _trimmed(x["piece"], x["begin"], F.lit(None)).alias("c")
            ),
        )
        return F.filter(rows, lambda r: F.length(r["c"]["text"]) >= max(min_length, 1))

    def widen(both: Column) -> Column:
        pieces, found = both["pieces"], both["found"]

        def one(r: Column, i: Column) -> Column:
            c, before = r["c"], F.get(found, i - 1)
            start = F.greatest(before["c"]["start_offset"], before["c"]["end_offset"] - overlap)
            # only the pieces from the previous paragraph to this one are joined
            near = F.array_join(F.slice(pieces, before["at"], r["at"] - before["at"] + 1), "")
            wide = F.substr(near, (start - before["begin"] + 1).cast("int"), (c["end_offset"] - start).cast("int"))
            return F.when(i == 0, c).otherwise(_chunk(F.lit(None), wide, start, c["end_offset"]))

        return F.transform(found, one)

    return tx.once(
        tx.pieces_at_paragraphs(text),
        lambda ps: tx.once(F.struct(ps.alias("pieces"), located(ps).alias("found")), widen),
    )


def _sections(text: Column, heading: str) -> Column:
    """array<struct<piece, start, head>> of the headed sections; what precedes them is dropped."""

    def label(pieces: Column) -> Column:
        both = F.zip_with(
            pieces,
            _starts(pieces),
            lambda p, s: F.struct(p.alias("piece"), s.alias("start"), tx.lead_match(p, heading).alias("head")),
        )
        return F.slice(both, F.lit(2), F.size(both))

    return tx.once(tx.pieces_at(text, heading), label)


def heading_chunks(text: Column, max_section: int = MAX_SECTION) -> Column:
    """One chunk per markdown section; a long section gives one chunk per paragraph."""

    def split_section(s: Column) -> Column:
        head = tx.ustrip(s["head"])
        whole = F.array(_trimmed(s["piece"], s["start"], head))
        body = F.substr(s["piece"], F.length(s["head"]) + 1)
        parts = paragraphs(body, 0, head, s["start"] + F.length(s["head"]))
        return F.when(F.length(s["piece"]) <= max_section, whole).otherwise(parts)

    return tx.once(
        _sections(text, MARKDOWN_HEADING),
        lambda ss: F.when(F.size(ss) == 0, paragraphs(text)).otherwise(F.flatten(F.transform(ss, split_section))),
    )


def section_chunks(text: Column, min_body: int = MIN_SECTION_BODY) -> Column:
    """One chunk per numbered, lettered, bracketed or markdown section.

    A section whose body is shorter than ``min_body`` joins the next one; trailing
    short sections join the last long one. So a chunk ends at each long section,
    except that the last chunk runs to the end.
    """

    def fold(ss: Column) -> Column:
        last = F.size(ss) - 1

        def is_long(i: Column) -> Column:
            s = F.get(ss, i)
            return F.length(s["piece"]) - F.length(tx.ustrip(s["head"])) >= min_body

        def group(longs: Column) -> Column:
            ends = F.when(F.size(longs) == 0, F.array(last)).otherwise(
                F.concat(F.slice(longs, F.lit(1), F.size(longs) - 1), F.array(last))
            )

            def one(end: Column, k: Column) -> Column:
                # a group begins after the long section that closed the one before
                first = F.when(k == 0, F.lit(0)).otherwise(F.get(longs, k - 1) + 1)
                s = F.get(ss, first)
                members = F.slice(ss, first + 1, end - first + 1)
                joined = F.array_join(F.transform(members, lambda x: x["piece"]), "")
                return _trimmed(joined, s["start"], tx.ustrip(s["head"]))

            return F.transform(ends, one)

        return tx.once(F.filter(F.sequence(F.lit(0), last), is_long), group)

    return tx.once(
        _sections(text, SECTION_HEADING),
        lambda ss: F.when(F.size(ss) == 0, paragraphs(text)).otherwise(
            F.filter(fold(ss), lambda c: F.length(c["text"]) > 0)
        ),
    )


def is_periodic_report(title: Column) -> Column:
    return F.coalesce(title, F.lit("")).rlike(PERIODIC_TITLE)


def scoped_section(text: Column, keyword: str = BUSINESS_SECTION) -> Column:
    """struct<text, base>: the first roman-numbered section whose title holds ``keyword``.

    Without such a section the whole text is kept at base 0.
    """

    def pick(ss: Column) -> Column:
        def holds(s: Column) -> Column:
            title = F.regexp_extract(s["head"], rf"(?Udm)\A{ROMAN_HEADING}", 2)
            return F.contains(title, F.lit(keyword))

        hit = F.get(F.filter(ss, holds), F.lit(0))
        return F.struct(
            F.when(hit.isNull(), text).otherwise(hit["piece"]).alias("text"),
            F.coalesce(hit["start"], F.lit(0).cast("long")).alias("base"),
        )

    return tx.once(_sections(text, ROMAN_HEADING), pick)


# Which chunker serves which kind of source; callers may pass their own table.
CHUNKERS: dict[str, Chunker] = {
    "dart": section_chunks,
    "ir": section_chunks,
    "press_release": paragraph_chunks,
    "tech_blog": heading_chunks,
    "ceo_letter": heading_chunks,
    "news": overlap_chunks,
}


def exploded(df: DataFrame, chunks: Column, keep: list[str]) -> DataFrame:
    """One row per chunk with ``chunk_index`` from 0 and the kept columns."""
    return tx.numbered(df, keep, chunks, "chunk_index", "c").select(*keep, "chunk_index", "c.*")


def chunk_documents(
    docs: DataFrame,
    keep: list[str] | None = None,
    chunkers: dict[str, Chunker] | None = None,
    scope_keyword: str = BUSINESS_SECTION,
) -> DataFrame:
    """Chunk ``docs`` (source_type, title, raw_text) by source type in one pass.

    Periodic filings are first cut down to their business section, with offsets
    still counted in the full text. Rows of unknown source types give no chunks;
    see ``unknown_sources``.
    """
    table = chunkers or CHUNKERS
    scoped = docs.withColumn(
        "_scope",
        F.when(
            (F.col("source_type") == "dart") & is_periodic_report(F.col("title")),
            scoped_section(F.col("raw_text"), scope_keyword),
        ).otherwise(F.struct(F.col("raw_text").alias("text"), F.lit(0).cast("long").alias("base"))),
    )
    by_chunker: dict[Chunker, list[str]] = {}
    for source_type, chunker in table.items():
        by_chunker.setdefault(chunker, []).append(source_type)
    choice = F.lit(None).cast(CHUNK_TYPE)
    for chunker, types in by_chunker.items():
        choice = F.when(F.col("source_type").isin(types), chunker(F.col("_scope.text"))).otherwise(choice)
    kept = keep or ["doc_id"]
    out = exploded(scoped.withColumn("base", F.col("_scope.base")), choice, [*kept, "base"])
    return out.select(
        *kept,
        "chunk_index",
        "heading",
        "text",
        (F.col("start_offset") + F.col("base")).alias("start_offset"),
        (F.col("end_offset") + F.col("base")).alias("end_offset"),
    )


def unknown_sources(docs: DataFrame, chunkers: dict[str, Chunker] | None = None) -> DataFrame:
    """Quarantine: documents no chunker is registered for."""
    known = list(chunkers or CHUNKERS)
    return docs.where(~F.coalesce(F.col("source_type"), F.lit("")).isin(known)).withColumn(
        "error", F.concat(F.lit("no chunker for source type "), F.coalesce(F.col("source_type"), F.lit("NULL")))
    )


def replace_chunks(current: DataFrame, fresh: DataFrame, key: str = "doc_id") -> DataFrame:
    """New chunk state: every document in ``fresh`` loses its old chunks."""
    changed = fresh.select(key).distinct()
    return current.join(changed, key, "left_anti").unionByName(fresh)
