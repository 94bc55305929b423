"""Independent SQL statements of the segmentation rules, used only to check results."""

from __future__ import annotations

HEAD = r"^#{1,6}\s+.+$"
SECTION = r"^(#{1,6}\s+.+|[IVXLCDM]+\.\s+.+|\d+(\.\d+)*\.?\s+.+|[가-힣]\.\s+.+|【.+?】.*)$"


def lines(source: str, out: str, pattern: str) -> str:
    """Numbered lines of t per doc_id with their offsets and whether they are headings."""
    return f"""{out}_raw AS (
  SELECT doc_id, t, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM {source}),
{out} AS (
  SELECT doc_id, line, i, regexp_matches(line, '{pattern}') AS is_h,
    coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st,
    sum(CASE WHEN regexp_matches(line, '{pattern}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS sec,
    sum(CASE WHEN line = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS gap
  FROM {out}_raw)"""


def trimmed(relation: str, out: str, extra: str = "") -> str:
    """Trim column s of a relation (doc_id, st, s, ...); blank rows go."""
    more = f", {extra}" if extra else ""
    return f"""{out} AS (
  SELECT doc_id{more}, regexp_replace(s, '^\\s+|\\s+$', '', 'g') AS text,
    st + length(s) - length(regexp_replace(s, '^\\s+', '')) AS start_offset,
    st + length(s) - length(regexp_replace(s, '^\\s+', '')) + length(regexp_replace(s, '^\\s+|\\s+$', '', 'g')) AS end_offset
  FROM {relation} WHERE regexp_replace(s, '^\\s+|\\s+$', '', 'g') <> '')"""


def paragraphs(source: str, out: str) -> str:
    return (
        lines(source, f"{out}_l", HEAD)
        + f""",
{out}_g AS (SELECT doc_id, gap, min(st) AS st, string_agg(line, chr(10) ORDER BY i) AS s FROM {out}_l WHERE line <> '' GROUP BY doc_id, gap),
"""
        + trimmed(f"{out}_g", out)
    )


def overlap(source: str, out: str) -> str:
    return (
        paragraphs(source, f"{out}_p")
        + f""",
{out}_o AS (
  SELECT doc_id, end_offset, coalesce(greatest(
      lag(start_offset) OVER w, lag(end_offset) OVER w - 80), start_offset) AS start_offset
  FROM {out}_p WHERE length(text) >= 20 WINDOW w AS (PARTITION BY doc_id ORDER BY start_offset)),
{out} AS (
  SELECT o.doc_id, substr(x.t, CAST(o.start_offset + 1 AS BIGINT), CAST(o.end_offset - o.start_offset AS BIGINT)) AS text,
    o.start_offset, o.end_offset FROM {out}_o o JOIN {source} x USING (doc_id))"""
    )


def headings(source: str, out: str) -> str:
    return (
        lines(source, f"{out}_l", HEAD)
        + f""",
{out}_n AS (SELECT doc_id, max(i) AS last, max(sec) AS secs FROM {out}_l GROUP BY doc_id),
{out}_s AS (
  SELECT doc_id, sec, min(st) AS st, max(CASE WHEN is_h THEN regexp_replace(line, '^\\s+|\\s+$', '', 'g') END) AS heading,
    string_agg(line || CASE WHEN i < last THEN chr(10) ELSE '' END, '' ORDER BY i) AS s
  FROM {out}_l JOIN {out}_n USING (doc_id) WHERE sec > 0 GROUP BY doc_id, sec),
{out}_long AS (SELECT doc_id, sec FROM {out}_s WHERE length(s) > 1500 UNION ALL SELECT doc_id, 0 FROM {out}_n WHERE secs = 0),
{out}_a AS (SELECT doc_id, st, heading, s FROM {out}_s WHERE length(s) <= 1500
  UNION ALL
  SELECT l.doc_id, min(l.st), any_value(h.heading), string_agg(l.line, chr(10) ORDER BY l.i)
  FROM {out}_l l JOIN {out}_long g USING (doc_id, sec) LEFT JOIN {out}_s h USING (doc_id, sec)
  WHERE l.line <> '' AND NOT l.is_h GROUP BY l.doc_id, l.sec, l.gap),
"""
        + trimmed(f"{out}_a", out, "heading")
    )


def sections(source: str, out: str) -> str:
    return (
        lines(source, f"{out}_l", SECTION)
        + f""",
{out}_n AS (SELECT doc_id, max(i) AS last, max(sec) AS secs FROM {out}_l GROUP BY doc_id),
{out}_s AS (
  SELECT doc_id, sec, min(st) AS st, max(CASE WHEN is_h THEN regexp_replace(line, '^\\s+|\\s+$', '', 'g') END) AS heading,
    string_agg(line || CASE WHEN i < last THEN chr(10) ELSE '' END, '' ORDER BY i) AS s
  FROM {out}_l JOIN {out}_n USING (doc_id) WHERE sec > 0 GROUP BY doc_id, sec),
{out}_b AS (
  SELECT *, length(s) - length(heading) >= 40 AS big,
    coalesce(sum(CASE WHEN length(s) - length(heading) >= 40 THEN 1 ELSE 0 END)
      OVER (PARTITION BY doc_id ORDER BY sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(CASE WHEN length(s) - length(heading) >= 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS bigs
  FROM {out}_s),
{out}_a AS (
  SELECT doc_id, min(st) AS st, arg_min(heading, sec) AS heading, string_agg(s, '' ORDER BY sec) AS s
  FROM {out}_b GROUP BY doc_id, greatest(least(before, bigs - 1), 0)
  UNION ALL
  SELECT doc_id, min(st), NULL, string_agg(line, chr(10) ORDER BY i)
  FROM {out}_l JOIN {out}_n USING (doc_id) WHERE secs = 0 AND line <> '' GROUP BY doc_id, gap),
"""
        + trimmed(f"{out}_a", out, "heading")
    )


def numbered(relation: str, heading: str = "heading", where: str = "") -> str:
    """Final select of chunks with their index."""
    return (
        f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start_offset, end_offset) - 1 AS INTEGER) AS chunk_index, "
        f"{heading} AS heading, text, CAST(start_offset AS BIGINT) AS start_offset, CAST(end_offset AS BIGINT) AS end_offset "
        f"FROM {relation} {where}"
    )


NULL_TEXT = "CAST(NULL AS VARCHAR)"
