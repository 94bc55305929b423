"""Named queries over the given tables, each with an independent SQL statement where one exists.

``QUERIES`` maps a name to ``(spark, sf_dir) -> DataFrame``; ``ORACLES`` maps it to SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from annalist.functions import dates, text as tx
from annalist.functions.vectors import hashed_vector
from annalist.operators import (
    chunking as ch,
    clustering as cl,
    dedupe as dd,
    evidence as ev,
    extraction as ex,
    lookups as lk,
    pairs as pr,
    ranking as rk,
    review as rv,
    threading as th,
    upserts as up,
)
from annalist.plans import reports as rp, sqltext as sq, tables as tb
from annalist.session import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def six(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ---------------------------------------------------------------- segmentation

CHUNK = ["doc_id", "chunk_index", "heading", "text", "start_offset", "end_offset"]


def _texts(spark: SparkSession, sf_dir: str, t: Column) -> DataFrame:
    return tb.read(spark, sf_dir, "documents").select("doc_id", t.alias("t"))


def _spaced() -> Column:
    """Line breaks doubled: every line becomes a paragraph."""
    return F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))


def _headed() -> Column:
    """Every line a markdown section: its first sentence the heading, the others paragraphs."""
    return F.concat(
        F.lit("# "),
        F.replace(F.replace(F.col("text"), F.lit("\n"), F.lit("\n# ")), F.lit(". "), F.lit(".\n\n")),
    )


def _numbered() -> Column:
    """Every line a numbered section, one sentence a line; short ones exercise folding."""
    return F.concat(
        F.lit("2 "),
        F.replace(F.replace(F.col("text"), F.lit("\n"), F.lit("\n2 ")), F.lit(". "), F.lit(".\n")),
    )


SPACED_SQL = "src AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents)"
HEADED_SQL = (
    "src AS (SELECT doc_id, '# ' || replace(replace(text, chr(10), chr(10) || '# '), '. ', '.' || chr(10) || chr(10)) AS t FROM documents)"
)
NUMBERED_SQL = (
    "src AS (SELECT doc_id, '2 ' || replace(replace(text, chr(10), chr(10) || '2 '), '. ', '.' || chr(10)) AS t FROM documents)"
)


@query(
    "chunk_paragraphs",
    f"WITH {SPACED_SQL}, {sq.paragraphs('src', 'p')} {sq.numbered('p', sq.NULL_TEXT, 'WHERE length(text) >= 20')}",
)
def chunk_paragraphs(spark, sf_dir):
    return ch.exploded(_texts(spark, sf_dir, _spaced()), ch.paragraph_chunks(F.col("t")), ["doc_id"])


@query("chunk_overlap", f"WITH {SPACED_SQL}, {sq.overlap('src', 'p')} {sq.numbered('p', sq.NULL_TEXT)}")
def chunk_overlap(spark, sf_dir):
    return ch.exploded(_texts(spark, sf_dir, _spaced()), ch.overlap_chunks(F.col("t")), ["doc_id"])


@query("chunk_headings", f"WITH {HEADED_SQL}, {sq.headings('src', 'p')} {sq.numbered('p')}")
def chunk_headings(spark, sf_dir):
    return ch.exploded(_texts(spark, sf_dir, _headed()), ch.heading_chunks(F.col("t")), ["doc_id"])


@query("chunk_sections", f"WITH {NUMBERED_SQL}, {sq.sections('src', 'p')} {sq.numbered('p')}")
def chunk_sections(spark, sf_dir):
    return ch.exploded(_texts(spark, sf_dir, _numbered()), ch.section_chunks(F.col("t")), ["doc_id"])


SCOPE_WORD = "tion"


@query(
    "scope_section",
    f"""WITH src AS (SELECT doc_id, 'I. ' || replace(text, chr(10), chr(10) || 'I. ') AS t FROM documents),
{sq.lines('src', 'l', sq.SECTION)},
hit AS (SELECT doc_id, min(i) AS i FROM l WHERE contains(substr(line, 4), '{SCOPE_WORD}') GROUP BY doc_id)
SELECT s.doc_id, CAST(coalesce(l.st, 0) AS BIGINT) AS base,
  coalesce(l.line || CASE WHEN n.i IS NULL THEN '' ELSE chr(10) END, s.t) AS text
FROM src s LEFT JOIN hit h USING (doc_id) LEFT JOIN l ON l.doc_id = s.doc_id AND l.i = h.i
LEFT JOIN l n ON n.doc_id = s.doc_id AND n.i = h.i + 1""",
)
def scope_section(spark, sf_dir):
    t = F.concat(F.lit("I. "), F.replace(F.col("text"), F.lit("\n"), F.lit("\nI. ")))
    rows = _texts(spark, sf_dir, t).withColumn("s", ch.scoped_section(F.col("t"), SCOPE_WORD))
    return rows.select("doc_id", "s.base", "s.text")


@query(
    "chunk_dispatch",
    f"""WITH {tb.DOCUMENTS_SQL},
a AS (SELECT doc_id, raw_text AS t FROM docs WHERE source_type IN ('dart', 'ir')),
b AS (SELECT doc_id, raw_text AS t FROM docs WHERE source_type = 'press_release'),
c AS (SELECT doc_id, raw_text AS t FROM docs WHERE source_type IN ('tech_blog', 'ceo_letter')),
d AS (SELECT doc_id, raw_text AS t FROM docs WHERE source_type = 'news'),
{sq.sections('a', 'pa')}, {sq.paragraphs('b', 'pb')}, {sq.headings('c', 'pc')}, {sq.overlap('d', 'pd')},
allp AS (
  SELECT doc_id, heading, text, start_offset, end_offset FROM pa
  UNION ALL SELECT doc_id, NULL, text, start_offset, end_offset FROM pb WHERE length(text) >= 20
  UNION ALL SELECT doc_id, heading, text, start_offset, end_offset FROM pc
  UNION ALL SELECT doc_id, NULL, text, start_offset, end_offset FROM pd)
{sq.numbered('allp')}""",
)
def chunk_dispatch(spark, sf_dir):
    return ch.chunk_documents(tb.documents(spark, sf_dir))


# ---------------------------------------------------------------- markup

BARE_SQL = (
    "regexp_replace(html, '(?is)<!--.*?-->|<!doctype[^>]*>|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', '<x>', 'g')"
)


@query(
    "html_to_text",
    f"""WITH n AS (SELECT page_id, string_split_regex({BARE_SQL}, '<[^>]*>') AS parts FROM pages)
SELECT page_id, array_to_string(list_filter(list_transform(parts, lambda x: regexp_replace(
  replace(replace(replace(replace(replace(replace(x, '&middot;', chr(183)), '&copy;', chr(169)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'),
  '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), chr(10)) AS text FROM n""",
)
def html_to_text(spark, sf_dir):
    return tb.read(spark, sf_dir, "pages").select("page_id", tx.html_to_text(F.col("html")).alias("text"))


@query("strip_tags", "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS text FROM pages")
def strip_tags(spark, sf_dir):
    return tb.read(spark, sf_dir, "pages").select("page_id", tx.strip_tags(F.col("html")).alias("text"))


# ---------------------------------------------------------------- ingestion state


def _deliveries(spark, sf_dir) -> DataFrame:
    """Documents of one source and id ending as successive deliveries of one document."""
    return tb.documents(spark, sf_dir).withColumns(
        {"delivery": F.col("doc_id"), "external_id": (F.col("doc_id") % 10).cast("string"), "source_type": F.lit("news")}
    ).drop("doc_id")


DELIVERIES_SQL = f"""{tb.DOCUMENTS_SQL},
deliv AS (SELECT company_id, 'news' AS source_type, CAST(doc_id % 10 AS VARCHAR) AS external_id, doc_id AS delivery,
  title, published_date, is_official, raw_text, sha256(raw_text) AS content_hash FROM docs),
steps AS (SELECT *, CASE WHEN lag(content_hash) OVER w = content_hash THEN 0 ELSE 1 END AS step,
  first_value(is_official) OVER w AS official FROM deliv
  WINDOW w AS (PARTITION BY company_id, external_id ORDER BY delivery)),
vers AS (SELECT *, CAST(sum(step) OVER (PARTITION BY company_id, external_id ORDER BY delivery) AS BIGINT) AS version FROM steps)"""


@query(
    "document_versions",
    f"WITH {DELIVERIES_SQL} SELECT company_id, source_type, external_id, delivery, content_hash, version, step = 1 AS changed FROM vers",
)
def document_versions(spark, sf_dir):
    return up.document_versions(_deliveries(spark, sf_dir))


@query(
    "versioned_upsert",
    f"""WITH {DELIVERIES_SQL} SELECT company_id, source_type, external_id, version, title, published_date,
raw_text, content_hash, official AS is_official FROM vers WHERE step = 1
QUALIFY row_number() OVER (PARTITION BY company_id, external_id ORDER BY delivery DESC) = 1""",
)
def versioned_upsert(spark, sf_dir):
    return up.upsert_documents(_deliveries(spark, sf_dir))


@query(
    "document_snapshots",
    f"""WITH {DELIVERIES_SQL} SELECT company_id, source_type, external_id, delivery, content_hash, version, raw_text
FROM vers WHERE step = 1""",
)
def document_snapshots(spark, sf_dir):
    rows = _deliveries(spark, sf_dir)
    return up.document_snapshots(rows, up.document_versions(rows))


@query(
    "ingest_tally",
    f"""WITH {DELIVERIES_SQL} SELECT CAST(sum(step) AS BIGINT) AS ingested, CAST(sum(1 - step) AS BIGINT) AS unchanged,
CAST(0 AS BIGINT) AS failed FROM vers""",
)
def ingest_tally(spark, sf_dir):
    return up.ingest_tally(up.document_versions(_deliveries(spark, sf_dir)))


@query(
    "ingestion_log",
    f"""WITH {DELIVERIES_SQL} SELECT 'dart' AS source, company_id, 'success' AS status,
external_id || ' (changed=' || CASE WHEN step = 1 THEN 'True' ELSE 'False' END || ')' AS detail FROM vers""",
)
def ingestion_log(spark, sf_dir):
    log = up.ingestion_log(up.document_versions(_deliveries(spark, sf_dir)), None, "dart")
    return log.select("source", "company_id", "status", "detail")


@query(
    "news_log",
    f"""WITH {tb.DOCUMENTS_SQL} SELECT DISTINCT 'news' AS source, company_id, 'success' AS status, source_type AS detail FROM docs""",
)
def news_log(spark, sf_dir):
    """Document types as the queries that articles were found by."""
    answers = tb.documents(spark, sf_dir).select("company_id", F.col("source_type").alias("query"))
    return up.query_log(answers, None).select("source", "company_id", "status", "detail")


@query(
    "content_duplicates",
    """SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents
GROUP BY 1 HAVING count(*) > 1""",
)
def content_duplicates(spark, sf_dir):
    rows = tb.read(spark, sf_dir, "documents").select("doc_id", up.content_hash(F.col("text")).alias("content_hash"))
    return rows.groupBy("content_hash").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")
    ).where("copies > 1")


@query(
    "company_dimension",
    f"""WITH {tb.DOCUMENTS_SQL}, {tb.COMPANIES_SQL}
SELECT name, row_number() OVER (ORDER BY substr(sha256(name), 1, 2), name) AS company_id FROM comps""",
)
def company_dimension(spark, sf_dir):
    names = tb.companies(spark, sf_dir).select("name")
    none = names.where("false").withColumn("company_id", F.lit(0).cast("long"))
    return up.get_or_create(none, names).select("name", "company_id")


@query(
    "pending_documents",
    f"""WITH {tb.DOCUMENTS_SQL} SELECT doc_id, company_id, source_type FROM docs d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
)
def pending_documents(spark, sf_dir):
    rows = lk.without(tb.documents(spark, sf_dir), tb.read(spark, sf_dir, "labels"), "doc_id")
    return rows.select("doc_id", "company_id", "source_type")


@query(
    "pending_events",
    f"""WITH {tb.EVENTS_SQL} SELECT e.event_id, e.company_id, e.event_date FROM ev e
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.doc_id)""",
)
def pending_events(spark, sf_dir):
    rows = lk.without(tb.events(spark, sf_dir), tb.read(spark, sf_dir, "labels"), "doc_id")
    return rows.select("event_id", "company_id", "event_date")


@query(
    "official_lineage",
    f"""WITH {tb.DOCUMENTS_SQL}, {tb.EVENTS_SQL} SELECT e.event_id, d.company_id, d.is_official
FROM ev e JOIN docs d USING (doc_id)""",
)
def official_lineage(spark, sf_dir):
    events = tb.events(spark, sf_dir).select("event_id", F.col("doc_id").alias("chunk_id"))
    docs = tb.documents(spark, sf_dir)
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), "doc_id")
    return lk.lineage(events, chunks, docs).select("event_id", "company_id", "is_official")


# ---------------------------------------------------------------- extraction

WORDS = [
    ("hahe", "strategy_announcement", "announce"),
    ("pour", "product_development", "build"),
    ("shblest", "pilot_program", "pilot"),
    ("euxre", "product_launch", "launch"),
    ("osta", "expansion", "scale"),
    ("lich", "partnership", "announce"),
]
SENTENCES_SQL = (
    "list_filter(list_transform(string_split(regexp_replace({t}, '([.!?\\n])\\s+', '\\1' || chr(1), 'g'), chr(1)), "
    "lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
)
_WORD_CASE = lambda k: "CASE " + " ".join(f"WHEN contains(lower(q), '{w[0]}') THEN '{w[k]}'" for w in WORDS) + " END"
_NAME_SQL = """coalesce(nullif(regexp_extract(q, '["''“]([^"''”]{2,40})["''”]', 1), ''),
  list_filter(list_transform(regexp_extract_all(regexp_replace(q, '([^\\p{L}\\p{N}_])', '\\1\\1', 'g'),
    '(?:^|[^\\p{L}\\p{N}_])([A-Z][a-zA-Z0-9]+(?:\\s\\s[A-Z0-9][a-zA-Z0-9]*){0,2})(?:$|[^\\p{L}\\p{N}_])', 1),
    lambda x: regexp_replace(x, '(\\s)\\s', '\\1', 'g')), lambda x: lower(x) NOT IN ("""
_NAME_SQL += ", ".join(f"'{w}'" for w in ex.ENTITY_STOPWORDS) + "))[1])"

KEYWORD_EVENTS_SQL = f"""{tb.DOCUMENTS_SQL}, {tb.COMPANIES_SQL},
sent AS (SELECT doc_id, company_id, published_date, unnest({SENTENCES_SQL.format(t='raw_text')}) AS q,
  generate_subscripts({SENTENCES_SQL.format(t='raw_text')}, 1) - 1 AS sentence_no FROM docs),
kev AS (SELECT doc_id, company_id, CAST(sentence_no AS INTEGER) AS sentence_no, {_WORD_CASE(1)} AS event_type, name AS subject,
  {_WORD_CASE(2)} AS action, published_date AS event_date, 'day' AS date_precision,
  CASE WHEN {_WORD_CASE(2)} = 'launch' THEN 'completed' ELSE 'planned' END AS lifecycle_status,
  CAST(NULL AS VARCHAR) AS domain, {_NAME_SQL} AS entity, q AS raw_quote
  FROM sent JOIN comps USING (company_id) WHERE {_WORD_CASE(1)} IS NOT NULL)"""


def _keyword_events(spark, sf_dir) -> DataFrame:
    docs = tb.documents(spark, sf_dir).withColumn("name", F.concat(F.lit("company "), F.col("company_id").cast("string")))
    return ex.keyword_events(docs, WORDS, text="raw_text", company="name", keep=["doc_id", "company_id"])


@query(
    "keyword_events",
    f"WITH {KEYWORD_EVENTS_SQL} SELECT * FROM kev",
)
def keyword_events(spark, sf_dir):
    return _keyword_events(spark, sf_dir)


@query(
    "pending_extraction",
    f"WITH {KEYWORD_EVENTS_SQL} SELECT * FROM kev WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
)
def pending_extraction(spark, sf_dir):
    """Events of the documents, each one chunk, that have none yet; those with a label are taken as done."""
    docs, labels = tb.documents(spark, sf_dir), tb.read(spark, sf_dir, "labels")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), "doc_id", F.col("raw_text").alias("text"))
    made = ex.extract_pending(chunks, labels.select(F.col("doc_id").alias("chunk_id")), docs, tb.companies(spark, sf_dir), families=WORDS)
    return made.drop("chunk_id")


@query("company_names", f"WITH {tb.DOCUMENTS_SQL}, {tb.COMPANIES_SQL} SELECT name FROM comps")
def company_names(spark, sf_dir):
    return lk.company_names(tb.companies(spark, sf_dir))


@query(
    "job_tasks",
    f"""SELECT item_id, list_filter({SENTENCES_SQL.format(t='text')}, lambda x: length(x) > 5)[1] AS first_task,
len(list_filter({SENTENCES_SQL.format(t='text')}, lambda x: length(x) > 5)) AS n_tasks,
array_to_string(list_filter({SENTENCES_SQL.format(t='text')}, lambda x: length(x) > 5), ' | ') AS tasks FROM benchmark""",
)
def job_tasks(spark, sf_dir):
    jobs = ex.parse_jobs(tb.read(spark, sf_dir, "benchmark"), "text")
    return jobs.select(
        "item_id",
        F.get("tasks", F.lit(0)).alias("first_task"),
        F.size("tasks").cast("long").alias("n_tasks"),
        F.array_join("tasks", " | ").alias("tasks"),
    )


@query(
    "ordered_entities",
    """WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations),
t AS (SELECT conv_id, turn, i, regexp_replace(word, '^\\s+|\\s+$', '', 'g') AS v FROM w),
f AS (SELECT conv_id, turn, v, i FROM t WHERE v <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, turn, lower(v) ORDER BY i) = 1)
SELECT conv_id, turn, string_agg(v, ' ' ORDER BY i) AS entities, count(*) AS n FROM f GROUP BY conv_id, turn""",
)
def ordered_entities(spark, sf_dir):
    words = ex.ordered_distinct(F.split("text", " ", -1))
    rows = tb.read(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("w")).where(F.size("w") > 0)
    return rows.select("conv_id", "turn", F.array_join("w", " ").alias("entities"), F.size("w").cast("long").alias("n"))


TITLE_SQL = """CASE WHEN coalesce(nullif(entity, ''), nullif(subject, ''), event_type) <> coalesce(nullif(action, ''), event_type)
  THEN coalesce(nullif(entity, ''), nullif(subject, ''), event_type) || ': ' || coalesce(nullif(action, ''), event_type)
  ELSE coalesce(nullif(action, ''), event_type) END"""
GENERATED_SQL = """CASE WHEN action <> '' AND action <> coalesce(nullif(entity, ''), nullif(domain, ''), event_type)
  THEN coalesce(nullif(entity, ''), nullif(domain, ''), event_type) || ': ' || action
  ELSE coalesce(nullif(entity, ''), nullif(domain, ''), event_type) END"""


@query(
    "title_text",
    f"WITH {tb.EVENTS_SQL} SELECT event_id, {TITLE_SQL} AS title, {GENERATED_SQL} AS generated FROM ev",
)
def title_text(spark, sf_dir):
    c = F.col
    return tb.events(spark, sf_dir).select(
        "event_id",
        cl.title_text(c("entity"), c("subject"), c("action"), c("event_type")).alias("title"),
        ex.generated_title(c("entity"), c("domain"), c("event_type"), c("action")).alias("generated"),
    )


@query(
    "titles_to_rewrite",
    f"""WITH {tb.EVENTS_SQL}, t AS (SELECT *, CASE WHEN event_type = 'signup' THEN coalesce(entity, domain, '') || ' 확장'
  WHEN event_type = 'view' THEN '가 ' || {TITLE_SQL} WHEN event_type = 'click' THEN '나 Initiative' ELSE {TITLE_SQL} END AS title FROM ev),
m AS (SELECT *, NOT regexp_matches(title, '[가-힣]') OR regexp_matches(title, ':\\s*[A-Za-z]')
  OR regexp_matches(title, '\\b(Expansion|Initiative)\\s*$') AS rewritten FROM t)
SELECT event_id, rewritten, CASE WHEN rewritten THEN {GENERATED_SQL} ELSE title END AS title FROM m""",
)
def titles_to_rewrite(spark, sf_dir):
    c = F.col
    plain = cl.title_text(c("entity"), c("subject"), c("action"), c("event_type"))
    title = (
        F.when(c("event_type") == "signup", th.thread_title(c("entity"), c("domain"), {**th.THREAD_TITLE, "other": " 확장", "none": ""}))
        .when(c("event_type") == "view", F.concat(F.lit("가 "), plain))
        .when(c("event_type") == "click", "나 Initiative")
        .otherwise(plain)
    )
    rows = ex.rewrite_titles(tb.events(spark, sf_dir).withColumn("title", title))
    return rows.select("event_id", "rewritten", "title")


# ---------------------------------------------------------------- evidence


def _mangled(q: Column) -> Column:
    """The quote as a careless copy gives it: capitals, doubled spaces, curly quotes."""
    return F.translate(F.replace(q, F.lit(" "), F.lit("  ")), 'abcdefghijklmnopqrstuvwxyz"', "ABCDEFGHIJKLMNOPQRSTUVWXYZ”")


def _line_chunks(spark, sf_dir) -> DataFrame:
    """Every line of every document as a chunk."""
    rows = _texts(spark, sf_dir, _spaced())
    return ch.exploded(rows, ch.paragraph_chunks(F.col("t"), 0), ["doc_id"])


def _quotes(spark, sf_dir, change) -> DataFrame:
    """Events extracted from chunks, their quotes changed, next to the chunk they came from."""
    chunks = _line_chunks(spark, sf_dir).withColumns({"company": F.lit("c"), "published_date": F.lit("2024-01-01")})
    keep = ["doc_id", "chunk_index", "text", "start_offset"]
    events = ex.keyword_events(chunks, WORDS, keep=keep).withColumnRenamed("start_offset", "base")
    return events.select("doc_id", "chunk_index", "sentence_no", "text", "base", change.alias("raw_quote"))


NORM_SQL = "lower(regexp_replace(translate({x}, '“”‘’«»', '\"\"''''\"\"'), '\\s+', ' ', 'g'))"
QUOTES_SQL = f"""{SPACED_SQL}, {sq.paragraphs('src', 'p')},
par AS ({sq.numbered('p', sq.NULL_TEXT)}),
sent AS (SELECT doc_id, chunk_index, start_offset AS base, text, unnest({SENTENCES_SQL.format(t='text')}) AS q,
  generate_subscripts({SENTENCES_SQL.format(t='text')}, 1) - 1 AS sentence_no FROM par),
quo AS (SELECT *, translate(replace(q, ' ', '  '), 'abcdefghijklmnopqrstuvwxyz"', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ”') AS raw_quote FROM sent WHERE {_WORD_CASE(1)} IS NOT NULL),
loc AS (SELECT *, regexp_replace({NORM_SQL.format(x='raw_quote')}, '^\\s+|\\s+$', '', 'g') AS nq, {NORM_SQL.format(x='text')} AS nt FROM quo),
hit AS (SELECT *, instr(nt, nq) AS spot, CASE WHEN regexp_matches(text, '\\s\\s') THEN list_filter(range(0, length(text)),
  lambda i: i = 0 OR NOT regexp_matches(substr(text, i, 2), '^\\s\\s$')) ELSE range(0, length(text)) END AS kept FROM loc),
spans AS (SELECT *, kept[spot] AS s, kept[spot + length(nq) - 1] + 1 AS e FROM hit WHERE spot > 0)"""


@query(
    "evidence_exact",
    f"""WITH {QUOTES_SQL}
SELECT doc_id, chunk_index, CAST(sentence_no AS INTEGER) AS sentence_no, CAST(base + s AS BIGINT) AS start_offset,
CAST(base + e AS BIGINT) AS end_offset, substr(text, s + 1, e - s) AS matched_text, 'exact' AS match_method,
CAST(1.0 AS DOUBLE) AS match_score, 'auto_valid' AS review_status
FROM spans WHERE e - s >= 15 AND e - s <= 2 * length(regexp_replace(raw_quote, '^\\s+|\\s+$', '', 'g'))""",
)
def evidence_exact(spark, sf_dir):
    found = ev.locate_quotes(_quotes(spark, sf_dir, _mangled(F.col("raw_quote"))), base="base")
    return found.where(F.col("match_method") == ev.EXACT).select(
        "doc_id", "chunk_index", "sentence_no", "start_offset", "end_offset", "matched_text", "match_method",
        six("match_score").alias("match_score"), "review_status",
    )


@query(
    "evidence_status_counts",
    f"""WITH {QUOTES_SQL}
SELECT CASE WHEN e - s >= 15 THEN 'auto_valid' ELSE 'rejected' END AS review_status, count(*) AS n FROM spans GROUP BY 1""",
)
def evidence_status_counts(spark, sf_dir):
    return ev.status_counts(ev.locate_quotes(_quotes(spark, sf_dir, _mangled(F.col("raw_quote"))), base="base"))


@query("evidence_fuzzy")
def evidence_fuzzy(spark, sf_dir):
    """Quotes with letters swapped (close), words reversed (uncertain) or read backwards (wrong)."""
    q = F.col("raw_quote")
    by_kind = (
        F.when(F.col("action") == "build", F.reverse(q))
        .when(F.col("action") == "pilot", F.array_join(F.reverse(F.split(q, " ")), " "))
        .otherwise(F.replace(q, F.lit("th"), F.lit("d")))
    )
    found = ev.locate_quotes(_quotes(spark, sf_dir, by_kind), base="base")
    return found.select(
        "doc_id", "chunk_index", "sentence_no", "start_offset", "end_offset", "matched_text", "match_method",
        six("match_score").alias("match_score"), "is_valid", "review_status",
    )


# ---------------------------------------------------------------- pairs and clusters

KEYS_SQL = """k AS (SELECT *, TRY_CAST(event_date AS DATE) AS d, lower(trim(nullif(entity, ''))) AS ek,
  lower(trim(nullif(domain, ''))) AS dk FROM ev)"""


def _pair_sql(window: int) -> str:
    return f"""prs AS (SELECT a.event_id AS a_id, b.event_id AS b_id, CAST(abs(a.d - b.d) AS INTEGER) AS days,
  a.event_type AS a_kind, b.event_type AS b_kind, a.entity AS ae, b.entity AS be, a.domain AS ad, b.domain AS bd
  FROM k a JOIN k b ON a.company_id = b.company_id AND a.event_id < b.event_id
  WHERE (a.ek = b.ek AND (a.d IS NULL OR b.d IS NULL OR abs(a.d - b.d) <= {window}))
     OR (a.dk = b.dk AND abs(a.d - b.d) <= least({window}, 3)))"""


def _candidate_query(window: int):
    def run(spark, sf_dir):
        return pr.candidate_pairs(tb.events(spark, sf_dir), window)

    return run


for _name, _window in (("candidate_pairs_30d", 30), ("candidate_pairs_180d", 180), ("candidate_pairs_7d", 7)):
    query(_name, f"WITH {tb.EVENTS_SQL}, {KEYS_SQL}, {_pair_sql(_window)} SELECT a_id, b_id, days FROM prs")(
        _candidate_query(_window)
    )


@query(
    "top_candidates",
    f"""WITH {tb.EVENTS_SQL}, {KEYS_SQL}, c AS (SELECT a.event_id AS item_id, b.event_id AS candidate_id,
  CAST(abs(a.d - b.d) AS INTEGER) AS days, row_number() OVER (PARTITION BY a.event_id
    ORDER BY coalesce(abs(a.d - b.d), 1000000000), b.d NULLS LAST, b.event_id) AS n
  FROM k a JOIN k b ON a.company_id = b.company_id AND a.event_id <> b.event_id
  WHERE (a.ek = b.ek AND (a.d IS NULL OR b.d IS NULL OR abs(a.d - b.d) <= 30)) OR (a.dk = b.dk AND abs(a.d - b.d) <= 3))
SELECT item_id, CAST(n AS INTEGER) AS rank, candidate_id, days FROM c WHERE n <= 10""",
)
def top_candidates(spark, sf_dir):
    return pr.top_candidates(tb.events(spark, sf_dir))


DECIDED_SQL = """CASE WHEN ae <> '' AND ae = be AND a_kind = b_kind THEN 'same_event'
  WHEN (ae <> '' AND ae = be) OR (ad <> '' AND ad = bd) THEN 'related_distinct' ELSE 'unrelated' END"""


@query(
    "classify_pairs",
    f"""WITH {tb.EVENTS_SQL}, {KEYS_SQL}, {_pair_sql(7)}, t AS (SELECT a_id, b_id, {DECIDED_SQL} AS relationship_type FROM prs)
SELECT *, CASE relationship_type WHEN 'same_event' THEN 0.9::DOUBLE WHEN 'related_distinct' THEN 0.7::DOUBLE ELSE 0.6::DOUBLE END AS confidence,
'llm' AS decided_by, 'pending' AS review_status, relationship_type = 'same_event' AS auto_apply FROM t""",
)
def classify_pairs(spark, sf_dir):
    pairs = pr.candidate_pairs(tb.events(spark, sf_dir), 7, carry=["event_type", "entity", "domain"])
    decided = pr.classify_pairs(pairs)
    rows = up.relationship_rows(decided.withColumn("auto", F.col("auto_apply")))
    flag = pr.auto_applies(F.col("relationship_type"), F.col("confidence"))
    return rows.drop("rationale").withColumn("auto_apply", flag)


def _assigned(spark, sf_dir, window: int = 30) -> DataFrame:
    return tb.stage(spark, sf_dir, f"assigned {window}", lambda: cl.assign_events(tb.events(spark, sf_dir), window_days=window))


def _cluster_sql(window: int, company: str = "company_id") -> str:
    """One event per company and step; seeds travel as a list."""
    return f"""{tb.EVENTS_SQL}, {KEYS_SQL},
o AS (SELECT * REPLACE ({company} AS company_id), row_number() OVER (PARTITION BY {company} ORDER BY d NULLS LAST, event_id) AS n FROM k),
r AS (
  SELECT DISTINCT company_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS step,
    CAST(NULL AS BIGINT) AS canonical_id,
    CAST([] AS STRUCT(d DATE, id BIGINT, entity VARCHAR, event_type VARCHAR, ek VARCHAR, dk VARCHAR)[]) AS seeds FROM o
  UNION ALL
  SELECT company_id, n, event_id, CASE WHEN hit IS NOT NULL THEN 'merged' WHEN is_official THEN 'new' ELSE 'deferred' END,
    CASE WHEN hit IS NOT NULL THEN hit WHEN is_official THEN event_id END,
    CASE WHEN hit IS NULL AND is_official
      THEN list_append(seeds, {{'d': d, 'id': event_id, 'entity': entity, 'event_type': event_type, 'ek': ek, 'dk': dk}}) ELSE seeds END
  FROM (SELECT o.*, r.seeds, list_filter(list_slice(list_sort(list_transform(list_filter(r.seeds, lambda s:
        (s.ek IS NOT NULL AND s.ek = o.ek AND (s.d IS NULL OR o.d IS NULL OR abs(s.d - o.d) <= {window}))
        OR (s.dk IS NOT NULL AND s.dk = o.dk AND s.d IS NOT NULL AND o.d IS NOT NULL AND abs(s.d - o.d) <= least({window}, 3))),
      lambda s: {{'gap': coalesce(abs(s.d - o.d), 1000000000), 'd': coalesce(s.d, DATE '9999-12-31'), 'id': s.id,
        'same': coalesce(s.entity = o.entity AND s.event_type = o.event_type, false)}})), 1, 10), lambda s: s.same)[1].id AS hit
    FROM r JOIN o ON o.company_id = r.company_id AND o.n = r.n + 1)),
asg AS (SELECT event_id, company_id, step AS action, canonical_id FROM r WHERE n > 0)"""


def _seed_query(window: int):
    def run(spark, sf_dir):
        return _assigned(spark, sf_dir, window).select("event_id", "company_id", "action", "canonical_id")

    return run


for _name, _window in (("seed_clusters", 30), ("seed_clusters_7d", 7)):
    query(_name, f"WITH RECURSIVE {_cluster_sql(_window)} SELECT * FROM asg")(_seed_query(_window))


@query("cluster_slices", f"WITH RECURSIVE {_cluster_sql(30, 'company_id % 16')} SELECT * FROM asg")
def cluster_slices(spark, sf_dir):
    """Clusters of sixteen large companies, taken slice of days by slice of days."""
    rows = tb.events(spark, sf_dir).withColumn("company_id", F.col("company_id") % 16)
    assigned = cl.assign_events(rows, island_rows=0, slice_rows=120)
    return assigned.select("event_id", "company_id", "action", "canonical_id")


@query(
    "cluster_counts",
    f"""WITH RECURSIVE {_cluster_sql(30)} SELECT count(*) FILTER (action = 'new') AS new_canonical, count(*) FILTER (action = 'merged') AS merged,
CAST(0 AS BIGINT) AS flagged_for_review, count(*) FILTER (action = 'deferred') AS deferred_news_event FROM asg""",
)
def cluster_counts(spark, sf_dir):
    return cl.tally(_assigned(spark, sf_dir))


def _canonical(spark, sf_dir) -> DataFrame:
    return tb.stage(
        spark, sf_dir, "canonical", lambda: cl.canonical_events(tb.events(spark, sf_dir), _assigned(spark, sf_dir))
    )


CANONICAL_SQL = f"""{_cluster_sql(30)},
ce AS (SELECT e.event_id AS canonical_id, e.company_id, e.event_type, e.action, e.event_date AS canonical_date, e.date_precision,
  e.domain, e.entity, {TITLE_SQL.replace('entity', 'e.entity').replace('subject', 'e.subject').replace('action', 'e.action').replace('event_type', 'e.event_type')} AS title, e.raw_quote AS summary
  FROM ev e JOIN asg a USING (event_id) WHERE a.action = 'new'),
mem AS (SELECT canonical_id, event_id, action = 'new' AS is_seed FROM asg WHERE canonical_id IS NOT NULL)"""


@query(
    "canonical_events",
    f"WITH RECURSIVE {CANONICAL_SQL} SELECT canonical_id, company_id, event_type, canonical_date, domain, entity, title, summary FROM ce",
)
def canonical_events(spark, sf_dir):
    return _canonical(spark, sf_dir).select(
        "canonical_id", "company_id", "event_type", "canonical_date", "domain", "entity", "title", "summary"
    )


def _members(spark, sf_dir) -> DataFrame:
    return cl.members(_assigned(spark, sf_dir))


@query("cluster_members", f"WITH RECURSIVE {CANONICAL_SQL} SELECT * FROM mem")
def cluster_members(spark, sf_dir):
    return _members(spark, sf_dir)


@query(
    "unclustered_events",
    f"""WITH RECURSIVE {CANONICAL_SQL} SELECT event_id, company_id, event_date FROM ev
WHERE event_id NOT IN (SELECT event_id FROM mem)""",
)
def unclustered_events(spark, sf_dir):
    events = tb.events(spark, sf_dir)
    evidence = events.select("event_id", F.lit(True).alias("is_valid"))
    return lk.unclustered_events(events, evidence, _members(spark, sf_dir)).select("event_id", "company_id", "event_date")


@query(
    "event_relationships",
    f"""WITH RECURSIVE {_cluster_sql(30)},
c AS (SELECT o.event_id AS item, s.event_id AS seed, o.event_type AS a_kind, s.event_type AS b_kind, o.entity AS ae, s.entity AS be,
  o.domain AS ad, s.domain AS bd, row_number() OVER (PARTITION BY o.event_id
    ORDER BY coalesce(abs(o.d - s.d), 1000000000), s.d NULLS LAST, s.event_id) AS m
  FROM o JOIN o s ON o.company_id = s.company_id AND s.n < o.n JOIN asg g ON g.event_id = s.event_id AND g.action = 'new'
  WHERE (o.ek = s.ek AND (o.d IS NULL OR s.d IS NULL OR abs(o.d - s.d) <= 30)) OR (o.dk = s.dk AND abs(o.d - s.d) <= 3)),
t AS (SELECT item, seed, {DECIDED_SQL} AS relationship_type FROM c WHERE m <= 10)
SELECT least(item, seed) AS a_id, greatest(item, seed) AS b_id, relationship_type,
CASE relationship_type WHEN 'same_event' THEN 0.9::DOUBLE WHEN 'related_distinct' THEN 0.7::DOUBLE ELSE 0.6::DOUBLE END AS confidence,
'llm' AS decided_by, CASE WHEN g.action = 'merged' AND g.canonical_id = seed THEN 'auto_applied' ELSE 'pending' END AS review_status
FROM t JOIN asg g ON g.event_id = item""",
)
def event_relationships(spark, sf_dir):
    decided = cl.relationships(tb.events(spark, sf_dir), _assigned(spark, sf_dir))
    return decided.drop("relationship_id", "rationale")


@query("near_duplicates")
def near_duplicates(spark, sf_dir):
    """Sentences with a family word as events: title from the rule, sentence as summary; each with its class and its number of links.

    Pairs of texts, whatever their types; events of one text are links of each other.
    """
    return dd.similar_classes(_sentence_events(spark, sf_dir))


def _sentence_events(spark, sf_dir) -> DataFrame:
    rows = _keyword_events(spark, sf_dir)
    c = F.col
    return rows.select(
        (c("doc_id") * 100_000 + c("sentence_no")).alias("canonical_id"),
        "company_id",
        c("event_date").alias("canonical_date"),
        "event_type",
        "entity",
        "domain",
        cl.title_text(c("entity"), c("subject"), c("action"), c("event_type")).alias("title"),
        c("raw_quote").alias("summary"),
    )


def _ratio_sql(a: str, b: str) -> str:
    """Indel ratio (0-100) of two texts: the longest common subsequence by one bit per letter of the first, letter by letter of the second."""
    full = f"((CAST(1 AS HUGEINT) << CAST(length({a}) AS INTEGER)) - 1)"
    mask = f"list_sum(list_transform(range(length({a})), lambda i: CASE WHEN substr({a}, i + 1, 1) = c THEN CAST(1 AS HUGEINT) << CAST(i AS INTEGER) ELSE CAST(0 AS HUGEINT) END))"
    rows = f"list_reduce(list_concat([{full}], list_transform(string_split({b}, ''), lambda c: CAST({mask} AS HUGEINT))), lambda r, m: ((r + (r & m)) | (r - (r & m))) & {full})"
    return f"CASE WHEN {a} = '' AND {b} = '' THEN 100.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE 200.0 * (length({a}) - bit_count({rows})) / (length({a}) + length({b})) END"


def _merges_sql(same: str) -> str:
    """Similar pairs in the order of the timeline, company by company; texts have up to 120 letters, so a row of bits is one integer."""
    return f"""{CANONICAL_SQL},
sx AS (SELECT canonical_id AS id, company_id, event_type, entity, canonical_date, TRY_CAST(canonical_date AS DATE) AS d, {{'t': coalesce(canonical_date, '~'), 'n': canonical_id}} AS place,
  array_to_string(list_sort(string_split(title, ' ')), ' ') AS title, array_to_string(list_sort(string_split(summary, ' ')), ' ') AS summary FROM ce),
sp AS (SELECT a.company_id, CASE WHEN a.place < b.place THEN {{'x': a.place, 'y': b.place}} ELSE {{'x': b.place, 'y': a.place}} END AS o, coalesce({same}, false) AS same
  FROM sx a JOIN sx b ON a.company_id = b.company_id AND a.id < b.id AND ((a.canonical_date IS NULL AND b.canonical_date IS NULL) OR abs(a.d - b.d) <= 3)
  WHERE greatest({_ratio_sql('a.title', 'b.title')}, {_ratio_sql('a.summary', 'b.summary')}) >= 55),
sl AS (SELECT company_id, list({{'x': o.x.n, 'y': o.y.n, 'same': same, 'checked': CAST(0 AS BIGINT), 'gone': CAST([] AS BIGINT[]), 'kept': CAST([] AS BIGINT[])}} ORDER BY o) AS pairs FROM sp GROUP BY company_id),
sr AS (SELECT list_reduce(list_concat([{{'x': CAST(0 AS BIGINT), 'y': CAST(0 AS BIGINT), 'same': false, 'checked': CAST(0 AS BIGINT), 'gone': CAST([] AS BIGINT[]), 'kept': CAST([] AS BIGINT[])}}], pairs), lambda r, p:
    CASE WHEN list_contains(r.gone, p.x) OR list_contains(r.gone, p.y) THEN r
      ELSE {{'x': p.x, 'y': p.y, 'same': p.same, 'checked': r.checked + 1, 'gone': CASE WHEN p.same THEN list_append(r.gone, greatest(p.x, p.y)) ELSE r.gone END,
        'kept': CASE WHEN p.same THEN list_append(r.kept, least(p.x, p.y)) ELSE r.kept END}} END) AS r FROM sl),
mg AS (SELECT unnest(r.gone) AS remove_id, unnest(r.kept) AS next_id FROM sr),
up AS (SELECT remove_id, next_id AS keep_id FROM mg UNION ALL SELECT up.remove_id, mg.next_id FROM up JOIN mg ON mg.remove_id = up.keep_id)"""


MERGED_SQL = "SELECT remove_id, keep_id FROM up WHERE keep_id NOT IN (SELECT remove_id FROM mg)"
TALLY_SQL = "SELECT (SELECT count(*) FROM sp) AS candidates, CAST((SELECT coalesce(sum(r.checked), 0) FROM sr) AS BIGINT) AS checked, (SELECT count(*) FROM mg) AS merged"
SAME_RULE, SAME_TYPE = "a.entity <> '' AND a.entity = b.entity AND a.event_type = b.event_type", "a.event_type = b.event_type"


@query("dedupe_merge", f"WITH RECURSIVE {_merges_sql(SAME_RULE)} {MERGED_SQL}")
def dedupe_merge(spark, sf_dir):
    return dd.dedupe(_canonical(spark, sf_dir))


class _TypeRule(pr.RuleClassifier):
    """Canonical events of one type are the same, whatever their entity."""

    def columns(self, a, b):
        kind = F.when(a["event_type"].eqNullSafe(b["event_type"]), "same_event").otherwise("unrelated")
        return F.struct(kind.alias("relationship_type"), F.lit(0.9).alias("confidence"), F.lit("").alias("rationale"))

    def decide(self, a, b):
        return ("same_event" if a["event_type"] == b["event_type"] else "unrelated"), 0.9


@query("dedupe_across_entities", f"WITH RECURSIVE {_merges_sql(SAME_TYPE)} {MERGED_SQL}")
def dedupe_across_entities(spark, sf_dir):
    """Canonical events of like texts and close dates merge by type: those that other entities kept apart."""
    return dd.dedupe(_canonical(spark, sf_dir), _TypeRule())


@query("dedupe_tally", f"WITH RECURSIVE {_merges_sql(SAME_RULE)} {TALLY_SQL}")
def dedupe_tally(spark, sf_dir):
    """Pairs that a sequential pass over the canonical events meets, checks and merges."""
    return dd.dedupe_tally(_canonical(spark, sf_dir))


@query("dedupe_tally_across_entities", f"WITH RECURSIVE {_merges_sql(SAME_TYPE)} {TALLY_SQL}")
def dedupe_tally_across_entities(spark, sf_dir):
    """The same pass, by type: pairs of events that are gone are not checked."""
    return dd.dedupe_tally(_canonical(spark, sf_dir), _TypeRule())


@query("dedupe_sentences")
def dedupe_sentences(spark, sf_dir):
    """Merges among the sentence events: documents repeat each other, exactly and nearly."""
    return dd.dedupe(_sentence_events(spark, sf_dir))


# ---------------------------------------------------------------- threads

THREAD_RULE = pr.RuleClassifier(related=0.8)  # above the gate, so that threads form


STAGE_SQL = "CASE " + " ".join(
    f"WHEN {' OR '.join(f"contains(lower(concat_ws(' ', nullif(c.action, ''), nullif(c.event_type, ''))), '{w}')" for w in words)} THEN '{stage}'"
    for stage, words in th.STAGE_WORDS.items()
) + " END"
#: One event per company and step; threads with their last members, and the events in threads, travel as lists.
_EVENT = "STRUCT(d DATE, id BIGINT, entity VARCHAR, domain VARCHAR, kind VARCHAR, ek VARCHAR, dk VARCHAR, text VARCHAR)"
_NEAR = """coalesce(({a}.ek = {b}.ek AND ({a}.d IS NULL OR {b}.d IS NULL OR abs({a}.d - {b}.d) <= 180)) OR ({a}.dk = {b}.dk AND abs({a}.d - {b}.d) <= 3), false)"""
_RELATED = """coalesce((({a}.entity <> '' AND {a}.entity = {b}.entity) OR ({a}.domain <> '' AND {a}.domain = {b}.domain))
        AND NOT coalesce({a}.entity <> '' AND {a}.entity = {b}.entity AND {a}.kind = {b}.kind, false), false)"""
def _threads_sql(company: str = "company_id") -> str:
    return f"""{CANONICAL_SQL},
tl AS (SELECT * REPLACE ({company} AS company_id), TRY_CAST(canonical_date AS DATE) AS d, lower(trim(nullif(entity, ''))) AS ek, lower(trim(nullif(domain, ''))) AS dk,
  row_number() OVER (PARTITION BY {company} ORDER BY TRY_CAST(canonical_date AS DATE) NULLS LAST, canonical_id) AS n FROM ce),
ts AS (SELECT company_id, n, {{'d': d, 'id': canonical_id, 'entity': entity, 'domain': domain, 'kind': event_type, 'ek': ek, 'dk': dk, 'text': coalesce(canonical_date, '')}} AS x FROM tl),
tp AS (SELECT company_id, list(x ORDER BY n) AS pool FROM ts GROUP BY company_id),
tr AS (
  SELECT company_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS step, CAST(NULL AS BIGINT) AS thread_id,
    CAST([] AS STRUCT(id BIGINT, place BIGINT)[]) AS places, CAST([] AS STRUCT(id BIGINT, size BIGINT, last {_EVENT})[]) AS chains, CAST([] AS BIGINT[]) AS gone, CAST([] AS STRUCT(other BIGINT, holds BOOLEAN)[]) AS seen FROM tp
  UNION ALL
  SELECT company_id, n, x.id, CASE WHEN done THEN 'already_threaded' WHEN hit IS NOT NULL THEN 'appended_to_thread' WHEN mate IS NOT NULL THEN 'created_thread' ELSE 'standalone' END,
    CASE WHEN hit IS NOT NULL THEN hit.id WHEN mate IS NOT NULL THEN x.id END,
    CASE WHEN hit IS NOT NULL THEN [{{'id': x.id, 'place': hit.size}}]
      WHEN mate IS NOT NULL THEN [{{'id': x.id, 'place': CASE WHEN mate.text <= x.text THEN 1 ELSE 0 END}}, {{'id': mate.id, 'place': CASE WHEN mate.text <= x.text THEN 0 ELSE 1 END}}] ELSE [] END,
    CASE WHEN hit IS NOT NULL THEN list_transform(chains, lambda c: CASE WHEN c.id = hit.id THEN {{'id': c.id, 'size': c.size + 1, 'last': x}} ELSE c END)
      WHEN mate IS NOT NULL THEN list_append(chains, {{'id': x.id, 'size': 2, 'last': CASE WHEN mate.text <= x.text THEN x ELSE mate END}}) ELSE chains END,
    CASE WHEN hit IS NOT NULL THEN list_append(gone, x.id) WHEN mate IS NOT NULL THEN list_concat(gone, [x.id, mate.id]) ELSE gone END,
    CASE WHEN done THEN [] ELSE list_concat(
      list_transform(list_slice(met, 1, coalesce(list_position(list_transform(met, lambda c: c.id), hit.id), len(met))), lambda c: {{'other': c.last.id, 'holds': coalesce(c.id = hit.id, false)}}),
      CASE WHEN hit IS NOT NULL THEN [] ELSE list_transform(list_slice(few, 1, coalesce(list_position(list_transform(few, lambda c: c.id), mate.id), len(few))), lambda c: {{'other': c.id, 'holds': coalesce(c.id = mate.id, false)}}) END) END
  FROM (SELECT *, list_filter(few, lambda c: {_RELATED.format(a='c.s', b='x')})[1].s AS mate FROM (SELECT *, CASE WHEN NOT done AND hit IS NULL THEN
      list_slice(list_sort(list_transform(list_filter(pool, lambda s: s.id <> x.id AND NOT list_contains(gone, s.id) AND {_NEAR.format(a='s', b='x')}),
        lambda s: {{'gap': coalesce(abs(s.d - x.d), 1000000000), 'd': coalesce(s.d, DATE '9999-12-31'), 'id': s.id, 's': s}})), 1, 10) ELSE [] END AS few
    FROM (SELECT *, list_filter(met, lambda c: {_RELATED.format(a='c.last', b='x')})[1] AS hit
      FROM (SELECT *, CASE WHEN done THEN [] ELSE list_filter(chains, lambda c: {_NEAR.format(a='c.last', b='x')}) END AS met FROM (SELECT ts.company_id, ts.n, ts.x, tp.pool, tr.chains, tr.gone, list_contains(tr.gone, ts.x.id) AS done
        FROM tr JOIN ts ON ts.company_id = tr.company_id AND ts.n = tr.n + 1 JOIN tp ON tp.company_id = tr.company_id)))))),
act AS (SELECT id AS canonical_id, step AS action, thread_id FROM tr WHERE n > 0),
te AS (SELECT thread_id, p.id AS canonical_id, p.place AS sequence_index FROM (SELECT thread_id, unnest(places) AS p FROM tr WHERE thread_id IS NOT NULL)),
thr AS (SELECT a.thread_id, c.company_id, CASE WHEN entity <> '' THEN entity || ' 확장' ELSE coalesce(nullif(domain, ''), '이니셔티브') || ' 이니셔티브' END AS title
  FROM act a JOIN ce c ON c.canonical_id = a.thread_id WHERE a.action = 'created_thread')"""


THREADS_SQL = _threads_sql()


def _linked(spark, sf_dir) -> DataFrame:
    return tb.stage(
        spark, sf_dir, "linked", lambda: th.link_threads(_canonical(spark, sf_dir), classifier=THREAD_RULE)
    )


@query("thread_assign", f"WITH RECURSIVE {THREADS_SQL} SELECT * FROM act")
def thread_assign(spark, sf_dir):
    return th.actions(_linked(spark, sf_dir))


@query(
    "thread_counts",
    f"WITH RECURSIVE {THREADS_SQL} SELECT "
    + ", ".join(f"count(*) FILTER (action = '{a}') AS {a}" for a in ("appended_to_thread", "created_thread", "standalone", "already_threaded"))
    + " FROM act",
)
def thread_counts(spark, sf_dir):
    return th.tally(_linked(spark, sf_dir))


@query("thread_slices", f"WITH RECURSIVE {_threads_sql('company_id % 16')} SELECT te.thread_id, te.canonical_id, te.sequence_index FROM te")
def thread_slices(spark, sf_dir):
    """Members of threads over sixteen large companies, taken slice of days by slice of days."""
    rows = _canonical(spark, sf_dir).withColumn("company_id", F.col("company_id") % 16)
    linked = th.link_threads(rows, classifier=THREAD_RULE, slice_rows=100)
    return linked.where(F.col("kind") == "member").select("thread_id", "canonical_id", "sequence_index")


@query(
    "thread_gate",
    f"""WITH RECURSIVE {CANONICAL_SQL} SELECT CAST(0 AS BIGINT) AS appended_to_thread, CAST(0 AS BIGINT) AS created_thread,
count(*) AS standalone, CAST(0 AS BIGINT) AS already_threaded FROM ce""",
)
def thread_gate(spark, sf_dir):
    """With the rule's own score no link passes the gate: every event stays alone."""
    return th.tally(th.link_threads(_canonical(spark, sf_dir)))


def _thread_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    canonical, linked = _canonical(spark, sf_dir), _linked(spark, sf_dir)
    return canonical, th.new_threads(linked, canonical), th.thread_events(linked, canonical)


@query(
    "canonical_relationships",
    f"""WITH RECURSIVE {THREADS_SQL}, seen AS (SELECT least(id, p.other) AS a_id, greatest(id, p.other) AS b_id, bool_or(p.holds) AS holds
  FROM (SELECT id, unnest(seen) AS p FROM tr WHERE n > 0) GROUP BY ALL),
f AS (SELECT s.*, a.entity AS ae, b.entity AS be, a.domain AS ad, b.domain AS bd, a.event_type AS a_kind, b.event_type AS b_kind
  FROM seen s JOIN ce a ON a.canonical_id = a_id JOIN ce b ON b.canonical_id = b_id), t AS (SELECT *, {DECIDED_SQL} AS relationship_type FROM f)
SELECT a_id, b_id, relationship_type, CASE relationship_type WHEN 'same_event' THEN 0.9::DOUBLE WHEN 'related_distinct' THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END AS confidence,
  'llm' AS decided_by, CASE WHEN holds THEN 'auto_applied' ELSE 'pending' END AS review_status FROM t""",
)
def canonical_relationships(spark, sf_dir):
    """Every pair of canonical events that threading compared, and what it decided."""
    return th.relationships(_linked(spark, sf_dir), _canonical(spark, sf_dir), THREAD_RULE).drop("relationship_id", "rationale")


@query(
    "thread_last_members",
    f"""WITH RECURSIVE {THREADS_SQL}, l AS (SELECT thread_id, arg_max(canonical_id, sequence_index) AS canonical_id, max(sequence_index) + 1 AS next_index FROM te GROUP BY thread_id)
SELECT thread_id, canonical_id, CAST(next_index AS BIGINT) AS next_index, company_id, canonical_date, entity, domain FROM l JOIN ce USING (canonical_id)""",
)
def thread_last_members(spark, sf_dir):
    """What a later run compares its new events with."""
    canonical, _, rows = _thread_tables(spark, sf_dir)
    return th.last_members(rows, canonical).select("thread_id", "canonical_id", "next_index", "company_id", "canonical_date", "entity", "domain")


@query(
    "thread_cards",
    f"""WITH RECURSIVE {THREADS_SQL}, tm AS (SELECT te.*, c.canonical_date, c.date_precision FROM te JOIN ce c USING (canonical_id))
SELECT thread_id, any_value(company_id) AS company_id, any_value(title) AS title, count(*) AS members, min(canonical_date) AS start_date,
  arg_min(date_precision, (canonical_date, sequence_index)) FILTER (canonical_date IS NOT NULL) AS start_precision, max(canonical_date) AS end_date,
  arg_max(date_precision, (canonical_date, sequence_index)) FILTER (canonical_date IS NOT NULL) AS end_precision FROM thr JOIN tm USING (thread_id) GROUP BY thread_id""",
)
def thread_cards(spark, sf_dir):
    canonical, threads, rows = _thread_tables(spark, sf_dir)
    return rp.thread_cards(threads, rows, canonical)


@query(
    "thread_detail",
    f"""WITH RECURSIVE {THREADS_SQL} SELECT te.*, {STAGE_SQL} AS stage, thr.title AS thread_title, c.canonical_date, c.event_type, c.title AS event_title
FROM te JOIN thr USING (thread_id) JOIN ce c USING (canonical_id)""",
)
def thread_detail(spark, sf_dir):
    canonical, threads, rows = _thread_tables(spark, sf_dir)
    return rp.thread_detail(threads, rows, canonical)


@query(
    "unthreaded_events",
    f"""WITH RECURSIVE {THREADS_SQL} SELECT canonical_id, company_id, canonical_date FROM ce WHERE canonical_id NOT IN (SELECT canonical_id FROM te)""",
)
def unthreaded_events(spark, sf_dir):
    canonical, _, rows = _thread_tables(spark, sf_dir)
    return lk.unthreaded_events(canonical, rows).select("canonical_id", "company_id", "canonical_date")


# documents grouped as threads of their source: a check of the cards against SQL
CARDS_SQL = f"""WITH RECURSIVE {CANONICAL_SQL}, te AS (SELECT company_id AS thread_id, canonical_id, canonical_date, date_precision,
  row_number() OVER (PARTITION BY company_id ORDER BY canonical_id) - 1 AS n FROM ce)
SELECT thread_id, thread_id AS company_id, 'company ' || thread_id AS title, count(*) AS members,
  min(canonical_date) AS start_date, arg_min(date_precision, canonical_date) AS start_precision,
  max(canonical_date) AS end_date, arg_max(date_precision, canonical_date) AS end_precision FROM te GROUP BY thread_id"""


@query("company_cards", CARDS_SQL)
def company_cards(spark, sf_dir):
    """Thread cards with every company's canonical events taken as one thread."""
    canonical = _canonical(spark, sf_dir)
    order = F.col("canonical_id").alias("sequence_index")
    rows = canonical.select(F.col("company_id").alias("thread_id"), "canonical_id", order)
    name = F.concat(F.lit("company "), F.col("company_id").cast("string")).alias("title")
    threads = canonical.select(F.col("company_id").alias("thread_id"), "company_id", name).distinct()
    return rp.thread_cards(threads, rows, canonical)


STAGE_TEST = {
    "announce": ["signup", "view of"],
    "build": ["click"],
    "pilot": ["error"],
    "launch": ["purchase"],
    "scale": ["view"],
}


@query(
    "stage_inference",
    f"""WITH {tb.EVENTS_SQL}, s AS (SELECT event_id, CASE event_type WHEN 'signup' THEN 'announce' WHEN 'click' THEN 'build'
  WHEN 'error' THEN 'pilot' WHEN 'purchase' THEN 'launch' WHEN 'view' THEN 'scale' END AS stage FROM ev)
SELECT event_id, stage, CAST(list_position(['announce','build','pilot','launch','scale'], stage) - 1 AS INTEGER) AS stage_no,
coalesce(list_position(['announce','build','pilot','launch','scale'], stage) > 3, false) AS past_pilot FROM s""",
)
def stage_inference(spark, sf_dir):
    rows = tb.events(spark, sf_dir).select(
        "event_id", th.stage_of(F.col("action"), F.col("event_type"), STAGE_TEST).alias("stage")
    )
    return rows.select(
        "event_id",
        "stage",
        th.stage_index(F.col("stage")).alias("stage_no"),
        th.moves_forward(F.lit("pilot"), F.col("stage")).alias("past_pilot"),
    )


# ---------------------------------------------------------------- timeline and labels

ROW = ["canonical_id", "company_id", "canonical_date", "domain", "title"]


def _timeline_sql(where: str) -> str:
    return f"WITH RECURSIVE {CANONICAL_SQL}, {tb.DOCUMENTS_SQL} SELECT canonical_id, company_id, canonical_date, domain, title FROM ce WHERE {where}"


@query("timeline", _timeline_sql("true"))
def timeline(spark, sf_dir):
    return rp.timeline(_canonical(spark, sf_dir)).select(*ROW)


@query(
    "timeline_range",
    _timeline_sql("(canonical_date IS NULL OR canonical_date >= '2024-01-10') AND (canonical_date IS NULL OR canonical_date <= '2024-01-20')"),
)
def timeline_range(spark, sf_dir):
    return rp.timeline(_canonical(spark, sf_dir), start="2024-01-10", end="2024-01-20").select(*ROW)


@query("timeline_domain", _timeline_sql("lower(coalesce(domain, '')) = 'd3'"))
def timeline_domain(spark, sf_dir):
    return rp.timeline(_canonical(spark, sf_dir), domain="D3").select(*ROW)


@query(
    "timeline_official",
    _timeline_sql("canonical_id IN (SELECT m.canonical_id FROM mem m JOIN ev USING (event_id) JOIN docs d USING (doc_id) WHERE d.is_official)"),
)
def timeline_official(spark, sf_dir):
    docs = tb.documents(spark, sf_dir).select("doc_id", "is_official")
    sources = tb.events(spark, sf_dir).select("event_id", "doc_id").join(docs, "doc_id")
    return rp.timeline(
        _canonical(spark, sf_dir), members=_members(spark, sf_dir), event_sources=sources, official_only=True
    ).select(*ROW)


@query(
    "timeline_threads",
    f"""WITH RECURSIVE {THREADS_SQL}, named AS (SELECT canonical_id, string_agg(title, ', ' ORDER BY thread_id) AS threads FROM te JOIN thr USING (thread_id) GROUP BY canonical_id)
SELECT {{ROW_SQL}}, named.threads FROM ce LEFT JOIN named USING (canonical_id)""".replace("{ROW_SQL}", ", ".join(ROW)),
)
def timeline_threads(spark, sf_dir):
    canonical, threads, rows = _thread_tables(spark, sf_dir)
    out = rp.timeline(canonical, rows, threads)
    return out.select(*ROW, F.array_join(F.transform("threads", lambda t: t["title"]), ", ").alias("threads"))


@query("domain_facet", f"WITH RECURSIVE {CANONICAL_SQL} SELECT DISTINCT domain FROM ce WHERE domain <> ''")
def domain_facet(spark, sf_dir):
    return lk.facet(_canonical(spark, sf_dir), "domain")


WORDS_ASCII = {"unknown": "no date", "year": "y", "month": "m", "day": "d", "quarter": "q"}
LABEL_SQL = """CASE WHEN coalesce(event_date, '') = '' THEN 'no date'
  WHEN p = 'year' THEN y || 'y' WHEN p = 'quarter' THEN y || 'y ' || ((m - 1) // 3 + 1) || 'q'
  WHEN p = 'month' THEN y || 'y ' || m || 'm' ELSE y || 'y ' || m || 'm ' || d || 'd' END"""


@query(
    "date_labels",
    f"""WITH {tb.EVENTS_SQL}, t AS (SELECT event_id, event_date, (['year','quarter','month','day','unknown'])[event_id % 5 + 1] AS p,
  substr(event_date, 1, 4) AS y, CAST(substr(event_date, 6, 2) AS INTEGER) AS m, CAST(substr(event_date, 9, 2) AS INTEGER) AS d FROM ev)
SELECT event_id, {LABEL_SQL} AS label FROM t""",
)
def date_labels(spark, sf_dir):
    kinds = F.array(*[F.lit(p) for p in ("year", "quarter", "month", "day", "unknown")])
    precision = F.element_at(kinds, (F.col("event_id") % 5 + 1).cast("int"))
    return tb.events(spark, sf_dir).select(
        "event_id", dates.date_label(F.col("event_date"), precision, WORDS_ASCII).alias("label")
    )


@query(
    "status_labels",
    f"""WITH {tb.DOCUMENTS_SQL}, {tb.STATES_SQL} SELECT doc_id,
CASE review_status WHEN 'pending' THEN '검토 대기' WHEN 'approved' THEN '승인됨' ELSE '거부됨' END AS status_label,
CASE source_type WHEN 'dart' THEN '공시(DART)' WHEN 'ir' THEN 'IR 자료' WHEN 'press_release' THEN '보도자료'
  WHEN 'tech_blog' THEN '기술 블로그' WHEN 'ceo_letter' THEN 'CEO 서한' ELSE '뉴스' END AS source_label FROM states""",
)
def status_labels(spark, sf_dir):
    return tb.review_states(spark, sf_dir).select(
        "doc_id",
        dates.word_for(F.col("review_status"), dates.REVIEW_STATUS_WORDS).alias("status_label"),
        dates.word_for(F.col("source_type"), dates.SOURCE_TYPE_WORDS).alias("source_label"),
    )


@query(
    "entities_for_search",
    f"""WITH RECURSIVE {CANONICAL_SQL} SELECT DISTINCT company_id, entity, 'company ' || company_id || ' ' || entity AS query
FROM ce WHERE entity <> ''""",
)
def entities_for_search(spark, sf_dir):
    canonical = _canonical(spark, sf_dir)
    names = canonical.select("company_id").distinct().withColumn(
        "name", F.concat(F.lit("company "), F.col("company_id").cast("string"))
    )
    return rp.search_queries(canonical, names)


@query(
    "company_documents",
    f"WITH {tb.DOCUMENTS_SQL} SELECT doc_id, company_id, title, published_date FROM docs WHERE source_type = 'press_release'",
)
def company_documents(spark, sf_dir):
    return lk.documents_of(tb.documents(spark, sf_dir), source_type="press_release").select(
        "doc_id", "company_id", "title", "published_date"
    )


# ---------------------------------------------------------------- vectors and ranking


@query(
    "hashed_vectors",
    """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM documents),
b AS (SELECT doc_id, CAST(('0x' || substr(sha256(w), 1, 2)) AS INTEGER) % 32 AS bucket, count(*) AS n FROM w GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM b GROUP BY doc_id)
SELECT doc_id, CAST(bucket AS INTEGER) AS bucket, round(n / norm, 6) AS weight FROM b JOIN n USING (doc_id)""",
)
def hashed_vectors(spark, sf_dir):
    rows = tb.read(spark, sf_dir, "documents").select("doc_id", hashed_vector(F.col("text")).alias("v"))
    return tx.numbered(rows, ["doc_id"], F.col("v"), "bucket", "weight").where("weight > 0").select(
        "doc_id", "bucket", six("weight").alias("weight")
    )


def _company() -> Column:
    """A company per hundred labels (the tables hold ten)."""
    return F.floor(F.col("label") / F.lit(100))


def _vectors(spark, sf_dir) -> DataFrame:
    return tb.read(spark, sf_dir, "embeddings").select(
        _company().alias("company_id"),
        F.col("vec_id").alias("span_id"),
        F.floor(F.col("vec_id") / 3).alias("canonical_id"),
        F.concat(F.lit("text "), F.col("vec_id").cast("string")).alias("text"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        "label",
    )


def _profile_tasks(spark, sf_dir) -> DataFrame:
    """One task per label: the mean vector of its rows."""
    rows = tb.read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = rows.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vector = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"])
    return means.groupBy("label").agg(vector.alias("vector")).select(
        (_company() + 1).alias("job_id"),
        _company().alias("company_id"),
        F.col("label").alias("task_no"),
        F.concat(F.lit("task "), F.col("label").cast("string")).alias("task"),
        "vector",
    )


MATCH_SQL = """m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) t(i) GROUP BY label, i),
tasks AS (SELECT label, list(x ORDER BY i) AS v FROM m GROUP BY label),
sc AS (SELECT vec_id, vec_id // 3 AS canonical_id, t.label AS task_no, list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS score
  FROM embeddings, tasks t),
best AS (SELECT canonical_id, score, 'task ' || task_no AS task, 'text ' || vec_id AS evidence_text FROM sc
  QUALIFY row_number() OVER (PARTITION BY canonical_id ORDER BY score DESC, vec_id, task_no) = 1)"""


@query(
    "evidence_scores",
    f"WITH {MATCH_SQL} SELECT CAST(1 AS BIGINT) AS job_id, canonical_id, round(score, 6) AS score, task, evidence_text FROM best",
)
def evidence_scores(spark, sf_dir):
    return _scores(spark, sf_dir).withColumn("score", six("score"))


def _scores(spark, sf_dir) -> DataFrame:
    return rk.score_evidence(_vectors(spark, sf_dir), _profile_tasks(spark, sf_dir))


RANK_SQL = MATCH_SQL + """,
te AS (SELECT DISTINCT vec_id // 3 AS canonical_id, label AS thread_id FROM embeddings WHERE label < 7),
cand AS (
  SELECT 'thread' AS kind, CAST(thread_id AS BIGINT) AS id, 'thread ' || thread_id AS title, max(score) AS score FROM best JOIN te USING (canonical_id) GROUP BY thread_id
  UNION ALL
  SELECT 'event', canonical_id, 'event ' || canonical_id, score FROM best WHERE canonical_id NOT IN (SELECT canonical_id FROM te)),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, kind DESC, id) AS rank FROM cand),
shown AS (
  SELECT 'thread' AS kind, CAST(thread_id AS BIGINT) AS id, canonical_id, score FROM best JOIN te USING (canonical_id)
    QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY score DESC, canonical_id) <= 3
  UNION ALL SELECT 'event', canonical_id, canonical_id, score FROM best WHERE canonical_id NOT IN (SELECT canonical_id FROM te)),
related AS (SELECT canonical_id, max(s.score) AS score FROM shown s JOIN ranked r USING (kind, id) WHERE r.rank <= 10 GROUP BY canonical_id)"""


def _ranked(spark, sf_dir) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    rows = vectors.where("label < 7").select("canonical_id", F.col("label").cast("long").alias("thread_id"))
    titles = vectors.select("canonical_id").distinct().withColumn(
        "title", F.concat(F.lit("event "), F.col("canonical_id").cast("string"))
    )
    threads = rows.select("thread_id").distinct().withColumn(
        "title", F.concat(F.lit("thread "), F.col("thread_id").cast("string"))
    )
    return rk.rank_candidates(_scores(spark, sf_dir), rows, titles, threads, top_n=10)


@query(
    "jd_match",
    f"WITH {RANK_SQL} SELECT CAST(1 AS BIGINT) AS job_id, CAST(rank AS INTEGER) AS rank, kind, id, title, round(score, 6) AS score FROM ranked WHERE rank <= 10",
)
def jd_match(spark, sf_dir):
    return _ranked(spark, sf_dir).select("job_id", "rank", "kind", "id", "title", six("score").alias("score"))


@query(
    "jd_related_scores",
    f"WITH {RANK_SQL} SELECT CAST(1 AS BIGINT) AS job_id, canonical_id, round(score, 6) AS score FROM related",
)
def jd_related_scores(spark, sf_dir):
    return rk.related_scores(_ranked(spark, sf_dir)).withColumn("score", six("score"))


@query(
    "timeline_by_relevance",
    f"""WITH RECURSIVE {CANONICAL_SQL}, {RANK_SQL}
SELECT c.canonical_id, c.company_id, c.canonical_date, c.domain, c.title, round(r.score, 6) AS score
FROM ce c LEFT JOIN related r USING (canonical_id)""",
)
def timeline_by_relevance(spark, sf_dir):
    rows = rp.by_relevance(_canonical(spark, sf_dir), rk.related_scores(_ranked(spark, sf_dir)))
    return rows.select(*ROW, six("score").alias("score"))


# ---------------------------------------------------------------- evidence and review reports


def _evidence(spark, sf_dir) -> DataFrame:
    """Evidence of events: verdict and text follow the label of the event's document."""
    states = tb.review_states(spark, sf_dir).select("doc_id", "review_status")
    events = tb.events(spark, sf_dir).join(states, "doc_id")
    valid = F.col("review_status") == "approved"
    return events.select(
        "event_id",
        "company_id",
        "raw_quote",
        F.when(valid, F.col("raw_quote")).alias("matched_text"),
        F.when(valid, 1.0).otherwise(0.5).alias("match_score"),
        F.when(valid, "exact").otherwise("rejected").alias("match_method"),
        valid.alias("is_valid"),
        "review_status",
    )


EVIDENCE_SQL = f"""{tb.DOCUMENTS_SQL}, {tb.STATES_SQL},
evi AS (SELECT e.event_id, e.company_id, e.raw_quote, CASE WHEN review_status = 'approved' THEN e.raw_quote END AS matched_text,
  CASE WHEN review_status = 'approved' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS match_score,
  CASE WHEN review_status = 'approved' THEN 'exact' ELSE 'rejected' END AS match_method,
  review_status = 'approved' AS is_valid, review_status FROM ev e JOIN states USING (doc_id))"""


@query(
    "evidence_drilldown",
    f"""WITH RECURSIVE {CANONICAL_SQL}, {EVIDENCE_SQL} SELECT m.canonical_id, m.event_id, m.is_seed, e.event_type, e.event_date,
i.match_method, i.match_score, i.matched_text, d.source_type, d.title AS doc_title, d.published_date
FROM mem m JOIN ev e USING (event_id) LEFT JOIN evi i USING (event_id) JOIN docs d USING (doc_id)""",
)
def evidence_drilldown(spark, sf_dir):
    return rp.evidence_drilldown(
        _members(spark, sf_dir), tb.events(spark, sf_dir), _evidence(spark, sf_dir), tb.documents(spark, sf_dir)
    ).drop("doc_id")


def _relationships(spark, sf_dir) -> DataFrame:
    """Decided pairs; a pair waits for review like the document of its first event."""
    pairs = pr.candidate_pairs(tb.events(spark, sf_dir), 7, carry=["event_type", "entity", "domain", "doc_id"])
    rows = pr.classify_pairs(pairs).join(
        tb.review_states(spark, sf_dir).select(F.col("doc_id").alias("a_doc_id"), "review_status"), "a_doc_id"
    )
    return rows.select("a_id", "b_id", "relationship_type", "confidence", "review_status")


RELATIONS_SQL = f"""{KEYS_SQL}, {_pair_sql(7)}, {EVIDENCE_SQL},
rel AS (SELECT a_id, b_id, {DECIDED_SQL} AS relationship_type, i.review_status FROM prs JOIN evi i ON i.event_id = a_id)"""


@query(
    "review_summary",
    f"""WITH {tb.EVENTS_SQL}, {RELATIONS_SQL} SELECT c.company_id, count(*) FILTER (i.review_status = 'pending') AS pending_evidence,
(SELECT count(*) FROM rel WHERE review_status = 'pending' AND relationship_type = 'same_event') AS pending_duplicate_relationships,
(SELECT count(*) FROM rel WHERE review_status = 'pending') AS pending_thread_relationships
FROM (SELECT DISTINCT company_id FROM ev) c LEFT JOIN evi i USING (company_id) GROUP BY c.company_id""",
)
def review_summary(spark, sf_dir):
    pairs = _relationships(spark, sf_dir)
    companies = tb.events(spark, sf_dir).select("company_id").distinct()
    return rv.review_summary(_evidence(spark, sf_dir), pairs, pairs, companies)


@query(
    "review_queue",
    f"""WITH {tb.EVENTS_SQL}, {RELATIONS_SQL} SELECT r.a_id, r.b_id, r.relationship_type, a.event_type AS a_event_type,
a.event_date AS a_event_date, a.entity AS a_entity, b.event_type AS b_event_type, b.event_date AS b_event_date, b.entity AS b_entity
FROM rel r JOIN ev a ON a.event_id = r.a_id JOIN ev b ON b.event_id = r.b_id
WHERE r.review_status = 'pending' AND r.relationship_type = 'same_event'""",
)
def review_queue(spark, sf_dir):
    rows = rv.pending_pairs(
        _relationships(spark, sf_dir), tb.events(spark, sf_dir), "event_id", ["event_type", "event_date", "entity"], "same_event"
    )
    return rows.drop("confidence", "review_status")


@query(
    "review_evidence_queue",
    f"""WITH {tb.EVENTS_SQL}, {EVIDENCE_SQL} SELECT i.event_id, e.company_id, e.event_type, e.event_date, e.entity, i.raw_quote
FROM evi i JOIN ev e USING (event_id) WHERE i.review_status = 'pending'""",
)
def review_evidence_queue(spark, sf_dir):
    evidence = _evidence(spark, sf_dir).drop("company_id")
    return rv.pending_evidence(evidence, tb.events(spark, sf_dir)).select(
        "event_id", "company_id", "event_type", "event_date", "entity", "raw_quote"
    )


def _decisions(spark, sf_dir) -> DataFrame:
    """Labelled documents as decisions on the events that cite them."""
    labels = tb.read(spark, sf_dir, "labels")
    return tb.events(spark, sf_dir).join(labels, "doc_id").select(
        F.col("event_id").alias("record_id"),
        F.when(F.col("toxic") == 1, "reject").otherwise("approve").alias("decision"),
        F.lit("reviewer").alias("actor"),
        F.col("event_id").alias("decision_no"),
    )


DECISIONS_SQL = """dec AS (SELECT event_id AS record_id, CASE WHEN toxic = 1 THEN 'reject' ELSE 'approve' END AS decision
  FROM ev JOIN labels USING (doc_id))"""


@query(
    "apply_decisions",
    f"""WITH {tb.EVENTS_SQL}, {EVIDENCE_SQL}, {DECISIONS_SQL} SELECT i.event_id,
CASE WHEN d.decision IS NULL THEN i.is_valid ELSE d.decision = 'approve' END AS is_valid,
CASE WHEN d.decision IS NULL THEN i.review_status WHEN d.decision = 'approve' THEN 'approved' ELSE 'rejected' END AS review_status
FROM evi i LEFT JOIN dec d ON d.record_id = i.event_id""",
)
def apply_decisions(spark, sf_dir):
    state, _ = rv.decide_evidence(_evidence(spark, sf_dir), _decisions(spark, sf_dir))
    return state.select("event_id", "is_valid", "review_status")


@query(
    "audit_history",
    f"""WITH {tb.EVENTS_SQL}, {EVIDENCE_SQL}, {DECISIONS_SQL} SELECT 'evidence_spans' AS table_name, record_id, decision AS action,
'human:reviewer' AS actor, i.review_status AS status_before, CASE WHEN decision = 'approve' THEN 'approved' ELSE 'rejected' END AS status_after
FROM dec JOIN evi i ON i.event_id = record_id""",
)
def audit_history(spark, sf_dir):
    _, changes = rv.decide_evidence(_evidence(spark, sf_dir), _decisions(spark, sf_dir))
    log = up.audit_history(up.audit_rows(changes, "2024-02-01"), "evidence_spans")
    status = lambda c: F.get_json_object(c, "$.review_status")
    return log.select(
        "table_name", "record_id", "action", "actor", status("before_json").alias("status_before"), status("after_json").alias("status_after")
    )


def _pair_decisions(spark, sf_dir, kind: str) -> tuple[DataFrame, DataFrame]:
    """Pairs of ``kind`` with a number, approved or rejected as their first event's document."""
    rows = _relationships(spark, sf_dir).where(F.col("relationship_type") == kind)
    # the decisions and every table that follows read the pairs; both ids have 32 bits of the number
    numbered = cut(rows.withColumn("relationship_id", F.shiftleft("a_id", 32) + F.col("b_id")))
    decided = numbered.where(F.col("review_status") != "pending").select(
        F.col("relationship_id").alias("record_id"),
        F.when(F.col("review_status") == "approved", "approve").otherwise("reject").alias("decision"),
        F.lit("reviewer").alias("actor"),
        F.col("relationship_id").alias("decision_no"),
    )
    return numbered.withColumn("review_status", F.lit("pending")), decided


@query("approve_event_pairs")
def approve_event_pairs(spark, sf_dir):
    pairs, decided = _pair_decisions(spark, sf_dir, "same_event")
    out = rv.decide_event_pairs(pairs, decided, _members(spark, sf_dir), tb.events(spark, sf_dir))
    return out["event_cluster_members"]


@query("approve_thread_pairs")
def approve_thread_pairs(spark, sf_dir):
    canonical, _, rows = _thread_tables(spark, sf_dir)
    pairs, decided = _pair_decisions(spark, sf_dir, "related_distinct")
    known = canonical.select("canonical_id")
    both = pairs.join(known.withColumnRenamed("canonical_id", "a_id"), "a_id").join(
        known.withColumnRenamed("canonical_id", "b_id"), "b_id"
    )
    out = rv.decide_canonical_pairs(both, decided, rows, canonical)
    return out["thread_events"]


# ---------------------------------------------------------------- stored rows: filters, lookups, upserts


@query("evidence_valid", f"WITH {tb.EVENTS_SQL}, {EVIDENCE_SQL} SELECT event_id, matched_text FROM evi WHERE is_valid")
def evidence_valid(spark, sf_dir):
    return lk.valid_evidence(_evidence(spark, sf_dir)).select("event_id", "matched_text")


@query("event_canonical", f"WITH RECURSIVE {CANONICAL_SQL} SELECT event_id, canonical_id, ce.company_id FROM mem JOIN ce USING (canonical_id)")
def event_canonical(spark, sf_dir):
    return lk.canonical_of_events(_members(spark, sf_dir), _canonical(spark, sf_dir))


@query(
    "canonical_seeds",
    f"""WITH RECURSIVE {CANONICAL_SQL} SELECT canonical_id, event_id, ev.event_type, ev.event_date
FROM mem JOIN ev USING (event_id) WHERE is_seed""",
)
def canonical_seeds(spark, sf_dir):
    rows = lk.seed_events(_canonical(spark, sf_dir), _members(spark, sf_dir), tb.events(spark, sf_dir))
    return rows.select("canonical_id", "event_id", "event_type", "event_date")


@query("company_documents", f"WITH {tb.DOCUMENTS_SQL} SELECT doc_id, company_id, published_date FROM docs WHERE source_type = 'news'")
def company_documents(spark, sf_dir):
    return lk.documents_of(tb.documents(spark, sf_dir), source_type="news").select("doc_id", "company_id", "published_date")


@query("documents_by_ids", f"WITH {tb.DOCUMENTS_SQL} SELECT doc_id, title FROM docs WHERE doc_id IN (SELECT doc_id FROM labels)")
def documents_by_ids(spark, sf_dir):
    return lk.by_ids(tb.documents(spark, sf_dir), tb.read(spark, sf_dir, "labels"), "doc_id").select("doc_id", "title")


@query(
    "columns_set",
    f"""WITH {tb.DOCUMENTS_SQL} SELECT doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'toxic ' || l.toxic ELSE title END AS title, published_date
FROM docs LEFT JOIN labels l USING (doc_id)""",
)
def columns_set(spark, sf_dir):
    changes = tb.read(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("toxic "), F.col("toxic").cast("string")).alias("title"))
    table = tb.documents(spark, sf_dir).select("doc_id", "title", "published_date")
    return up.set_columns(table, changes, "doc_id")


@query(
    "evidence_upsert",
    f"""WITH {tb.EVENTS_SQL}, {EVIDENCE_SQL} SELECT event_id, CASE WHEN is_valid THEN match_score ELSE 0.75::DOUBLE END AS match_score,
CASE WHEN is_valid THEN 'exact' ELSE 'fuzzy_rapidfuzz' END AS match_method, event_id AS embedded FROM evi""",
)
def evidence_upsert(spark, sf_dir):
    """Evidence that failed is found again, twice; the later finding wins and the stored embedding stays."""
    stored = _evidence(spark, sf_dir).withColumn("embedding", F.array(F.col("event_id").cast("double")))
    lost = stored.where(~F.col("is_valid")).withColumn("match_method", F.lit("fuzzy_rapidfuzz")).drop("embedding")
    again = lost.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).withColumns(
        {"match_score": F.when(F.col("n") == 2, 0.75).otherwise(0.65), "embedding": F.lit(None).cast("array<double>")}
    )
    rows = up.upsert_evidence(stored, again, "n")
    return rows.select("event_id", "match_score", "match_method", F.col("embedding")[0].cast("long").alias("embedded"))


@query(
    "relationship_upsert",
    f"""WITH {tb.EVENTS_SQL}, {RELATIONS_SQL} SELECT a_id, b_id, CASE WHEN review_status = 'pending' THEN 'unrelated' ELSE relationship_type END AS relationship_type,
CASE WHEN review_status = 'pending' THEN 'llm' ELSE 'human' END AS decided_by FROM rel""",
)
def relationship_upsert(spark, sf_dir):
    """A rerun calls every pair unrelated; decided pairs keep the decision of a person."""
    stored = _relationships(spark, sf_dir).select(
        "a_id", "b_id", "relationship_type", F.when(F.col("review_status") == "pending", "llm").otherwise("human").alias("decided_by")
    )
    rerun = stored.select(
        F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"), F.lit("unrelated").alias("relationship_type"),
        F.lit("llm").alias("decided_by"), F.lit(1).alias("n"),
    )
    return up.upsert_relationships(stored, rerun, "n")


@query(
    "chunks_replaced",
    f"""WITH {tb.DOCUMENTS_SQL} SELECT doc_id, CAST(n AS INTEGER) AS chunk_index, CASE WHEN l.doc_id IS NULL THEN raw_text ELSE 'new ' || n END AS text
FROM docs LEFT JOIN labels l USING (doc_id), range(2) AS r(n) WHERE n = 0 OR l.doc_id IS NOT NULL""",
)
def chunks_replaced(spark, sf_dir):
    """One stored chunk per document; labelled documents are chunked anew, in two."""
    stored = tb.documents(spark, sf_dir).select("doc_id", F.lit(0).alias("chunk_index"), F.col("raw_text").alias("text"))
    known = stored.join(tb.read(spark, sf_dir, "labels"), "doc_id", "left_semi")
    fresh = known.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk_index")).withColumn(
        "text", F.concat(F.lit("new "), F.col("chunk_index").cast("string"))
    )
    return ch.replace_chunks(stored, fresh)


@query(
    "event_provenance",
    f"""WITH {tb.EVENTS_SQL} SELECT event_id, 'rule' AS extraction_model, 'v1' AS prompt_version, entity AS said_entity, raw_quote AS said_quote FROM ev""",
)
def event_provenance(spark, sf_dir):
    rows = up.event_rows(tb.events(spark, sf_dir), "rule", "v1")
    said = lambda f: F.get_json_object("raw_response_json", f"$.{f}")
    return rows.select("event_id", "extraction_model", "prompt_version", said("entity").alias("said_entity"), said("raw_quote").alias("said_quote"))
