"""Landed files as tables: front-matter documents, disclosure listings, archives, news results.

Readers give a frame of good rows and a quarantine frame (detail, error). Nothing here
talks to a network; responses are read from where they were landed.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from annalist.functions import text as tx
from annalist.functions.dates import compact_date, mail_date
from annalist.operators.upserts import DOC_KEY

# What a front-matter document must state, report categories, answer codes.
REQUIRED = ("title", "source_type")
REPORT_CATEGORIES = ("A", "B")
OK_STATUS = ("000", "013")

DOCUMENT_SCHEMA = (
    "company_id long, source_type string, is_official boolean, title string, url string, published_date string, "
    "external_id string, file_path string, raw_text string, metadata map<string,string>, delivery long"
)


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*\z", "")


def _numbered(rows: DataFrame, order: str) -> DataFrame:
    """Deliveries of the same document in order."""
    return rows.withColumn("delivery", F.row_number().over(W.partitionBy(*DOC_KEY).orderBy(order)).cast("long"))


def read_front_matter(spark: SparkSession, folder: str, company_id: int) -> tuple[DataFrame, DataFrame]:
    """Markdown files below ``folder`` with a ``key: value`` header; a missing folder gives no rows."""
    try:
        files = (
            spark.read.option("recursiveFileLookup", "true")
            .option("pathGlobFilter", "*.md")
            .text(folder, wholetext=True)
            .select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"))
        )
    except AnalysisException as error:
        if not _missing(error):
            raise
        return spark.createDataFrame([], DOCUMENT_SCHEMA), spark.createDataFrame([], "company_id long, detail string, error string")
    whole = r"(?sU)\A\s*---[ \t]*\r?\n(.*?)\r?\n?---[ \t]*(?:\r?\n(.*))?\z"
    head = F.regexp_extract("value", whole, 1)

    def field(key: str) -> Column:
        raw = F.trim(F.regexp_extract(head, rf"(?m)^{key}:[ \t]*(.*?)[ \t\r]*$", 1))
        plain = F.regexp_replace(raw, r"""\A(['"])(.*)\1\z""", "$2")
        return F.when(~F.lower(raw).isin("", "null", "~"), plain)

    parsed = files.select(
        "path",
        _stem(F.col("name")).alias("slug"),
        tx.ustrip(F.regexp_extract("value", whole, 2)).alias("raw_text"),
        *[field(k).alias(k) for k in ("title", "source_type", "url", "published_date")],
    )
    absent = F.array_compact(F.array(*[F.when(F.coalesce(F.col(k), F.lit("")) == "", F.lit(k)) for k in REQUIRED]))
    error = F.when(
        F.size(absent) > 0,
        F.concat(F.lit("missing required front-matter field(s): "), F.array_join(absent, ", ")),
    ).when(F.col("raw_text") == "", F.lit("document body is empty"))
    checked = parsed.withColumn("error", error)
    good = checked.where(F.col("error").isNull()).select(
        F.lit(company_id).cast("long").alias("company_id"),
        "source_type",
        (F.col("source_type") != "news").alias("is_official"),
        "title",
        "url",
        "published_date",
        F.concat(F.lit("manual:"), "slug").alias("external_id"),
        F.col("path").alias("file_path"),
        "raw_text",
        F.create_map(F.lit("manual_slug"), "slug").alias("metadata"),
    )
    failed = checked.where(F.col("error").isNotNull()).select(
        F.lit(company_id).cast("long").alias("company_id"),
        F.col("path").alias("detail"),
        F.concat_ws(": ", "path", "error").alias("error"),
    )
    return _numbered(good, "file_path"), failed


def read_company_codes(spark: SparkSession, path: str) -> DataFrame:
    """Company name -> code from the bulk XML; a repeated name keeps its last code."""
    rows = (
        spark.read.format("xml")
        .option("rowTag", "list")
        .schema("corp_code string, corp_name string")
        .load(path)
        .select("corp_code", "corp_name", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
        .where((F.length("corp_name") > 0) & (F.length("corp_code") > 0))
    )
    # inside a block of a file ids grow with the rows; they only rank repeated names and are dropped
    last = rows.groupBy(F.trim("corp_name").alias("name")).agg(F.max_by(F.trim("corp_code"), F.struct("path", "block", "at")).alias("code"))
    return last


def resolve_codes(companies: DataFrame, codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Companies with their code, and those the list does not know."""
    joined = companies.join(codes, "name", "left")
    failed = joined.where(F.col("code").isNull()).select(
        F.col("name").alias("detail"), F.concat(F.lit("no code found for company name "), "name").alias("error")
    )
    return joined.where(F.col("code").isNotNull()), failed


LISTING = (
    "status string, message string, "
    "list array<struct<rcept_no:string,report_nm:string,rcept_dt:string,corp_name:string>>"
)


def read_listings(
    spark: SparkSession, path: str, categories: tuple[str, ...] | None = REPORT_CATEGORIES
) -> tuple[DataFrame, DataFrame]:
    """Filings of landed listing answers, one per receipt number, last one wins.

    Answers lie in ``category=X`` folders, as they were asked for. Answers with an
    error status go to quarantine; "no data" is no error.
    """
    raw = spark.read.schema(LISTING).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    pages = raw.select("*", F.col("_metadata.file_path").alias("path")).withColumn(
        "category", F.regexp_extract("path", r"category=([^/]+)/", 1)
    )
    if categories is not None:
        pages = pages.where(F.col("category").isin(list(categories)))
    ok = F.coalesce(F.col("status"), F.lit("")).isin(list(OK_STATUS))
    failed = pages.where(~ok).select(
        F.lit("list_disclosures").alias("detail"),
        F.concat_ws(" ", F.lit("listing error"), F.concat("status", F.lit(":")), "message").alias("error"),
    )
    rows = pages.where(ok).select("category", "path", F.posexplode("list").alias("at", "f"))
    latest = rows.groupBy(F.col("f.rcept_no").alias("rcept_no")).agg(
        F.max_by(F.struct("f.report_nm", "f.rcept_dt", "f.corp_name", "category"), F.struct("category", "path", "at")).alias("r")
    )
    filings = latest.select(
        "rcept_no", F.col("r.report_nm").alias("title"), compact_date(F.col("r.rcept_dt")).alias("published_date"),
        F.col("r.corp_name").alias("corp_name"), F.col("r.category").alias("category"),
    )
    return filings, failed


MEMBER = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("member_no", T.IntegerType()),
        T.StructField("markup", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


#: A declared encoding in the first bytes of markup: of an XML declaration or a meta element.
_DECLARED = re.compile(rb"""<\?xml[^>]*\bencoding\s*=\s*["']([\w.:-]+)|<meta[^>]*\bcharset\s*=\s*["']?([\w.:-]+)""", re.I)


def decoded(body: bytes) -> str:
    """Markup as text by its byte order mark, its declared encoding, or UTF-8; raises if neither fits."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if body.startswith(mark):
            return body.decode(name)
    said = _DECLARED.search(body[:2048])
    name = next(g for g in said.groups() if g).decode("ascii") if said else "utf-8"
    # the superset that such pages are really written in
    return body.decode({"euc-kr": "cp949", "ks_c_5601-1987": "cp949", "ksc5601": "cp949"}.get(name.lower(), name))


def _unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Archive members as text; opening the container is the only step Spark lacks."""
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for n, name in enumerate(archive.namelist()):
                        try:
                            body, fault = decoded(archive.read(name)), None
                        except (UnicodeDecodeError, LookupError) as e:
                            body, fault = None, f"{name}: {e}"
                        yield pd.DataFrame([(path, n, body, fault)], columns=MEMBER.names)
            except zipfile.BadZipFile:
                yield pd.DataFrame([(path, None, None, "not a valid archive")], columns=MEMBER.names).astype({"member_no": "Int32"})


def read_archives(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rcept_no, raw_text) of landed archives named by receipt number; members join by a blank line."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    members = files.mapInPandas(_unzip, MEMBER)
    name = _stem(F.regexp_extract("path", r"([^/]+)\z", 1))
    text = members.where(F.col("error").isNull()).select(
        name.alias("rcept_no"), "member_no", tx.html_to_text(F.col("markup")).alias("text")
    )
    ordered = F.array_sort(F.collect_list(F.struct("member_no", "text")))
    bodies = text.groupBy("rcept_no").agg(F.array_join(F.transform(ordered, lambda m: m["text"]), "\n\n").alias("raw_text"))
    failed = members.where(F.col("error").isNotNull()).select(name.alias("detail"), "error")
    return bodies, failed


def filing_documents(filings: DataFrame, bodies: DataFrame, company_id: int) -> tuple[DataFrame, DataFrame]:
    """Documents of filings that have a body, and the filings that have none."""
    rows = filings.join(bodies, "rcept_no").select(
        F.lit(company_id).cast("long").alias("company_id"),
        F.lit("dart").alias("source_type"),
        F.lit(True).alias("is_official"),
        "title",
        F.lit(None).cast("string").alias("url"),
        "published_date",
        F.col("rcept_no").alias("external_id"),
        F.lit(None).cast("string").alias("file_path"),
        "raw_text",
        F.create_map(F.lit("rcept_no"), "rcept_no").alias("metadata"),
        F.lit(1).cast("long").alias("delivery"),
    )
    lost = filings.join(bodies, "rcept_no", "left_anti").select(
        F.col("rcept_no").alias("detail"), F.lit("no readable archive").alias("error")
    )
    return rows, lost


NEWS = "query string, error string, items array<struct<title:string,link:string,description:string,pubDate:string>>"


def read_news(spark: SparkSession, path: str, company_id: int) -> tuple[DataFrame, DataFrame]:
    """Articles of landed search answers ({query, items} or {query, error} per line).

    A link counts once, at its first place over the sorted queries; articles without a
    description are left out.
    """
    answers = spark.read.schema(NEWS).json(path)
    failed = answers.where(F.col("error").isNotNull()).select(F.col("query").alias("detail"), "error")
    items = answers.where(F.col("error").isNull()).select("query", F.posexplode("items").alias("at", "i"))
    first = items.groupBy(F.col("i.link").alias("link")).agg(F.min_by(F.struct("query", "i"), F.struct("query", "at")).alias("r"))
    body = tx.strip_tags(F.coalesce("r.i.description", F.lit("")))
    rows = first.select(
        F.lit(company_id).cast("long").alias("company_id"),
        F.lit("news").alias("source_type"),
        F.lit(False).alias("is_official"),
        tx.strip_tags(F.col("r.i.title")).alias("title"),
        F.col("link").alias("url"),
        mail_date(F.col("r.i.pubDate")).alias("published_date"),
        F.col("link").alias("external_id"),
        F.lit(None).cast("string").alias("file_path"),
        body.alias("raw_text"),
        F.create_map(F.lit("query"), F.col("r.query")).alias("metadata"),
        F.lit(1).cast("long").alias("delivery"),
    ).where(F.col("raw_text") != "")
    return rows, failed
