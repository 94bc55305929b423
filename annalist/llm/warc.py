"""WARC archives with resolved revisits (operator 10)."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from annalist.llm.tables import stored

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Uncompressed bytes of records that an archive file holds, on average.
FILE_BYTES = 24 << 20
#: Most records of an archive file.
FILE_RECORDS = 4000
#: Bytes that are unpacked at once.
PIECE = 1 << 20


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in bare upper-case base32: five hex digits become four letters."""
    hexes = F.sha1(payload)
    letters = []
    for i in range(8):
        bits = F.conv(F.substring(hexes, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def resolved(pages: DataFrame, key: str = "page_id", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """The rows with payload_bytes, payload_digest and refers_to (the key they revisit; null: a response).

    Headers alone are shuffled by digest to find the largest key of each, in parts before
    the shuffle; that table is joined back, and skewed digests are split by the join.
    Payloads under ``min_bytes`` are all responses. A null payload counts as empty, a null
    key revisits any other; rows repeated with key and payload are all responses.
    """
    body = F.coalesce(F.col(f"`{payload}`"), F.lit(""))
    rows = pages.withColumns({"payload_bytes": F.octet_length(body).cast("long"), "payload_digest": base32_sha1(body)})
    heads = rows.select(F.col(f"`{key}`").alias("k"), "payload_bytes", "payload_digest").filter(F.col("payload_bytes") >= min_bytes)
    # a computed key, so that the join has an exchange of its own on both sides and can split skewed digests
    first = heads.groupBy("payload_digest").agg(F.max("k").alias("origin")).select(F.concat("payload_digest", F.lit("")).alias("d"), "origin")
    again = (F.col("payload_bytes") >= min_bytes) & ~F.col("origin").eqNullSafe(F.col(f"`{key}`"))
    return rows.join(first, F.col("payload_digest") == F.col("d"), "left").withColumn("refers_to", F.when(again, F.col("origin"))).drop("d", "origin")


def _id(key: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">"))


def _line(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit("\r\n"))


def write(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, date: str | None = None
) -> None:
    """Write one record per page into archives below ``path``.

    A response carries the payload in UTF-8, a revisit only headers that name the response.
    Spark's text writer ends each record with the two line ends the format asks for,
    so the archives are gzip files of plain WARC records, committed like any Spark output;
    a lost executor's files are written again. White space in a URL is taken out; a null URL is ``urn:null``. ``date``
    is the record date, by default the time of writing. Files hold about ``FILE_BYTES`` of payloads, by their mean size. Null and empty payloads are records of zero bytes; an empty
    table writes empty archives.
    """
    rows = pages.select(
        F.col(f"`{key}`").alias("k"), F.regexp_replace(F.coalesce(F.col(f"`{url}`"), F.lit("urn:null")), r"\s", "").alias("u"),
        F.coalesce(F.col(f"`{payload}`"), F.lit("")).alias("body"),
    )
    both = resolved(rows, "k", "body", min_bytes)
    again = F.col("refers_to").isNotNull()
    header = F.concat(
        F.lit(VERSION + "\r\n"),
        _line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _id(F.col("k"))),
        _line("WARC-Target-URI", F.col("u")),
        _line("WARC-Date", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'") if date is None else date),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(again, F.concat(_line("WARC-Profile", PROFILE), _line("WARC-Refers-To", _id(F.col("refers_to"))))).otherwise(F.lit("")),
        _line("Content-Type", "text/html; charset=utf-8"),
        _line("Content-Length", F.when(again, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"),
    )
    record = F.concat(header, F.when(again, F.lit("")).otherwise(F.col("body")))
    mean = rows.agg(F.avg(F.octet_length("body"))).first()[0] or 0.0
    most = max(1, min(FILE_RECORDS, int(FILE_BYTES / max(mean, 1.0))))
    both.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def _unpacked(content: bytes) -> Iterator[bytes]:
    """The bytes of all gzip members of a file, in pieces; a file that ends inside a member raises."""
    while content.rstrip(b"\0"):
        member = zlib.decompressobj(47)
        while not member.eof:
            piece = member.decompress(content, PIECE)
            content = member.unconsumed_tail
            if piece:
                yield piece
            elif not member.eof and not content:
                raise ValueError("an archive is cut short")
        content = member.unused_data


def _records(pieces: Iterable[bytes]) -> Iterator[dict]:
    """The records of one archive, payloads by their stated length; one record and one piece are held."""
    pieces, held = iter(pieces), bytearray()

    def fill(n: int) -> bool:
        while len(held) < n:
            if (more := next(pieces, None)) is None:
                return False
            held.extend(more)
        return True

    while fill(1):
        while (stop := held.find(b"\r\n\r\n")) < 0:
            if not fill(len(held) + 1):
                raise ValueError("a record is cut short")
        lines = held[:stop].decode("utf-8").split("\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"no record here: {lines[0][:40]!r}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        end = stop + 4 + size
        if not fill(end + 4) or held[end : end + 4] != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield fields | {"body": bytes(held[stop + 4 : end])}
        del held[: end + 4]


RECORDS = "page_id long, url string, record_type string, refers_to long, digest string, body binary"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, digest, body): the records of the archives below ``path``.

    Archives may have a gzip member for each record or one for all. A task holds the packed
    bytes of a file and one unpacked record; a file that is cut short raises.
    """

    def of(key: str | None) -> int | None:
        return None if key in (None, "<urn:page:>") else int(key.removeprefix("<urn:page:").removesuffix(">"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("body", pa.binary())])
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for r in _records(_unpacked(content.as_py())):
                    rows.append({
                        "page_id": of(r["WARC-Record-ID"]), "url": r["WARC-Target-URI"], "record_type": r["WARC-Type"],
                        "refers_to": of(r.get("WARC-Refers-To")), "digest": r["WARC-Payload-Digest"].removeprefix("sha1:"), "body": r["body"],
                    })
                    held += len(r["body"])
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    # one file a batch would be best; a batch holds few files, as each is several MB
    return files.select("content").mapInArrow(run, RECORDS)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) with revisits joined to their responses.

    Length and digest are taken from the payload itself, for a revisit from that of the
    response it names; a header digest that differs, and a revisit without its response, raise.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [(len(x), digest(x)) if kind == "response" else (None, None) for kind, x in zip(b.column(2).to_pylist(), b.column(5).to_pylist())]
            wrong = next((p for p, (n, d), said in zip(b.column(0).to_pylist(), own, b.column(4).to_pylist()) if n is not None and d != said), None)
            if wrong is not None:
                raise ValueError(f"the payload of page {wrong} does not have the digest its header states")
            yield pa.RecordBatch.from_pydict({
                "page_id": b.column(0), "url": b.column(1), "record_type": b.column(2), "refers_to": b.column(3), "said": b.column(4),
                "n": pa.array([x[0] for x in own], pa.int64()), "d": pa.array([x[1] for x in own], pa.string()),
            })

    records = stored(read(spark, path).mapInArrow(run, "page_id long, url string, record_type string, refers_to long, said string, n long, d string"))
    responses = records.filter("record_type = 'response'")
    known = responses.groupBy(F.col("page_id").alias("o"), F.col("d").alias("od")).agg(F.max("n").alias("on"))
    revisits = records.filter("record_type = 'revisit'")
    named = revisits.join(known, (F.col("refers_to") == F.col("o")) & (F.col("said") == F.col("od")), "left")
    lost = F.raise_error(F.concat(F.lit("no response for the revisit of page "), F.coalesce(F.col("refers_to").cast("string"), F.lit("null"))))
    named = named.withColumn("on", F.when(F.col("od").isNull(), lost.cast("long")).otherwise(F.col("on")))
    return responses.select("page_id", "url", F.col("n").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", "refers_to").union(
        named.select("page_id", "url", "on", "od", "record_type", "refers_to")
    )
