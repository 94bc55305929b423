import base64
import gzip
import hashlib
from collections import Counter

import pytest

from annalist.llm import warc
from annalist.llm.queries import QUERIES
from annalist.llm.tables import shared_folder

PAGES = [
    (1, "http://a/", "<p>same</p>"), (2, "http://b/ x", "<p>same</p>"), (3, None, "<p>same</p>"), (4, "u", None), (5, "u", ""), (6, "u", "\r\n\r\nWARC/1.1\r\n\r\n"),
    (7, "é", "é\x00\n" * 20000), (None, "u", "<p>same</p>"), (None, "u", "alone"), (8, "u", "twice"), (8, "u", "twice"),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, payload_digest string, k int")


def expected(rows, least=0):
    out = []
    for k, _, h in rows:
        body = (h or "").encode()
        same = [x[0] for x in rows if (x[2] or "").encode() == body and x[0] is not None]
        top = max(same, default=None)
        first = len(body) < least or top == k
        out.append((k, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if first else "revisit", None if first else top))
    return Counter(out)


def got(df):
    return Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


def test_odd_pages_read_back(spark):
    for least in (0, 6):
        path = shared_folder(spark)
        warc.write(table(spark, PAGES), path, min_bytes=least)
        assert got(warc.read_back(spark, path)) == expected(PAGES, least)


def test_archives_are_plain_warc_records(spark):
    path = shared_folder(spark)
    warc.write(table(spark, PAGES), path)
    import glob

    data = b"".join(gzip.open(f).read() for f in glob.glob(f"{path.removeprefix('file:')}/*.gz"))
    records = list(warc._records([data]))
    assert len(records) == len(PAGES) and {r["WARC-Type"] for r in records} == {"response", "revisit"}
    assert all(r["body"] == b"" and r["WARC-Profile"] == warc.PROFILE for r in records if r["WARC-Type"] == "revisit")


def packed(records):
    """One gzip member for each record."""
    return b"".join(gzip.compress(r) for r in records)


def record(kind, key, body, refers=None, digest=None):
    lines = [warc.VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{key}>", "WARC-Target-URI: u", f"WARC-Payload-Digest: sha1:{digest or warc.digest(body)}"]
    lines += [f"WARC-Refers-To: <urn:page:{refers}>"] if refers else []
    return "\r\n".join([*lines, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def test_archives_with_a_member_for_each_record(spark, tmp_path):
    bodies = [b"", b"a\r\n\r\nb", b"x" * 3_000_000]
    whole = [record("response", k, b) for k, b in enumerate(bodies)] + [record("revisit", 9, b"", 2, warc.digest(bodies[2]))]
    (tmp_path / "1.warc.gz").write_bytes(packed(whole))
    rows = {r.page_id: r for r in warc.read_back(spark, str(tmp_path)).collect()}
    assert {k: r.payload_bytes for k, r in rows.items()} == {0: 0, 1: 6, 2: 3_000_000, 9: 3_000_000} and rows[9].refers_to == 2
    few = b"".join(whole[:2])
    for n in (1, 5, 1000):
        assert [r["body"] for r in warc._records(few[i : i + n] for i in range(0, len(few), n))] == bodies[:2]
    cut = packed(whole)[:-9]
    with pytest.raises(ValueError, match="cut short"):
        list(warc._records(warc._unpacked(cut)))
    with pytest.raises(ValueError, match="cut short"):
        list(warc._records(warc._unpacked(gzip.compress(whole[1][:-2]))))


def test_a_revisit_without_its_response_raises(spark, tmp_path):
    (tmp_path / "1.warc.gz").write_bytes(packed([record("response", 1, b"x"), record("revisit", 2, b"", 7, warc.digest(b"y"))]))
    with pytest.raises(Exception, match="no response for the revisit of page 7"):
        warc.read_back(spark, str(tmp_path)).collect()


def test_large_pages_make_more_files(spark):
    path = shared_folder(spark)
    warc.write(table(spark, [(k, "u", f"{k} " * (3 << 20)) for k in range(12)]).coalesce(1), path)
    assert spark.read.format("binaryFile").load(path).count() > 1
    assert warc.read(spark, path).count() == 12


def test_empty_table(spark):
    path = shared_folder(spark)
    warc.write(table(spark, []), path)
    assert warc.read_back(spark, path).count() == 0


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert got(QUERIES["op10_warc"](spark, sf)) == expected(rows)
