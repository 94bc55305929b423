import random
import re

from pyspark.sql import functions as F

from annalist.functions import text as tx
from annalist.operators import chunking as ch

BITS = [
    "# Title", "## 가나", "2.1 two\n", "I. 사업", "IV. x", "가. 나", "【사업의 내용】 z", "\n", "\n\n", "\n\n\n", " \n", "\t",
    "a line of text that is long enough to be kept as a paragraph", "short", "😀 emoji 한글 words", "6.2\n이름(주)",
    "x" * 60, "\r\n", "\x01", "　", "word " * 50, "y" * 1600,
]


def samples(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) + rng.choice(["", "\n", "\n\n"]) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def run(spark, texts, fn):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return {r.i: r.c for r in df.select("i", fn(F.col("t")).alias("c")).collect()}


def by_lines(text):
    """Paragraph spans found line by line."""
    spans, at, open_at = [], 0, None
    for line in text.split("\n"):
        if line and open_at is None:
            open_at = at
        if not line and open_at is not None:
            spans.append((open_at, at - 1))
            open_at = None
        at += len(line) + 1
    if open_at is not None:
        spans.append((open_at, len(text)))
    out = []
    for s, e in spans:
        core = text[s:e].strip()
        if core:
            lead = len(text[s:e]) - len(text[s:e].lstrip())
            out.append((core, s + lead))
    return out


def test_paragraphs_match_a_line_scan(spark):
    texts = samples(200)
    got = run(spark, texts, ch.paragraphs)
    for i, text in enumerate(texts):
        assert [(c.text, c.start_offset) for c in got[i]] == by_lines(text)


def test_every_chunker_gives_exact_slices(spark):
    texts = samples(200, 4)
    for fn in (ch.paragraph_chunks, ch.overlap_chunks, ch.heading_chunks, ch.section_chunks):
        got = run(spark, texts, fn)
        for i, text in enumerate(texts):
            for c in got[i]:
                assert text[c.start_offset : c.end_offset] == c.text and c.text == c.text.strip() or fn is ch.overlap_chunks
                assert text[c.start_offset : c.end_offset] == c.text


def test_short_paragraphs_are_dropped(spark):
    got = run(spark, ["a paragraph of some length here\n\ntiny\n\nanother paragraph of some length"], ch.paragraph_chunks)
    assert [c.text for c in got[0]] == ["a paragraph of some length here", "another paragraph of some length"]


def test_overlap_reaches_back_but_not_beyond_the_previous_start(spark):
    text = "first paragraph with text\n\nsecond paragraph with text\n\n" + "third " * 40
    got = run(spark, [text], lambda c: ch.overlap_chunks(c, 10, 5))[0]
    assert got[0].start_offset == 0
    assert got[1].start_offset == got[0].end_offset - 10
    wide = run(spark, [text], lambda c: ch.overlap_chunks(c, 500, 5))[0]
    assert wide[1].start_offset == 0


def test_long_sections_split_into_paragraphs_under_their_heading(spark):
    body = "\n\n".join("sentence about the design of the system. " * 3 for _ in range(5))
    text = f"lost preamble\n\n# One\n\nshort body\n\n# Two\n\n{body}\n"
    got = run(spark, [text], lambda c: ch.heading_chunks(c, 200))[0]
    assert [c.heading for c in got] == ["# One"] + ["# Two"] * 5
    assert got[0].text.startswith("# One") and not got[1].text.startswith("#")


def test_tiny_sections_fold_forward_and_the_last_one_back(spark):
    long = "body text that is clearly longer than the limit of forty characters"
    text = f"1. a\nx\n2. b\n{long}\n3. c\n{long}\n4. d\ny\n5. e\nz"
    got = run(spark, [text], ch.section_chunks)[0]
    assert [c.heading for c in got] == ["1. a", "3. c"]
    assert got[1].text.endswith("5. e\nz")
    only_tiny = run(spark, ["1. a\nx\n2. b\ny"], ch.section_chunks)[0]
    assert len(only_tiny) == 1 and only_tiny[0].heading == "1. a"


def test_folding_equals_a_sequential_pass(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(150):
        texts.append("\n".join(f"{n}. h\n{'b' * rng.choice([3, 10, 60])}" for n in range(1, rng.randint(2, 8))))
    got = run(spark, texts, ch.section_chunks)
    for i, text in enumerate(texts):
        starts = [m.start() for m in re.finditer(r"^\d+\. h", text, re.M)]
        ends = starts[1:] + [len(text)]
        groups, held = [], None
        for s, e in zip(starts, ends):
            held = s if held is None else held
            if (e - s) - 4 >= 40:
                groups.append([held, e])
                held = None
        if held is not None:
            if groups:
                groups[-1][1] = len(text)
            else:
                groups.append([held, len(text)])
        assert [c.start_offset for c in got[i]] == [g[0] for g in groups]
        assert [c.text for c in got[i]] == [text[s:e].strip() for s, e in groups]


REPORT = "I. 회사의 개요\n1. 개요\n" + "가" * 50 + "\n\nII. 사업의 내용\n1. 사업\n" + "나" * 50 + "\n\nIII. 재무\n1. 요약\n" + "다" * 50


def test_periodic_reports_are_cut_to_their_business_section(spark):
    rows = [(1, "dart", "분기보고서 (2026.03)", REPORT), (2, "dart", "주요사항보고서", REPORT), (3, "blog", "t", "x" * 50)]
    docs = spark.createDataFrame(rows, "doc_id int, source_type string, title string, raw_text string")
    got = ch.chunk_documents(docs).collect()
    one = [r for r in got if r.doc_id == 1]
    assert one and all("나" in r.text and "다" not in r.text for r in one)
    assert all(REPORT[r.start_offset : r.end_offset] == r.text for r in got if r.doc_id in (1, 2))
    assert any("다" in r.text for r in got if r.doc_id == 2)
    assert not [r for r in got if r.doc_id == 3]
    assert [r.doc_id for r in ch.unknown_sources(docs).collect()] == [3]


def test_scope_falls_back_to_the_whole_text(spark):
    df = spark.createDataFrame([("no headings at all",)], "t string")
    r = df.select(ch.scoped_section(F.col("t")).alias("s")).first().s
    assert (r.text, r.base) == ("no headings at all", 0)


def test_rechunking_replaces_all_chunks_of_a_document(spark):
    schema = "doc_id int, chunk_index int, heading string, text string, start_offset long, end_offset long"
    old = spark.createDataFrame([(1, 0, None, "a", 0, 1), (1, 1, None, "b", 1, 2), (2, 0, None, "c", 0, 1)], schema)
    new = spark.createDataFrame([(1, 0, None, "z", 0, 1)], schema)
    assert sorted((r.doc_id, r.text) for r in ch.replace_chunks(old, new).collect()) == [(1, "z"), (2, "c")]


def test_prefix_sums_over_many_blocks(spark):
    df = spark.createDataFrame([([i % 7 for i in range(1000)],), ([],), ([5],)], "a array<int>")
    for r in df.select("a", tx.running_starts(F.col("a")).alias("s")).collect():
        assert r.s == [sum(r.a[:i]) for i in range(len(r.a))]


def test_markup_to_text(spark):
    html = "<html><head><style>p{}</style><title>T &amp; U</title></head><!-- no --><body><p>a&#65;b</p> \n<p>&nbsp;c &middot; &#x1F600;</p><script>var x='<p>';</script></body></html>"
    df = spark.createDataFrame([(html,)], "h string")
    r = df.select(tx.html_to_text(F.col("h")).alias("t"), tx.strip_tags(F.lit("<b>x</b> y")).alias("s")).first()
    assert r.t == "T & U\naAb\nc · 😀"
    assert r.s == "x y"


def test_a_number_alone_in_its_line_is_no_heading(spark):
    body = "words of a body that is long enough to stand alone"
    text = f"148.9.179.169.\n{body}\n2. Two\n{body}\n3\n{body}"
    assert [(c.heading, c.text) for c in run(spark, [text], ch.section_chunks)[0]] == [("2. Two", f"2. Two\n{body}\n3\n{body}")]
    text = f"# \nlost\n# One\n{body}"
    assert [(c.heading, c.text) for c in run(spark, [text], ch.heading_chunks)[0]] == [("# One", f"# One\n{body}")]
