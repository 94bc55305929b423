import html
import re

from annalist.llm import html as H
from annalist.llm.queries import QUERIES

PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<div class="cookie-notice">We use cookies <p>ok</div><nav><ul><li>one<li>two</ul></nav>
<%s><h1>Real  title</h1><p>Hello &amp; <b>wor</b>ld, this&nbsp;is<br>text<p>Second <i>para</i>graph with words.<!-- no -->
<script>var a = "</p>";</script><aside>side</aside><form>Sign <input> up</form><table><tr><td>x<td>y</table></%s>
<section class="comments"><p>I like it very much indeed, thank you all</p></section><footer>foot</footer>"""
MAIN = "Real title\nHello & world, this is text\nSecond paragraph with words.\nx\ny"


def test_main_text_without_the_rest():
    for tag in ("article", "main", 'div id="content"'):
        assert H.main_text(PAGE % (tag, tag.split()[0]), {}) == MAIN
    weights = H.learn([PAGE % ("article", "article")] * 3)
    assert all(w < 0 for f, w in weights.items() if f[0] == "<") and weights[".comments"] <= 0 and all(w > 0 for f, w in weights.items() if f[0] == "w")
    assert H.main_text(PAGE % ("article", "article"), weights) == MAIN


def test_left_out_elements_inside_a_block_do_not_break_it():
    assert H.main_text("<p>Hello <script>x</script>big <span class='ad'>buy</span>world <button>go</button>now</p>", {}) == "Hello big world now"


BODY = "<h1>Title</h1><p>First words of the text.</p><p>More words of it.</p>"
TEXT = "Title\nFirst words of the text.\nMore words of it."


def test_names_of_wrappers_and_headings_cost_no_text():
    for wrap in ('<div class="with-sidebar">%s</div>', '<div class="page has-header">%s</div>', '<div id="search-page">%s</div>', "<form>%s</form>"):
        assert H.main_text(wrap % f"<article>{BODY}</article>", {}) == TEXT
    assert H.main_text('<article><h2 id="related-work">Related work</h2><p>words here</p></article>', {}) == "Related work\nwords here"
    assert H.main_text(f'<aside><article>{BODY}</article></aside><div><p>own words of the page</p></div>', {}) == "own words of the page"
    assert H.main_text(f'<div class="main-comments"><article class="comment">{BODY}</article></div>', {}) == ""


def test_several_articles_and_main():
    second = BODY.replace("First", "Second")
    both = f"<article>{BODY}</article><article>{second}</article>"
    assert H.main_text(both, H.learn([both])) == TEXT + "\n" + TEXT.replace("First", "Second")
    assert H.main_text(f"<main><h1>Above</h1><article>{BODY}</article></main>", {}) == "Above\n" + TEXT


def test_learned_weights_decide():
    junk = "<div><p>%s</p></div>" % ("unnamed words beside " * 30)
    box = '<div class="zq-box"><p>%s</p></div>' % ("boxed words " * 40)
    pages = [f"<body>{box}<article>{BODY}</article>{junk}</body>"] * 20
    weights = H.learn(pages)
    assert weights[".zq"] <= H.AWAY and H.main_text(pages[0], weights) == TEXT
    assert "unnamed" in H.main_text(pages[0], {}) and "boxed" in H.main_text(pages[0], {})
    # learned names hold on pages without a labelled element, and an empty article changes nothing
    weights = H.learn([f"<body>{box}<article>{BODY}</article></body>"] * 20)
    assert H.main_text(f"<body>{box}<div>{BODY}</div>{box}</body>", weights) == TEXT
    assert H.main_text(f"<body><article></article><div>{BODY}</div></body>", weights) == TEXT


def test_best_stretch_equals_brute_force():
    import random

    rng = random.Random(2)
    for _ in range(500):
        xs = [rng.choice([-3, -1, 0.5, 2]) for _ in range(rng.randrange(12))]
        a, b = H.best_stretch(xs)
        best = max((sum(xs[i:j]) for i in range(len(xs)) for j in range(i, len(xs) + 1)), default=0)
        assert abs(sum(xs[a:b]) - max(0, best)) < 1e-9


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<"), (4, "u", "plain words"), (5, "u", "<p>" * 3000 + "deep"), (None, "u", "<p>a<p>b</div>"), (7, "u", "<nav>only"), (8, "u", "<p>x " + "long " * 50000), (7, "u", "<nav>only")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, b int")
    got = sorted(((r.page_id or -1), r.text) for r in H.extract(df).collect())
    want = [(-1, "a\nb"), (1, ""), (2, ""), (3, "<"), (4, "plain words"), (5, "deep"), (7, ""), (7, ""), (8, "x " + ("long " * 50000).strip())]
    assert [g for g in got if g[0] != 3] == [w for w in want if w[0] != 3]
    assert H.extract(df.limit(0)).count() == 0


def test_query(spark, sf):
    rows = {r.page_id: r for r in QUERIES["op2_html"](spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        blocks = (re.sub(r"<[^>]+>", "", b.replace("<br>", " ")) for b in re.split(r"</?(?:p|h1|ul|li|div)\b[^>]*>", inner))
        want = "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)
        assert rows[p.page_id].text == want and rows[p.page_id].n_chars == len(want)
