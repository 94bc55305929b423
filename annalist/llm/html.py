"""Main text of web pages as the maximum-scoring stretch of words and tags (operator 2)."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from annalist.llm.tables import clean_names, drawn, map_rows

# HTML elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
UNBROKEN = INLINE | frozenset("script style noscript template button select textarea svg iframe canvas object option input".split())
UNSEEN = frozenset("button select head script style noscript template iframe svg textarea title option object canvas".split())
OUTSIDE = frozenset("nav header footer aside form menu dialog".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar alertdialog".split())
OUTSIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended share sharing social "
    "newsletter subscribe signup login popup modal comment comments reader discussion disqus respond replies reply form search pagination pager toolbar skip".split()
)
LABELLED = frozenset(["article", "main"])
#: Names that part an article of a reader or a teaser from the main one.
ASIDE_NAMES = frozenset(["comment", "comments", "reply", "related"])
#: First words of names that say what else a page has ("with-sidebar"), not what the element is.
HAVING = frozenset(["has", "with", "no", "without"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])

#: Pages, chosen by hash, that weights are learned from, and the most characters of such a page.
SAMPLE_PAGES, SAMPLE_CHARS = 500, 1 << 16
#: Bounds of a tag's and a word's weight.
TAG_WEIGHTS, WORD_WEIGHTS = (-2.0, -0.05), (0.05, 3.0)
#: Least weight of a word outside the labelled element of a page that has one: long text there stays below the tags around it.
OUTSIDE_WORD = 0.001
#: Weight of an element's names from which on its words weigh nothing, and of a name above that pages have not shown.
AWAY, LISTED = -2.0, -3.0

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">]|['\"])*?)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)


def _marks(tag: str, attributes: str) -> list[str]:
    """What tells whether an element is beside the main text: its tag, role, and the words of its names."""
    out = [f"<{tag}>"] if tag in OUTSIDE else []
    if tag in ("body", "html") or not attributes:
        return out
    for name, value in _ATTRIBUTE.findall(attributes):
        value, name = value.strip("\"'").lower(), name.lower()
        if name == "hidden" or name == "role" and value in OUTSIDE_ROLES:
            out.append(f"@{value if name == 'role' else name}")
        elif name in ("class", "id") and tag not in HEADINGS:
            for one in value.split():
                parts = [x for x in re.split(r"[_-]+", one) if x]
                if parts and parts[0] not in HAVING:
                    out += [f".{x}" for x in parts if tag not in LABELLED or x in ASIDE_NAMES]
    return out


def _listed(mark: str) -> bool:
    return mark[0] != "." or mark[1:] in OUTSIDE_NAMES


#: A token: (kind, name, text, element, labelled); kinds are "t" tag and "w" words of a text run, the element
#: is the innermost one with marks, or -1, and labelled tells whether it lies in an article or main element.
Token = tuple[str, str, str, int, bool]


class Element:
    """An element with marks: the one around it that has some, and whether it holds an article or main element."""

    __slots__ = ("around", "marks", "holds")

    def __init__(self, around: int, marks: list[str]) -> None:
        self.around, self.marks, self.holds = around, marks, False


def tokens(page: str | None) -> tuple[list[Token], list[Element]]:
    """Tags and text runs of a page in order, and the elements that have marks; what is never shown is left out.

    A text run carries the innermost block element around it. Unclosed elements end with
    the element around them.
    """
    out: list[Token] = []
    elements: list[Element] = []
    if not page:
        return out, elements
    stack: list[tuple[str, int, int, int]] = []  # tag, unseen, element with marks, labelled depth
    block, unseen, inner, depth, at, end = "", 0, -1, 0, 0, len(page)

    def text(a: int, b: int) -> None:
        if b > a and not unseen:
            s = page[a:b]
            out.append(("w", "", " ", inner, depth > 0) if s.isspace() else ("w", block, s, inner, depth > 0))

    search = _TOKEN.search
    while at < end:
        m = search(page, at)
        if m is None:
            text(at, end)
            break
        text(at, m.start())
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text(m.start() + 9, m.end() - 3)
            continue
        tag = m[2].lower()
        own = inner, depth
        hidden = unseen

        def close(i: int) -> None:
            nonlocal unseen, inner, depth
            del stack[i:]
            _, unseen, inner, depth = stack[-1] if stack else ("", 0, -1, 0)

        if m[1]:
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if i < 0:
                continue
            close(i)
        else:
            if tag in ("p", "li", "option", "tr", "td", "th", "dt", "dd"):  # a new one ends one still open
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        close(i)
                        break
                    if stack[i][0] not in INLINE and stack[i][0] not in ("p", "li", "td", "th", "dt", "dd"):
                        break
            if tag not in VOID and not m[3].endswith("/"):
                if marks := _marks(tag, m[3]):
                    elements.append(Element(inner, marks))
                    inner = len(elements) - 1
                if tag in LABELLED and not marks and not unseen:
                    depth += 1
                    i = inner
                    while i >= 0:
                        elements[i].holds = True
                        i = elements[i].around
                unseen += tag in UNSEEN
                stack.append((tag, unseen, inner, depth))
                own = inner, depth
                if tag in RAW:
                    shut = re.compile(rf"</{tag}\b", re.I).search(page, at)
                    at = shut.start() if shut else end
                    continue
        if not unseen and not hidden:
            out.append(("t", ("/" if m[1] else "") + tag, "", own[0], own[1] > 0))
        block = next((t for t, *_ in reversed(stack) if t not in INLINE), "")
    return out, elements


def away(elements: list[Element], weights: dict[str, float]) -> list[bool]:
    """Which elements are beside the main text: the marks of one, or of one around it, weigh ``AWAY`` or less.

    Names alone never leave out an element that holds the article; a sidebar or footer that holds one stays outside.
    """
    out: list[bool] = []
    for e in elements:
        marks = [m for m in e.marks if not e.holds or m[0] != "." and m not in ("<form>", "@form")]
        total = sum(min(weights.get(m, 0.0), LISTED if _listed(m) else 0.0) for m in marks)
        out.append(total <= AWAY or e.around >= 0 and out[e.around])
    return out


def features(own: list[Token], beside: list[bool]) -> list[tuple[str, int]]:
    """What is weighed of each token, and how often: a tag once, a text run for each word.

    Words of a page with a labelled element are weighed apart inside and outside it; what is beside the main text counts nothing.
    """
    held = any(inside and kind == "w" and name and not (e >= 0 and beside[e]) for kind, name, _, e, inside in own)
    side = {True: "@in", False: "@out"} if held else {True: "", False: ""}
    return [
        (f"<{name}>" if kind == "t" else f"w:{name}{side[inside]}", 0 if e >= 0 and beside[e] else 1 if kind == "t" else len(s.split()))
        for kind, name, s, e, inside in own
    ]


def learn(pages: list[str]) -> dict[str, float]:
    """Log odds of tags, of words by their block, and of elements' names, inside against outside the labelled element.

    A page is labelled by its ``article`` or ``main`` elements. Tags and names stay negative, words positive.
    """
    inside: Counter[str] = Counter()
    outside: Counter[str] = Counter()
    for page in pages:
        own, elements = tokens(page)
        if not any(t[4] for t in own):
            continue
        beside = away(elements, {})
        places: dict[int, bool] = {}
        for (f, n), (kind, name, _, e, within) in zip(features(own, beside), own):
            label = name.lstrip("/") in LABELLED and kind == "t"
            counts = inside if within and not label else outside
            counts[f] += n
            if kind == "w":
                counts[f"w:{name}"] += n if "@" in f else 0
            if e >= 0:
                places[e] = places.get(e, False) or within
        for e, within in places.items():
            if not elements[e].holds:
                for m in set(elements[e].marks):
                    (inside if within else outside)[m] += 1
    words = [sum(n for f, n in c.items() if f.startswith("w:")) + 1 for c in (inside, outside)]
    tags = [sum(n for f, n in c.items() if f.startswith("<")) + 1 for c in (inside, outside)]
    weights = {}
    for f in inside.keys() | outside.keys():
        if f[0] in ".@" or f[1:-1] in OUTSIDE:
            weights[f] = min(TAG_WEIGHTS[1], math.log((inside[f] + 0.5) / (outside[f] + 0.5)))
            continue
        total_in, total_out = words if f.startswith("w:") else tags
        w = math.log((inside[f] + 0.5) / total_in) - math.log((outside[f] + 0.5) / total_out)
        if f.endswith("@out") or f.endswith("@in"):
            w = math.log((inside[f] + 0.5) / (outside[f] + 0.5))
        low, high = WORD_WEIGHTS if f.startswith("w:") else TAG_WEIGHTS
        weights[f] = min(max(w, OUTSIDE_WORD if f.endswith("@out") else low), high)
    return weights


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous stretch of the largest sum, by one scan; the earliest and longest on ties."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += x
        if total > best or total == best and at[1] and start == at[0]:
            best, at = total, (start, i + 1)
    return at


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """Blocks of the best stretch, one line each, character references decoded, white space made single.

    The stretch spans all articles of a page whose words outweigh the tags between them.
    """
    own, elements = tokens(page)
    beside = away(elements, weights)
    scores = [weights.get(f, 2.0 if f.startswith("w:") else -0.5) * n for f, n in features(own, beside)]
    a, b = best_stretch(scores)
    blocks: list[list[str]] = [[]]
    for kind, name, s, e, _ in own[a:b]:
        tag = name.lstrip("/")
        if e >= 0 and beside[e]:
            if kind == "t" and tag not in UNBROKEN:
                blocks.append([])
        elif kind == "w":
            blocks[-1].append(s)
        elif tag in UNBROKEN:
            if name == "br":
                blocks[-1].append(" ")
        else:
            blocks.append([])
    lines = (" ".join(html.unescape("".join(x)).split()) for x in blocks)
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", sample: int = SAMPLE_PAGES) -> DataFrame:
    """(key, url, text) of every page, from its whole HTML.

    Weights are learned on a bounded sample: the ``sample`` pages with an article or main
    element and at most ``SAMPLE_CHARS`` characters that come first by hash of their
    content. Every page is then read in one pass without a shuffle. Null and empty pages, and pages without words, have an empty text;
    repeated pages are extracted alike; an empty table learns nothing and gives no rows.
    """
    rows = clean_names(pages, key, url, page)
    labelled = rows.filter(F.col(f"`{page}`").rlike(r"(?i)<(article|main)[\s>]")).filter(F.length(f"`{page}`") <= SAMPLE_CHARS)
    weights = learn([r[0] for r in drawn(labelled.select(page), F.xxhash64(F.col(f"`{page}`")), sample)])

    def make() -> Callable[[pa.RecordBatch], dict]:
        def of(b: pa.RecordBatch) -> dict:
            return {key: b.column(0), url: b.column(1), "text": pa.array([main_text(x, weights) for x in b.column(2).to_pylist()], pa.string())}

        return of

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, url))
    return map_rows(rows, make, f"{kinds}, text string")
