"""Line dedup by pairwise alignment with patience diff (operator 4)."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from annalist.llm.tables import clean_names, discard, map_rows, stored

#: Words that an aligned block needs to be deleted; runs of lines of so many words are what documents are found by.
BLOCK_WORDS = 25

#: A line ends after a line feed, or, so that long paragraphs can be compared, after the mark and space that end a sentence.
ENDS = ("\n", ". ", "! ", "? ")


def split_lines(text: str | None) -> list[str]:
    """Lines with what parts them from the next; joined they are the text."""
    if not text:
        return []
    mark = "\0"  # put after each end; longer than any run of it in the text
    while mark in text:
        mark += mark
    for end in ENDS:
        text = text.replace(end, end + mark)
    out = text.split(mark)
    return out if out[-1] else out[:-1]


def line_table(text: str | None) -> tuple[list[int], list[int]]:
    """Hash and number of words of each line, white space at its ends left out; a blank line has no words."""
    digest = xxhash.xxh64_intdigest
    bare = [line.strip() for line in split_lines(text)]
    counts = [(len(x.split()) if "  " in x else x.count(" ") + 1) if x else 0 for x in bare]
    return [digest(x.encode()) >> 1 for x in bare], counts


def _plain_tables(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``line_table`` says, and where each line begins; white space is that of bytes."""
    part = np.frombuffer(raw, np.uint8)
    ends = part == 10
    ends[1:] |= ((part == 46) | (part == 33) | (part == 63))[:-1] & (part[1:] == 32)
    bounds = np.r_[0, np.flatnonzero(ends) + 1, len(raw)]
    places, digest = bounds.tolist(), xxhash.xxh64_intdigest
    bare = [raw[s:e].strip() for s, e in zip(places, places[1:])]
    hashes = np.array([digest(x) >> 1 for x in bare], np.int64)
    lengths = np.fromiter(map(len, bare), np.int64, len(bare))
    till = np.cumsum(lengths + 1)
    blank = np.frombuffer(b"\n".join([*bare, b""]), np.uint8) == 32
    counts = np.where(lengths > 0, np.diff(blank.cumsum(dtype=np.int32)[till - 1], prepend=0) + 1, 0)
    for i in np.unique(np.searchsorted(till, np.flatnonzero(blank[1:] & blank[:-1]), "right")).tolist():
        counts[i] = len(bare[i].split())
    return hashes, counts.astype(np.int64), bounds[:-1]


def line_runs(texts: list[str | None], least: int) -> tuple[np.ndarray, ...]:
    """The lines of texts that are not blank, and their runs as in ``run_keys``, hashed in one step.

    Hashes and numbers of words of all lines, where each text's begin (and the last's end); the runs,
    once for each text, and where each text's begin.
    """
    hashes, counts, sizes, raws, size = [], [], [], [], 0

    def take() -> None:
        if raws:
            h, c, begins = _plain_tables(b"\n".join(raws))
            hashes.append(h)
            counts.append(c)
            sizes.append(np.diff(np.searchsorted(begins, np.cumsum([0, *(len(r) + 1 for r in raws[:-1])])), append=len(h)))
            raws.clear()

    for t in texts:
        raw = (t or "").encode()
        if _RARE.search(raw) or not raw.isascii() and _has_wide(raw):
            take()
            h, c = line_table(t)
            hashes.append(np.array(h, np.int64))
            counts.append(np.array(c, np.int64))
            sizes.append([len(h)])
            continue
        raws.append(raw)
        size += len(raw)
        if size >= GROUP_BYTES:
            take()
            size = 0
    take()
    none = np.zeros(0, np.int64)
    lines, words, edges = np.concatenate([*hashes, none]), np.concatenate([*counts, none]), np.cumsum(np.concatenate([[0], *sizes, none]))
    filled = words > 0
    edges = np.r_[0, filled.cumsum()][edges]
    lines, words = lines[filled], words[filled]
    till, n = words.cumsum(), len(lines)
    last = np.searchsorted(till, till - words + least)
    starts = np.flatnonzero(last < np.repeat(edges[1:], np.diff(edges)))
    sums = np.r_[np.uint64(0), np.cumsum(lines.view(np.uint64) * _powers(_TURN, n))]
    keys = (_mixed((sums[last[starts] + 1] - sums[starts]) * _powers(_UNTURN, n)[starts]) >> np.uint64(1)).view(np.int64)
    own = np.searchsorted(starts, edges)
    runs = [np.unique(keys[s:e]) for s, e in zip(own[:-1], own[1:])]
    return lines, words, edges, np.concatenate([*runs, none]), np.cumsum([0, *map(len, runs)])


def run_keys(hashes: list[int], counts: list[int], least: int) -> list[int]:
    """Hash of the shortest run of lines with ``least`` words from each line on, blank ones left out."""
    places = [i for i, c in enumerate(counts) if c]
    if len(places) < len(hashes):
        hashes, counts = [hashes[i] for i in places], [counts[i] for i in places]
    digest, packed = xxhash.xxh64_intdigest, np.array(hashes, "<i8").tobytes()
    till = list(accumulate(counts))
    out, j, n, before = [], 0, len(till), 0
    for i, here in enumerate(till):
        while j < n and till[j] - before < least:
            j += 1
        if j == n:
            break
        out.append(digest(packed[8 * i : 8 * j + 8]) >> 1)
        before = here
    return out


_WORD = re.compile(r"\S+")
_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: The same in UTF-8: single ones, and those that begin like dashes and quotes.
_WIDE_RAW, _WIDE_LIKE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80"), re.compile(b"\xe2\x80[\x80-\x8a\xa8\xa9\xaf]")
#: White space for strings that is none for bytes.
_RARE = re.compile(b"[\x1c-\x1f]")
_TURN, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_UNTURN = np.uint64(pow(int(_TURN), -1, 1 << 64))

#: Bytes of a text whose words are hashed in one step; steps end at spaces.
STEP_BYTES = 1 << 16
#: Short texts are hashed together up to so many bytes.
GROUP_BYTES = 1 << 18
_DIGIT = np.where(np.isin(np.arange(256), [9, 10, 11, 12, 13, 28, 29, 30, 31, 32]), np.uint64(0), np.array([xxhash.xxh64_intdigest(bytes([i])) for i in range(256)], np.uint64))


def _powers(x: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(max(0, n - 1), x, np.uint64)])[:n]


_POWERS, _BACK = _powers(_TURN, STEP_BYTES), _powers(_UNTURN, STEP_BYTES)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x *= _MIX
    return x ^ (x >> np.uint64(32))


def _has_wide(raw: bytes) -> bool:
    return any(x in raw for x in _WIDE_RAW) or _WIDE_LIKE.search(raw) is not None


def _raw(text: str | None) -> bytes:
    """The text in UTF-8, white space beyond ASCII as spaces."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return _WIDE.sub(" ", text).encode("utf-8", "surrogatepass") if not raw.isascii() and _has_wide(raw) else raw


def _hashed(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, from the values of its bytes, each turned by its place in the word; and where it begins."""
    out, places, at = [], [], 0
    while at < len(raw):
        end = at + STEP_BYTES
        if end < len(raw):
            cut = raw.rfind(b" ", at, end)
            end = cut + 1 if cut >= 0 else (raw.find(b" ", end) + 1 or len(raw))
        part = np.frombuffer(raw, np.uint8, min(end, len(raw)) - at, at)
        blank = (part - np.uint8(9) < 5) | (part - np.uint8(28) < 5)  # 9 to 13, 28 to 32
        first = ~blank
        first[1:] &= blank[:-1]
        starts = np.flatnonzero(first)
        begin, at = at, end
        if len(starts) == 0:
            continue
        places.append(starts + begin)
        if len(part) <= len(_POWERS):
            sums = np.cumsum(_DIGIT.take(part, mode="clip") * _POWERS[: len(part)])
            till = np.r_[sums[starts[1:] - 1], sums[-1]]
            out.append(_mixed(np.diff(till, prepend=np.uint64(0)) * _BACK[starts]))
        else:  # a part without a space: its words start again at the first power
            place = np.arange(starts[0], len(part)) - np.repeat(starts, np.diff(np.r_[starts, len(part)]))
            out.append(_mixed(np.add.reduceat(_DIGIT[part[starts[0] :]] * _POWERS[place % len(_POWERS)], starts - starts[0])))
    return (np.concatenate(out), np.concatenate(places)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def word_hashes(text: str | None) -> np.ndarray:
    """Hash of each word of ``text.split()``."""
    return _hashed(_raw(text))[0]


def grouped_words(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Hashes of the words of neighbouring texts together: the first text's place, the hashes, and where each text's begin (and the last's end)."""
    at, raws, size = 0, [], 0
    for i, text in enumerate(texts):
        raws.append(_raw(text))
        size += len(raws[-1]) + 1
        if size >= GROUP_BYTES or i + 1 == len(texts):
            hashes, places = _hashed(b" ".join(raws))
            begins = np.cumsum([0, *(len(r) + 1 for r in raws)])
            yield at, hashes, np.searchsorted(places, begins)
            at, raws, size = i + 1, [], 0


def _whole(edges: np.ndarray, size: int) -> np.ndarray:
    """Which runs of ``size`` words of a group lie in one text."""
    n = max(0, int(edges[-1]) - size + 1)
    return np.arange(n) + size <= np.repeat(edges[1:], np.diff(edges))[:n]


def _window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, put together from runs of one, two, four, ... words."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    out, done, runs, p = None, 0, words, 1
    while size:
        turn = np.uint64(pow(int(_TURN), p, 1 << 64))
        if size & 1:
            out, done = (runs if out is None else out[: len(runs) - done] * turn + runs[done:]), done + p
        size >>= 1
        if size:
            runs = runs[: len(runs) - p] * turn + runs[p:]
            p *= 2
    return _mixed(out)


def _least_of(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    p = 1
    while 2 * p <= width:
        x = np.minimum(x[:-p], x[p:])
        p *= 2
    return np.minimum(x[: len(x) - width + p], x[width - p :]) if p < width else x


def _anchor_of(words: np.ndarray, least: int) -> np.ndarray:
    """The anchor of each run of ``least`` words: the least hash among the runs of a third as many words inside.

    So equal runs have equal anchors, and neighbouring runs mostly share theirs.
    """
    size = (least + 2) // 3
    return _least_of(_window_hashes(words, size), least - size + 1).view(np.int64) if len(words) >= least else np.empty(0, np.int64)


def _covered(starts: np.ndarray, n: int, least: int) -> np.ndarray:
    """Which of ``n`` words lie in windows that begin at ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + least, -1)
    return edge.cumsum()[:n] > 0


def _in_lines(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which words of the text lie in the lines of the spans."""
    sizes = np.array([len(x.split()) for x in split_lines(text) if x.strip()], np.int64)
    gone = np.zeros(len(sizes), bool)
    for s, e in spans:
        gone[s:e] = True
    return np.repeat(gone, sizes)


def _anchors(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of lines that occur once on either side, in the longest order both share."""
    once_a, once_b = Counter(a), Counter(b)
    at = {h: i for i, h in enumerate(a) if once_a[h] == 1}
    pairs = [(at[h], j) for j, h in enumerate(b) if once_b[h] == 1 and h in at]
    tops: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for k, (i, _) in enumerate(pairs):
        p = bisect_left(tops, i)
        back[k] = ends[p - 1] if p else -1
        tops[p : p + 1] = [i]
        ends[p : p + 1] = [k]
    chain, k = [], ends[-1] if ends else -1
    while k >= 0:
        chain.append(pairs[k])
        k = back[k]
    return chain[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Aligned common blocks (place in a, place in b, lines), in order.

    Lines unique on both sides anchor the alignment and grow both ways; the gaps between
    are aligned by the same rule, and a gap without unique lines by its longest common run.
    """
    blocks: list[tuple[int, int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        if alo >= ahi or blo >= bhi:
            continue
        chain = _anchors(a[alo:ahi], b[blo:bhi])
        if not chain:
            i, j, n = _longest(a, alo, ahi, b, blo, bhi)
            if n:
                blocks.append((i, j, n))
                todo += [(alo, i, blo, j), (i + n, ahi, j + n, bhi)]
            continue
        x, y = alo, blo
        for i, j in chain:
            i, j = i + alo, j + blo
            if i < x or j < y:
                continue
            s, t = i, j
            while s > x and t > y and a[s - 1] == b[t - 1]:
                s, t = s - 1, t - 1
            e, f = i + 1, j + 1
            while e < ahi and f < bhi and a[e] == b[f]:
                e, f = e + 1, f + 1
            blocks.append((s, t, e - s))
            todo.append((x, s, y, t))
            x, y = e, f
        todo.append((x, ahi, y, bhi))
    blocks.sort(key=lambda k: k[1])
    out: list[tuple[int, int, int]] = []
    for i, j, n in blocks:
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + n)
        else:
            out.append((i, j, n))
    return out


def _longest(a: list[int], alo: int, ahi: int, b: list[int], blo: int, bhi: int) -> tuple[int, int, int]:
    places: dict[int, list[int]] = {}
    for i in range(alo, ahi):
        places.setdefault(a[i], []).append(i)
    best, lengths = (0, 0, 0), {}
    for j in range(blo, bhi):
        now = {}
        for i in places.get(b[j], ()):
            n = now[i] = lengths.get(i - 1, 0) + 1
            if n > best[2]:
                best = (i - n + 1, j - n + 1, n)
        lengths = now
    return best


def repeated(a: list[int], b: list[int], counts: list[int], least: int) -> list[tuple[int, int]]:
    """Stretches (start, end) of lines of ``b`` that blocks of at least ``least`` words share with ``a``.

    Alignment keeps order, so what it leaves is aligned again; where it finds nothing more,
    a run that both sides still have, moved or hidden by shorter matches, is looked up and
    grown. So no common block of so many words stays.
    """
    if a == b:  # an exact copy is one block
        return [(0, len(b))] if sum(counts) >= least else []
    # lines of one side alone part what is around them; for the rest only their number matters
    both = set(a) & set(b)
    a = _shared(a, both)
    size = dict(zip(b, counts))
    places = {k: i for i, k in reversed(list(enumerate(run_keys(a, [size.get(h, least) for h in a], least))))}
    if len(both) * 2 < len(b):
        return [s for lo, hi in _stretches(b, both) for s in _cut_out(a, b, counts, least, places, lo, hi)]
    return sorted(_cut_out(a, b, counts, least, places, 0, len(b)))


def _shared(lines: list[int], both: set[int]) -> list[int]:
    """The lines of ``both``, with one mark, met nowhere else, for each gap between them."""
    out, gap = [], -1
    for h in lines:
        if h in both:
            out.append(h)
        elif not out or out[-1] >= 0:
            out.append(gap)
            gap -= 1
    return out


def _stretches(lines: list[int], both: set[int]) -> list[tuple[int, int]]:
    out, start = [], -1
    for i, h in enumerate(lines):
        if h in both:
            if start < 0:
                start = i
        elif start >= 0:
            out.append((start, i))
            start = -1
    return out + ([(start, len(lines))] if start >= 0 else [])


def _cut_out(a: list[int], b: list[int], counts: list[int], least: int, places: dict[int, int], lo: int, hi: int) -> list[tuple[int, int]]:
    out = []
    left = [(lo, hi)]
    while left:
        lo, hi = left.pop()
        own, words = b[lo:hi], counts[lo:hi]
        if sum(words) < least:
            continue
        runs = run_keys(own, words, least)
        if not any(k in places for k in runs):
            continue
        blocks = [(j, j + n) for _, j, n in patience(a, own) if sum(words[j : j + n]) >= least]
        if not blocks:
            j = next(j for j, k in enumerate(runs) if k in places)
            i, n = places[runs[j]], 0
            while i + n < len(a) and j + n < len(own) and a[i + n] == own[j + n]:
                n += 1
            blocks = [(j, j + n)]
        last = 0
        for s, e in blocks:
            out.append((lo + s, lo + e))
            left.append((lo + last, lo + s))
            last = e
        left.append((lo + last, hi))
    return sorted(out)


def deletions(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = BLOCK_WORDS) -> DataFrame:
    """(doc, earlier, start, end): lines that the document shares with an earlier one, by place among its lines that are not blank.

    Documents are found by runs of lines of ``least`` words, hashed: every common block of so
    many words holds one. The least key that has a run is its owner, found in parts before the shuffle; each
    later holder is aligned with the owner alone, so a passage in very many documents makes one
    pair for each, not all pairs. No run is left out for being frequent.
    """
    rows = clean_names(docs, key, text)

    def of(b: pa.RecordBatch) -> dict:
        hashes, counts, edges, runs, own = line_runs(b.column(1).to_pylist(), least)
        lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values))
        return {"doc": b.column(0).cast(pa.int64()), "hashes": lists(edges, hashes), "counts": lists(edges, counts.astype(np.int32)), "runs": lists(own, runs)}

    lines = stored(map_rows(rows, lambda: of, "doc long, hashes array<long>, counts array<int>, runs array<long>").filter("doc is not null and size(runs) > 0"))
    each = lines.select("doc", F.explode("runs").alias("run"))
    owners = each.groupBy("run").agg(F.min("doc").alias("owner"), F.max("doc").alias("last")).filter("owner < last")
    # a computed key: both sides of the join get an exchange, and the run of very many documents is split
    owners = owners.select(F.col("run").bitwiseXOR(F.lit(0).cast("long")).alias("r"), "owner")
    pairs = each.join(owners, F.col("run") == F.col("r")).filter("owner < doc").select("doc", "owner").distinct()

    later = lines.select(F.col("doc").alias("d"), F.col("hashes").alias("b"), F.col("counts").alias("bc"))
    earlier = lines.select(F.col("doc").alias("o"), F.col("hashes").alias("a"))
    both = pairs.join(earlier, F.col("owner") == F.col("o")).join(later, F.col("doc") == F.col("d")).select("doc", "owner", "a", "b", "bc")

    def align(b: pa.RecordBatch) -> dict:
        out: list[tuple[int, int, int, int]] = []
        for doc, owner, a, own, counts in zip(*(b.column(i).to_pylist() for i in range(5))):
            out += [(doc, owner, s, e) for s, e in repeated(a, own, counts, least)]
        columns = list(zip(*out)) if out else [[], [], [], []]
        return {n: pa.array(columns[i], pa.int64()) for i, n in enumerate(("doc", "earlier", "start", "end"))}

    out = stored(map_rows(both, lambda: align, "doc long, earlier long, start long, end long"))
    discard(lines)
    return out


def shared_windows(docs: DataFrame, gone: DataFrame, key: str = "doc_id", text: str = "text", least: int = BLOCK_WORDS) -> DataFrame:
    """(gone_doc, windows, owners): hashes of the runs of ``least`` words that an earlier document has too, wherever lines end.

    ``gone`` has the lines that are cut already (gone_doc, gone_spans). Every window has one
    anchor, fewer and shorter than windows, and equal windows have equal ones; a document gives out only
    windows whose anchor another document has, and which are not all in lines that are cut: the earliest
    holder of a window never loses it by lines. So every window of two documents is met.
    """
    rows = clean_names(docs, key, text)
    doc = F.col(f"`{key}`").cast("long")
    ints = pa.list_(pa.int64())

    def anchored(b: pa.RecordBatch) -> dict:
        out = []
        for _, words, edges in grouped_words(b.column(1).to_pylist()):
            whole = _whole(edges, least)
            anchor, own = _anchor_of(words, least)[whole], np.r_[0, np.cumsum(whole)][np.minimum(edges, len(whole))]
            out += [np.unique(anchor[s:e]) for s, e in zip(own[:-1], own[1:])]
        return {"doc": b.column(0).cast(pa.int64()), "anchors": pa.array(out, ints)}

    anchors = stored(map_rows(rows, lambda: anchored, "doc long, anchors array<long>").filter("doc is not null and size(anchors) > 0"))
    each = anchors.select("doc", F.explode("anchors").alias("anchor"))
    met = each.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high")
    # computed keys, as in deletions: what very many documents share is split
    met = met.select(F.col("anchor").bitwiseXOR(F.lit(0).cast("long")).alias("a"))
    near = each.join(met, F.col("anchor") == F.col("a")).groupBy(F.col("doc").alias("near_doc")).agg(F.collect_set("anchor").alias("near"))
    held = rows.select(doc.alias("doc"), F.col(f"`{text}`").alias("t")).join(near, F.col("doc") == F.col("near_doc")).join(gone, F.col("doc") == F.col("gone_doc"), "left").select("doc", "t", "near", "gone_spans")

    def given(b: pa.RecordBatch) -> dict:
        out = []
        texts, near, spans = b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()
        for at, words, edges in grouped_words(texts):
            hashes, anchor = _window_hashes(words, least).view(np.int64), _anchor_of(words, least)
            # an anchor that another document has is one of every text that holds it; neighbours mostly have the same
            turns = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else np.zeros(0, np.int64)
            met = np.isin(anchor[turns], near.slice(at, len(edges) - 1).flatten().to_numpy())
            wanted = np.repeat(met, np.diff(np.r_[turns, len(anchor)])) & _whole(edges, least)
            for i, (s, e) in enumerate(zip(edges[:-1], edges[1:]), at):
                last = max(s, e - least + 1)
                mine = wanted[s:last]
                if spans[i] and len(mine):
                    kept = np.r_[0, (~_in_lines(texts[i], [(x["start"], x["end"]) for x in spans[i]])).cumsum()]
                    mine = mine & (kept[least:] > kept[:-least])
                out.append(np.unique(hashes[s:last][mine]))
        return {"doc": b.column(0), "windows": pa.array(out, ints)}

    kept = stored(map_rows(held, lambda: given, "doc long, windows array<long>").filter("size(windows) > 0"))
    discard(anchors)
    some = kept.select("doc", F.explode("windows").alias("window"))
    owners = some.groupBy("window").agg(F.min("doc").alias("owner"), F.max("doc").alias("last")).filter("owner < last")
    owners = owners.select(F.col("window").bitwiseXOR(F.lit(0).cast("long")).alias("w"), "owner")
    later = some.join(owners, F.col("window") == F.col("w")).filter("owner < doc")
    out = stored(later.groupBy(F.col("doc").alias("cut_doc")).agg(F.collect_set("window").alias("cut_windows"), F.collect_set("owner").alias("cut_owners")))
    discard(kept)
    return out


def _without(line: str, gone: np.ndarray) -> str:
    """The line without the words that are marked, each with the space up to the next."""
    places = [m.span() for m in _WORD.finditer(line)]
    out, at = [], 0
    for i, (s, e) in enumerate(places):
        if gone[i]:
            out.append(line[at:s])
            at = places[i + 1][0] if i + 1 < len(places) else e
    return "".join([*out, line[at:]])


def cut_lines(text: str, spans: list[tuple[int, int]], words: np.ndarray | None = None) -> tuple[str, int]:
    """The text without the lines of the spans, by place among its lines that are not blank, and how many went.

    ``words`` marks further words to cut; a line that has no others goes like those of the spans.
    """
    gone = set()
    for s, e in spans:
        gone.update(range(s, e))
    n = len(gone)
    parts = split_lines(text)
    if words is not None:
        i = at = 0
        for p, line in enumerate(parts):
            if size := len(line.split()):
                mine = words[at : at + size]
                if mine.all():
                    gone.add(i)
                elif mine.any() and i not in gone:
                    parts[p] = _without(line, mine)
                i, at = i + 1, at + size
    kept, i = [], 0
    for line in parts:
        if line.strip():
            if i not in gone:
                kept.append(line)
            elif line.endswith("\n") and kept and not kept[-1].endswith("\n"):
                kept.append("\n")
            i += 1
        elif not kept or kept[-1] != line or line != "\n" or (i - 1) not in gone:
            kept.append(line)
    return "".join(kept), n


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = BLOCK_WORDS) -> DataFrame:
    """The rows with ``text`` cut, and columns ``n_removed`` (lines), ``n_cut`` (words) and ``shared_with`` (earlier keys).

    Every aligned block of lines of at least ``least`` words that an earlier document (smaller key)
    has too is deleted from the later one, and so is every other run of ``least`` words that one has, wherever
    its lines end; the earliest keeps it, and shorter repeats stay. ``n_removed`` counts the lines of
    blocks, ``n_cut`` the words that went besides. A document that is wholly repeated is left empty.
    Null and empty texts and null keys
    are passed on as they are; rows that repeat a key have equal lines and are one document;
    an empty table gives no rows. Columns named like the new ones are replaced.
    """
    gone = stored(deletions(docs, key, text, least).groupBy(F.col("doc").alias("gone_doc")).agg(F.collect_list(F.struct("start", "end")).alias("gone_spans"), F.collect_set("earlier").alias("gone_owners")))
    cut = shared_windows(docs, gone, key, text, least)
    rows = docs.drop("n_removed", "n_cut", "shared_with", *gone.columns, *cut.columns)
    doc = F.col(f"`{key}`").cast("long")
    both = rows.join(gone, doc == F.col("gone_doc"), "left").join(cut, doc == F.col("cut_doc"), "left")
    none = F.array().cast("array<long>")
    shared = F.array_sort(F.array_union(F.coalesce("gone_owners", none), F.coalesce("cut_owners", none)))
    kept = [c for c in rows.columns]
    both = both.select(*[F.col(f"`{c}`") for c in kept], "gone_spans", "cut_windows", shared.alias("shared_with"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)

    def of(b: pa.RecordBatch) -> dict:
        texts, spans, found = b.column(kept.index(text)), b.column(len(kept)), b.column(len(kept) + 1)
        touched = pc.or_(spans.is_valid(), found.is_valid())
        at = np.flatnonzero(touched.to_numpy(zero_copy_only=False))
        new, counts, cuts = texts.take(pa.array(at)).to_pylist(), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
        lined = [[(x["start"], x["end"]) for x in s or []] for s in spans.take(pa.array(at)).to_pylist()]
        marked: dict[int, np.ndarray] = {}
        some = [i for i, k in enumerate(at.tolist()) if found[k].is_valid]
        for first, words, edges in grouped_words([new[i] for i in some]):
            hashes = _window_hashes(words, least).view(np.int64)
            for i, s, e in zip(some[first:], edges[:-1], edges[1:]):
                own = hashes[s : max(s, e - least + 1)]
                marked[i] = _covered(np.flatnonzero(np.isin(own, found[int(at[i])].values.to_numpy())), int(e - s), least)
                cuts[at[i]] = int((marked[i] & ~_in_lines(new[i], lined[i])).sum()) if lined[i] else int(marked[i].sum())
        for i, s in enumerate(lined):
            new[i], counts[at[i]] = cut_lines(new[i], s, marked.get(i))
        out = {c: b.column(i) for i, c in enumerate(kept)}
        out[text] = pc.replace_with_mask(texts, touched, pa.array(new, texts.type))
        return out | {"n_removed": pa.array(counts, pa.int64()), "n_cut": pa.array(cuts, pa.int64()), "shared_with": b.column(len(kept) + 2)}

    return map_rows(both, lambda: of, f"{kinds}, n_removed long, n_cut long, shared_with array<long>")
