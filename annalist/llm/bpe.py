"""BPE encoding and decoding with the contiguous rank array (operator 5)."""

from __future__ import annotations

import heapq
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Callable
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from annalist.llm.tables import clean_names, map_rows

# Fixed values of the vocabulary's format.
WORD_END = "</w>"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Letters and numbers that Unicode 16.0 added to 15.1, the version Python knows.
NEW_LETTERS = (
    "\u1c89-\u1c8a\ua7cb-\ua7cd\ua7da-\ua7dc\U000105c0-\U000105f3\U00010d4a-\U00010d65\U00010d6f-\U00010d85"
    "\U00010ec2-\U00010ec4\U00011380-\U00011389\U0001138b\U0001138e\U00011390-\U000113b5\U000113b7\U000113d1"
    "\U000113d3\U00011bc0-\U00011be0\U00013460-\U000143fa\U00016100-\U0001611d\U00016d40-\U00016d6c\U00018cff"
    "\U0001e5d0-\U0001e5ed\U0001e5f0"
)
NEW_NUMBERS = "\U00010d40-\U00010d49\U000116d0-\U000116e3\U00011bf0-\U00011bf9\U00016130-\U00016139\U00016d70-\U00016d79\U0001ccf0-\U0001ccf9\U0001e5f1-\U0001e5fa"
# Small letters of the capitals that Unicode 16.0 and 17.0 added.
NEW_SMALL = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}

#: Largest vocabulary file that is sent to the executors, in bytes.
FILE_BYTES = 64 << 20
#: Encoded words of a generation; a task remembers two.
CACHE_WORDS = 150_000
#: Words longer than this keep their ranks in a heap of positions instead of rescanning an array.
SHORT_WORD = 400
_NONE = 1 << 60


def byte_letters() -> list[str]:
    """The printable letter of each byte: itself if printable Latin-1, else the next letter from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@cache
def word_pattern() -> re.Pattern:
    """Contractions, runs of letters, single numbers, runs of other marks; by Unicode 16.0, whatever a library knows."""
    runs: dict[str, list[list[int]]] = {"L": [], "N": []}
    for c in range(sys.maxunicode + 1):
        if (of := runs.get(unicodedata.category(chr(c))[0])) is not None:
            if of and of[-1][1] == c - 1:
                of[-1][1] = c
            else:
                of.append([c, c])
    letters, numbers = ("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs[k]) + new for k, new in (("L", NEW_LETTERS), ("N", NEW_NUMBERS)))
    return re.compile(f"{CONTRACTIONS}|[{letters}]+|[{numbers}]|[^{SPACES}{letters}{numbers}]+")


class Bpe:
    """Encoder and decoder of one vocabulary; keeps the words it has met, up to ``CACHE_WORDS``."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model = spec["model"]
        if model.get("end_of_word_suffix") != WORD_END or spec.get("decoder") is not None:
            raise ValueError("a BPE vocabulary with word ends and no decoder is expected")
        self.ids: dict[str, int] = model["vocab"]
        # a pair's rank is its place in the list; what it becomes is one more vocabulary entry
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(self.ids[a], self.ids[b]): rank for rank, (a, b) in enumerate(pairs)}.get
        self.merge = [self.ids[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.token = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.start = [self.ids[x] for x in byte_letters()]
        self.end = [self.ids[x + WORD_END] for x in byte_letters()]
        self.pattern = word_pattern()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def word(self, word: str) -> list[int]:
        """Ids of one word of the pattern.

        ``ids`` holds the parts between boundaries, ``ranks[i]`` the rank of merging part i
        with the next. The least rank (leftmost on ties) loses its boundary; only the ranks
        of the parts beside it are looked up again.
        """
        start, end = self.start, self.end
        spelled = word.encode()
        ids = [start[b] for b in spelled]
        ids[-1] = end[spelled[-1]]
        if len(ids) > SHORT_WORD:
            return self._long(ids)
        merge = self.merge
        rank = self.rank
        ranks = [rank(pair, _NONE) for pair in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            at = ranks.index(least)
            ids[at] = merge[least]
            del ids[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rank((ids[at], ids[at + 1]), _NONE)
            if at:
                ranks[at - 1] = rank((ids[at - 1], ids[at]), _NONE)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same merges for a very long word: a heap of (rank, place) over linked parts, so cost is n log n."""
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.rank((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            least, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = self.merge[least], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (r := self.rank((ids[k], ids[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k, ids[k], ids[after[k]]))
        return [i for i in ids if i >= 0]

    def _packed(self, chunk: str) -> bytes:
        """Ids of a chunk without white space. Two generations are remembered, so words in use stay."""
        if (out := self.older.get(chunk)) is None:
            small = chunk if chunk.isascii() else chunk.translate(NEW_SMALL)
            ids = [i for w in self.pattern.findall(small) for i in self.word(w)]
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(chunk) <= 64:
            if len(self.known) >= CACHE_WORDS:
                self.older, self.known = self.known, {}
            self.known[chunk] = out
        return out

    def _plain(self, text: str) -> list[bytes]:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # lower-casing is by character: no final form
            text = text.replace("Σ", "σ")
        text = text.lower()
        # no word of the pattern holds white space, so chunks between it can be remembered;
        # U+001C-1F split Python strings but are no white space of the pattern
        chunks = re.findall(f"[^{SPACES}]+", text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        packed = self._packed
        return [self.known.get(c) or packed(c) for c in chunks]

    def encode(self, text: str | None) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers; null and empty give none."""
        if not text:
            return b""
        if "<" not in text:
            return b"".join(self._plain(text))
        out: list[bytes] = []
        for part in self.split_special.split(text):
            if part in self.special:
                out.append(struct.pack("<I", self.special[part]))
            elif part:
                out += self._plain(part)
        return b"".join(out)

    def decode(self, packed: bytes | None) -> str:
        """The tokens of the ids, joined by spaces, as a vocabulary without decoder is read back."""
        token = self.token
        return " ".join([token[i] for i in np.frombuffer(packed or b"", dtype="<u4").tolist()])


def _coder(df: DataFrame, vocabulary: str) -> Callable[[], Bpe]:
    size = Path(vocabulary).stat().st_size
    if size > FILE_BYTES:
        raise ValueError(f"{vocabulary} has {size} bytes; at most {FILE_BYTES} are sent to the executors")
    sent = df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text(encoding="utf-8"))
    return lambda: Bpe(sent.value)


def encode(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """(key, ids): the whole text as packed little-endian unsigned 32-bit ids; no row is lost.

    ``decoded`` adds the text that the ids decode to, by the same worker.

    Null and empty texts get no ids; strings of special tokens in a text become those
    tokens. Repeated rows give repeated rows, an empty table none. ``vocabulary`` is a path
    on the driver.
    """
    coder = _coder(df, vocabulary)
    rows = clean_names(df, key, text)

    def make() -> Callable[[pa.RecordBatch], dict]:
        bpe = coder()

        def of(b: pa.RecordBatch) -> dict:
            ids = [bpe.encode(t) for t in b.column(1).to_pylist()]
            out = {key: b.column(0), "ids": pa.array(ids, pa.binary())}
            return out | {"decoded": pa.array(map(bpe.decode, ids), pa.string())} if decoded else out

        return of

    return map_rows(rows, make, f"`{key}` {rows.schema[key].dataType.simpleString()}, ids binary{', decoded string' if decoded else ''}")


def decode(df: DataFrame, vocabulary: str, keep: list[str] | None = None, ids: str = "ids") -> DataFrame:
    """Columns ``keep`` and ``decoded``: the text that packed ids stand for; null ids give an empty text."""
    coder = _coder(df, vocabulary)
    keep = [c for c in df.columns if c != "decoded"] if keep is None else keep
    rows = clean_names(df, *keep, ids)
    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def make() -> Callable[[pa.RecordBatch], dict]:
        bpe = coder()

        def of(b: pa.RecordBatch) -> dict:
            out = {c: b.column(i) for i, c in enumerate(keep)}
            return out | {"decoded": pa.array([bpe.decode(x) for x in b.column(len(keep)).to_pylist()], pa.string())}

        return of

    return map_rows(rows, make, f"{types}, decoded string")
