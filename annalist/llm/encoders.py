"""Token ids of whole texts by public vocabularies, at the speed of compiled merges."""

from __future__ import annotations

import base64
import json
import re
import unicodedata
from collections.abc import Callable
from functools import cache, cached_property
from pathlib import Path

import numpy as np
import sentencepiece
import tiktoken
from pyspark.sql import SparkSession
from tokenizers import Tokenizer

from annalist.llm.bpe import CONTRACTIONS, FILE_BYTES, SPACES, WORD_END, byte_letters

#: Characters from here on, and words or spaces longer than this, are left to the tokenizers library.
PLAIN, LONG = "̀", 500
_RARE = re.compile(f"[^\\x00-\\x1b\\x20-{chr(ord(PLAIN) - 1)}]")
_GAP = re.compile(rf"\s{{{LONG}}}")


def _plain(text: str) -> bool:
    """No character whose class or form libraries may know differently, no run that merges slowly."""
    return not (_RARE.search(text) or _GAP.search(text) or len(max(text.split(), key=len, default="")) > LONG)


@cache
def plain_words() -> re.Pattern:
    """The vocabulary's words, for lower-cased plain texts alone (the small dotted i has a mark of its own)."""
    # two capitals have small letters far beyond the plain ones
    there = sorted({x for c in range(128, ord(PLAIN)) for x in chr(c) + chr(c).lower()})
    of = {k: "".join(x for x in there if unicodedata.category(x)[0] == k) for k in "LN"}
    letters, numbers = "a-zA-Z" + of["L"], "0-9" + of["N"]
    return re.compile(f"{CONTRACTIONS}|[{letters}]+|[{numbers}]|[^{SPACES}{letters}{numbers}]+")


class WordIds:
    """Ids of a BPE vocabulary with word ends, as the tokenizers library gives them.

    A space stands for the end of a word: it is a byte that no word holds, so the merges of
    the vocabulary are merges of bytes, and words that end in a space are encoded by
    compiled code. Texts that are not plain, or may hold special tokens, go to the library.
    """

    def __init__(self, definition: str):
        spec = json.loads(definition)
        vocab = spec["model"]["vocab"]
        merged = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in spec["model"]["merges"]]
        firsts = sorted(vocab[x + e] for x in byte_letters() for e in ("", WORD_END))
        if firsts != list(range(512)) or [vocab[m] for m in merged] != list(range(512, 512 + len(merged))):
            raise ValueError("ids in the order of merges are expected")
        byte = {c: bytes([b]) for b, c in enumerate(byte_letters())}
        ranks = {}
        for token, i in vocab.items():
            if i < 512 + len(merged):
                ends = token.endswith(WORD_END) and token != WORD_END
                ranks[b"".join(byte[c] for c in (token[: -len(WORD_END)] if ends else token)) + b" " * ends] = i
        self.merges = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.library = Tokenizer.from_str(definition)
        self.library.no_truncation()
        self.library.no_padding()

    def ids(self, text: str | None) -> list[int]:
        if not text:
            return []
        if _plain(text) and not self.special.search(text):
            found = plain_words().findall(text.lower())
            return self.merges.encode_ordinary(" ".join(found) + " ") if found else []
        return self.library.encode(text, add_special_tokens=False).ids


class ByteIds:
    """Ids of a byte-level BPE vocabulary, special tokens' strings being plain text; ``spelled[i]`` are the bytes of id i."""

    def __init__(self, definition: str, ranks: bytes, pattern: str):
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.merges = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=known, special_tokens={})
        self.definition = definition
        self.spelled = [b""] * (max(known.values()) + 1)
        for word, i in known.items():
            self.spelled[i] = word

    @cached_property
    def library(self) -> Tokenizer:
        of = Tokenizer.from_str(self.definition)
        of.no_truncation()
        of.no_padding()
        of.encode_special_tokens = True
        return of

    def ids(self, text: str) -> list[int]:
        if _plain(text):
            return self.merges.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids


class PieceIds:
    """Ids of a sentencepiece model; ``spelled[i]`` are the bytes of id i: U+2581 is a space, <0xHH> a byte."""

    def __init__(self, model: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)

        def spelled(i: int) -> bytes:
            piece = self.model.id_to_piece(i)
            return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

        self.spelled = [spelled(i) for i in range(self.model.vocab_size())]

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def _bytes(path: str) -> bytes:
    size = Path(path).stat().st_size
    if size > FILE_BYTES:
        raise ValueError(f"{path} has {size} bytes; at most {FILE_BYTES} are sent to the executors")
    return Path(path).read_bytes()


def word_encoder(spark: SparkSession, vocabulary: str) -> Callable[[], WordIds]:
    """What a task calls to get its encoder; ``vocabulary`` is a path on the driver."""
    sent = spark.sparkContext.broadcast(_bytes(vocabulary).decode())
    return lambda: WordIds(sent.value)


def pair_encoder(spark: SparkSession, bytewise: str, ranks: str, pattern: str, piecewise: str) -> Callable[[], tuple[ByteIds, PieceIds]]:
    """What a task calls to get both encoders; the three paths are on the driver."""
    sent = spark.sparkContext.broadcast((_bytes(bytewise).decode(), _bytes(ranks), pattern, _bytes(piecewise)))

    def make() -> tuple[ByteIds, PieceIds]:
        definition, table, pat, model = sent.value
        return ByteIds(definition, table, pat), PieceIds(model)

    return make
