"""Exact byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word, the token with which its encoding ends is unique: it is the one
vocabulary token that ends there, begins where another prefix ends, and is compatible
with that prefix's own last token. An automaton over the vocabulary finds all tokens
that end at each place in one pass; the pair test decides which of them continues; going
back from the end of the word emits the ids. A word costs time in proportion to its
length, while merging pairs one by one is quadratic for long words.

**Pair test.** Merges happen in order of rank. While a token is built, the piece at its
right edge goes through its right spine (itself, its right part, that one's right part ...),
and each piece lives until its parent's merge. The border between two tokens is kept if no
merge of a piece of the left one's right spine with a piece of the right one's left spine
comes while both live. Of equal merges the left one comes first.

The vocabulary comes from a tokenizer file in the format of the ``tokenizers`` library
with byte-level words and an end-of-word suffix. Words are cached, with a bound.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contest_analytics.llm.common import text_rows

#: Words and pairs that a worker remembers before it starts afresh.
CACHE = 300_000
#: Marks that end most chunks, and the first letter that may change its kind when lower-cased.
MARKS, LATIN_END = ".,;:!?", "\u0130"
#: Stands for the end-of-word suffix in the automaton; no byte is spelled like this.
END = "\n"
NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The letter of each byte: printable Latin-1 as it is, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in plain)
    letters = {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}
    return [letters[b] for b in range(256)]


class Cache(dict):
    """Text -> little-endian ids; an unknown text is encoded when it is asked for."""

    def __init__(self, encode: Callable[[str], bytes]) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, text: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        self[text] = ids = self.encode(text)
        return ids


class Words:
    """Splits texts as the tokenizer file says; ``encode`` turns one spelled word into ids."""

    def __init__(self, spec: dict, encode: Callable[[str], list[int]]) -> None:
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.find = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")).findall
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.added = {text: np.array([n], "<u4").tobytes() for text, n in added.items()}
        letters = byte_letters()

        plain = {b: letters[b] for b in range(128)}

        def word_ids(word: str) -> bytes:
            if word.isascii():
                ids = encode(word.translate(plain))
            else:
                ids = encode("".join(letters[b] for b in word.encode("utf-8", "replace")))
            return struct.pack(f"<{len(ids)}I", *ids)

        self.words, self.chunks = Cache(word_ids), Cache(self._chunk)

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        # Letter by letter: the rule for a final sigma does not apply.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _chunk(self, text: str) -> bytes:
        # The common forms, a word of plain Latin letters and perhaps a mark after it, need no splitting.
        word, mark = (text[:-1], text[-1]) if text[-1] in MARKS else (text, "")
        if word.isalpha() and (word.isascii() or max(word) < LATIN_END):
            return self.words[word.lower()] + (self.words[mark] if mark else b"")
        parts = self.special.split(text) if self.special and "<" in text else [text]
        known = self.words.__getitem__
        done = [self.added.get(p) or b"".join(map(known, self.find(self.normal(p)))) for p in parts if p]
        return b"".join(done)

    def ids(self, text: str | None) -> bytes:
        """The ids of a text as little-endian 32-bit integers.

        White space ends a word in any case, so what stands between is encoded by itself.
        """
        if not text:
            return b""
        # split() also divides at these four, which are no white space here.
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self._chunk(text)
        return b"".join(map(self.chunks.__getitem__, text.split()))


class PrefixEncoder:
    """Ids of one word, spelled in byte letters, by the last token of every prefix."""

    def __init__(self, model: dict) -> None:
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.automaton = ahocorasick.Automaton()
        for token, n in vocab.items():
            final = token.endswith(suffix)
            plain = token.removesuffix(suffix)
            self.automaton.add_word(plain + END * final, (n, len(plain), final))
        self.automaton.make_automaton()
        self.rank: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            a, b = vocab[left], vocab[right]
            self.rank[a, b] = rank
            parts.setdefault(vocab[left + right], (a, b, rank))
        self.parts = parts
        self.compatible = lru_cache(CACHE)(self._compatible)
        self.right_spine, self.left_spine = (lru_cache(None)(lambda t, s=s: self._spine(t, s)) for s in (1, 0))

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces at one edge, largest first, each with the rank that ends its life."""
        spine, until = [(token, NEVER)], self.parts.get(token)
        while until:
            piece = until[side]
            spine.append((piece, until[2]))
            until = self.parts.get(piece)
        return spine

    def _compatible(self, one: int, two: int) -> bool:
        rank = self.rank.get
        for a, a_ends in self.right_spine(one):
            for b, b_ends in self.left_spine(two):
                at = rank((a, b))
                if at is not None and at < a_ends and at <= b_ends:
                    return False
        return True

    def __call__(self, word: str) -> list[int]:
        size = len(word)
        last: list[tuple[int, int] | None] = [None] * (size + 1)
        for end, (token, length, final) in self.automaton.iter(word + END):
            stop = size if final else end + 1
            # Only a token with the suffix can end the word.
            if last[stop] is not None or (stop == size) != final:
                continue
            start = stop - length
            if start == 0 or (last[start] is not None and self.compatible(last[start][0], token)):
                last[stop] = (token, start)
        ids, at = [], size
        while at:
            token, at = last[at]
            ids.append(token)
        return ids[::-1]


@lru_cache(2)
def load(path: str) -> tuple[Words, list[str]]:
    """Splitter with the prefix encoder, and the token of every id."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    names = {n: token for token, n in spec["model"]["vocab"].items()}
    names |= {t["id"]: t["content"] for t in spec["added_tokens"]}
    listed = [names.get(n, "") for n in range(max(names) + 1)]
    return Words(spec, PrefixEncoder(spec["model"])), listed


def decode(ids: np.ndarray, names: list[str]) -> str:
    """Tokens joined by a space: what the library does for files without a decoder."""
    return " ".join(map(names.__getitem__, ids.tolist()))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` of every row. ``path``: the tokenizer file, on every executor.

    Defined cases: null and empty texts have no ids; null ids of rows stay null; repeated
    rows stay; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, _ = load(path)
        for rows in text_rows(batches):
            found = [np.frombuffer(words.ids(t), "<u4") for t in rows.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "ids"]
            )

    return _slim(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``text`` of every row of ``doc_id``, ``ids``; null ids give an empty text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, names = load(path)
        for rows in text_rows(batches):
            texts = [decode(np.array(ids or [], np.int64), names) for ids in rows.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number and digest of each text's ids and digest of their decoded text, in one pass.

    Cases as in :func:`encode`; a text without ids decodes to an empty text.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, names = load(path)
        for rows in text_rows(batches):
            counts, ids, texts = [], [], []
            for text in rows.column(1).to_pylist():
                raw = words.ids(text)
                counts.append(len(raw) // 4)
                ids.append(hashlib.sha256(raw).hexdigest())
                back = decode(np.frombuffer(raw, "<u4"), names)
                texts.append(hashlib.sha256(back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _slim(docs, id_col, text_col).mapInArrow(run, schema)


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
