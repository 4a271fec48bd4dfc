"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

The rules come from a tokenizer file whose path is a parameter; nothing is
trained. Supported is the file's own kind: NFC, blanks folded, lower case, a
split into clitics, letter runs, single digits and symbol runs, bytes written
as printable characters, and a mark on the last piece of every word.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat.llm.common import free_name, text_chunks

#: Unicode blanks, as the pattern \\s of the tokenizer file takes them (fixed values).
BLANKS = "\\t\\n\\v\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Clitics that stand as words of their own (fixed values).
CLITICS = "'s|'t|'re|'ve|'m|'ll|'d"
#: Capital letters newer than Python's own tables: first, last, distance to the small letter (fixed values).
NEWER = [
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1),
    (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
]
LOWERED = {c: c + step for first, last, step in NEWER for c in range(first, last + 1)}
NEW_CAPITALS = re.compile("[\u1c89\ua7cb-\ua7dc\U00010000-\U0010ffff]")
#: Code points that the tokenizer's tables do not know as letters or numbers yet (fixed values).
UNKNOWN = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
BEYOND = re.compile("[\U00010000-\U0010ffff]")
#: Characters that split() takes for blanks and the pattern does not.
NO_BLANKS = re.compile("[\x1c-\x1f]")
#: Words that one generation of a worker's memory holds (about 100 MB each, two at most).
REMEMBERED = 500_000
#: No pair at a leaf of the tree.
NONE = 1 << 62


def _class_of(kind: str, last: int) -> str:
    """A character class of the code points up to ``last`` that have the Unicode property ``kind``."""
    has = regex.compile(rf"\p{{{kind}}}+")
    blank = {c for first, end in [*UNKNOWN, (0xD800, 0xDFFF)] for c in range(first, end + 1)}
    line = "".join(" " if c in blank else chr(c) for c in range(last + 1))
    return "".join(f"\\U{m.start():08x}-\\U{m.end() - 1:08x}" for m in has.finditer(line))


def _pattern(last: int) -> re.Pattern:
    """The split into words, for texts whose code points go up to ``last``."""
    letter, digit = _class_of("L", last), _class_of("N", last)
    return re.compile(f"{CLITICS}|[{letter}]+|[{digit}]|[^{BLANKS}{letter}{digit}]+")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself, or the next one free from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(free)) for b in range(256)]


class PairTree:
    """Segment tree over the adjacent pairs of one word, 16 children to a node.

    A leaf holds ``rank << 32 | position`` of the pair that starts at that
    position, or NONE, so the root is the lowest rank and, among equals, the
    leftmost. A point update recomputes one node per level.
    """

    def __init__(self, leaves: list[int]):
        self.levels = [leaves]
        while len(leaves) > 1:
            leaves = [min(leaves[i : i + 16]) for i in range(0, len(leaves), 16)]
            self.levels.append(leaves)

    def root(self) -> int:
        return self.levels[-1][0]

    def refresh(self, places: tuple[int, ...]) -> None:
        """Recompute the nodes above the given leaves."""
        for below, above in zip(self.levels, self.levels[1:]):
            places = {p >> 4 for p in places}
            for p in places:
                above[p] = min(below[p << 4 : (p << 4) + 16])


def merge_word(ids: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply the lowest-ranked merge, leftmost first, until no adjacent pair has one.

    ``ranks`` gives, for a pair of ids, its rank in the high half of a number
    (low half zero) and the id that replaces it.
    """
    n = len(ids)
    if n < 2:
        return ids
    get, none = ranks.get, (NONE, -1)
    found = [get(pair, none) for pair in zip(ids, ids[1:])]
    leaves = [f[0] | i for i, f in enumerate(found)]
    made = [f[1] for f in found]
    tree = PairTree(leaves) if n > 17 else None  # up to 16 pairs the root is the only node
    after, before, ids = list(range(1, n + 1)), list(range(-1, n)), list(ids)
    while (low := tree.root() if tree else min(leaves)) < NONE:
        at = low & 0xFFFFFFFF
        gone = after[at]
        right = after[at] = after[gone]
        new = ids[at] = made[at]
        ids[gone] = -1
        if right < n:
            before[right] = at
            key, made[at] = get((new, ids[right]), none)
            leaves[at] = key | at
            leaves[gone] = NONE
        else:
            leaves[at] = NONE
        left = before[at]
        if left >= 0:
            key, made[left] = get((ids[left], new), none)
            leaves[left] = key | left
        if tree:
            tree.refresh((at, min(gone, n - 2), max(left, 0)))
    return [i for i in ids if i >= 0]


class _Memo(dict):
    """Words and the packed ids of each, filled on demand.

    When it is full, what it holds becomes the old generation, which gives back
    what is asked for again and is dropped at the next turn; so frequent words stay.
    """

    def __init__(self, encode, limit: int = REMEMBERED):
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, word: str) -> bytes:
        packed = self.old.get(word)
        if packed is None:
            packed = self.encode(word)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = packed
        return packed


class WordBPE:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        self.special = self._tables(path)
        self.words = _pattern(0xFFFF)
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.known = _Memo(self._encode_word)
        self.runs = _Memo(self._encode_run, REMEMBERED // 2)

    def _tables(self, path: str) -> dict[str, int]:
        """Take the file's vocabulary and merges; the ids of its special tokens."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.mark = model["vocab"], model["end_of_word_suffix"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in special.items()}
        self.names = pa.array([names.get(i, "") for i in range(max(names) + 1)], pa.large_string())
        self.ranks = {(vocab[a], vocab[b]): (rank << 32, vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + self.mark] for c in letters]
        return special

    @cached_property
    def all_words(self) -> re.Pattern:
        """The split for texts beyond the basic plane, built when the first one comes."""
        return _pattern(sys.maxunicode)

    def _encode_word(self, word: str) -> bytes:
        data = word.encode("utf-8")
        ids = [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]]
        return array("i", merge_word(ids, self.ranks)).tobytes()

    def _encode_run(self, run: str) -> bytes:
        """Ids of text as it stands between blanks; words do not reach over blanks."""
        return b"".join(map(self.known.__getitem__, self._words_of(run)))

    def _words_of(self, run: str) -> list[str]:
        return (self.all_words if BEYOND.search(run) else self.words).findall(run)

    def _encode_plain(self, text: str) -> bytes:
        if not text.isascii():
            # Lower case goes by single characters, so a capital sigma never takes its final form.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if NEW_CAPITALS.search(text):
                text = text.translate(LOWERED)
        text = text.lower()
        if NO_BLANKS.search(text):
            return self._encode_run(text)
        return b"".join(map(self.runs.__getitem__, text.split()))

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text; special tokens written in the text become their ids."""
        parts = self.specials.split(text) if "<|" in text else [text]
        packed = [np.int32(self.special[p]).tobytes() if p in self.special else self._encode_plain(p) for p in parts]
        return np.frombuffer(b"".join(packed), np.int32)

    def decode(self, ids: pa.Array) -> pa.Array:
        """Texts of lists of ids: the pieces joined by one space, special tokens kept."""
        pieces = self.names.take(ids.values)
        return pc.binary_join(pa.LargeListArray.from_arrays(ids.offsets.cast(pa.int64()), pieces), pa.scalar(" ", pa.large_string()))


@lru_cache(maxsize=2)
def coder(path: str) -> WordBPE:
    """The coder of a file, built once per worker."""
    return WordBPE(path)


def encode_and_decode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``docs`` without the text, with its ids (array<int>) and the text decoded from them.

    One Arrow pass without a shuffle; rows are cut into runs of about a megabyte,
    so memory does not grow with a partition. Null and empty texts give an empty
    list and an empty text. Other columns pass through; one that has the name of
    a new column is replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in (text_col.lower(), ids_col.lower(), decoded_col.lower())]
    schema = docs.select(*kept).schema.add(ids_col, T.ArrayType(T.IntegerType())).add(decoded_col, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            for at, texts in text_chunks(pa.array(range(len(batch))), batch.column(len(kept))):
                found = [bpe.encode(t) for t in texts.to_pylist()]
                offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else []))
                part = batch.slice(at[0].as_py(), len(at))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(kept)], ids, bpe.decode(ids).cast(pa.string())], [*kept, ids_col, decoded_col]
                )

    return docs.select(*kept, F.col(text_col).cast("string").alias(free_name(docs, "_text"))).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of the text; see ``encode_and_decode``."""
    copy, decoded = free_name(docs, "_copy"), free_name(docs, "_decoded")
    return encode_and_decode(docs.withColumn(copy, F.col(text_col)), path, copy, ids_col, decoded).drop(decoded)


def decode(rows: DataFrame, path: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ids. Null lists give null texts, empty lists empty texts."""

    @F.arrow_udf("string")
    def texts(ids: pa.Array) -> pa.Array:
        plain = ids.fill_null([]) if ids.null_count else ids
        plain = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(x) for x in plain.to_pylist()]]).astype(np.int32)), plain.flatten())
        made = coder(path).decode(plain).cast(pa.string())
        return pc.if_else(ids.is_null(), pa.scalar(None, pa.string()), made)

    return rows.withColumn(decoded_col, texts(F.col(ids_col).cast("array<int>")))
