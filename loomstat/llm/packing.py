"""Best-fit packing by minimum bin slack.

For every bin a bitset subset-sum over the lengths still available finds the
fullest feasible combination around the longest piece left; the combination is
then removed, as many times as the counts allow. The search needs only how
many pieces there are of each length (at most ``capacity`` numbers), so its
size does not depend on the data; the pieces are placed in parallel.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from loomstat.llm.bpe import WordBPE, _Memo, byte_letters
from loomstat.llm.common import free_name, text_chunks
from loomstat.session import materialise

CAPACITY = 4096
END = 1


#: Runs of text that one generation of a worker's memory holds (about 45 MB each, two at most).
RUNS = 220_000


class LibraryCoder(WordBPE):
    """Ids by the model of the tokenizers library; runs of text seen before are not encoded again.

    Words come here normalised and split, so only the library's merges are asked. Its
    normaliser must not run again: lower case can leave marks in an order that it changes.
    An executor keeps more idle workers than it has cores, and each holds on to its coder: it is
    kept small, and a run that was forgotten is cheap to encode again. It only encodes.
    """

    def __init__(self, path: str):
        self.letters = dict(enumerate(byte_letters()))
        super().__init__(path)
        # Runs of text between blanks and the words inside them share one memory: most of these words are runs elsewhere.
        self.runs = _Memo(self._encode_run, RUNS)

    def _tables(self, path: str) -> dict[str, int]:
        """The library holds vocabulary and merges; a second copy of them is never read."""
        tokenizer = Tokenizer.from_file(path)
        self.library = tokenizer.model
        return {token.content: i for i, token in tokenizer.get_added_tokens_decoder().items()}

    def _written(self, word: str) -> str:
        """The word's bytes as the library writes them; printable ASCII stands for itself."""
        if word.isascii() and word.isprintable():
            return word
        return word.encode("utf-8").decode("latin-1").translate(self.letters)

    def _encode_word(self, word: str) -> bytes:
        return array("i", [token.id for token in self.library.tokenize(self._written(word))]).tobytes()

    def _encode_run(self, run: str) -> bytes:
        words = [run] if run.isascii() and run.isalpha() else self._words_of(run)
        if words == [run]:
            return self._encode_word(run)
        return b"".join(map(self.runs.__getitem__, words))


@lru_cache(maxsize=2)
def _coder(path: str) -> LibraryCoder:
    return LibraryCoder(path)


def fullest(counts: dict[int, int], target: int) -> list[tuple[int, int]]:
    """The (length, copies) from ``counts`` whose sum comes nearest to ``target`` without passing it.

    A bit of ``reach`` says that its position is a sum of some combination.
    Copies of one length go in by powers of two. The search ends as soon as the
    target itself is reached.
    """
    reach, steps = 1, []
    mask, goal = (1 << (target + 1)) - 1, 1 << target
    for length in sorted(counts, reverse=True):
        left, size = min(counts[length], target // length), 1
        while left > 0 and not reach & goal:
            size = min(size, left)
            steps.append((length, size, reach))
            reach |= (reach << (length * size)) & mask
            left -= size
            size *= 2
        if reach & goal:
            break
    total, used = reach.bit_length() - 1, {}
    for length, size, before in reversed(steps):
        if not (before >> total) & 1:
            total -= length * size
            used[length] = used.get(length, 0) + size
    return sorted(used.items(), reverse=True)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Bins as (combination, how many bins are filled by it).

    Every combination uses up one of its lengths but for fewer pieces than it
    holds, so a length ends at most log2(capacity / length) + 1 combinations:
    some 10,000 for a capacity of 4096, whatever the number of pieces.
    """
    left, bins = {k: n for k, n in counts.items() if n > 0}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        rest = fullest({k: n for k, n in left.items() if n > 0 and k <= capacity - longest}, capacity - longest)
        left[longest] += 1
        used = dict(rest)
        used[longest] = used.get(longest, 0) + 1
        times = min(left[k] // c for k, c in used.items())
        for k, c in used.items():
            left[k] -= c * times
            if not left[k]:
                del left[k]
        bins.append((sorted(used.items(), reverse=True), times))
    return bins


@dataclass
class Placement:
    """For every length, runs of pieces that go to the same combination; sorted by length and rank."""

    keys: np.ndarray
    firsts: np.ndarray
    sequences: np.ndarray
    copies: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, bins: list[tuple[list[tuple[int, int]], int]]) -> Placement:
        rows, done, sequence = [], {}, 0
        for used, times in bins:
            offset = 0
            for length, copies in used:
                first = done.get(length, 0)
                rows.append(((length << 44) + first, first, sequence, copies, offset))
                done[length] = first + copies * times
                offset += length * copies
            sequence += times
        rows.sort()
        return cls(*(np.array(c, np.int64) for c in (zip(*rows) if rows else [()] * 5)))

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these lengths and ranks within their length."""
        at = np.searchsorted(self.keys, (lengths << 44) + ranks, side="right") - 1
        inside = ranks - self.firsts[at]
        return self.sequences[at] + inside // self.copies[at], self.offsets[at] + inside % self.copies[at] * lengths


def pieces(docs: DataFrame, path: str, capacity: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """Token pieces of all documents, with the partition and the rank among its pieces of that length."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, part int, local long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = _coder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for names, texts in text_chunks(batch.column(0), batch.column(1)):
                who, rows, held = [], [], []
                for k, text in enumerate(texts.to_pylist()):
                    ids = np.append(coder.encode(text), np.int32(END))
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        own = ids[start : start + capacity]
                        rows.append((piece, start, len(own), zlib.crc32(own.astype("<u4").tobytes()), seen[len(own)]))
                        seen[len(own)] += 1
                        who.append(k)
                        held.append(own)
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.int64()] * 4))]
                out = [names.take(pa.array(who)), *columns[:4], pa.array(np.full(len(rows), part, np.int32)), columns[4]]
                if with_ids:
                    ends = np.cumsum([0, *map(len, held)]).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held))))
                yield pa.RecordBatch.from_arrays(out, [f"c{i}" for i in range(len(out))]).rename_columns(names_of)

    names_of = [id_col, "piece", "start", "length", "ids_crc32", "part", "local"] + ["ids"] * with_ids
    return docs.select(id_col, F.col(text_col).cast("string").alias(free_name(docs, "_text"))).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and the ids if asked for.

    A document's ids end with END; only documents longer than ``capacity`` are
    cut, into full pieces and a rest. Null and empty texts are one END. Rows that
    share an id are packed each on its own. Other columns are ignored; an empty
    table gives no rows.

    The pieces are written once with their partition and their rank among that
    partition's pieces of a length, so no row is numbered twice. Ranks become global by
    adding the counts of the partitions before; no length, however common, meets
    in one task as rows. Only the counts per length reach the driver, and the
    placement (bounded by ``capacity``) goes back to every task.
    """
    cut = materialise(pieces(docs, path, capacity, id_col, text_col, with_ids), "pieces")
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    totals = dict(map(tuple, counts.groupBy("length").agg(F.sum("n").alias("n")).collect()))
    placement = Placement.of(plan_bins(totals, capacity))
    kept = [id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    ranked = cut.join(shifts, ["length", "part"]).select(*kept, (F.col("local") + F.col("shift")).alias("_rank"))
    schema = ranked.select(*kept).schema.add("sequence_id", T.LongType()).add("offset", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, len(kept)))
            sequence, offset = placement.place(lengths, ranks)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(sequence), pa.array(offset)], schema.names)

    return ranked.mapInArrow(run, schema)
