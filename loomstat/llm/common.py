"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores added until no column begins with it."""
    while any(c.lower().startswith(base.lower()) for c in df.columns):
        base += "_"
    return base


def exact_columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns by exact name, also beside columns whose names differ only by case."""
    at = [df.columns.index(name) for name in names]
    return df.toDF(*[f"_c{k}" for k in range(len(df.columns))]).select(*[F.col(f"_c{k}").alias(n) for k, n in zip(at, names)])


def crc_of_id(id_col: str) -> Column:
    """crc32 of an id written as text: the rule that splits training from held-out rows."""
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def unit_hash(*cols: str, seed: int) -> Column:
    """A number in [0, 1) that depends on the columns and the seed only."""
    bits = F.xxhash64(*[F.col(c) for c in cols], F.lit(seed))
    return F.shiftrightunsigned(bits, 11).cast("double") / F.lit(float(1 << 53))


#: Bits of a filter as a power of two: 16 bits a value, within these bounds. 2^29 bits are 64 MB, the most that is broadcast.
LEAST_BITS, MOST_BITS = 20, 29
_BLOCK = 12  # one row of a filter holds 2^12 bits as 64 words


def filter_bits(values: int) -> int:
    """The size of a filter for so many values, as a power of two."""
    return min(max((16 * max(values, 1) - 1).bit_length(), LEAST_BITS), MOST_BITS)


def filter_cell(value: Column, which: int, bits: int) -> Column:
    """A filter cell of a value; cells of one value with different ``which`` share a block."""
    block = F.xxhash64(value, F.lit(-1)).bitwiseAND(F.lit((1 << (bits - _BLOCK)) - 1))
    inside = F.xxhash64(value, F.lit(which)).bitwiseAND(F.lit((1 << _BLOCK) - 1))
    return F.shiftleft(block, _BLOCK).bitwiseOR(inside)


def filter_blocks(cells: DataFrame) -> DataFrame:
    """A bitmap filter as rows (filter_block, filter_words), with the bit of every ``cell`` set.

    Whatever the number of cells, it has at most 2^(bits - 12) rows of 64 words, so it may be broadcast.
    """
    word, bit = F.expr("cast(shiftright(cell, 6) & 63 as int)"), F.expr("shiftleft(1L, cast(cell & 63 as int))")
    words = cells.groupBy(F.shiftright("cell", _BLOCK).alias("filter_block"), word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    held = words.groupBy("filter_block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("held"))
    return held.select("filter_block", F.expr("transform(sequence(0, 63), w -> coalesce(held[w], 0L))").alias("filter_words"))


def with_filter(rows: DataFrame, blocks: DataFrame, cell: Column) -> DataFrame:
    """``rows`` with the words of the filter's block, null where the filter has none. No shuffle of ``rows``."""
    return rows.join(F.broadcast(blocks), F.shiftright(cell, _BLOCK) == F.col("filter_block"), "left").drop("filter_block")


def in_filter(cell: Column, words: str = "filter_words") -> Column:
    """Whether the cell's bit is set in ``words``."""
    word = F.get(F.col(words), F.shiftright(cell, 6).bitwiseAND(F.lit(63)).cast("int"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), cell.bitwiseAND(F.lit(63)).cast("int"))
    return F.coalesce(word.bitwiseAND(bit) != 0, F.lit(False))


def parted(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two: those whose ``key`` may be among ``keys`` (column ``key``, longs), and those where it surely is not.

    A broadcast filter over the keys decides, so the second part needs no join and
    its texts never shuffle. The keys are read twice: give a written table.
    """
    bits = filter_bits(keys.count())
    cell, own = filter_cell(key, 0, bits), free_name(rows, "_filter")
    blocks = filter_blocks(keys.select(filter_cell(F.col("key"), 0, bits).alias("cell"))).toDF(f"{own}_block", f"{own}_words")
    tested = rows.join(F.broadcast(blocks), F.shiftright(cell, _BLOCK) == F.col(f"{own}_block"), "left")
    maybe = in_filter(cell, f"{own}_words")
    return tested.where(maybe).select(*rows.columns), tested.where(~maybe).select(*rows.columns)


def _offsets(texts: pa.Array) -> np.ndarray:
    """Where each text starts and the last one ends; large strings keep 64-bit offsets."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def with_group_values(rows: DataFrame, keys: list[str], salt: Column, first: dict[str, Column], whole: dict[str, Column], slices: int = 64) -> DataFrame:
    """``rows`` with the values of their group, without one task that sees all rows of a hot group.

    A group is cut into slices by a hash of ``salt``. ``first`` aggregates a slice, ``whole``
    the slices of a group, from the columns that ``first`` names; both are combined before
    they shuffle. The values go back to the slices, of which a group has 64 at most, and
    from there to the rows. Keys must not be null.
    """
    own = free_name(rows, "_slice")
    cut = rows.withColumn(own, F.pmod(F.xxhash64(salt), F.lit(slices)).cast("int"))
    parts = cut.groupBy(*keys, own).agg(*[c.alias(n) for n, c in first.items()])
    groups = parts.groupBy(*keys).agg(*[c.alias(n) for n, c in whole.items()])
    back = parts.select(*keys, own).join(groups, keys)
    return cut.join(back, [*keys, own]).drop(own)


def text_chunks(ids: pa.Array, texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Cut one Arrow batch into runs of rows of about ``limit`` bytes of text, one row at least."""
    if not len(texts):
        return
    texts = texts.fill_null("")
    offsets = _offsets(texts)
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), len(texts))
        yield ids.slice(start, stop - start), texts.slice(start, stop - start)
        start = stop


def utf8_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array without nulls, and where each text starts (one more entry than texts)."""
    offsets = _offsets(texts)
    data = texts.buffers()[2]
    if data is None or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9FB21C651E98DF25)
    x = x ^ (x >> np.uint64(28))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
