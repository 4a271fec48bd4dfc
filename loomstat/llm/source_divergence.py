"""Source divergence audit: which sources of a language use its words differently.

In-mapper stripes: a task folds whole documents into a hash of term to stripe,
a stripe being the term's document frequency and its count per source. A full hash
is spilled as rows. Stripes of one (language, term) meet in one sorted run and are
merged; merged stripes with enough documents emit the divergences directly, cell
by cell (language, bucket of terms, two blocks of sources).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstat.llm.common import exact_columns
from loomstat.session import materialise

#: Cells (source counts and document frequencies) a task's hash holds before it spills.
CELLS = 400_000
#: Terms of a bucket on average, and sources of a block: what one cell of the last step holds.
TERMS, SOURCES = 4_096, 256
_PIECE = 1 << 20
_ROWS = 16_384
_STRIPE = "lang string, term binary, df long, sources array<string>, counts array<long>"

#: A-Z to a-z; every other ASCII character that is no letter becomes a blank. Bytes from 128 on stay.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def pieces(text: bytes, size: int = _PIECE) -> Iterator[list[bytes]]:
    """The terms of one UTF-8 text, in lists of about ``size`` bytes of text."""
    text, start = text.translate(_LETTERS), 0
    while start < len(text):
        stop = text.find(b" ", start + size)
        stop = len(text) if stop < 0 else stop
        yield text[start:stop].split()
        start = stop


def _lists(sizes: np.ndarray, *values: pa.Array) -> list[pa.Array]:
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, v) for v in values]


def _batches(lang: pa.Array, term: pa.Array, df: pa.Array, lists: list[pa.Array]) -> Iterator[pa.RecordBatch]:
    batch = pa.RecordBatch.from_arrays([lang, term, df, *lists], ["lang", "term", "df", "sources", "counts"])
    for at in range(0, len(batch), _ROWS):
        yield batch.slice(at, _ROWS)


class Stripes:
    """The stripes of one language, by column: document frequencies, and one hash of counts per source."""

    def __init__(self) -> None:
        self.df: Counter = Counter()
        self.by_source: dict[str, Counter] = {}

    def add(self, source: str, text: bytes) -> int:
        """Fold one document in; returns how many cells that made."""
        counts, terms = self.by_source.setdefault(source, Counter()), set()
        before = len(counts) + len(self.df)
        for found in pieces(text):
            counts.update(found)
            terms.update(found)
        self.df.update(terms)
        return len(counts) + len(self.df) - before

    def spill(self, lang: str) -> Iterator[pa.RecordBatch]:
        """One row per term with its whole stripe."""
        if not self.df:
            return
        place = dict(zip(self.df, range(len(self.df))))
        held = [(k, c) for k, c in enumerate(self.by_source.values())]
        row = np.concatenate([np.fromiter(map(place.__getitem__, c), np.int64, len(c)) for _, c in held])
        count = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for _, c in held])
        source = np.repeat([k for k, _ in held], [len(c) for _, c in held])
        order = np.argsort(row, kind="stable")
        lists = _lists(np.bincount(row, minlength=len(place)), pa.array(list(self.by_source), pa.string()).take(pa.array(source[order])), pa.array(count[order]))
        yield from _batches(pa.repeat(lang, len(place)), pa.array(list(place), pa.binary()), pa.array(self.df.values(), pa.int64()), lists)


def fold(cells: int = CELLS):
    """The map side: batches of (lang, source, text) to stripes, with hashes of at most about ``cells`` cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes, size = {}, 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(2)), batch.column(2)):
                size += stripes.setdefault(lang, Stripes()).add(source, text.as_py())
                if size >= cells:
                    for name, held in stripes.items():
                        yield from held.spill(name)
                    stripes, size = {}, 0
        for name, held in stripes.items():
            yield from held.spill(name)

    return run


def _merged(batch: pa.RecordBatch, starts: np.ndarray, df: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    """The runs of equal keys of one batch, each as one row; those below ``least`` documents are not looked into."""
    ends = np.append(starts[1:], len(batch))
    kept = np.flatnonzero(df >= least)
    if not len(kept):
        return
    sizes = ends[kept] - starts[kept]
    rows = np.repeat(starts[kept] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    held = batch.take(pa.array(rows))
    sources, counts = (held.column(k) for k in (3, 4))
    run = np.repeat(np.repeat(np.arange(len(kept)), sizes), np.asarray(sources.value_lengths()))
    names = sources.flatten().dictionary_encode()
    cell, at = np.unique(run * len(names.dictionary) + np.asarray(names.indices), return_inverse=True)
    sums = np.zeros(len(cell), np.int64)
    np.add.at(sums, at, np.asarray(counts.flatten()))
    run, source = np.divmod(cell, len(names.dictionary))
    firsts = batch.take(pa.array(starts[kept]))
    lists = _lists(np.bincount(run, minlength=len(kept)), names.dictionary.take(pa.array(source)), pa.array(sums))
    yield from _batches(firsts.column(0), firsts.column(1), pa.array(df[kept]), lists)


def merge(least: int):
    """The reduce side: key-sorted stripes to one stripe per key, those of at least ``least`` documents.

    Runs that lie inside a batch are merged together; the last run of a batch may go on
    in the next one and is carried as one merged row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for batch in batches:
            if not len(batch):
                continue
            if carried is not None:
                both = [pa.Table.from_batches([carried]).cast(batch.schema), pa.Table.from_batches([batch])]
                batch = pa.concat_tables(both).combine_chunks().to_batches()[0]
            lang, term = batch.column(0), batch.column(1)
            n = len(batch)
            differs = pc.or_(pc.not_equal(lang.slice(1), lang.slice(0, n - 1)), pc.not_equal(term.slice(1), term.slice(0, n - 1)))
            starts = np.append(0, np.flatnonzero(differs.to_numpy(zero_copy_only=False)) + 1)
            df = np.add.reduceat(batch.column(2).to_numpy(), starts)
            last = int(starts[-1])
            if last:
                yield from _merged(batch.slice(0, last), starts[:-1], df[:-1], least)
            carried = next(_merged(batch.slice(last), np.zeros(1, np.int64), df[-1:], 0))
        if carried is not None and carried.column(2)[0].as_py() >= least:
            yield carried

    return run


def billionths(count: np.ndarray, total: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), by long division: exact while 1000 (total + 5 terms) fits 64 bits."""
    whole, rest = np.divmod(count + 5, total + 5 * terms)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total + 5 * terms)
        whole = whole * 1000 + digits
    return whole + 1


def _side(stripes: pa.Table, block: int, size: int) -> np.ndarray:
    """Counts, terms of the cell by sources of one block. A stripe is cut by block, so its rows are summed."""
    out = np.zeros((len(stripes), size), np.int64)
    of = stripes.column("side").to_numpy() == block
    places, counts = (stripes.column(c).combine_chunks() for c in ("places", "counts"))
    lengths = np.where(of, np.asarray(places.value_lengths()), 0)
    held = np.repeat(of, np.asarray(places.value_lengths()))
    out[np.repeat(np.arange(len(stripes)), lengths), np.asarray(places.flatten())[held]] = np.asarray(counts.flatten())[held]
    return out


_CELL = "part string, source string, item string, value long"


def _emit(limit: int):
    """One cell: sums of |p - q| for every two sources of its blocks, and the foremost terms of each source."""

    def run(key: tuple, stripes: pa.Table, groups: pa.Table) -> pa.Table:
        _, bucket, low, high = (k.as_py() for k in key)
        out: list[tuple] = []
        order = groups.sort_by([("block", "ascending"), ("place", "ascending")])
        block = order.column("block").to_numpy()
        names = np.array(order.column("source").to_pylist(), object)
        total, all_terms = order.column("n").to_numpy(), order.column("v").to_numpy()
        if not len(names):
            return pa.table({"part": pa.array([], pa.string()), "source": pa.array([], pa.string()), "item": pa.array([], pa.string()), "value": pa.array([], pa.int64())})
        sides = [np.flatnonzero(block == side) for side in (low, high)]
        v = int(all_terms[0])
        if v:
            terms = stripes.column("term").to_pylist()
            at = {t: k for k, t in enumerate(dict.fromkeys(terms))}
            row = np.array([at[t] for t in terms], np.int64)
            shares, base = [], []
            for side, members in zip((low, high), sides):
                counts = np.zeros((len(at), len(members)), np.int64)
                if len(stripes):
                    np.add.at(counts, row, _side(stripes, side, len(members)))
                shares.append((counts, billionths(counts, total[members], all_terms[members])))
                base.append(billionths(np.zeros(len(members), np.int64), total[members], all_terms[members]))
        for k, a in enumerate(sides[0]):
            if v:
                none = np.abs(base[0][k] - base[1])
                sums = np.abs(shares[0][1][:, k, None] - shares[1][1]).sum(axis=0) + ((v if bucket == 0 else 0) - len(at)) * none
            else:
                sums = np.zeros(len(sides[1]), np.int64)
            first = k + 1 if low == high else 0
            out += [("pair", names[a], names[b], int(s)) for b, s in zip(sides[1][first:], sums[first:])]
        if v and low == high and at:
            whole = np.zeros(len(at), np.int64)
            whole[row] = stripes.column("total").to_numpy()
            q = billionths(whole, np.int64(order.column("lang_n")[0].as_py()), np.int64(v))
            texts = list(at)
            counts, p = shares[0]
            for k, a in enumerate(sides[0]):
                more = np.where(counts[:, k] > 0, p[:, k] - q, 0)
                found = np.flatnonzero(more > 0)
                if len(found) > limit:
                    found = found[more[found] >= np.partition(more[found], -limit)[-limit]]
                best = sorted(found, key=lambda t: (-more[t], texts[t]))[:limit]
                out += [("term", names[a], texts[t].decode(), int(more[t])) for t in best]
        columns = list(zip(*out)) or [(), (), (), ()]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("part", "source", "item", "value"), columns, [pa.string()] * 3 + [pa.int64()])})

    return run


def source_divergence(
    docs: DataFrame,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    least: int = 30,
    top: int = 50,
    cells: int = CELLS,
) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from others, and by which terms.

    A language keeps the V terms found in at least ``least`` of its documents. A
    group (lang, source), or a whole language, gives a term p = 1 + floor(10^9
    (count + 5) / (N + 5 V)), N being its occurrences of kept terms. Part ``pair``:
    item is each other source of the language, value the sum of |p - q| over all
    kept terms (0 without any), every rank. Part ``term``: item is a kept term that
    the group has and of which it has a larger p than the language, value the
    difference, the first ``top`` ranks. Ties go to the smaller item in UTF-8.

    Null lang, source and text count as ''. A language without kept terms has its
    pairs with value 0; a language of one source has no pair. Repeated rows each
    count. Other columns are ignored; an empty table gives no rows. Whole numbers
    throughout, exact up to 9 * 10^15 occurrences a language.

    Scale: a frequent term leaves a task once per spill, however often it occurs.
    A term absent from two sources adds the same to each such pair, so only present
    ones are visited. A cell holds a bucket of terms and two blocks of sources, so
    neither a large language nor a language of many sources meets in one task.
    """
    rows = exact_columns(docs, lang_col, source_col, text_col).toDF("lang", "source", "text")
    rows = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    stripes = rows.withColumn("text", F.col("text").cast("binary")).mapInArrow(fold(cells), _STRIPE)
    sorted_runs = stripes.repartition("lang", "term").sortWithinPartitions("lang", "term")
    kept = materialise(sorted_runs.mapInArrow(merge(least), _STRIPE), "stripes")

    each = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("cell"))
    occurring = each.groupBy("lang", F.col("cell.sources").alias("source")).agg(F.sum("cell.counts").alias("n"))
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("v"))
    whole = occurring.groupBy("lang").agg(F.sum("n").alias("lang_n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = rows.select("lang", "source").distinct().withColumn("at", place)
    groups = groups.join(occurring, ["lang", "source"], "left").join(vocabulary, "lang", "left").join(whole, "lang", "left")
    groups = groups.na.fill(0, ["n", "v", "lang_n"])
    groups = groups.select("*", F.floor(F.col("at") / SOURCES).cast("int").alias("block"), (F.col("at") % SOURCES).cast("int").alias("place"))
    groups = materialise(groups, "source-groups")

    buckets = max(1, -(-kept.count() // TERMS))
    blocks = groups.groupBy("lang").agg((F.max("block") + 1).alias("blocks"))
    low, high = F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    # Each block meets every block of its language, itself too.
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda s, n: s + n).alias("total")
    parts = kept.select("lang", "term", total, F.explode(F.arrays_zip("sources", "counts")).alias("cell"))
    parts = parts.select("lang", "term", "total", F.col("cell.sources").alias("source"), F.col("cell.counts").alias("count"))
    parts = parts.join(groups.select("lang", "source", "block", "place"), ["lang", "source"])
    parts = parts.groupBy("lang", "term", "total", "block").agg(F.collect_list(F.struct("place", "count")).alias("held"))
    parts = parts.join(blocks, "lang").select("*", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"), others)
    parts = parts.select(
        "lang", "bucket", low, high, "term", "total", F.col("block").alias("side"), F.col("held.place").alias("places"), F.col("held.count").alias("counts")
    )
    sides = groups.join(blocks, "lang").select("*", others)
    sides = sides.select("*", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    sides = sides.select("lang", "bucket", low, high, "source", "n", "v", "lang_n", "block", "place")
    keys = ["lang", "bucket", "low", "high"]
    schema = f"lang string, {_CELL}"

    emit = _emit(top)

    def cell(key: tuple, stripes: pa.Table, groups: pa.Table) -> pa.Table:
        found = emit(key, stripes, groups)
        return found.add_column(0, "lang", pa.array([key[0].as_py()] * len(found), pa.string()))

    emitted = materialise(parts.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInArrow(cell, schema), "divergences")
    sums = emitted.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("way")
    pairs = sums.select("lang", "value", ways).select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    terms = emitted.where("part = 'term'").select("lang", "source", "part", "item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    foremost = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.unionByName(foremost).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
