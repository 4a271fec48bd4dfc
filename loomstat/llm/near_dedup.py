"""Near-duplicate documents: banded MinHash, Odd sketches, exact confirmation.

A text is lower-cased (A-Z) and cut into words at ASCII blanks; its set holds the
distinct five-word shingles. Documents link when the Jaccard similarity of
their sets reaches the threshold. One pass over the texts gives each document
128 MinHash samples, four to each of 32 band keys, and up to 4096 more from one
permutation, folded into a bitmap of 2048 parities, its Odd sketch. Documents
that share a band key are candidates; the bits in which two sketches differ
estimate the similarity, and what passes is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.llm.common import free_name, mix, parted, text_chunks, utf8_bytes, with_group_values
from loomstat.llm.components import components
from loomstat.session import materialise

WORDS = 5
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
#: The sketch folds the minima of 2^12 bins into 2^11 parities.
BINS, BITS = 1 << 12, 1 << 11
#: How many standard deviations below its expectation the estimate of a pair at the threshold may fall.
DEVIATIONS = 4.0

_SEEDS = np.random.default_rng(20_240_517)
_MULTIPLY = _SEEDS.integers(1 << 62, (1 << 63) - 1, SAMPLES, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _SEEDS.integers(0, (1 << 63) - 1, SAMPLES, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in order, and the first word of each text."""
    data, offsets = utf8_bytes(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    heads = offsets[:-1]
    before[heads[heads < len(data)]] = False
    starts = np.flatnonzero(word & ~before)
    firsts = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), firsts
    letters = data[word]
    letters = letters + np.uint8(32) * ((letters >= 65) & (letters <= 90)).astype(np.uint8)
    inside = np.cumsum(word)[starts] - 1  # where each word starts among the letters
    lengths = np.diff(np.append(inside, len(letters)))
    place = np.arange(len(letters)) - np.repeat(inside, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _BASE, np.uint64))
    sums = np.add.reduceat((letters.astype(np.uint64) + np.uint64(1)) * powers[place], inside)
    return mix(sums + lengths.astype(np.uint64) * _STEP), firsts


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text (no nulls) the sorted distinct hashes of its five-word shingles."""
    words, firsts = _word_hashes(texts)
    joined = np.zeros(max(len(words) - WORDS + 1, 0), np.uint64)
    for k in range(WORDS if len(joined) else 0):
        joined = joined * _STEP + words[k : k + len(joined)]
    joined = mix(joined)
    for a, b in zip(firsts[:-1], firsts[1:]):
        if b - a >= WORDS:
            yield np.unique(joined[a : b - WORDS + 1])
        elif b > a:
            short = np.array([b - a], np.uint64) * _BASE
            for h in words[a:b]:
                short = short * _STEP + h
            yield mix(short ^ _BASE)
        else:
            yield joined[:0]


def min_hashes(items: np.ndarray) -> np.ndarray:
    """The MinHash samples of a non-empty set of hashed shingles."""
    best = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 2048):
        part = items[at : at + 2048]
        np.minimum(best, (part[None, :] * _MULTIPLY[:, None] + _ADD[:, None]).min(axis=1), out=best)
    return best >> np.uint64(16)


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One key per band for each row of samples."""
    keys = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(samples), BANDS)).copy()
    for k in range(ROWS):
        keys = mix(keys * _STEP + samples[:, k::ROWS])
    return keys.view(np.int64)


def odd_sketch(items: np.ndarray) -> tuple[int, np.ndarray]:
    """The Odd sketch of a set: how many bins have a minimum, and BITS parities as 64-bit words.

    One permutation deals the items into BINS bins; the least item of a bin is
    one MinHash sample. A bit says if an odd number of samples fell on it.
    """
    dealt = np.sort(mix(items ^ _STEP))
    bins = dealt >> np.uint64(52)
    first = np.ones(len(dealt), bool)
    first[1:] = bins[1:] != bins[:-1]
    place = mix(dealt[first] ^ _BASE) >> np.uint64(53)
    odd = np.bincount(place.astype(np.int64), minlength=BITS) & 1
    return int(first.sum()), np.packbits(odd.astype(np.uint8)).view(np.int64)


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(0, rows.size + 1, rows.shape[1] or 1, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))


_SIGNATURE = "id long, n long, f1 long, f2 long, m int, bands array<long>, sketch array<long>"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, texts in text_chunks(batch.column(0), batch.column(1)):
            n = np.zeros(len(ids), np.int64)
            marks = np.zeros((len(ids), 2), np.uint64)
            samples = np.zeros((len(ids), SAMPLES), np.uint64)
            m, sketch = np.zeros(len(ids), np.int32), np.zeros((len(ids), BITS // 64), np.int64)
            for k, items in enumerate(shingle_sets(texts)):
                if len(items):
                    n[k] = len(items)
                    marks[k] = mix(items).sum(), mix(items ^ _STEP).sum()
                    samples[k] = min_hashes(items)
                    m[k], sketch[k] = odd_sketch(items)
            bands, marks = band_keys(samples), marks.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n), pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array(m), _lists(bands), _lists(sketch)],
                ["id", "n", "f1", "f2", "m", "bands", "sketch"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, texts in text_chunks(batch.column(0), batch.column(1)):
            sets = list(shingle_sets(texts))
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(items.view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids, lists], ["id", "items"])


def different_bits(a: Column, b: Column) -> Column:
    """In how many bits two sketches differ."""
    return sum((F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(1, BITS // 64)), F.bit_count(a[0].bitwiseXOR(b[0])))


def _may_link(a: str, b: str, percent: int) -> Column:
    """Whether sizes and sketches of two sides leave it possible that the similarity reaches the threshold.

    The bits that differ estimate how many samples do, hence how many bins agree. At
    the threshold the agreeing bins are a hypergeometric draw from the union; the
    variance of the sketch comes on top. Only what lies DEVIATIONS below is refused.
    """
    (na, ma, sa), (nb, mb, sb) = ([F.col(f"{side}.{c}") for c in ("n", "m", "sketch")] for side in (a, b))
    j, bits, bins = percent / 100, float(BITS), float(BINS)
    near = (F.lit(100) * F.least(na, nb)) >= (F.lit(percent) * F.greatest(na, nb))
    apart = -bits / 2 * F.log(F.greatest(1 - 2 * different_bits(sa, sb) / bits, F.lit(1e-3)))
    agree = (ma + mb - apart) / 2
    union = (na + nb) / (1 + j)
    empty = F.exp(-union / bins)
    full = bins * (1 - empty)
    drawn = full * j * (1 - j) * F.greatest(1 - full / union, F.lit(0.0)) + j * j * bins * empty * F.greatest(1 - (1 + union / bins) * empty, F.lit(0.0))
    expected = F.greatest(ma + mb - 2 * j * full, F.lit(0.0))
    growth = F.exp(4 * expected / bits)
    folded = F.greatest((bits / 4 * (1 - 1 / growth) - expected / growth) * growth, F.lit(0.0))
    return near & (agree >= j * full - DEVIATIONS * F.sqrt(drawn + folded / 4) - 1)


def _confirmed(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold on their full sets."""
    asked = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    asked = materialise(asked, "asked")
    # A filter of bounded size keeps most other texts out of the shuffle. The join is a merge join at
    # every size, so its cost stays in proportion.
    likely, _ = parted(rows, F.col("id"), asked.select(F.col("id").alias("key")))
    sets = likely.join(asked.hint("merge"), "id", "left_semi").mapInArrow(_sets, "id long, items array<long>")
    sets = materialise(sets, "shingle-sets")
    with_a = pairs.hint("merge").join(sets.select(F.col("id").alias("a"), F.col("items").alias("xs")), "a")
    with_b = with_a.join(sets.select(F.col("id").alias("b"), F.col("items").alias("ys")), "b")
    shared = with_b.select("a", "b", (F.size("xs") + F.size("ys")).alias("total"), F.size(F.array_intersect("xs", "ys")).alias("both"))
    return shared.where(F.lit(100) * F.col("both") >= F.lit(percent) * (F.col("total") - F.col("both"))).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row per document: id, n_shingles, class_id, component_id, kept.

    ``class_id`` is the smallest id with exactly the same set, ``component_id``
    the smallest id that links reach, ``kept`` whether the row carries that id.

    Scale: copies with equal sets collapse first (``min`` per fingerprint, in slices, so a
    large group of copies is in no task as a whole). Inside a band bucket every document is compared
    with the bucket's smallest and largest one, so a bucket of copies costs no more
    than two pairs a member. Only where a bucket still holds several components are
    documents of different components compared, on sizes and sketches inside
    the join, so no pair that the sketches refuse leaves it. Nothing is capped.

    Null or blank texts have no shingles and link with nothing. Rows with a null
    id take no part (component null, kept). Rows that share an id count as one
    document. Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = materialise(rows.mapInArrow(_signatures, _SIGNATURE), "signatures")
    usable = signed.where("n > 0 and id is not null")
    # Every row learns its class's smallest id; a class is never whole in one task.
    same = ["f1", "f2", "n"]
    placed_rows = with_group_values(usable.select("id", *same), same, F.col("id"), {"low": F.min("id")}, {"rep": F.min("low")})
    placed_rows = materialise(placed_rows, "classes")
    reps = usable.join(placed_rows.where("id = rep").select("id", *same), ["id", *same], "left_semi")
    sketches = materialise(reps.select(F.col("id").alias("rep"), "n", "m", "sketch", "bands"), "sketches")

    buckets = sketches.select("rep", F.posexplode("bands").alias("band", "key"))
    hubs = buckets.groupBy("key").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first < last")
    shared = materialise(buckets.join(hubs, "key"), "buckets")

    slim = sketches.select("rep", "n", "m", "sketch")
    stars = shared.select("rep", F.explode(F.array("first", "last")).alias("hub")).where("rep <> hub")
    stars = stars.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    stars = stars.join(slim.alias("x"), F.col("a") == F.col("x.rep")).join(slim.alias("y"), F.col("b") == F.col("y.rep"))
    stars = materialise(stars.where(_may_link("x", "y", percent)).select("a", "b"), "pairs")
    linked = materialise(_confirmed(stars, rows, percent), "links")
    found = components(linked.select(F.col("a").alias("u"), F.col("b").alias("v")))

    placed = shared.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "band", "rep", F.coalesce("component", "rep").alias("part"))
    mixed = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
    placed = placed.join(mixed.select("key"), "key", "left_semi").join(sketches, "rep")
    placed = materialise(placed, "mixed-buckets")
    x, y = placed.alias("x"), placed.alias("y")
    # A pair may share many buckets; it counts in the first of them only.
    shared_bands = F.zip_with("x.bands", "y.bands", lambda p, q: p == q)
    first = F.array_position(shared_bands, F.lit(True)) == F.col("x.band") + 1
    across = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.part") < F.col("y.part")) & _may_link("x", "y", percent) & first)
    across = across.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
    across = materialise(across.join(stars, ["a", "b"], "left_anti"), "pairs")
    more = _confirmed(across, rows, percent)
    edges = found.select(F.col("node").alias("u"), F.col("component").alias("v"))
    edges = edges.unionByName(more.select(F.col("a").alias("u"), F.col("b").alias("v")))
    final = components(edges).withColumnRenamed("node", "rep")

    rest = signed.where("n = 0 or id is null").select("id", "n", F.lit(None).cast("long").alias("rep"))
    members = placed_rows.select("id", "n", "rep").unionByName(rest).join(final, "rep", "left")
    own = F.when(F.col("n") > 0, F.coalesce("rep", "id")).otherwise(F.col("id"))
    component = F.coalesce("component", own)
    return members.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        own.alias("class_id"),
        F.when(F.col("id").isNotNull(), component).alias("component_id"),
        (F.col("id").isNull() | (F.col("id") == component)).alias("kept"),
    )


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns.

    An id on several rows leaves only if all of them do; a null id stays. Rows whose id
    lies outside a filter over the dropped ids bypass the join, so their texts do not shuffle.
    """
    found = near_duplicates(docs, id_col, text_col, percent)
    ids = found.groupBy(F.col(id_col).alias("key")).agg(F.bool_or("kept").alias("kept"))
    gone = materialise(ids.where("not kept and key is not null").select("key"), "near-copies")
    own, name = F.col(id_col).cast("long"), free_name(docs, "_gone")
    maybe, others = parted(docs, own, gone)
    return others.unionByName(maybe.join(gone.toDF(name), own == F.col(name), "left_anti"))
