"""Exact duplicates with a two-pass Bloom filter, in DataFrame operations only.

The first pass counts, per cell of a filter sized from the number of rows, how many
texts fall on it; cells with two or more form the filter. In the second pass a
text whose cells are all in the filter is possibly repeated. Only those rows
shuffle by their hash; the rest pass straight through as groups of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.llm.common import filter_bits, filter_blocks, filter_cell, free_name, in_filter, parted, with_filter, with_group_values
from loomstat.session import materialise


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. Of equal texts the row
    with the largest id stays, one row exactly even if ids repeat; a null id is
    smaller than any other. Other columns are ignored; an empty table gives no rows.

    Only (id, digest) goes on after the texts are read, written once so that both
    passes see the same rows. The filter that is broadcast has 16 bits a row, up to
    64 MB (``common.MOST_BITS``); with over 30 million rows more of them shuffle, and
    the result stays the same. A group of copies is counted in slices, and its rows get the count by slice, so
    no task sees a whole large group.
    """
    digest = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256)
    rows = docs.select(F.col(id_col).alias("id"), digest.alias("digest"))
    rows = materialise(rows.select("*", F.monotonically_increasing_id().alias("row")), "digests")
    bits = filter_bits(rows.count())
    rows = rows.withColumns({f"c{k}": filter_cell(F.col("digest"), k, bits) for k in (0, 1)})

    each = rows.select(F.explode(F.array_distinct(F.array("c0", "c1"))).alias("cell"))
    often = each.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    maybe = in_filter(F.col("c0")) & in_filter(F.col("c1"))
    tested = with_filter(rows, filter_blocks(often), F.col("c0")).select("id", "digest", "row", maybe.alias("maybe"))
    single = tested.where(~F.col("maybe")).select(
        "id", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")
    )
    again = tested.where("maybe").select("id", "digest", "row")
    order = F.struct(F.col("id").isNotNull().alias("has"), "id", "row")
    back = with_group_values(
        again, ["digest"], F.col("row"), {"best": F.max(order), "n": F.count("*")}, {"best": F.max("best"), "group_size": F.sum("n")}
    ).select(
        "id", "digest", F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept")
    )
    return single.unionByName(back).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with all their columns: one row of each text.

    Rows are told apart by id and text, so another text under the same id stays and
    a null id leaves where an id with the same text is there. Where the id that stays
    repeats with that text, any one of its rows does.

    Texts of rows outside a filter over the dropped (id, digest) bypass the join; only
    the dropped rows and a few others shuffle.
    """
    own = free_name(docs, "_copy")
    who, what = f"{own}_id", f"{own}_digest"
    digest = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256)
    extra = exact_duplicates(docs, id_col, text_col).where("not kept")
    same = F.col(id_col).eqNullSafe(F.col("keep_id")).alias("same")
    extra = materialise(extra.select(F.col(id_col).alias(who), F.col("text_sha256").alias(what), same).distinct(), "copies")
    maybe, others = parted(docs, F.xxhash64(F.col(id_col), digest), extra.select(F.xxhash64(who, what).alias("key")))
    match = F.col(id_col).eqNullSafe(F.col(who)) & (digest == F.col(what))
    kept = others.unionByName(maybe.join(extra, match, "left_anti"))
    if extra.where("same").isEmpty():
        return kept
    repeated = maybe.join(extra.where("same"), match, "left_semi").withColumn(what, digest).dropDuplicates([id_col, what])
    return kept.unionByName(repeated.drop(what))
