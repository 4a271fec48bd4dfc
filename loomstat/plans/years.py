"""Which year does a phrase come from: three scorers over word counts per year.

``counts`` holds one row per (word, year) with ``count``. "Year" is any category,
with any number of values. Queries come as a batch ``(query_id, text)``.

Scores have a row per matched (query, year) and one complement row per query for
all years that share no word with it: its year is null and ``n_years`` says how many
there are. No query is crossed with all years.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat.functions import stats
from loomstat.functions.casting import lenient_number
from loomstat.functions.text import query_terms, strip_pos, strip_unicode_punctuation, tokens
from loomstat.operators.joins import keep_terms
from loomstat.operators.ranking import with_position

log = logging.getLogger(__name__)


def parse_counts(lines: DataFrame, value: str = "value") -> DataFrame:
    """``word \\t year \\t count [\\t books]`` lines; a line that does not parse is dropped."""
    p = F.split(F.col(value), "\t", -1)
    at = lambda i: F.get(p, F.lit(i))
    rows = lines.select(
        at(0).alias("word"),
        lenient_number(at(1), T.IntegerType()).alias("year"),
        lenient_number(at(2), T.LongType()).alias("count"),
        lenient_number(at(3), T.LongType()).alias("books"),
    )
    return rows.dropna(subset=["word", "year", "count"])


def clean_counts(rows: DataFrame) -> DataFrame:
    """Strip part-of-speech suffixes and add up what then coincides."""
    return (
        rows.select(strip_pos(F.col("word")).alias("word"), "year", "count", "books")
        .groupBy("word", "year")
        .agg(F.sum("count").alias("count"), F.sum("books").alias("books"))
    )


def odd_years(rows: DataFrame) -> DataFrame:
    """The odd-year sample; negative years count by their remainder too."""
    return rows.where(F.pmod("year", F.lit(2)) == 1)


def year_totals(counts: DataFrame) -> DataFrame:
    """Distinct and total words per year."""
    return counts.groupBy("year").agg(F.count("*").alias("unique_words"), F.sum("count").alias("total_words"))


def year_count(counts: DataFrame) -> DataFrame:
    return counts.agg(F.count_distinct("year").alias("n_years"))


def average_words(totals: DataFrame) -> DataFrame:
    return totals.agg(F.avg("total_words").alias("avg_words"))


def years_per_word(counts: DataFrame) -> DataFrame:
    return counts.groupBy("word").agg(F.count("*").alias("n_years_with"))


def idf_model(counts: DataFrame, log_idf: bool = False) -> DataFrame:
    """Inverse frequency of each word over the years."""
    n = year_count(counts).scalar()
    idf = stats.inverse_document_frequency(n, F.col("n_years_with"), log_idf)
    return years_per_word(counts).select("word", idf.alias("idf"))


def phrase_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(query_terms(F.col("text"))).alias("term")).where(F.col("term") != "")


def matched_counts(counts: DataFrame, terms: DataFrame) -> DataFrame:
    """Count rows whose lower-cased word is a term, once per query that has it.

    The semi join drops other words right after the scan.
    """
    kept = keep_terms(counts, "word", terms)
    return kept.join(terms, F.lower("word") == F.col("term"))


def with_complement(queries: DataFrame, matched: DataFrame, totals: DataFrame, **constant: Column) -> DataFrame:
    """``matched`` (query_id, year, …) plus, per query, one row for all other years.

    The row has a null year, the values of ``constant`` for the other columns, and
    ``n_years``, how many years it stands for; it is missing where every year is matched.
    """
    n = totals.agg(F.count("*").alias("n")).scalar()
    found = matched.groupBy("query_id").agg(F.count("*").alias("_m"))
    rest = queries.select("query_id").distinct().join(found, "query_id", "left").withColumn("n_years", n - F.coalesce("_m", F.lit(0)))
    none = F.lit(None).cast(matched.schema["year"].dataType)
    rest = rest.where("n_years > 0").select("query_id", none.alias("year"), *[c.alias(k) for k, c in constant.items()], "n_years")
    one = matched.select("query_id", "year", *constant, F.lit(1).cast("bigint").alias("n_years"))
    return one.unionByName(rest)


def with_every_year(queries: DataFrame, matched: DataFrame, totals: DataFrame, **constant: Column) -> DataFrame:
    """One row per query and year: ``matched`` (query_id, year, …), or the values of ``constant`` where a year shares no word."""
    grid = queries.select("query_id").distinct().crossJoin(totals.select("year").distinct())
    out = grid.join(matched.withColumn("_found", F.lit(True)), ["query_id", "year"], "left")
    return out.select("query_id", "year", *[F.when(F.col("_found"), F.col(k)).otherwise(c).alias(k) for k, c in constant.items()])


def bm25(
    counts: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, log_idf: bool = False, whole: bool = False
) -> DataFrame:
    """BM25 of the years that have a word of the phrase; all other years score 0, in one complement row, or one by one with ``whole``."""
    totals = year_totals(counts).select("year", "total_words")
    average = average_words(totals).scalar()
    terms = phrase_terms(queries)
    idf = keep_terms(idf_model(counts, log_idf), "word", terms)
    rows = matched_counts(counts, terms).join(idf, "word", "left").join(totals, "year", "left")
    length = F.coalesce("total_words", F.lit(0))
    term = stats.bm25_term(F.coalesce("idf", F.lit(0.0)), F.col("count"), length, average, k1, b)
    scored = rows.groupBy("query_id", "year").agg(F.sum(term).alias("score"))
    return (with_every_year if whole else with_complement)(queries, scored, totals, score=F.lit(0.0))


def naive_bayes(counts: DataFrame, queries: DataFrame, vocabulary: int = 0) -> DataFrame:
    """Σ ln(f + 1) − m·ln(total + 1 + V) over the m matched rows of a year."""
    totals = year_totals(counts).select("year", "total_words")
    rows = matched_counts(counts, phrase_terms(queries))
    sums = rows.groupBy("query_id", "year").agg(
        F.sum(F.ln(F.col("count") + F.lit(1))).alias("_s"), F.count("*").alias("_m")
    )
    joined = sums.join(totals, "year")
    size = F.ln(F.col("total_words") + F.lit(1 + vocabulary))
    return joined.select("query_id", "year", (F.col("_s") - F.col("_m") * size).alias("score"))


def phrase_vectors(queries: DataFrame) -> DataFrame:
    """Term counts of a phrase: punctuation stripped, case kept.

    A token that was punctuation only does not count as a word.
    """
    words = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("_w"))
    cleaned = words.select("query_id", strip_unicode_punctuation(F.col("_w")).alias("word")).where(F.col("word") != "")
    return cleaned.groupBy("query_id", "word").agg(F.count("*").alias("q"))


def nearest_years(counts: DataFrame, queries: DataFrame, whole: bool = False) -> DataFrame:
    """Euclidean distance of unit-length count vectors to the years that share a word.

    d² = 2 − 2·cos, so only shared words are joined; all other years lie at √2, in one
    complement row, or one by one with ``whole``. Phrases without a word are left out. Doubles throughout.
    """
    vectors = phrase_vectors(queries)
    f = F.col("count").cast("double")
    norms = counts.groupBy("year").agg(F.sqrt(F.sum(f * f)).alias("_norm"))
    lengths = vectors.groupBy("query_id").agg(F.sqrt(F.sum(F.col("q") * F.col("q").cast("double"))).alias("_len"))
    dots = counts.join(vectors, "word").groupBy("query_id", "year").agg(F.sum(F.col("q") * f).alias("_dot"))
    joined = dots.join(norms, "year").join(lengths, "query_id")
    cos = F.try_divide("_dot", F.col("_norm") * F.col("_len"))
    squared = F.greatest(F.lit(2.0) - F.lit(2.0) * F.coalesce(cos, F.lit(0.0)), F.lit(0.0))
    matched = joined.select("query_id", "year", F.sqrt(squared).alias("distance"))
    return (with_every_year if whole else with_complement)(lengths, matched, norms, distance=F.sqrt(F.lit(2.0)))


def squared_distances(counts: DataFrame, queries: DataFrame, whole: bool = False) -> DataFrame:
    """‖q − y‖² of raw count vectors: every year that shares a word, and the nearest of the others.

    ‖q‖² + ‖y‖² − 2·q·y covers terms missing on either side without pairing the two
    vocabularies. Without a shared word only ‖y‖² differs between years, so the
    nearest such year is the first in the order of (‖y‖², year) that the query does not match; with
    m matches it is among the first m + 1, and no more are looked at. Its row has
    ``n_years``, how many years share no word; matched rows have 1 and ``shared`` true.
    With ``whole`` every year has its own row, (query_id, year, squared, shared).
    """
    vectors = phrase_vectors(queries)
    f, q = F.col("count"), F.col("q")
    years = counts.groupBy("year").agg(F.sum(f * f).alias("_yy"))
    lengths = vectors.groupBy("query_id").agg(F.sum(q * q).alias("_qq"))
    dots = counts.join(vectors, "word").groupBy("query_id", "year").agg(F.sum(q * f).alias("_dot"))
    squared = F.col("_qq") + F.col("_yy") - 2 * F.col("_dot")
    if whole:
        grid = lengths.crossJoin(years).join(dots, ["query_id", "year"], "left")
        each = F.col("_qq") + F.col("_yy") - 2 * F.coalesce("_dot", F.lit(0).cast("bigint"))
        return grid.select("query_id", "year", each.alias("squared"), F.col("_dot").isNotNull().alias("shared"))
    columns = ["query_id", "year", "squared", "n_years", "shared"]
    matched = dots.join(years, "year").join(lengths, "query_id").withColumns(
        {"squared": squared, "n_years": F.lit(1).cast("bigint"), "shared": F.lit(True)}
    )
    placed = with_position(years, [F.col("_yy"), F.col("year")], "_at")
    n = years.agg(F.count("*").alias("n")).scalar()
    found = dots.groupBy("query_id").agg(F.count("*").alias("_m"))
    rest = lengths.join(found, "query_id", "left").withColumn("_m", F.coalesce("_m", F.lit(0).cast("bigint"))).where(F.col("_m") < n)
    first = rest.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_m"))).alias("_at")).join(placed, "_at")
    first = first.join(dots.select("query_id", "year"), ["query_id", "year"], "left_anti")
    nearest = first.groupBy("query_id", "_qq", "_m").agg(F.min_by(F.struct("year", "_yy"), "_at").alias("_y"))
    others = nearest.select(
        "query_id", F.col("_y.year").alias("year"), (F.col("_qq") + F.col("_y._yy")).alias("squared"), (n - F.col("_m")).alias("n_years"), F.lit(False).alias("shared")
    )
    return matched.select(*columns).unionByName(others.select(*columns))


def rank_years(scores: DataFrame, score: Column) -> DataFrame:
    """Rank the years of each phrase, best first; ties by year, the complement row last.

    A complement row counts as its ``n_years`` years: it has the first rank of
    them, and what comes after it follows with the gap. A phrase has at most one row per matched year, so its window is bounded.
    Without ``n_years`` every row is one year.
    """
    order = Window.partitionBy("query_id").orderBy(score, F.col("year").asc_nulls_last())
    if "n_years" not in scores.columns:
        return scores.withColumn("rank", F.row_number().over(order))
    before = F.sum("n_years").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return scores.withColumn("rank", (F.coalesce(before, F.lit(0)) + 1).cast("int"))


def all_scorers(counts: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, whole: bool = False) -> dict[str, DataFrame]:
    return {
        "bm25": bm25(counts, queries, k1, b, whole=whole),
        "naive_bayes": naive_bayes(counts, queries).withColumn("n_years", F.lit(1).cast("bigint")),
        "nearest": nearest_years(counts, queries, whole).withColumnRenamed("distance", "score"),
    }


def analyse(counts: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, whole: bool = False) -> DataFrame:
    """All three scorers on a batch: (scorer, query_id, year, score, n_years), without ``n_years`` with ``whole``."""
    columns = ["query_id", "year", "score"] + ([] if whole else ["n_years"])
    out = None
    for name, df in all_scorers(counts, queries, k1, b, whole).items():
        rows = df.select(F.lit(name).alias("scorer"), *columns)
        out = rows if out is None else out.unionByName(rows)
    return out


def analyse_to(counts: DataFrame, queries: DataFrame, root: str, mode: str = "error") -> dict[str, str | None]:
    """Write each scorer's table on its own; a failing one does not stop the rest.

    Returns the error text per scorer, None where it went well.
    """
    outcome: dict[str, str | None] = {}
    for name, df in all_scorers(counts, queries).items():
        try:
            df.write.mode(mode).parquet(f"{root}/{name}")
            outcome[name] = None
        except Exception as error:  # any job failure: record it and go on
            log.warning("scorer %s failed: %s", name, error)
            outcome[name] = str(error)
    return outcome
