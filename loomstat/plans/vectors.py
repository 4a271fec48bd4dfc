"""Dictionaries, term vectors, TF-IDF and collocations, all in long form."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.functions import stats
from loomstat.functions.text import ENGLISH_STOP_WORDS, analyzed_tokens, analyzed_words, head_of, longest_runs, shingles, tail_of, tokens
from loomstat.operators.ranking import with_position
from loomstat.session import materialise, text_tasks


def word_rows(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """One row per blank-separated token."""
    return docs.select(doc, F.explode(tokens(F.col(text))).alias("word"))


def analyzed_grams(docs: DataFrame, doc: str, text: str, n_max: int = 1) -> DataFrame:
    """One row per analyzed term (and n-gram up to ``n_max``)."""
    if n_max == 1:
        # Without n-grams the stop words can go after the explode, in compiled code.
        terms = docs.select(doc, F.explode(analyzed_words(F.col(text))).alias("term"))
        return terms.where(~F.col("term").isin(ENGLISH_STOP_WORDS))
    words = docs.select(doc, analyzed_tokens(F.col(text)).alias("_w"))
    return words.select(doc, F.explode(shingles(F.col("_w"), n_max)).alias("term"))


def dictionary(terms: DataFrame, term: str = "term") -> DataFrame:
    """Distinct terms with dense ids 0..n-1 in term order, numbered in parallel."""
    distinct = terms.where(F.col(term).isNotNull()).select(F.col(term).alias("term")).distinct()
    return with_position(distinct, [F.col("term").asc()], "term_id")


def first_ranks(ranked: DataFrame, word: str, rank: str) -> DataFrame:
    """Each word once, with its smallest rank."""
    return ranked.groupBy(word).agg(F.min(rank).alias(rank))


def term_frequencies(terms: DataFrame, doc: str, known: DataFrame | None = None, keep: str | None = None) -> DataFrame:
    """``(doc, term, tf)``, restricted to a dictionary when given.

    Counting comes before the dictionary join, so a frequent term crosses the
    join once per document. ``keep`` names a dictionary column to carry along.
    """
    counts = terms.groupBy(doc, "term").agg(F.count("*").alias("tf"))
    if known is None:
        return counts
    columns = ["term"] + ([keep] if keep else [])
    return counts.join(known.select(*columns), "term").select(doc, *columns, "tf")


def empty_documents(docs: DataFrame, doc: str, vectors: DataFrame) -> DataFrame:
    """How many documents have no term of the dictionary."""
    return docs.join(vectors, doc, "left_anti").agg(F.count("*").alias("empty_vectors"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    """Documents per term; ``tf`` has one row per (doc, term)."""
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def join_terms(rows: DataFrame, table: DataFrame, df: DataFrame, most: int = 50_000) -> DataFrame:
    """``rows`` joined with ``table`` on ``term``; ``df`` says in how many rows a term is.

    The terms of most rows are few: up to ``most`` of them are written as a table of their own, whose size tells
    the planner that it need not move the rows. Only rows of rarer terms cross a shuffle.
    """
    least = math.ceil(rows.count() / most)
    if least <= 1:
        return rows.join(table, "term")
    often = materialise(df.where(F.col("df") >= least).select("term"), "frequent-terms")
    frequent = materialise(table.join(often, "term", "left_semi"), "frequent")
    rare = [x.join(often, "term", "left_anti") for x in (rows, table)]
    return rows.join(frequent, "term").unionByName(rare[0].join(rare[1], "term"))


def tf_idf(tf: DataFrame, df: DataFrame, n_docs, doc: str) -> DataFrame:
    """Weighted vectors; ``n_docs`` is a Column (literal or scalar subquery)."""
    joined = join_terms(tf, df, df)
    return joined.select(doc, "term", stats.tf_idf(F.col("tf"), F.col("df"), n_docs).alias("weight"))


def gram_totals(docs: DataFrame, doc: str, text: str, n_max: int = 2, n_min: int = 2) -> DataFrame:
    """(gram, n): the n-grams of ``n_min``..``n_max`` words and how often they occur.

    Every position counts its longest run only, the shorter grams are that run's beginnings. Runs
    are counted in tasks of bounded size first and cross one shuffle, by their first
    ``n_min`` words, so the beginnings are added up where the runs arrive.
    """
    n = text_tasks(docs, text)
    dealt = docs.select(F.pmod(F.xxhash64(doc, text), F.lit(n)).cast("int").alias("_task"), text).repartitionById(n, "_task")
    words = dealt.select("_task", tokens(F.col(text)).alias("_w"))
    runs = words.select("_task", F.explode(longest_runs(F.col("_w"), n_max, n_min)).alias("_run"))
    counts = runs.groupBy("_task", "_run").agg(F.count("*").alias("_n"))
    counts = counts.select(F.substring_index("_run", " ", n_min).alias("_lead"), "_run", "_n").repartition(n, "_lead")
    grams = F.array_distinct(F.array(*[F.substring_index("_run", " ", k) for k in range(n_min, n_max + 1)]))
    return counts.select("_lead", "_n", F.explode(grams).alias("gram")).groupBy("_lead", "gram").agg(F.sum("_n").alias("n")).drop("_lead")


def gram_counts(docs: DataFrame, doc: str, text: str, n_max: int = 2) -> DataFrame:
    """Counts of n-grams of 2..n_max words: gram, head, tail, n, head_n, tail_n, total.

    A head count sums the n-grams that start with the same words, a tail count
    those that end with the same word, and the total all of them. Texts are cut into words
    once; the counts are written, since all three sums come from them.
    """
    counts = materialise(gram_totals(docs, doc, text, n_max), "grams")
    parts = counts.select("gram", "n", head_of(F.col("gram")).alias("head"), tail_of(F.col("gram")).alias("tail"))
    heads = parts.groupBy("head").agg(F.sum("n").alias("head_n"))
    tails = parts.groupBy("tail").agg(F.sum("n").alias("tail_n"))
    total = parts.agg(F.sum("n").alias("t")).scalar()
    return parts.join(heads, "head").join(tails, "tail").select("gram", "head", "tail", "n", "head_n", "tail_n", total.alias("total"))


def collocations(grams: DataFrame, min_support: int = 2, min_llr: float = 1.0) -> DataFrame:
    """N-grams of ``gram_counts`` scored by log-likelihood ratio, weak and rare ones dropped."""
    n, head, tail = F.col("n"), F.col("head_n"), F.col("tail_n")
    frequent = grams.where(n >= min_support)
    # A three-word tail can also end two-word grams, so the rest may not go below 0.
    rest = F.greatest(F.col("total") - (head + tail - n), F.lit(0))
    llr = stats.log_likelihood_ratio(n, head - n, tail - n, rest)
    return frequent.select("gram", "n", llr.alias("llr")).where(F.col("llr") >= F.lit(float(min_llr)))


def unigrams(docs: DataFrame, text: str) -> DataFrame:
    """Word counts to put beside the collocations when asked for."""
    words = docs.select(F.explode(tokens(F.col(text))).alias("gram"))
    return words.groupBy("gram").agg(F.count("*").alias("n"))
