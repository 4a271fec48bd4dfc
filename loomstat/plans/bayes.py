"""Naive Bayes models as tables, and batch classification by joins.

Scores are sums over matched terms plus a per-category constant, so a document
is joined only with the categories its terms occur in, never with everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.functions.text import normalised_tokens
from loomstat.plans.vectors import analyzed_grams, document_frequencies, join_terms, term_frequencies, tf_idf
from loomstat.session import by_document, materialise


def word_category_counts(docs: DataFrame, text: str, category: str) -> DataFrame:
    """``(word, category, count)`` over normalised tokens of labelled texts."""
    words = docs.select(F.col(category).alias("category"), F.explode(normalised_tokens(F.col(text))).alias("word"))
    return words.groupBy("word", "category").agg(F.count("*").alias("count"))


def merge_counts(rows: DataFrame) -> DataFrame:
    """The model: counts summed per (word, category)."""
    return rows.groupBy("word", "category").agg(F.sum("count").alias("count"))


def _vocabulary(model: DataFrame, size: str) -> Column:
    if size == "tokens":
        return model.agg(F.sum("count").alias("v")).scalar()
    if size == "vocabulary":
        return model.agg(F.count_distinct("word").alias("v")).scalar()
    raise ValueError("vocabulary size is 'tokens' or 'vocabulary'")


def score(model: DataFrame, docs: DataFrame, doc: str, text: str, size: str = "tokens") -> DataFrame:
    """Add-one score of each document for each category it shares a word with.

    The model is read three times: give a stored table.

    score = Σ over tokens ln((n_cw + 1)/(n_c + V)). A token unknown to the
    category adds ln(1/(n_c + V)), which the constant term covers; the answer is
    taken from the complete sums.
    """
    v = _vocabulary(model, size)
    words = by_document(docs, doc, text).select(doc, normalised_tokens(F.col(text)).alias("_ws"))
    # The length rides along with the words, so no second pass per document is needed.
    exploded = words.select(doc, F.size("_ws").alias("_len"), F.explode("_ws").alias("word"))
    counted = exploded.groupBy(doc, "_len", "word").agg(F.count("*").alias("_m"))
    totals = model.groupBy("category").agg(F.sum("count").alias("_total"))
    known = model.select("word", "category", F.ln(F.col("count") + F.lit(1)).alias("_ln"))
    matched = counted.join(known, "word").groupBy(doc, "_len", "category").agg(F.sum(F.col("_m") * F.col("_ln")).alias("_sum"))
    out = matched.join(totals, "category")
    return out.select(doc, "category", (F.col("_sum") - F.col("_len") * F.ln(F.col("_total") + v)).alias("score"))


def classify(
    model: DataFrame, docs: DataFrame, doc: str, text: str, size: str = "tokens", default: str | None = None, digits: int = 9
) -> DataFrame:
    """Best category per document; ``default`` (or null) where nothing matches.

    Ties (scores equal to ``digits`` decimals) go to the smaller category.
    """
    scores = score(model, docs, doc, text, size)
    best = scores.groupBy(doc).agg(
        F.min_by("category", F.struct(-F.round("score", digits), F.col("category"))).alias("category"), F.max("score").alias("score")
    )
    out = docs.select(doc).join(best, doc, "left")
    return out if default is None else out.withColumn("category", F.coalesce("category", F.lit(default)))


# ---- weighted vectors --------------------------------------------------------------


def weight_model(vectors: DataFrame, labels: DataFrame, doc: str, label: str) -> DataFrame:
    """``(label, term, weight)``: weights of labelled vectors summed up."""
    joined = vectors.join(labels.select(doc, F.col(label).alias("label")), doc)
    return joined.groupBy("label", "term").agg(F.sum("weight").alias("weight"))


def validate_weights(model: DataFrame, alpha: float) -> DataFrame:
    """One row: sizes of the model and whether it can score anything."""
    if alpha <= 0:
        raise ValueError("alpha must be positive")
    sizes = model.agg(
        F.count_distinct("label").alias("n_labels"),
        F.count_distinct("term").alias("n_terms"),
        F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total_weight"),
    )
    valid = (F.col("n_labels") > 0) & (F.col("n_terms") > 0) & (F.col("total_weight") > 0)
    return sizes.withColumn("valid", valid)


def score_weights(model: DataFrame, vectors: DataFrame, doc: str, alpha: float = 1.0, whole: bool = False) -> DataFrame:
    """Σ w·ln((W_lf + α)/(W_l + α·F)) of the labels that share a term with the document.

    Terms a label has never seen contribute w·ln(α/(W_l + α·F)): a constant of the
    label, its floor, times the document's total weight. A label without a shared term
    has that floor alone, so of these only the best is returned, as one row per document with
    ``matched`` false: the label of the greatest floor (ties to the smaller). Where that
    label shares a term itself, it has the matched row only. Weights must not be negative, so that no
    other unmatched label can come first. With ``whole`` every document has a row for every label.
    """
    if alpha <= 0:
        raise ValueError("alpha must be positive")
    n_terms = model.agg(F.count_distinct("term").alias("f")).scalar()
    labels = model.groupBy("label").agg(F.sum("weight").alias("_w"))
    floor = F.lit(alpha) / (F.col("_w") + F.lit(alpha) * n_terms)
    floors = labels.select("label", F.ln(floor).alias("_floor"))
    weight = F.when(F.col("weight") >= 0, F.col("weight")).otherwise(F.raise_error(F.lit("a weight is negative or no number")).cast("double"))
    vectors = vectors.select(doc, "term", weight.alias("weight"))
    per_doc = vectors.groupBy(doc).agg(F.sum("weight").alias("_total"))
    gain = F.ln((F.col("_mw") + F.lit(alpha)) / F.lit(alpha))
    known = model.select("term", "label", F.col("weight").alias("_mw"))
    matched = join_terms(vectors, known, document_frequencies(vectors)).groupBy(doc, "label").agg(F.sum(F.col("weight") * gain).alias("_gain"))
    scored = matched.join(per_doc, doc).join(floors, "label")
    scored = scored.select(doc, "label", (F.col("_total") * F.col("_floor") + F.col("_gain")).alias("score"), F.lit(True).alias("matched"))
    if whole:
        every = per_doc.crossJoin(floors).join(matched, [doc, "label"], "left")
        score = F.col("_total") * F.col("_floor") + F.coalesce("_gain", F.lit(0.0))
        return every.select(doc, "label", score.alias("score"), F.col("_gain").isNotNull().alias("matched"))
    # One label for all documents: a scalar of the small table of floors.
    best = floors.agg(F.min_by(F.struct("label", "_floor"), F.struct(-F.col("_floor"), F.col("label"))).alias("b")).scalar()
    rest = per_doc.withColumn("_b", best).where("_b is not null")
    rest = rest.select(doc, F.col("_b.label").alias("label"), (F.col("_total") * F.col("_b._floor")).alias("score"), F.lit(False).alias("matched"))
    rest = rest.join(matched.select(doc, "label"), [doc, "label"], "left_anti")
    return scored.unionByName(rest.select(doc, "label", "score", "matched"))


def best_label(scores: DataFrame, doc: str, digits: int = 9) -> DataFrame:
    """The label with the greatest score; ties (to ``digits`` decimals) to the smaller label."""
    return scores.groupBy(doc).agg(
        F.min_by("label", F.struct(-F.round("score", digits), F.col("label"))).alias("predicted")
    )


def held_out(doc: str, percent: int = 20, seed: int = 0) -> Column:
    """Whether a document is held out of training: the first 32 bits of md5('seed:id') decide, as any engine can repeat."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), doc).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 100 < percent


def evaluate_documents(
    docs: DataFrame, labels: DataFrame, doc: str, text: str, label: str, n_max: int = 1, alpha: float = 1.0, percent: int = 20, seed: int = 0
) -> DataFrame:
    """Confusion on held-out labelled documents: trained on the other labels, tested on these only."""
    vectors = materialise(weighted_documents(docs, doc, text, n_max), "vectors")
    labels, out = materialise(labels, "labels"), held_out(doc, percent, seed)
    model = materialise(weight_model(vectors, labels.where(~out), doc, label), "weights")
    tests = labels.where(out)
    asked = materialise(vectors.join(tests.select(doc), doc, "left_semi"), "test-vectors")
    scores = score_weights(model, asked, doc, alpha)
    return confusion(best_label(scores, doc), tests, doc, label)


def weighted_documents(docs: DataFrame, doc: str, text: str, n_max: int = 1, known: DataFrame | None = None) -> DataFrame:
    """Text → analyzed n-grams → counts (dictionary only) → TF-IDF weights.

    The counts are made where the documents are, without a shuffle of words, and written; so are the
    frequencies, whose size the planner then knows when it joins the two.
    """
    tf = materialise(term_frequencies(analyzed_grams(by_document(docs, doc, text), doc, text, n_max), doc, known), "tf")
    n_docs = docs.agg(F.count("*").alias("n")).scalar()
    return tf_idf(tf, materialise(document_frequencies(tf), "df"), n_docs, doc)


def classify_documents(
    docs: DataFrame, labels: DataFrame, doc: str, text: str, label: str, n_max: int = 1, alpha: float = 1.0, whole: bool = False
) -> DataFrame:
    """The whole chain: train on the labelled documents, score all of them (see ``score_weights``).

    The vectors feed training and scoring and the model is read three times, so both are written once.
    """
    vectors = materialise(weighted_documents(docs, doc, text, n_max), "vectors")
    model = materialise(weight_model(vectors, materialise(labels, "labels"), doc, label), "weights")
    return score_weights(model, vectors, doc, alpha, whole)


def confusion(predicted: DataFrame, labels: DataFrame, doc: str, label: str) -> DataFrame:
    """Rows per (label, predicted); unpredicted rows count with a null."""
    truth = labels.select(doc, F.col(label).alias("label"))
    return truth.join(predicted.select(doc, "predicted"), doc, "left").groupBy("label", "predicted").agg(
        F.count("*").alias("n")
    )
