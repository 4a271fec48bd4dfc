"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the presence of words and word beginnings is trained
in numpy from confirmed toxic texts and unlabelled ones. Its risk is the
class-prior-corrected estimate
``prior * E+[loss(g)] + max(0, Eu[loss(-g)] - prior * E+[loss(-g)])``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat.llm.common import free_name, text_chunks, unit_hash

POSITIVES, UNLABELLED = 3_000, 6_000
THRESHOLD = 0.3
STEMS = (4, 5, 6)
#: How many times oftener a feature must occur in confirmed texts than in clean ones, as the prior lets estimate.
TELLING = 10.0
#: Smaller weights are dropped.
LEAST_WEIGHT = 0.1
#: In how many confirmed texts a feature must occur.
LEAST_TEXTS = 3
_WORD = re.compile(r"[^\W\d_]+")
_REMEMBERED = 300_000


def word_features(word: str) -> list[int]:
    """Hashed features of one lower-case word: itself and its beginnings."""
    return [zlib.crc32(word.encode()), *(zlib.crc32(f"{word[:k]}*".encode()) for k in STEMS if len(word) > k)]


def text_features(text: str) -> list[int]:
    """Distinct features of a whole text, sorted."""
    return sorted({f for w in set(_WORD.findall(text.lower())) for f in word_features(w)})


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in text_chunks(pa.array(range(len(batch))), batch.column(2)):
            found = [np.array(text_features(t), np.uint32).view(np.int32) for t in texts.to_pylist()]
            part = batch.slice(at[0].as_py(), len(at))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.list_(pa.int32()))], ["positive", "hash", "found"])


def fit_nnpu(rows: list[np.ndarray], positive: np.ndarray, features: int, prior: float, rounds: int = 400, rate: float = 0.05, strength: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the non-negative risk with logistic loss (Adam, whole batch).

    ``rows`` are the feature numbers present in each example. When the estimated
    risk of the negative class falls below zero, a step goes against it instead.
    An absolute penalty per weight, of one and a half standard deviations of the
    feature's count, keeps features near zero that toxic texts hold by chance; a
    feature of few texts is not held back further.
    """
    at = np.concatenate(rows) if rows else np.zeros(0, int)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    p, u = positive, ~positive
    held = np.bincount(np.concatenate([np.zeros(0, int), *(r for r, own in zip(rows, p) if own)]), minlength=features)
    penalty = strength * prior * 1.5 * np.sqrt(held) / max(p.sum(), 1)
    share_p, share_u = prior * p / max(p.sum(), 1), u / max(u.sum(), 1)
    w, m, v = np.zeros(features + 1), np.zeros(features + 1), np.zeros(features + 1)
    w[-1] = np.log(prior / (1 - prior))
    for k in range(1, rounds + 1):
        g = np.bincount(of, w[at], len(rows)) + w[-1]
        s = 1 / (1 + np.exp(-np.clip(g, -500, 500)))
        negative = ((share_u - share_p) * np.logaddexp(0, g)).sum()
        if negative >= 0:
            slope = share_p * (s - 1) + (share_u - share_p) * s
        else:
            slope = -(share_u - share_p) * s
        grad = np.append(np.bincount(at, slope[of], features), slope.sum())
        grad[:-1] += penalty * np.tanh(20 * w[:-1]) + 1e-4 * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w[:-1], float(w[-1])


@dataclass
class ToxicityModel:
    """Weights by hashed feature, and the intercept."""

    weights: dict[int, float]
    intercept: float

    def scorer(self):
        """A function from text to score; it remembers the features of frequent words."""
        known: dict[str, tuple] = {}
        weights = self.weights

        def score(text: str) -> float:
            found: set[int] = set()
            for w in set(_WORD.findall(text.lower())):
                hit = known.get(w)
                if hit is None:
                    if len(known) >= _REMEMBERED:
                        known.clear()
                    hit = tuple(f for f in word_features(w) if f in weights)
                    if len(w) <= 64:
                        known[w] = hit
                found.update(hit)
            g = self.intercept + sum(weights[f] for f in sorted(found))
            return float(1 / (1 + np.exp(-np.clip(g, -500, 500))))

        return score


def train(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    positives: int = POSITIVES,
    unlabelled: int = UNLABELLED,
    prior: float | None = None,
) -> ToxicityModel:
    """Train from confirmed toxic rows and unlabelled texts where ``learn`` (on the id) holds.

    At most ``positives`` and ``unlabelled`` rows, chosen by a hash of the id, reach
    the driver as feature numbers. The class prior is the share of toxic labels
    among the labelled rows that may be learned from, unless given; negative
    labels serve for nothing else. Without a positive example every score is 0.
    Null labels, ids and texts take no part.
    """
    known = labels.where(learn).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    known = known.where("_id is not null and _label is not null")
    total, toxic = known.agg(F.count("*"), F.coalesce(F.sum((F.col("_label") == 1).cast("long")), F.lit(0))).first()
    if not toxic:
        return ToxicityModel({}, -500.0)
    prior = prior if prior is not None else float(np.clip(toxic / total, 1e-4, 0.9))
    chosen = known.where("_label = 1").orderBy(unit_hash("_id", seed=8), "_id").limit(positives).select("_id")
    rows = docs.where(learn)
    size = rows.count()
    texts = rows.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where("_text is not null")
    own = unit_hash("_id", "_text", seed=10).alias("hash")
    sure = texts.join(F.broadcast(chosen), "_id").select(F.lit(True).alias("positive"), own, "_text")
    plain = texts.where(unit_hash("_id", seed=9) * F.lit(float(size)) < unlabelled).select(F.lit(False).alias("positive"), own, "_text")
    kind = "positive boolean, hash double, found array<int>"
    # Ids on several rows may bring more; those of the smallest hashes of id and text stay, whatever the order of the files.
    sides = [side.mapInArrow(_feature_rows, kind).orderBy("hash").limit(2 * n) for side, n in ((sure, positives), (plain, unlabelled))]
    found = sides[0].unionByName(sides[1])
    found = found.toPandas()
    positive = found["positive"].to_numpy(bool)
    if not positive.any():
        return ToxicityModel({}, -500.0)
    sure, plain = (np.concatenate([np.zeros(0, np.int32), *found["found"][p]]) for p in (positive, ~positive))
    names, n = np.unique(sure, return_counts=True)
    plain.sort()
    other = np.searchsorted(plain, names, side="right") - np.searchsorted(plain, names)
    del sure, plain
    # The share among clean texts, corrected by the prior; what is common there would only add noise to long texts.
    share = n / positive.sum()
    clean = np.maximum(other / max((~positive).sum(), 1) - prior * share, 0) / (1 - prior)
    telling = share >= TELLING * (clean + 1 / max((~positive).sum(), 1))
    names = names[(n >= LEAST_TEXTS) & telling]
    rows = []
    for f in found["found"]:
        f = np.asarray(f, np.int32)
        at = np.searchsorted(names, f)
        inside = at < len(names)
        at = at[inside]
        rows.append(at[names[at] == f[inside]] if len(names) else np.zeros(0, int))
    weights, _ = fit_nnpu(rows, positive, len(names), prior)
    kept = np.flatnonzero(weights > LEAST_WEIGHT)
    place = np.full(len(names) + 1, -1)
    place[kept] = np.arange(len(kept))
    rows = [place[r][place[r] >= 0] for r in rows]
    # The penalty has chosen the features; their weights are fitted again without it.
    names, (weights, intercept) = names[kept], fit_nnpu(rows, positive, len(kept), prior, strength=0.0)
    return ToxicityModel({int(a) & 0xFFFFFFFF: float(b) for a, b in zip(names, weights)}, intercept)


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the text, with score (0 to 1) and predicted (1 if the score reaches the threshold).

    Whole texts, one Arrow pass, no shuffle. Null texts score as empty ones.
    Other columns pass through, except ones named like the new columns.
    """
    kept = [c for c in docs.columns if c.lower() not in (text_col.lower(), "score", "predicted")]
    schema = docs.select(*kept).schema.add("score", T.DoubleType()).add("predicted", T.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = model.scorer()
        for batch in batches:
            for at, texts in text_chunks(pa.array(range(len(batch))), batch.column(len(kept))):
                scores = np.array([rate(t) for t in texts.to_pylist()])
                part = batch.slice(at[0].as_py(), len(at))
                new = [pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *new], [*kept, "score", "predicted"])

    return docs.select(*kept, F.col(text_col).cast("string").alias(free_name(docs, "_text"))).mapInArrow(run, schema)
