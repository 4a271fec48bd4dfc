"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters are hashed into 2^15 features. Document
frequencies come from all training rows. The weights are trained on a bounded
sample, per language, with follow-the-regularised-leader and elastic-net
penalties, which leaves most of them zero; a temperature fitted on rows kept
apart then calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat.llm.common import free_name, text_chunks, unit_hash

BITS = 15
FEATURES = 1 << BITS
PER_LANGUAGE = 600
MAX_SAMPLE = 20_000
#: Rows of each language that MAX_SAMPLE does not take away, however many languages there are.
FEW = 10
UNKNOWN = "und"

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), np.bool_)


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a whole text and how often each occurs; nothing if it has no letter.

    Case is folded and everything that is no letter counts as a blank.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0)
    codes = np.where(letter, codes, 32).astype(np.uint64)
    grams, found = np.zeros(len(codes), np.uint64), []
    for k, factor in enumerate(_FACTORS):
        if len(codes) <= k:
            break
        grams = grams[: len(codes) - k] * _FACTORS[0] + codes[k:] + np.uint64(1)
        found.append((grams * factor) >> np.uint64(64 - BITS))
    counts = np.bincount(np.concatenate(found).astype(np.int64), minlength=FEATURES)
    present = np.flatnonzero(counts)
    return present, counts[present]


def _weights(counts: np.ndarray) -> np.ndarray:
    return 1.0 + np.log(counts)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: in how many documents each feature occurs; feature -1 counts the documents."""
    seen, docs = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for _, texts in text_chunks(batch.column(0), batch.column(0)):
            for text in texts.to_pylist():
                present, _ = ngram_counts(text)
                seen[present] += 1
                docs += len(present) > 0
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], docs))], ["feature", "n"])


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in text_chunks(pa.array(range(len(batch))), batch.column(1)):
            langs, u = (batch.column(k).slice(at[0].as_py(), len(at)) for k in (0, 2))
            found = [ngram_counts(t) for t in texts.to_pylist()]
            offsets = pa.array(np.cumsum([0, *(len(a) for a, _ in found)]).astype(np.int32))
            grams = np.concatenate([a for a, _ in found]).astype(np.int32)
            x = _weights(np.concatenate([c for _, c in found])).astype(np.float32)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (grams, x)]
            yield pa.RecordBatch.from_arrays([langs, *lists, u], ["lang", "at", "x", "u"])


@dataclass
class LanguageModel:
    """Languages, idf of every feature, weights (features x languages), intercepts and temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    intercepts: np.ndarray
    temperature: float

    def logits(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        x = tf * self.idf[at]
        return (x / max(np.linalg.norm(x), 1e-12)) @ self.weights[at] + self.intercepts

    def predict(self, text: str) -> tuple[str, float]:
        at, counts = ngram_counts(text)
        if not len(at) or not self.languages:
            return UNKNOWN, 0.0
        z = self.logits(at, _weights(counts)) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def _ftrl(rows, classes: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over (features, values, class) rows; the intercept takes no penalty."""
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))

    def current(at: np.ndarray) -> np.ndarray:
        zs, steps = z[at], (beta + np.sqrt(n[at])) / alpha
        w = np.where(np.abs(zs) > l1, (np.sign(zs) * l1 - zs) / (steps + l2), 0.0)
        w[-1] = -zs[-1] / steps[-1]
        return w

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            at, x = np.append(at, FEATURES), np.append(x, 1.0)
            w = current(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = current(np.arange(FEATURES + 1))
    return w[:-1], w[-1]


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss on rows that were not trained on."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    grid = np.exp(np.linspace(-4, 3, 141))
    return float(grid[np.argmin([loss(t) for t in grid])])


def quota(sizes: list[int], per_language: int) -> int:
    """The most rows the sample takes of one language: as many as MAX_SAMPLE allows, but FEW at least."""
    held, most = np.array(sizes, np.int64), per_language
    while most > FEW and np.minimum(held, most).sum() > MAX_SAMPLE:
        most -= 1
    return most


def train(
    docs: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = PER_LANGUAGE,
    epochs: int = 3,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.01,
) -> LanguageModel:
    """Train on the rows where ``learn`` holds and neither text nor language is null.

    Document frequencies cover all those rows; ``per_language`` bounds the sample
    for the weights (so many rows of each language, those with the smallest hash
    of id and text; fewer where MAX_SAMPLE rows would not do, see ``quota``).
    Every language with a letter in some text is learned, so the weights grow
    with the number of languages (2^15 numbers each), and so does the sample
    above MAX_SAMPLE / FEW languages. Only the sample's features shuffle. The
    driver gets 2^15 counts, the size of each language and the sample's features.
    An empty table gives a model without languages.
    """
    rows = docs.where(learn).select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).where("text is not null and lang is not null")
    counted = rows.select("text").mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    counted = dict(map(tuple, counted.collect()))
    total = counted.pop(-1, 0)
    frequency = np.zeros(FEATURES)
    for at, n in counted.items():
        frequency[at] = n
    idf = np.log((1.0 + total) / (1.0 + frequency)) + 1.0

    lettered = rows.where(F.col("text").rlike(r"\p{L}")).select("lang", "text", unit_hash("id", "text", seed=3).alias("u"))
    sizes = lettered.groupBy("lang").agg(F.count("*").alias("size"), F.min("u").alias("least")).collect()
    most = quota([r["size"] for r in sizes], per_language)
    # More rows than needed pass the cut, so that the rank below finds ``most`` of them; the least hash always passes.
    cuts = [(r["lang"], max((most + 5 * most**0.5 + 5) / r["size"], r["least"])) for r in sizes]
    cuts = docs.sparkSession.createDataFrame(cuts, "lang string, cut double")
    # A row per language is far less than the model, which every executor holds.
    chosen = lettered.join(F.broadcast(cuts), "lang").where(F.col("u") <= F.col("cut")).select("lang", "text", "u")
    examples = chosen.mapInArrow(_examples, "lang string, at array<int>, x array<float>, u double").where(F.size("at") > 0)
    ranked = examples.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("u")))
    sample = ranked.where(F.col("_r") <= most).drop("_r").toPandas()
    sample = sample.sort_values(["lang", "u"], ignore_index=True)
    languages = sorted(set(sample["lang"]))
    place = {lang: k for k, lang in enumerate(languages)}
    data = []
    for lang, at, tf in zip(sample["lang"], sample["at"], sample["x"]):
        at = np.asarray(at)
        x = np.asarray(tf) * idf[at]
        data.append((at, x / np.linalg.norm(x), place[lang]))
    if not data:
        return LanguageModel([], idf.astype(np.float32), np.zeros((FEATURES, 0), np.float32), np.zeros(0), 1.0)
    apart = (sample.groupby("lang").cumcount() % 5 == 4).to_numpy()
    weights, intercepts = _ftrl([d for d, a in zip(data, apart) if not a], len(languages), epochs, alpha, beta, l1, l2)
    kept = [d for d, a in zip(data, apart) if a]
    logits = np.array([x @ weights[at] + intercepts for at, x, _ in kept]).reshape(len(kept), len(languages))
    heat = _temperature(logits, np.array([y for _, _, y in kept], int))
    return LanguageModel(languages, idf.astype(np.float32), weights.astype(np.float32), intercepts, heat)


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with lang_pred and score (the calibrated probability of that language).

    Whole texts, one Arrow pass, no shuffle. Null texts and texts without a letter
    give ``und`` with score 0; so does everything if the model has no language.
    Other columns pass through, except ones named like the new columns.
    """
    kept = [c for c in docs.columns if c.lower() not in (text_col.lower(), "lang_pred", "score")]
    schema = docs.select(*kept).schema.add("lang_pred", T.StringType()).add("score", T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_chunks(pa.array(range(len(batch))), batch.column(len(kept))):
                found = [model.predict(t) for t in texts.to_pylist()]
                new = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
                part = batch.slice(at[0].as_py(), len(at))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *new], [*kept, "lang_pred", "score"])

    return docs.select(*kept, F.col(text_col).cast("string").alias(free_name(docs, "_text"))).mapInArrow(run, schema)
