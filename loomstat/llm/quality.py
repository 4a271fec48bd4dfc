"""Quality classifier: a sparse ensemble of rules over text statistics.

Small boosted trees on a bounded labelled sample give paths; every path is a
conjunction of thresholds on statistics. A logistic regression with an L1
penalty over these rules keeps few of them, and the kept ones become one Spark
column expression, so that scoring stays inside the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.llm.common import free_name, unit_hash

SAMPLE = 8_000
THRESHOLD = 0.3
Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, threshold), all of which must hold


def statistics(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` with numeric statistics of the whole text; null counts as empty."""
    prefix = free_name(docs, "_s")
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    made = docs.withColumns(
        {
            f"{prefix}chars": F.length(t).cast("double"),
            f"{prefix}upper": F.regexp_count(t, F.lit(r"\p{Lu}")).cast("double"),
            f"{prefix}digits": F.regexp_count(t, F.lit("[0-9]")).cast("double"),
            f"{prefix}signs": F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\s.,]")).cast("double"),
            f"{prefix}runs": F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\s.,]{2}")).cast("double"),
            f"{prefix}stops": (F.length(t) - F.length(F.replace(t, F.lit("."), F.lit("")))).cast("double"),
            f"{prefix}lines": (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))).cast("double"),
            f"{prefix}all": F.split(t, r"\s+"),
        }
    )
    made = made.withColumns(
        {
            f"{prefix}words": F.size(f"{prefix}all").cast("double"),
            f"{prefix}kinds": F.size(F.array_distinct(f"{prefix}all")).cast("double"),
        }
    ).drop(f"{prefix}all")
    c = {n: F.col(prefix + n) for n in ("chars", "upper", "digits", "signs", "runs", "stops", "lines", "words", "kinds")}
    chars, words = F.greatest(c["chars"], F.lit(1.0)), F.greatest(c["words"], F.lit(1.0))
    stats = {
        "f_chars": c["chars"],
        "f_words": c["words"],
        "f_upper": c["upper"] / chars,
        "f_digits": c["digits"] / chars,
        "f_signs": c["signs"] / chars,
        "f_runs": c["runs"] / words,
        "f_signs_per_word": c["signs"] / words,
        "f_upper_per_word": c["upper"] / words,
        "f_word_length": c["chars"] / words,
        "f_kinds": c["kinds"] / words,
        "f_repeats": c["words"] - c["kinds"],
        "f_kinds_root": c["kinds"] / F.sqrt(words),
        "f_sentence": c["words"] / (c["stops"] + 1.0),
        "f_lines": c["lines"] / words,
    }
    names = [prefix + n for n in stats]
    # Rows of one generated record: a filter on the score stops here and does not copy the counts.
    record = F.inline(F.array(F.struct(*[e.alias(prefix + n) for n, e in stats.items()])))
    return made.select(*docs.columns, record), names


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray], depth: int, rows: np.ndarray, path: Rule, rules: list[Rule], out: np.ndarray) -> None:
    """Grow one regression tree on binned statistics; every node below the root adds its path to ``rules``."""
    g, h = grad[rows].sum(), hess[rows].sum()
    out[rows] = -g / (h + 1.0)
    if depth == 0 or len(rows) < 20:
        return
    best = (1e-3, -1, 0)
    for f, cut in enumerate(cuts):
        bins = x[rows, f]
        gs = np.cumsum(np.bincount(bins, grad[rows], len(cut) + 1))[:-1]
        hs = np.cumsum(np.bincount(bins, hess[rows], len(cut) + 1))[:-1]
        gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g * g / (h + 1)
        gain[(hs < 1e-3) | (h - hs < 1e-3)] = 0
        if len(gain) and gain.max() > best[0]:
            best = (gain.max(), f, int(gain.argmax()))
    if best[1] < 0:
        return
    _, f, k = best
    above = x[rows, f] > k
    for side in (False, True):
        longer = (*path, (f, side, float(cuts[f][k])))
        rules.append(longer)
        _grow(x, grad, hess, cuts, depth - 1, rows[above == side], longer, rules, out)


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3) -> list[Rule]:
    """Distinct root paths of boosted trees, in the order of their first appearance."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 64))) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    rng, rules = np.random.default_rng(11), []
    score = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        rows = np.flatnonzero(rng.random(len(y)) < 0.6)
        step = np.zeros(len(y))
        if len(rows):
            found: list[Rule] = []
            _grow(binned, p - y, p * (1 - p), cuts, depth, rows, (), found, step)
            rules += found
        score += rate * step
    return list(dict.fromkeys(tuple(sorted(r)) for r in rules))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    """For which rows a rule holds."""
    return np.logical_and.reduce([(x[:, f] > t) if above else (x[:, f] <= t) for f, above, t in rule])


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 300) -> tuple[np.ndarray, float]:
    """L1-penalised logistic weights by accelerated proximal gradient; the intercept is free."""
    r = r.astype(np.float32)
    n, m = r.shape
    a = np.hstack([r, np.ones((n, 1), np.float32)])
    v = np.ones(m + 1) / np.sqrt(m + 1)
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= max(np.linalg.norm(v), 1e-12)
    step = 4.0 * n / max(float(v @ (a.T @ (a @ v))), 1e-12)
    w = z = np.zeros(m + 1)
    t = 1.0
    for _ in range(rounds):
        g = a.T @ (1 / (1 + np.exp(-(a @ z))) - y) / n
        new = z - step * g
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / after * (new - w), new, after
    return w[:-1], float(w[-1])


@dataclass
class RuleModel:
    """Weighted rules and an intercept; ``expression`` is the model as a Spark column."""

    rules: list[Rule]
    weights: list[float]
    intercept: float

    def expression(self, names: list[str]) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            parts = [F.col(names[f]) > F.lit(t) if above else F.col(names[f]) <= F.lit(t) for f, above, t in rule]
            both = parts[0]
            for p in parts[1:]:
                both = both & p
            total = total + F.when(both, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> RuleModel:
    """Rules and weights from a sample. Without both labels, or a rule that parts them, the score is the constant share (0.5 if empty)."""
    rules = tree_rules(x, y) if len(y) and y.min() < y.max() else []
    if not rules:
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.001, 0.999))
        return RuleModel([], [], float(np.log(share / (1 - share))))
    weights, intercept = lasso_logistic(np.stack([holds(r, x) for r in rules], axis=1), y, penalty)
    kept = np.flatnonzero(np.abs(weights) > 1e-6)
    return RuleModel([rules[k] for k in kept], [float(weights[k]) for k in kept], intercept)


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> RuleModel:
    """Train on at most ``sample`` labelled ids where ``learn`` (on the id) holds, chosen by a hash of the id.
    Where ids repeat, on at most twice as many of their rows, chosen by a hash of id and text.

    The chosen (id, label) rows are few by that bound, so they go to every task
    and texts stay where they are; only statistics of the sample reach the driver.
    Null labels and ids take no part.
    """
    known = labels.where(learn).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    known = known.where("_id is not null and _label is not null")
    chosen = known.orderBy(unit_hash("_id", seed=5), "_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    # Ids on several rows may bring more; those of the smallest hashes of id and text stay, whatever the order of the files.
    rows, names = statistics(texts.withColumn("_hash", unit_hash("_id", "_text", seed=6)), "_text")
    found = rows.orderBy("_hash", "_label").select("_label", *names).limit(2 * sample).toPandas()
    return fit(found[names].to_numpy(float).reshape(-1, len(names)), found["_label"].to_numpy(float))


def score(docs: DataFrame, model: RuleModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if the score reaches the threshold).

    No shuffle and no Python: statistics, rules and score are column expressions
    over the whole text. Null and empty texts are scored as empty texts. Columns
    named like the new ones are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    rows, names = statistics(docs.select(*kept), text_col)
    scored = rows.withColumn("score", model.expression(names))
    return scored.select(*kept, "score", (F.col("score") >= F.lit(threshold)).cast("int").alias("predicted"))
