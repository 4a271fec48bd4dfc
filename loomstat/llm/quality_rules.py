"""Quality rules with risk-controlled thresholds.

Each rule compares one whole-number statistic of a text with a cutoff. The cutoffs
of a rule form a chain from lenient to strict. Labelled documents are the holdout:
within a stratum the good ones that a cutoff would reject are a binomial count, and
the cutoff is certified while the exact upper bound of their share stays below the
rule's part of the risk. A chain is tested in order and ends at its first failure
(fixed sequence, so its length costs nothing); the chains of all strata and rules
share the error by Bonferroni. With probability 1 - delta every stratum then loses
at most the share ``risk`` of its good documents to all rules together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat.llm.common import exact_columns
from loomstat.session import materialise

WORDS = 5
_BLANKS = b" \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


class Rule(NamedTuple):
    """Reject where floor(1000 * part / whole) lies above (or below) a cutoff; ``cutoffs`` go from lenient to strict."""

    name: str
    part: str
    whole: str | None
    above: bool
    cutoffs: tuple[int, ...]

    def value(self) -> Column:
        if self.whole is None:
            return F.col(self.part)
        return F.floor(F.lit(1000) * F.col(self.part) / F.greatest(self.whole, F.lit(1)))

    def rejects(self, cutoff: Column) -> Column:
        return F.coalesce(self.value() > cutoff if self.above else self.value() < cutoff, F.lit(False))

    def spared(self) -> Column:
        """How many cutoffs, from the most lenient on, do not reject the row."""
        return F.size(F.filter(F.array(*map(F.lit, self.cutoffs)), lambda c: ~self.rejects(c)))


RULES = (
    Rule("long_words", "word_chars", "n_words", True, tuple(range(20_000, 5_000, -250))),
    Rule("short_words", "word_chars", "n_words", False, tuple(range(1_000, 4_750, 250))),
    Rule("symbols", "n_symbols", "n_words", True, (3000, 2000, 1000, 750, 500, 400, 300, 250, 200, 150, 100, 50, 20, 10)),
    Rule("repeated_lines", "n_dup_lines", "n_lines", True, tuple(range(900, 0, -50))),
    Rule("repeated_words", "n_repeat_words", "n_words", True, tuple(range(195, 0, -10))),
    Rule("few_words", "n_words", None, False, tuple(range(11, 61))),
)


def _paired(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every pair as one whole number, equal for equal pairs only, and how often that number occurs."""
    _, codes, counts = np.unique(left * (right.max() + 1) + right, return_inverse=True, return_counts=True)
    return codes.astype(np.int64), counts


def repeated_words(words: list[bytes]) -> int:
    """Words inside five-word windows that occur twice or more, the first occurrence included."""
    n, codes = len(words), {}
    if n <= WORDS:
        return 0
    one = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n)
    if len(codes) == n:
        return 0
    two, _ = _paired(one[:-1], one[1:])
    four, counts = _paired(two[:-2], two[2:])
    if (counts == 1).all():
        return 0
    five, counts = _paired(four[:-1], one[4:])
    starts = np.flatnonzero(counts[five] > 1)
    edges = np.zeros(n + 1, np.int64)
    edges[starts] += 1
    edges[starts + WORDS] -= 1
    return int((np.cumsum(edges) > 0).sum())


def text_statistics(text: bytes) -> tuple[int, ...]:
    """The values of ``STATISTICS`` for one UTF-8 text."""
    words = text.split()  # at ASCII blanks, as these are bytes
    blanks = len(text) - len(text.translate(None, _BLANKS))
    seen, lines, again = set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            again += line in seen
            seen.add(line)
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    return len(words), len(text.decode()) - blanks, symbols, again, repeated_words(words), lines


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [text_statistics(text.as_py()) for text in batch.column(2)]
        columns = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * len(STATISTICS))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "stratum", *STATISTICS])


def measure(docs: DataFrame, id_col: str, stratum_col: str, text_col: str) -> DataFrame:
    """id, stratum and the statistics of every text (null: empty), plus ``base_failed``."""
    rows = exact_columns(docs, id_col, stratum_col, text_col).toDF("id", "stratum", "text")
    rows = rows.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    fields = [T.StructField(n, rows.schema[n].dataType) for n in ("id", "stratum")]
    measured = rows.mapInArrow(_measure, T.StructType(fields + [T.StructField(n, T.LongType()) for n in STATISTICS]))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measured.withColumn("base_failed", failed)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial count, summed from its k-th term downwards (k below n p) or from the next upwards."""
    if k >= n or p <= 0:
        return 1.0
    if k < 0 or p >= 1:
        return 0.0
    if k >= n * p:
        return 1.0 - binomial_tail(n - k - 1, n, 1.0 - p)
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total, i = 0.0, k
    while i >= 0 and term > total * 1e-17:
        total += term
        term *= i * (1 - p) / ((n - i + 1) * p)
        i -= 1
    return min(total, 1.0)


def upper_bound(k: int, n: int, level: float) -> float:
    """Clopper-Pearson: the largest share under which a count of k or less has probability ``level``."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if binomial_tail(k, n, middle) > level else (low, middle)
    return high


def choose(rule: Rule, good: np.ndarray, bad: np.ndarray, risk: float, level: float) -> tuple | None:
    """(cutoff, good rows, good rows rejected, bad rows rejected, bound) of one stratum, or None.

    ``good[i]`` and ``bad[i]`` count the rows that cutoff i is the first to reject;
    one more entry counts those that none rejects. Of the certified cutoffs the most
    lenient of those that reject most bad rows is taken.
    """
    n, best = int(good.sum()), None
    lost, caught = np.cumsum(good[:-1]), np.cumsum(bad[:-1])
    for cutoff, k, hits in zip(rule.cutoffs, lost.tolist(), caught.tolist()):
        if binomial_tail(k, n, risk) > level:
            break
        if hits > (best[3] if best else 0):
            best = cutoff, n, k, hits, upper_bound(k, n, level)
    return best


_CHOSEN = "rule string, cutoff long, n_good long, good_rejected long, bad_rejected long, bound double"


def choose_cutoffs(labelled: DataFrame, rules: tuple[Rule, ...] = RULES, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """stratum, rule, cutoff, n_good, good_rejected, bad_rejected, bound: the certified cutoffs.

    ``labelled`` has stratum, good (boolean) and the statistics. Every row counts; what
    reaches a task is a histogram of at most a few hundred cells per stratum, and
    only the number of strata reaches the driver. A rule has no row where no cutoff can
    be certified, as in a small stratum, or where none rejects a bad row.
    """
    first = [F.struct(F.lit(k).alias("rule"), r.spared().alias("first")) for k, r in enumerate(rules)]
    cells = labelled.select("stratum", "good", F.explode(F.array(*first)).alias("cell"))
    counts = cells.groupBy("stratum", "good", "cell.rule", "cell.first").agg(F.count("*").alias("n"))
    counts = materialise(counts, "rule-counts")
    strata = counts.select("stratum").distinct().count()
    level = delta / max(1, strata * len(rules))

    def select(cells: pa.Table) -> pa.Table:
        sums = [np.zeros((2, len(r.cutoffs) + 1), np.int64) for r in rules]
        for good, k, at, n in zip(*(cells.column(c).to_pylist() for c in ("good", "rule", "first", "n"))):
            sums[k][int(good), at] += n
        found = [(r, choose(r, s[1], s[0], risk / len(rules), level)) for r, s in zip(rules, sums)]
        rows = [(r.name, *f) for r, f in found if f]
        types = [pa.string(), *[pa.int64()] * 4, pa.float64()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, types)]
        stratum = cells.column("stratum").combine_chunks()
        names = ["stratum", "rule", "cutoff", "n_good", "good_rejected", "bad_rejected", "bound"]
        return pa.Table.from_arrays([stratum.take(pa.array([0] * len(rows), pa.int64())), *columns], names)

    kind = labelled.schema["stratum"].dataType.simpleString()
    return counts.groupBy("stratum").applyInArrow(select, f"stratum {kind}, {_CHOSEN}")


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    label_col: str = "quality",
    rules: tuple[Rule, ...] = RULES,
    risk: float = 0.02,
    delta: float = 0.05,
) -> DataFrame:
    """One row per document: id, the statistics, base_failed, kept, rejected_by.

    ``base_failed`` is fixed (fewer than ten words, or more than a fifth of them in
    repeated windows). The rules are certified on labelled documents that pass
    it and decide over the others; ``rejected_by`` names those that reject, in order.

    A null text is empty. A null stratum is a stratum; one without labelled rows, or with
    too few to certify anything, rejects nothing. A label of 1 is good, any other number
    bad, null no label; an id with several labels is good if all are. Labelled ids
    on several rows count each row, and every row is judged. A null id has no label.
    Other columns are ignored; an empty table gives no rows.

    Scale: one pass over the texts, whose statistics are written; all else moves a few
    numbers a document. The cutoffs are a table joined by stratum, without a hint.
    """
    measured = materialise(measure(docs, id_col, stratum_col, text_col), "text-statistics")
    marks = exact_columns(labels, id_col, label_col).toDF("id", "label").where("label is not null and id is not null")
    marks = marks.groupBy("id").agg(F.bool_and(F.col("label") == 1).alias("good"))
    cutoffs = choose_cutoffs(measured.where("not base_failed").join(marks, "id"), rules, risk, delta)
    limits = cutoffs.groupBy(F.col("stratum").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("limits"))
    limits = materialise(limits, "rule-limits")
    judged = measured.join(limits, F.col("stratum").eqNullSafe(F.col("of")), "left")
    named = [F.when(r.rejects(F.col("limits")[r.name]), F.lit(r.name)) for r in rules]
    rejected = F.when(F.col("base_failed"), F.lit("")).otherwise(F.concat_ws(",", *named))
    judged = judged.withColumn("rejected_by", rejected)
    return judged.select(
        F.col("id").alias(id_col), *STATISTICS[:-1], "base_failed", (~F.col("base_failed") & (F.col("rejected_by") == "")).alias("kept"), "rejected_by"
    )
