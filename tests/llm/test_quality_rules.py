"""Quality rules against plain Python: statistics, binomial bounds, certified cutoffs."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, Text string, id string, stratum string, limits string, kept string"


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = {g for g in grams if grams.count(g) > 1} if len(grams) < 400 else {g for g in set(grams) if grams.index(g) != len(grams) - 1 - grams[::-1].index(g)}
    covered = {i + k for i, g in enumerate(grams) if g in often for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines)


def texts():
    rng = random.Random(7)
    out = [None, "", " \n\t ", "a", "one two three four five", "a b c d e a b c d e", "a a a a a a", "x y\r\nx y\r\n\nx y", "naïve 漢字 ### <b> 🙂\x1f\x0b|"]
    out += ["la " * 50, "w" * 5_000, " ".join(f"w{i % 700}" for i in range(1_500)), "\n".join(["same line here"] * 5 + ["other"])]
    for _ in range(150):
        words = rng.choices(["a", "bb", "ccc", "#", "$$", "é", "ok\n", "\n", "long" * rng.randint(1, 9)], k=rng.randint(0, 40))
        out.append("".join(w + rng.choice([" ", "  ", "\t", "\n", "\v"]) for w in words))
    return out


def test_statistics_match_plain_python():
    for text in texts():
        assert Q.text_statistics((text or "").encode()) == plain(text), text


def exact_tail(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


@pytest.mark.parametrize("n", [1, 7, 60, 400])
def test_binomial_tail_and_upper_bound(n):
    for k in sorted({0, 1, n // 9, n // 3, n - 1}):
        for p in (0.001, 0.05, 0.4, 0.9):
            assert Q.binomial_tail(k, n, p) == pytest.approx(exact_tail(k, n, p), rel=1e-9, abs=1e-12)
        bound = Q.upper_bound(k, n, 0.01)
        assert bound == 1.0 if k >= n else exact_tail(k, n, bound) == pytest.approx(0.01, rel=1e-6)


def test_a_chain_ends_at_its_first_failure_and_prefers_lenient_cutoffs():
    rule = Q.Rule("r", "n_symbols", "n_words", True, (50, 40, 30, 20, 10))
    good, bad = np.array([0, 1, 0, 300, 0, 700]), np.array([3, 2, 0, 5, 9, 1])
    # 20 loses 301 of 1001 good rows: not certified, and 10 after it is not tested.
    assert Q.choose(rule, good, bad, 0.05, 0.01)[:4] == (40, 1001, 1, 5)
    assert Q.choose(rule, good, 0 * bad, 0.05, 0.01) is None
    assert Q.choose(rule, good // 100, bad, 0.05, 0.01) is None  # too few rows


def corpus():
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(3_000):
        lang = rng.choice(["en", "en", "en", "fr", None])
        bad = rng.random() < 0.3
        words = [f"w{rng.randint(0, 999)}" for _ in range(rng.randint(11, 40))]
        if bad:
            words = [w + "##" if rng.random() < 0.7 else w for w in words]
        rows.append((i, " ".join(words), lang, "T", "i", "s", "l", "k"))
        if i % 4:
            labels.append((i, 0 if bad else 1))
    rows += [(3_000, "ab $$$ " * 4 + "x y z w", "xx", "T", "i", "s", "l", "k"), (None, rows[0][1], "en", "T", "i", "s", "l", "k"), rows[5], rows[5]]
    rows += [(4_000 + k, t, "en", "T", "i", "s", "l", "k") for k, t in enumerate(texts())]
    return rows, labels + [(8, None), (8, 1), (9, 0), (9, 1), (None, 1)]


def test_certified_cutoffs_and_verdicts_match_plain_python(spark):
    rows, labels = corpus()
    risk, delta = 0.1, 0.05
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {}
    for r in Q.quality_rules(docs, marks, risk=risk, delta=delta).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    good = {}
    for i, q in labels:
        if i is not None and q is not None:
            good[i] = good.get(i, True) and q == 1

    def values(s):
        n, chars, symbols, dup, rep, lines = s
        return {
            "long_words": 1000 * chars // max(n, 1), "short_words": 1000 * chars // max(n, 1), "symbols": 1000 * symbols // max(n, 1),
            "repeated_lines": 1000 * dup // max(lines, 1), "repeated_words": 1000 * rep // max(n, 1), "few_words": n,
        }

    stats = [(i, lang, plain(t)) for i, t, lang, *_ in rows]
    failed = [s[0] < 10 or 100 * s[4] > 20 * s[0] for _, _, s in stats]
    held = [(lang, good[i], values(s)) for (i, lang, s), f in zip(stats, failed) if i in good and not f]
    level = delta / (len({lang for lang, _, _ in held}) * len(Q.RULES))
    cutoffs = {}
    for lang in {lang for lang, _, _ in held}:
        for rule in Q.RULES:
            mine = [(g, v[rule.name]) for at, g, v in held if at == lang]
            n, best = sum(g for g, _ in mine), 0
            for c in rule.cutoffs:
                out = [g for g, v in mine if (v > c if rule.above else v < c)]
                if exact_tail(sum(out), n, risk / len(Q.RULES)) > level:
                    break
                if len(out) - sum(out) > best:
                    best, cutoffs[lang, rule.name] = len(out) - sum(out), c
    want = {}
    for (i, lang, s), f in zip(stats, failed):
        v = values(s)
        names = [r.name for r in Q.RULES if (c := cutoffs.get((lang, r.name))) is not None and (v[r.name] > c if r.above else v[r.name] < c)]
        want.setdefault(i, []).append((*s[:5], f, not f and not names, "" if f else ",".join(names)))
    assert any(r[-1] for group in want.values() for r in group)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_the_promise_holds_on_fresh_documents(spark):
    """Certified on one half, the share of good documents lost on the other stays below the risk in every stratum."""
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, quality int").where("quality is not null")
    out = Q.quality_rules(docs, marks.where("doc_id % 2 = 1"), risk=0.1).join(marks.where("doc_id % 2 = 0 and quality = 1"), "doc_id")
    out = out.join(docs.select("doc_id", "lang"), "doc_id").where("not base_failed").groupBy("lang").agg(F.avg((~F.col("kept")).cast("int")).alias("lost"))
    assert all(r.lost <= 0.1 for r in out.collect())


def test_empty_tables_and_no_labels(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int")
    assert Q.quality_rules(docs, labels).collect() == []
    one = spark.createDataFrame([(1, "a b c d e f g h i $$$$", "en", "T", "i", "s", "l", "k")], SCHEMA)
    assert [tuple(r) for r in Q.quality_rules(one, labels).collect()] == [(1, 10, 13, 4, 0, 0, False, True, "")]
