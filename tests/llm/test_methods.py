"""The learned and drawn parts of the training-data operators against plain forms, and shared helpers."""

import itertools
import math
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomstat.llm import bpe, common, exact_dedup, language, near_dedup, packing, pii, quality, sharding, toxicity


def test_large_strings_give_the_same_sets():
    """64-bit offsets, as Spark sends them under large variable types."""
    texts = ["", "one two three four five six", "é " * 9, "a b"]
    plain, large = pa.array(texts), pa.array(texts, pa.large_string())
    for cut in (0, 1):
        want = [s.tolist() for s in near_dedup.shingle_sets(plain.slice(cut))]
        assert [s.tolist() for s in near_dedup.shingle_sets(large.slice(cut))] == want and any(want)
    ids = pa.array(range(4))
    assert [t.to_pylist() for _, t in common.text_chunks(ids, large, 5)] == [t.to_pylist() for _, t in common.text_chunks(ids, plain, 5)]


def test_filters_grow_with_the_values():
    assert common.filter_bits(0) == common.filter_bits(1000) == common.LEAST_BITS
    assert [common.filter_bits(n) for n in (1 << 20, (1 << 20) + 1, 10**12)] == [24, 25, common.MOST_BITS]


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_rows_part_at_a_filter(spark, n):
    rows = spark.range(20_000).select("id", F.col("id").alias("key"), F.lit(1).alias("filter_words"), F.lit(2).alias("_filter_block"))
    keys = spark.range(n).select((F.col("id") * 7).alias("key"))
    maybe, others = common.parted(rows, F.col("id"), keys)
    assert maybe.columns == others.columns == rows.columns
    inside = {r.id for r in maybe.collect()}
    assert {7 * k for k in range(n) if 7 * k < 20_000} <= inside and len(inside) <= min(n, 2858) + 1600
    assert inside | {r.id for r in others.collect()} == set(range(20_000)) and maybe.count() + others.count() == 20_000


def test_kept_texts_do_not_shuffle(spark):
    """Of many texts the two dropped ones go through a join; the plan exchanges rows behind the filter only."""
    rows = [(i, f"text number {i} " + "w " * 10, "x") for i in range(300)] + [(900, "text number 7 " + "w " * 10, "x"), (901, "text number 7 " + "w " * 10, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _copy string").repartition(3)
    kept = exact_dedup.without_copies(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(300) if i != 7] + [901]
    assert kept.columns == docs.columns


def test_near_copies_leave_by_id(spark):
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(1, base, "k"), (2, base + " more", "k"), (3, "something else entirely here now", "k"), (None, base, "k"), (4, None, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    assert sorted((r.doc_id for r in near_dedup.without_near_copies(docs).collect()), key=repr) == [1, 3, 4, None]


def test_hypergeometric_beyond_the_library():
    """The rejection draw, forced at small sizes, has the exact probabilities; at large sizes it keeps its bounds and moments."""
    rng = np.random.default_rng(1)
    for good, bad, n in ((5, 9, 6), (30, 4, 10), (12, 12, 12), (1, 50, 7)):
        draws = np.array([sharding.hypergeometric(rng, good, bad, n, limit=0) for _ in range(6000)])
        for k in range(max(0, n - bad), min(good, n) + 1):
            p = math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n)
            assert abs((draws == k).mean() - p) < 5 * math.sqrt(p * (1 - p) / 6000) + 1e-9
    good, bad, n = 3 * 10**9, 5 * 10**9, 10**6
    draws = np.array([sharding.hypergeometric(rng, good, bad, n) for _ in range(300)], float)
    mean, deviation = n * 3 / 8, math.sqrt(n * 3 / 8 * 5 / 8)
    assert abs(draws.mean() - mean) < 5 * deviation / math.sqrt(300) and 0.8 < draws.std() / deviation < 1.2
    assert sharding.hypergeometric(rng, 10**10, 0, 7) == 7 and sharding.hypergeometric(rng, 0, 10**10, 7) == 0
    assert sharding.hypergeometric(rng, 10**10, 5, 10**10 + 5) == 10**10


def test_sharding_matches_its_own_matrix(spark):
    """Plain form: partitions send what the matrix says, shards hold their exact size, slots are a permutation."""
    docs = spark.range(1000).repartition(6).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    got = sharding.shuffle_into_shards(docs, shards=7).collect()
    sizes = [sum(r.shard == s for r in got) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1 and sorted(r.doc_id for r in got) == list(range(1000))
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s])) for s in range(7))
    spread = [len({r.shard for r in got if r.doc_id % 50 == k}) for k in range(50)]
    assert min(spread) >= 5


def test_merges_take_the_lowest_rank_from_the_left():
    ranks = {(1, 1): (0 << 32, 2), (2, 2): (1 << 32, 3), (2, 1): (2 << 32, 4)}
    assert bpe.merge_word([1] * 7, ranks) == [3, 4]


def test_fullest_against_enumeration():
    rng = random.Random(3)
    for _ in range(150):
        counts = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        target = rng.randint(0, 40)
        sums = [sum(k * c for k, c in zip(counts, pick)) for pick in itertools.product(*[range(n + 1) for n in counts.values()])]
        got = packing.fullest(counts, target)
        assert sum(k * c for k, c in got) == max(s for s in sums if s <= target) and all(c <= counts[k] for k, c in got)


def test_rules_hold_in_spark_as_in_numpy(spark):
    """The compiled expression scores rows as the rules and weights do."""
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["word", "UP", "a1", "##", "x,", "y."], rng.integers(0, 30))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, names = quality.statistics(docs)
    table = rows.select("doc_id", *names).toPandas().sort_values("doc_id")
    x = table[names].to_numpy(float)
    y = (np.char.count(np.array(texts), "#") > 4).astype(float)
    model = quality.fit(x, y)
    assert model.rules
    total = model.intercept + sum(w * quality.holds(r, x) for r, w in zip(model.rules, model.weights))
    for rule in model.rules[:20]:
        plain = [all((row[f] > t) if above else (row[f] <= t) for f, above, t in rule) for row in x]
        assert quality.holds(rule, x).astype(bool).tolist() == plain
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert [got[i] for i in range(120)] == pytest.approx((1 / (1 + np.exp(-total))).tolist())


def test_non_negative_risk_learns_from_unlabelled_rows():
    """Features of the positive class win although a share of the unlabelled rows is positive too; the risk stays near the plain estimate."""
    rng = np.random.default_rng(5)
    prior, rows, positive, truth = 0.3, [], [], []
    for k in range(900):
        bad = k < 300 or rng.random() < prior
        rows.append(np.unique(np.append(rng.integers(2, 12, 4), rng.integers(0, 2) if bad else [])).astype(int))
        positive.append(k < 300)
        truth.append(bad)
    positive, truth = np.array(positive), np.array(truth)
    weights, intercept = toxicity.fit_nnpu(rows, positive, 12, prior, strength=0.0)
    g = np.array([intercept + weights[r].sum() for r in rows])
    assert ((g > 0) == truth)[300:].mean() > 0.97
    loss = lambda z: np.logaddexp(0, -z)
    negative = loss(-g[~positive]).mean() - prior * loss(-g[positive]).mean()
    assert prior * loss(g[positive]).mean() + max(0, negative) < 0.25 and negative > -0.1


def test_temperature_and_sparse_weights_of_language(spark):
    """Held-out accuracy and calibrated scores on three made-up languages."""
    rng = np.random.default_rng(6)
    parts = {"aa": ["th", "er", "ing"], "bb": ["sch", "ung", "ein"], "cc": ["eau", "ou", "ion"]}
    rows = [(i, " ".join("".join(rng.choice(parts[x], 3)) for _ in range(rng.integers(3, 30))), x) for i, x in enumerate(rng.choice(list(parts), 360))]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(table, F.col("doc_id") % 4 != 2)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(table.select("doc_id", "text"), model).collect()}
    held = [(got[i], x) for i, _, x in rows if i % 4 == 2]
    assert np.mean([p == x for (p, _), x in held]) > 0.97 and all(1 / 3 <= s <= 1 for (_, s), _ in held)
    assert np.mean([s for (_, s), _ in held]) > 0.8


def test_predictions_over_empty_tables(spark):
    """Models trained on rows, asked about none."""
    rows = spark.createDataFrame([(i, "good text here" if i % 2 else "bad ## text", "aa") for i in range(40)], "doc_id long, text string, lang string")
    marks = rows.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))
    everything, none = F.lit(True), rows.limit(0)
    assert quality.score(none, quality.train(rows, marks, everything)).count() == 0
    assert toxicity.score(none, toxicity.train(rows, marks, everything)).count() == 0
    assert language.predict(none.drop("lang"), language.train(rows, everything)).count() == 0


def test_columns_that_differ_by_case_only(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = spark.createDataFrame([(1, "mail a@b.org now", 7, 8, 9, 10, 11)], "doc_id long, text string, IDS int, Score int, PII int, Lang_Pred int, _pii_text int")
    coded = bpe.encode_and_decode(rows, path).first()
    assert coded.decoded == "mail a @ b . org now " or coded.ids
    found = pii.find_pii(rows).first()
    assert [(s.kind, s.start) for s in found.pii] == [("email", 5)] and found["_pii_text"] == 11
    assert toxicity.score(rows, toxicity.ToxicityModel({}, 0.0)).first()["score"] == 0.5
    assert quality.score(rows, quality.RuleModel([], [], 0.0)).columns.count("score") == 1
    trained = language.train(spark.createDataFrame([(1, "abc", "aa"), (2, "xyz", "bb")] * 9, "doc_id long, text string, lang string"), F.lit(True))
    assert language.predict(rows, trained).columns[-2:] == ["lang_pred", "score"]


def test_repeated_ids_give_one_model_whatever_the_order(spark):
    rows = [(i % 40, ("### " if i % 2 else "plain words ") * (3 + i), i % 2) for i in range(400)]
    marks = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    models = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame([r[:2] for r in order], "doc_id long, text string").repartition(3)
        models.append((quality.train(docs, marks, F.lit(True), sample=30), toxicity.train(docs, marks, F.lit(True), positives=12, unlabelled=30)))
    assert models[0][0] == models[1][0] and models[0][1] == models[1][1] and models[0][0].rules
    assert quality.train(docs.limit(0), marks, F.lit(True)).rules == [] == quality.train(docs, marks, F.lit(True), sample=2).rules


def test_the_score_decides_over_added_spans(spark):
    texts = [
        "number 123-45-6789 here", "my SSN is 123-45-6789 ok", "social security: 078-05-1120, and 666-12-3456, ssn 000-11-2222",
        "ssn 123-45-67890 and 9123-45-6789", "call +1 238 555 6608", "ssn 912-34-5678 then 123-00-4567",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.score) for s in r.pii] for r in pii.find_pii(docs).collect()}
    assert got[0] == got[3] == got[5] == []  # without context, or never given out
    assert [(k, a) for k, a, _ in got[1]] == [("ssn", 10)] and [(k, a) for k, a, _ in got[2]] == [("ssn", 17)]
    assert got[4][0][0] == "phone" and got[4][0][2] >= 0.5
    clean = [r.text for r in pii.redact(pii.find_pii(docs)).orderBy("doc_id").collect()]
    assert clean[0] == texts[0] and clean[1] == "my SSN is <SSN> ok"
