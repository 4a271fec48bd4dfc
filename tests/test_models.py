import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomstat.functions import stats, text as X
from loomstat.plans import bayes as B
from loomstat.plans import recommend as REC
from loomstat.plans import vectors as V
from loomstat.plans import years as Y

REVIEWS = [("POSITIVE", "Fantastic hotel, lovely staff! Fantastic."), ("NEGATIVE", "Very disappointing room, awful breakfast"), ("POSITIVE", "Great place")]


def test_reviews_are_classified(rows):
    model = B.word_category_counts(rows.of(REVIEWS, "label string, text string"), "text", "label")
    asked = rows.of([(1, "Fantastic hotel!"), (2, "Very disappointing…"), (3, "zzz"), (4, "")], "id int, text string")
    got = dict(rows.sorted(B.classify(model, asked, "id", "text", default="OTHER"), "id", "category"))
    assert got == {1: "POSITIVE", 2: "NEGATIVE", 3: "OTHER", 4: "OTHER"}
    plain = dict(rows.sorted(B.classify(model, asked, "id", "text"), "id", "category"))
    assert plain[3] is None


@pytest.mark.parametrize("size", ["tokens", "vocabulary"])
def test_naive_bayes_scores_by_hand(rows, size):
    model = rows.of([("a", "x", 3), ("b", "x", 1), ("a", "y", 1), ("c", "y", 5)], "word string, category string, count bigint")
    docs = rows.of([(1, "a a q c")], "id int, text string")
    v = {"tokens": 10, "vocabulary": 3}[size]
    counts = {"x": {"a": 3, "b": 1}, "y": {"a": 1, "c": 5}}
    want = {c: sum(math.log((counts[c].get(t, 0) + 1) / (sum(counts[c].values()) + v)) for t in "aaqc") for c in counts}
    got = {r["category"]: r["score"] for r in B.score(model, docs, "id", "text", size).collect()}
    assert got == pytest.approx(want)


def test_weighted_scores_by_hand(rows):
    model = rows.of([("x", "a", 2.0), ("x", "b", 1.0), ("y", "c", 4.0)], "label string, term string, weight double")
    vectors = rows.of([(1, "a", 1.5), (1, "c", 0.5), (2, "zzz", 1.0)], "id int, term string, weight double")
    w = {"x": {"a": 2.0, "b": 1.0}, "y": {"c": 4.0}}
    got = {(r["id"], r["label"]): r["score"] for r in B.score_weights(model, vectors, "id", 0.5).collect()}
    for doc, vec in ((1, {"a": 1.5, "c": 0.5}), (2, {"zzz": 1.0})):
        for label in w:
            want = sum(x * math.log((w[label].get(t, 0) + 0.5) / (sum(w[label].values()) + 0.5 * 3)) for t, x in vec.items())
            # Document 2 shares no term, so only the label of the greatest floor is returned.
            assert (doc, label) not in got if (doc, label) == (2, "y") else got[doc, label] == pytest.approx(want)
    with pytest.raises(ValueError):
        B.score_weights(model, vectors, "id", 0)


def test_model_validity(rows):
    model = rows.of([("x", "a", 2.0)], "label string, term string, weight double")
    assert B.validate_weights(model, 1.0).head()["valid"]
    assert not B.validate_weights(model.where("weight < 0"), 1.0).head()["valid"]
    with pytest.raises(ValueError):
        B.validate_weights(model, -1)


COUNTS = [("the", 1900, 50), ("The", 1900, 5), ("war", 1900, 3), ("the", 1950, 80), ("jet", 1950, 7), ("war", 1950, 9), ("jet", 2000, 1)]


def test_parse_and_clean(rows):
    lines = rows.of([("war_NOUN\t1900\t3\t2",), ("war_VERB\t1900\t4\t1",), ("bad\tx\t1",), ("short\t1",), ("a\t1901\t2",)], "value string")
    parsed = Y.parse_counts(lines)
    assert rows.sorted(parsed) == sorted([("war_NOUN", 1900, 3, 2), ("war_VERB", 1900, 4, 1), ("a", 1901, 2, None)], key=repr)
    assert rows.sorted(Y.clean_counts(parsed)) == sorted([("war", 1900, 7, 3), ("a", 1901, 2, None)], key=repr)
    odd = rows.of([(-3,), (2,), (5,)], "year int")
    assert rows.sorted(Y.odd_years(odd)) == [(-3,), (5,)]


def test_bm25_by_hand(rows):
    counts = rows.of(COUNTS, "word string, year int, count bigint")
    q = rows.of([("q", "THE war war")], "query_id string, text string")
    totals = Counter()
    for _, y, c in COUNTS:
        totals[y] += c
    avg, n = sum(totals.values()) / 3, 3
    with_ = Counter(w for w, _, _ in COUNTS)
    want = {y: 0.0 for y in totals}
    for w, y, c in COUNTS:
        if w.lower() in ("the", "war"):
            idf = (n - with_[w] + 0.5) / (with_[w] + 0.5)
            want[y] += idf * c * 2.5 / (c + 1.5 * (0.25 + 0.75 * totals[y] / avg))
    got = {r["year"]: r["score"] for r in Y.bm25(counts, q).collect()}
    want[None] = want.pop(2000)  # the complement row
    assert got == pytest.approx(want) and got[None] == 0
    ranked = Y.rank_years(Y.bm25(counts, q), F.col("score").desc()).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == [1, 2, 3] and ranked[-1]["year"] is None and ranked[-1]["n_years"] == 1


def test_year_naive_bayes_drops_years_without_words(rows):
    counts = rows.of(COUNTS, "word string, year int, count bigint")
    got = {r["year"]: r["score"] for r in Y.naive_bayes(counts, rows.of([("q", "the war")], "query_id string, text string")).collect()}
    want = {
        1900: math.log(51) + math.log(6) + math.log(4) - 3 * math.log(59),
        1950: math.log(81) + math.log(10) - 2 * math.log(97),
    }
    assert got == pytest.approx(want)


def test_nearest_matches_full_vectors(rows):
    counts = rows.of(COUNTS, "word string, year int, count bigint")
    q = rows.of([("q", "the, the war."), ("r", "nothing here")], "query_id string, text string")
    got = {(r["query_id"], r["year"]): r["distance"] for r in Y.nearest_years(counts, q).collect()}
    raw = {(r["query_id"], r["year"]): r["squared"] for r in Y.squared_distances(counts, q).collect()}
    rest = {(r["query_id"], r["year"], r["n_years"]) for r in Y.squared_distances(counts, q).collect() if not r["shared"]}
    for qid, vec in (("q", {"the": 2, "war": 1}), ("r", {"nothing": 1, "here": 1})):
        squared, unshared = {}, []
        for year in (1900, 1950, 2000):
            yv = {w: c for w, y, c in COUNTS if y == year}
            norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
            words = set(vec) | set(yv)
            want = math.sqrt(sum((vec.get(w, 0) / norm(vec) - yv.get(w, 0) / norm(yv)) ** 2 for w in words))
            assert got.get((qid, year), got.get((qid, None))) == pytest.approx(want, abs=1e-7)
            squared[year] = sum((vec.get(w, 0) - yv.get(w, 0)) ** 2 for w in words)
            if set(vec) & set(yv):
                assert raw[qid, year] == squared[year] and (qid, year) in got
            else:
                unshared.append((squared[year], year))
        if unshared:
            assert raw[qid, min(unshared)[1]] == min(unshared)[0] and (qid, min(unshared)[1], len(unshared)) in rest


def test_a_failing_scorer_does_not_stop_the_others(rows, tmp_path, monkeypatch):
    counts = rows.of(COUNTS, "word string, year int, count bigint")
    q = rows.of([("q", "the war")], "query_id string, text string")
    broken = lambda c, q: c.select(F.raise_error(F.lit("boom")).alias("query_id"))
    monkeypatch.setattr(Y, "naive_bayes", broken)
    outcome = Y.analyse_to(counts, q, str(tmp_path / "scores"))
    assert outcome["bm25"] is None and outcome["nearest"] is None and "boom" in outcome["naive_bayes"]


def test_shingles_and_parts(rows):
    df = rows.of([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    got = [r[0] for r in df.select(X.shingles(F.col("w"), 3)).collect()]
    assert got == [["a", "b", "c", "a b", "b c", "a b c"], ["a"], []]
    g = rows.of([("a b c",)], "g string").select(X.head_of(F.col("g")), X.tail_of(F.col("g"))).head()
    assert tuple(g) == ("a b", "c")


def test_collocations_by_hand(rows):
    docs = rows.of([(1, "new york is big"), (2, "new york is new"), (3, "york new is big")], "id int, text string")
    grams = {r["gram"]: r for r in V.gram_counts(docs, "id", "text").collect()}
    assert (grams["new york"]["n"], grams["new york"]["head_n"], grams["new york"]["tail_n"]) == (2, 3, 2)
    got = {r["gram"]: r["llr"] for r in V.collocations(V.gram_counts(docs, "id", "text"), 2, 0.5).collect()}
    h = lambda *k: sum(x * math.log(x) for x in k if x > 0)
    want = 2 * (h(2, 1, 0, 6) - h(3, 6) - h(2, 7) + h(9))
    assert got["new york"] == pytest.approx(want)
    assert "york new" not in got


def test_llr_of_independent_counts_is_zero(rows):
    df = rows.of([(10, 10, 10, 10)], "a int, b int, c int, d int")
    value = df.select(stats.log_likelihood_ratio(*[F.col(c) for c in "abcd"])).head()[0]
    assert value == pytest.approx(0, abs=1e-9)


def test_dictionary_and_vectors(rows):
    terms = rows.of([(1, "b"), (1, "a"), (1, "b"), (2, "zz"), (3, None)], "doc int, term string")
    known = V.dictionary(terms.where("term <> 'zz' OR term IS NULL"))
    assert rows.sorted(known) == [("a", 0), ("b", 1)]
    vectors = V.term_frequencies(terms, "doc", known, keep="term_id")
    assert rows.sorted(vectors) == [(1, "a", 0, 1), (1, "b", 1, 2)]
    assert V.empty_documents(terms.select("doc").distinct(), "doc", vectors).head()[0] == 2


def test_other_text_expressions(rows):
    row = rows.of([("Sun Jan 05 10:00:00 +0000 2014", "compute-1.example.org", "The cat's U.S. Hat, a HAT")], "t string, h string, x string")
    got = row.select(
        X.plain_date(X.tweet_time(F.col("t"))), X.short_host(F.col("h")), X.analyzed_tokens(F.col("x")),
        X.strip_pos(F.lit("run_VERB_x")), X.query_terms(F.lit("A b a")), X.normalise_word(F.lit("Ho-Tel!")),
    ).head()
    assert tuple(got) == ("2014-1-5", "compute-1", ["cat's", "u.s", "hat", "hat"], "run", ["a", "b"], "hotel")


def pearson(xs, ys):
    n = len(xs)
    if n < 2:
        return None
    mx, my = sum(xs) / n, sum(ys) / n
    sx, sy = sum((x - mx) ** 2 for x in xs), sum((y - my) ** 2 for y in ys)
    if sx < 1e-9 or sy < 1e-9:
        return None
    return sum((x - mx) * (y - my) for x, y in zip(xs, ys)) / math.sqrt(sx * sy)


@pytest.fixture(scope="module")
def ratings(spark):
    rng = random.Random(9)
    data = {(u, i): float(rng.randint(1, 5)) for u in range(12) for i in range(9) if rng.random() < 0.6}
    return data, spark.createDataFrame([(u, i, r) for (u, i), r in data.items()], "user bigint, item bigint, rating double")


def similarities(data):
    out = {}
    for a in range(12):
        for b in range(a + 1, 12):
            common = [i for i in range(9) if (a, i) in data and (b, i) in data]
            s = pearson([data[a, i] for i in common], [data[b, i] for i in common])
            if s is not None:
                out[a, b] = s
    return out


def test_pearson_against_brute_force(ratings):
    data, df = ratings
    got = {(r["a"], r["b"]): r["similarity"] for r in REC.user_similarity(df).collect()}
    assert got == pytest.approx(similarities(data))


def test_pearson_of_asked_users_and_of_large_offsets(ratings, spark):
    data, df = ratings
    sims = similarities(data)
    asked = spark.createDataFrame([(2,), (7,)], "user bigint")
    got = {(r["a"], r["b"]): r["similarity"] for r in REC.user_similarity(df, asked=asked).collect()}
    assert got == pytest.approx({(a, b): s for (x, y), s in sims.items() for a, b in ((x, y), (y, x)) if a in (2, 7)})
    far = df.withColumn("rating", F.col("rating") + F.col("user") * 1_000_000.0 + 10_000_000.0)
    moved = {(r["a"], r["b"]): r["similarity"] for r in REC.user_similarity(far).collect()}
    assert moved == pytest.approx(sims, abs=1e-6)


@pytest.mark.parametrize("heavy", [1024, 2])
def test_similarity_of_asked_items(ratings, spark, heavy):
    data, df = ratings
    every = {(r["a"], r["b"]): (r["n"], r["similarity"]) for r in REC.item_similarity(df).collect()}
    asked = spark.createDataFrame([(1,), (4,), (4,), (77,)], "item bigint")
    got = {(r["a"], r["b"]): (r["n"], r["similarity"]) for r in REC.item_similarity(df, asked=asked, heavy=heavy).collect()}
    assert got == {(a, b): v for (x, y), v in every.items() for a, b in ((x, y), (y, x)) if a in (1, 4)}


def test_recommendations_against_brute_force(ratings):
    data, df = ratings
    sims = similarities(data)
    got = {}
    for r in REC.recommend(REC.near_threshold(REC.user_similarity(df), 0.1), df, 2).collect():
        got[r["user"], r["rank"]] = (r["item"], round(r["estimate"], 9))
    want = {}
    for u in range(12):
        near = {v: sims[min(u, v), max(u, v)] for v in range(12) if sims.get((min(u, v), max(u, v)), 0) >= 0.1 and u != v}
        scored = []
        for i in range(9):
            have = [(s, data[v, i]) for v, s in near.items() if (v, i) in data]
            if (u, i) not in data and have:
                scored.append((-round(sum(s * r for s, r in have) / sum(s for s, _ in have), 9), i))
        for rank, (e, i) in enumerate(sorted(scored)[:2], 1):
            want[u, rank] = (i, -e)
    assert got == want


def test_item_similarity_against_brute_force(ratings):
    data, df = ratings
    got = {(r["a"], r["b"]): (r["n"], r["similarity"]) for r in REC.item_similarity(df).collect()}
    users = len({u for u, _ in data})
    h = lambda *k: sum(x * math.log(x) for x in k if x > 0)
    for (a, b), (n, s) in got.items():
        ra, rb = {u for u, i in data if i == a}, {u for u, i in data if i == b}
        k = [len(ra & rb), len(ra - rb), len(rb - ra), users - len(ra | rb)]
        g = max(2 * (h(*k) - h(k[0] + k[1], k[2] + k[3]) - h(k[0] + k[2], k[1] + k[3]) + h(sum(k))), 0)
        assert n == k[0] and s == pytest.approx(1 - 1 / (1 + g))


def test_nearest_n_and_split(ratings):
    data, df = ratings
    near = REC.near_n(REC.user_similarity(df), 3)
    assert max(r["count"] for r in near.groupBy("of").count().collect()) <= 3
    train, test = REC.split_ratings(df, 90, seed=4)
    assert train.count() + test.count() == len(data)
    again, _ = REC.split_ratings(df, 90, seed=4)
    assert train.exceptAll(again).count() == 0
    first = {(r["user"], r["item"]) for r in train.collect()}
    digest = lambda u, i: int(hashlib.md5(f"4:{u}:{i}".encode()).hexdigest()[:8], 16) % 100
    assert first == {(u, i) for u, i in data if digest(u, i) < 90}
    assert REC.evaluate(df, seeds=(1, 2), train_percent=70).count() == 2


def test_no_bound_on_years_and_labels(spark, rows):
    """Many years and labels: rows grow with the matches, the complement row stands for the rest."""
    n = 100_001
    ids = spark.range(n)
    counts = ids.select(F.when(F.col("id") < 1000, "war").otherwise("other").alias("word"), F.col("id").alias("year"), (F.col("id") + 1).alias("count"))
    q = rows.of([("q", "war"), ("r", "peace")], "query_id string, text string")
    for found in (Y.bm25(counts, q), Y.nearest_years(counts, q), Y.squared_distances(counts, q)):
        got = {r["query_id"]: (r["rows"], r["n"]) for r in found.groupBy("query_id").agg(F.count("*").alias("rows"), F.sum("n_years").alias("n")).collect()}
        assert got == {"q": (1001, n), "r": (1, n)}
        assert "Cartesian" not in found._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    model = ids.select(F.col("id").cast("string").alias("label"), F.when(F.col("id") < 5, "a").otherwise("b").alias("term"), (F.col("id") + 1.0).alias("weight"))
    vectors = rows.of([(1, "a", 1.0), (2, "zz", 1.0)], "id int, term string, weight double")
    scores = B.score_weights(model, vectors, "id")
    assert {(r["id"], r["label"], r["matched"]) for r in scores.collect()} == {(1, str(k), True) for k in range(5)} | {(2, "0", False)}


def test_the_constant_of_other_years_ranks_between_matched_scores(rows):
    counts = [("the", 1, 5), ("the", 2, 9), ("the", 3, 1), ("war", 3, 4), ("sea", 4, 2), ("air", 5, 2)]
    q = rows.of([("q", "the war"), ("n", "nothing")], "query_id string, text string")
    scores = Y.bm25(rows.of(counts, "word string, year int, count bigint"), q, log_idf=True).withColumn("score", F.round("score", 6))
    got = [(r["query_id"], r["year"], r["rank"], r["n_years"]) for r in Y.rank_years(scores, F.col("score").desc()).orderBy("query_id", "rank").collect()]
    # "the" is in three of five years, so its weight is below zero; years 4 and 5 share no word.
    assert [g for g in got if g[0] == "n"] == [("n", None, 1, 5)]
    mine = [g[1:] for g in got if g[0] == "q"]
    assert mine[0][0] == 3 and mine[1] == (None, 2, 2) and [m[1] for m in mine[2:]] == [4, 5] and {m[0] for m in mine[2:]} == {1, 2}


def test_best_label_matches_the_full_grid(rows):
    rng = random.Random(3)
    model = [(f"l{k}", t, round(rng.random() * 9, 2)) for k in range(9) for t in "abcdefgh" if rng.random() < 0.3]
    vectors = [(d, t, round(rng.random(), 2)) for d in range(40) for t in rng.sample("abcdefghxyz", rng.randint(1, 4))]
    m, v = rows.of(model, "label string, term string, weight double"), rows.of(vectors, "id int, term string, weight double")
    terms, labels = {t for _, t, _ in model}, sorted({x for x, _, _ in model})
    weight = {x: sum(w for y, _, w in model if y == x) for x in labels}
    of = {(x, t): w for x, t, w in model}
    want = {}
    for d in range(40):
        score = {x: sum(w * math.log((of.get((x, t), 0) + 1) / (weight[x] + len(terms))) for e, t, w in vectors if e == d) for x in labels}
        want[d] = min(labels, key=lambda x: (-round(score[x], 9), x))
    assert {r["id"]: r["predicted"] for r in B.best_label(B.score_weights(m, v, "id"), "id").collect()} == want
    with pytest.raises(Exception, match="negative"):
        B.score_weights(m, rows.of([(1, "a", -1.0)], "id int, term string, weight double"), "id").collect()


def test_whole_grids_of_years_and_labels(rows):
    """With ``whole`` every year and label has its own row, also where nothing is shared."""
    counts = rows.of([("a", "y1", 2), ("b", "y2", 1), ("c", "y3", 5)], "word string, year string, count bigint")
    queries = rows.of([(1, "a"), (2, "zzz")], "query_id bigint, text string")
    ranked = Y.rank_years(Y.bm25(counts, queries, whole=True), F.col("score").desc())
    assert rows.sorted(ranked, "query_id", "year", "rank") == [(1, f"y{k}", k) for k in (1, 2, 3)] + [(2, f"y{k}", k) for k in (1, 2, 3)]
    assert Y.nearest_years(counts, queries, whole=True).count() == 6
    assert rows.sorted(Y.squared_distances(counts, queries, whole=True)) == sorted(
        [(1, "y1", 1, True), (1, "y2", 2, False), (1, "y3", 26, False), (2, "y1", 5, False), (2, "y2", 2, False), (2, "y3", 26, False)], key=repr
    )
    model = rows.of([("p", "a", 1.0), ("q", "b", 2.0), ("r", "c", 3.0)], "label string, term string, weight double")
    vectors = rows.of([(1, "a", 1.0), (2, "b", 1.0)], "doc bigint, term string, weight double")
    scores = B.score_weights(model, vectors, "doc", whole=True)
    assert rows.sorted(scores, "doc", "label", "matched") == sorted([(d, x, (d, x) in ((1, "p"), (2, "q"))) for d in (1, 2) for x in "pqr"], key=repr)


def test_seen_items_are_marked_in_their_cell(rows):
    """Recommendations leave out what a user rated without a join against the ratings."""
    df = rows.of([(1, 1, 5.0), (1, 2, 3.0), (2, 1, 4.0), (2, 2, 2.0), (2, 3, 1.0)], "user bigint, item bigint, rating double")
    near = rows.of([(1, 2, 0.5)], "of bigint, other bigint, similarity double")
    out = REC.recommend(near, df, 3)
    assert rows.sorted(out, "user", "item", "estimate", "rank") == [(1, 3, 1.0, 1)]
    assert "LeftAnti" not in out._jdf.queryExecution().optimizedPlan().toString()
    pairs = rows.of([(1, 3, 0.5), (2, 3, 0.5), (1, 2, 0.5)], "a bigint, b bigint, similarity double")
    assert rows.sorted(REC.recommend_by_items(df, pairs, 2), "user", "item", "estimate", "rank") == [(1, 3, 4.0, 1)]


@pytest.mark.parametrize("asked", [None, [3, 7]])
def test_only_the_nearest_leave_a_cell(ratings, spark, asked):
    """The cells drop what cannot be among the n nearest, and the n nearest are the same; pairs of all sums took a sort of all pairs."""
    data, df = ratings
    users = None if asked is None else spark.createDataFrame([(u,) for u in asked], "user bigint")
    pairs = REC.user_similarity(df, asked=users, nearest=2)
    sims = similarities(data)
    best = lambda u: sorted((-round(s, 12), y if x == u else x) for (x, y), s in sims.items() if u in (x, y))[:2]
    got = {}
    for r in REC.near_n(pairs, 2).collect():
        got.setdefault(r["of"], []).append((-round(r["similarity"], 12), r["other"]))
    assert {u: sorted(v) for u, v in got.items()} == {u: best(u) for u in asked or range(12) if best(u)}
    assert pairs.count() <= 2 * pairs.rdd.getNumPartitions() * len(asked or range(12))
    whole = REC.near_n(REC.user_similarity(df, asked=users), 2, asked=asked is not None)
    assert {(r["of"], r["other"]) for r in whole.collect()} == {(u, o) for u, v in got.items() for _, o in v}


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_words_of_a_document_are_counted_without_a_shuffle_of_words(rows):
    from loomstat.session import by_document

    docs = rows.of([(1, "b bb bb"), (2, "bb c"), (1, "bb"), (None, "c c"), (3, None)], "doc bigint, text string")
    tf = V.term_frequencies(V.analyzed_grams(by_document(docs, "doc", "text"), "doc", "text"), "doc")
    assert _shuffles(tf) == 1  # the texts
    assert rows.sorted(tf, "doc", "term", "tf") == sorted([(1, "b", 1), (1, "bb", 3), (2, "bb", 1), (2, "c", 1), (None, "c", 2)], key=repr)


def test_gram_totals_match_all_shingles(rows):
    texts = ["x y z x y", "x y", "x", "", None, "x y z", "z z z z", "x y"]
    docs = rows.of([(k % 5, t) for k, t in enumerate(texts)], "doc int, text string")
    for n_max, n_min in ((2, 2), (3, 2), (3, 1), (4, 3)):
        want = Counter(" ".join(w[i : i + k]) for w in ((t or "").split() for t in texts) for k in range(n_min, n_max + 1) for i in range(len(w) - k + 1))
        totals = V.gram_totals(docs, "doc", "text", n_max, n_min)
        assert dict(rows.sorted(totals, "gram", "n")) == want
        assert _shuffles(totals) == 1


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_join_terms_of_frequent_and_rare_terms(rows, most):
    data = [(k, t) for k in range(6) for t in "aaab"[: k + 1]] + [(7, "rare"), (8, None), (9, "unknown")]
    table = [("a", "x"), ("a", "y"), ("b", "x"), ("rare", "z"), (None, "n"), ("other", "o")]
    left, right = rows.of(data, "doc int, term string"), rows.of(table, "term string, label string")
    got = V.join_terms(left, right, V.document_frequencies(left), most)
    assert rows.sorted(got, "doc", "term", "label") == sorted([(d, t, y) for d, t in data for u, y in table if t is not None and t == u], key=repr)


def _joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("CartesianProduct")]
    return sum(above.count(x) for x in ("SortMergeJoin", "HashJoin", "Window"))


@pytest.mark.parametrize("asked", [None, [3, 7, 11]])
def test_pairs_leave_their_cells_finished(ratings, spark, asked, monkeypatch):
    """However many blocks there are, of each user exactly the nearest leave the tasks, and counts of items meet no join."""
    from loomstat.operators import pairs

    monkeypatch.setattr(pairs, "ENTRIES", 10)
    data, df = ratings
    users = None if asked is None else spark.createDataFrame([(u,) for u in asked], "user bigint")
    near = REC.user_similarity(df, asked=users, nearest=2)
    sims = similarities(data)
    best = lambda u: [o for _, o in sorted((-round(s, 12), y if x == u else x) for (x, y), s in sims.items() if u in (x, y))[:2]]
    got = {}
    for r in sorted(near.collect(), key=lambda r: r["place"]):
        got.setdefault(r["a"], []).append(r["b"])
    assert got == {u: best(u) for u in asked or range(12) if best(u)}
    out = REC.recommend(REC.near_n(near, 2), df, 2)
    assert _joins(near) == _joins(REC.near_n(near, 2)) == _joins(out) == 0
    items = REC.item_similarity(df, asked=None if asked is None else spark.createDataFrame([(1,), (4,)], "item bigint"))
    assert _joins(items) == 0
    assert {(r["user"], r["rank"]) for r in out.collect()} <= {(u, k) for u in got for k in (1, 2)}
    for r in items.collect():
        assert r["n"] == sum((u, r["a"]) in data and (u, r["b"]) in data for u in range(12))


def test_hold_out_sums_stay_in_their_cells(spark, monkeypatch):
    """Each held-out rating adds up its near raters block by block; pairs of users met a join and a shuffle of test rows with all raters."""
    from loomstat.operators import pairs

    monkeypatch.setattr(pairs, "ENTRIES", 16)
    rng = random.Random(12)
    some = {(u, i): rng.choice([None, 1.0, 2.0, 3.0, 4.0, 5.0, 5.5]) for u in [*range(14), None] for i in [*range(10), None] if rng.random() < 0.75}
    held = {k for k in some if rng.random() < 0.25} | {(99, 1)}
    some[99, 1] = 3.0
    of = lambda keys: spark.createDataFrame([(u, i, some[u, i]) for u, i in keys], "user bigint, item bigint, rating double")
    train = {k: v for k, v in some.items() if k not in held}
    sims = {}
    for a in range(14):
        for b in range(14):
            common = [i for i in [*range(10), None] if a != b and train.get((a, i)) is not None and train.get((b, i)) is not None]
            sims[a, b] = pearson([train[a, i] for i in common], [train[b, i] for i in common])
    errors = []
    for u, i in held:
        raters = [(sims[u, v], train[v, i]) for v in range(14) if u is not None and u != 99 and i is not None and (v, i) in train and (sims[u, v] or 0) >= 0.1]
        weight, known = sum(s for s, _ in raters), [(s, x) for s, x in raters if x is not None]
        if known and some[u, i] is not None:
            errors.append(abs(sum(s * x for s, x in known) / weight - some[u, i]))
    out = REC.holdout_error(of(train), of(held), 0.1)
    got = out.head()
    assert got["n"] == len(errors) > 5 and got["mae"] == pytest.approx(sum(errors) / len(errors))
    above = out._jdf.queryExecution().executedPlan().toString()
    assert above[: above.index("CartesianProduct")].count("Join") == 0
