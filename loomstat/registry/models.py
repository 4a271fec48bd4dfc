"""Text model, classifier and recommender queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstat.operators import ranking as R
from loomstat.plans import bayes as B
from loomstat.plans import recommend as REC
from loomstat.plans import vectors as V
from loomstat.plans import years as Y
from loomstat.registry.base import (
    COUNTS, RATINGS, TOKENS, documents, phrases, query, ratings_table, table, token_rows, year_counts, year_table,
)
from loomstat.registry.rows import ANALYZED, PHRASE_VECTORS
from loomstat.session import materialise


def labelled(spark, d):
    docs, labels = documents(spark, d), table(spark, d, "labels")
    return docs.select("doc_id", "text").join(labels.select("doc_id", F.col("quality").cast("string").alias("category")), "doc_id")


NORMAL = f"""
{TOKENS}, nw AS (SELECT * FROM (SELECT doc_id, lower(regexp_replace(word, '[[:punct:]]', '', 'g')) AS word FROM tok) WHERE word <> ''),
model AS (SELECT word, CAST(quality AS VARCHAR) AS category, count(*) AS count FROM nw JOIN labels USING (doc_id) GROUP BY ALL)
"""


@query("M01_naive_bayes_model", f"WITH {NORMAL} SELECT * FROM model")
def nb_model(spark, d):
    return B.merge_counts(B.word_category_counts(labelled(spark, d), "text", "category"))


NB_SCORES = f"""
{NORMAL}, v AS (SELECT sum(count) AS v FROM model), tot AS (SELECT category, sum(count) AS t FROM model GROUP BY category),
dw AS (SELECT doc_id, word, count(*) AS m FROM nw GROUP BY ALL), len AS (SELECT doc_id, sum(m) AS n FROM dw GROUP BY doc_id),
sc AS (SELECT doc_id, category, sum(m * ln(count + 1)) AS s FROM dw JOIN model USING (word) GROUP BY ALL),
fin AS (SELECT doc_id, category, s - n * ln(t + (SELECT v FROM v)) AS score FROM sc JOIN len USING (doc_id) JOIN tot USING (category)),
best AS (SELECT doc_id, category, score FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, category) AS rn FROM fin) WHERE rn = 1)
"""


@query(
    "M02_naive_bayes_classify",
    f"WITH {NB_SCORES} SELECT doc_id, category, round(score, 6) AS score FROM documents LEFT JOIN best USING (doc_id)",
)
def nb_classify(spark, d):
    model = materialise(B.word_category_counts(labelled(spark, d), "text", "category"), "bayes")
    return B.classify(model, documents(spark, d), "doc_id", "text").withColumn("score", F.round("score", 6))


@query(
    "M03_year_model",
    f"WITH {COUNTS} SELECT year, count(*) AS unique_words, CAST(sum(count) AS BIGINT) AS total_words FROM counts GROUP BY year",
)
def year_model(spark, d):
    """Lines of counts are parsed back, filtered and totalled per year."""
    c = year_counts(spark, d)
    number = F.regexp_extract("year", r"(\d+)", 1)
    lines = c.select(F.concat_ws("\t", "word", number, "count").alias("value"))
    totals = Y.year_totals(Y.parse_counts(lines))
    return totals.select(F.concat(F.lit("src"), "year").alias("year"), "unique_words", "total_words")


PHRASES = f"""
{COUNTS}, totals AS (SELECT year, sum(count) AS total FROM counts GROUP BY year),
terms AS (SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id, unnest(string_split(lower(text), ' ')) AS term FROM benchmark) WHERE term <> ''),
hit AS (SELECT query_id, word, year, count FROM counts JOIN terms ON lower(word) = term)
"""


@query(
    "M04_year_naive_bayes",
    f"""
    WITH {PHRASES} SELECT query_id, year, round(sum(ln(count + 1)) - count(*) * ln(total + 1), 6) AS score
    FROM hit JOIN totals USING (year) GROUP BY query_id, year, total
    """,
)
def year_nb(spark, d):
    return Y.naive_bayes(year_table(spark, d), phrases(spark, d)).withColumn("score", F.round("score", 6))


@query(
    "M05_bm25_model",
    f"""
    WITH {COUNTS}, n AS (SELECT count(DISTINCT year) AS n FROM counts)
    SELECT word, round(((SELECT n FROM n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE), 9) AS idf FROM counts GROUP BY word
    """,
)
def bm25_model(spark, d):
    return Y.idf_model(year_table(spark, d)).withColumn("idf", F.round("idf", 9))


BM25 = f"""
{PHRASES}, n AS (SELECT count(*) AS n, avg(total) AS a FROM totals),
idf AS (SELECT word, ((SELECT n FROM n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) AS idf FROM counts GROUP BY word),
sc AS (SELECT query_id, year, sum(idf * count * 2.5::DOUBLE / (count + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * total / (SELECT a FROM n)))) AS s
  FROM hit JOIN idf USING (word) JOIN totals USING (year) GROUP BY ALL),
bm AS (SELECT item_id AS query_id, t.year, coalesce(s, 0) AS score FROM benchmark CROSS JOIN totals t LEFT JOIN sc ON sc.query_id = item_id AND sc.year = t.year)
"""


@query(
    "M05_bm25_scores_ranked",
    f"""
    WITH {BM25} SELECT query_id, year, round(score, 6) AS score, CAST(row_number() OVER (
      PARTITION BY query_id ORDER BY round(score, 6) DESC, year) AS INTEGER) AS rank FROM bm
    """,
)
def bm25_scores(spark, d):
    scores = Y.bm25(year_table(spark, d), phrases(spark, d), whole=True).withColumn("score", F.round("score", 6))
    return Y.rank_years(scores, F.col("score").desc())


@query(
    "M05_bm25_log_idf",
    f"""
    WITH {PHRASES}, n AS (SELECT count(*) AS n, avg(total) AS a FROM totals),
    idf AS (SELECT word, ln(((SELECT n FROM n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM counts GROUP BY word),
    sc AS (SELECT query_id, year, sum(idf * count * 2.2::DOUBLE / (count + 1.2::DOUBLE * (0.5::DOUBLE + 0.5::DOUBLE * total / (SELECT a FROM n)))) AS s
      FROM hit JOIN idf USING (word) JOIN totals USING (year) GROUP BY ALL),
    bm AS (SELECT item_id AS query_id, t.year, coalesce(s, 0) AS score FROM benchmark CROSS JOIN totals t LEFT JOIN sc ON sc.query_id = item_id AND sc.year = t.year)
    SELECT query_id, year, round(score, 6) AS score, CAST(row_number() OVER (
      PARTITION BY query_id ORDER BY round(score, 6) DESC, year) AS INTEGER) AS rank FROM bm
    """,
)
def bm25_log(spark, d):
    """Words of most years have a negative weight here, so the 0 of all other years may stand between matched scores."""
    scores = Y.bm25(year_table(spark, d), phrases(spark, d), k1=1.2, b=0.5, log_idf=True, whole=True).withColumn("score", F.round("score", 6))
    return Y.rank_years(scores, F.col("score").desc())


NEAREST = f"""
{COUNTS}, {PHRASE_VECTORS}, norm AS (SELECT year, sqrt(sum(count * count)) AS n FROM counts GROUP BY year),
ql AS (SELECT query_id, sqrt(sum(q * q)) AS n FROM pv GROUP BY query_id),
dot AS (SELECT query_id, year, sum(q * count) AS dt FROM pv JOIN counts USING (word) GROUP BY ALL),
near AS (SELECT ql.query_id, norm.year, sqrt(greatest(2 - 2 * coalesce(dt, 0) / (ql.n * norm.n), 0)) AS distance
  FROM ql CROSS JOIN norm LEFT JOIN dot ON dot.query_id = ql.query_id AND dot.year = norm.year)
"""


@query("M06_nearest_years", f"WITH {NEAREST} SELECT query_id, year, round(distance, 7) AS distance FROM near")
def nearest(spark, d):
    return Y.nearest_years(year_table(spark, d), phrases(spark, d), whole=True).withColumn("distance", F.round("distance", 7))


@query(
    "M07_dictionary",
    f"WITH {TOKENS} SELECT word AS term, row_number() OVER (ORDER BY word) - 1 AS term_id FROM (SELECT DISTINCT word FROM tok)",
)
def dictionary(spark, d):
    return V.dictionary(token_rows(spark, d), "word")


BENCHMARK_WORDS = "dict AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS term_id FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM benchmark) WHERE word <> '')"


def _benchmark_words(spark, d):
    """A dictionary of another table: many of its words are in no document, and some documents have none of them."""
    return V.dictionary(table(spark, d, "benchmark").select(F.explode(F.split("text", " ")).alias("term")).where("term <> ''"))


@query("M08_term_frequencies", f"WITH {TOKENS}, {BENCHMARK_WORDS} SELECT doc_id, word AS term, term_id, count(*) AS tf FROM tok JOIN dict USING (word) GROUP BY ALL")
def term_frequencies(spark, d):
    terms = token_rows(spark, d).withColumnRenamed("word", "term")
    return V.term_frequencies(terms, "doc_id", _benchmark_words(spark, d), keep="term_id")


@query(
    "M08_empty_vectors",
    f"WITH {TOKENS}, {BENCHMARK_WORDS} SELECT count(*) AS empty_vectors FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM tok JOIN dict USING (word))",
)
def empty_vectors(spark, d):
    terms = token_rows(spark, d).withColumnRenamed("word", "term")
    vectors = V.term_frequencies(terms, "doc_id", _benchmark_words(spark, d))
    return V.empty_documents(documents(spark, d), "doc_id", vectors)


TFIDF = f"""
{ANALYZED}, tf AS (SELECT doc_id, term, count(*) AS tf FROM an GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT doc_id, term, sqrt(tf) * (ln((SELECT count(*) FROM documents) / (df + 1.0::DOUBLE)) + 1) AS weight FROM tf JOIN df USING (term))
"""


@query("M09_tf_idf", f"WITH {TFIDF} SELECT doc_id, term, round(weight, 6) AS weight FROM w")
def tf_idf(spark, d):
    return B.weighted_documents(documents(spark, d), "doc_id", "text").withColumn("weight", F.round("weight", 6))


def weighted_sql(labelled: str, scored: str = "w") -> str:
    """Model, scores and best label: ``labelled`` (doc_id, label) trains, the vectors of ``scored`` are scored."""
    return f"""
{TFIDF}, la AS ({labelled}), wm AS (SELECT label, term, sum(weight) AS mw FROM w JOIN la USING (doc_id) GROUP BY ALL),
lab AS (SELECT label, sum(mw) AS t FROM wm GROUP BY label), nf AS (SELECT count(DISTINCT term) AS f FROM wm),
base AS (SELECT doc_id, label, sum(weight) * ln(1 / (t + (SELECT f FROM nf))) AS b FROM {scored} CROSS JOIN lab GROUP BY doc_id, label, t),
gain AS (SELECT doc_id, label, sum(weight * ln(mw + 1)) AS g FROM {scored} JOIN wm USING (term) GROUP BY ALL),
ws AS (SELECT doc_id, label, b + coalesce(g, 0) AS score, g IS NOT NULL AS matched FROM base LEFT JOIN gain USING (doc_id, label)),
wb AS (SELECT doc_id, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, label) AS rn FROM ws) WHERE rn = 1)
"""


LANG_QUALITY = "SELECT doc_id, lang || '-' || quality AS label FROM documents JOIN labels USING (doc_id)"
WEIGHTED = weighted_sql(LANG_QUALITY)


def _labels(spark, d):
    """Language and quality of the labelled documents; languages share few words, so labels are missed."""
    docs, labels = table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id").select("doc_id", F.concat_ws("-", "lang", "quality").alias("label"))


def _weighted(spark, d, whole=False):
    labels = _labels(spark, d)
    return B.classify_documents(documents(spark, d), labels, "doc_id", "text", "label", whole=whole), labels


@query(
    "M10_weighted_scores",
    f"WITH {WEIGHTED} SELECT doc_id, label, round(score, 4) AS score, matched FROM ws",
)
def weighted_scores(spark, d):
    return _weighted(spark, d, whole=True)[0].withColumn("score", F.round("score", 4))


@query(
    "M11_model_validity",
    f"""
    WITH {WEIGHTED} SELECT count(DISTINCT label) AS n_labels, count(DISTINCT term) AS n_terms, round(sum(mw), 4) AS total_weight, true AS valid FROM wm
    """,
)
def validity(spark, d):
    vectors = B.weighted_documents(documents(spark, d), "doc_id", "text")
    model = B.weight_model(vectors, materialise(_labels(spark, d), "labels"), "doc_id", "label")
    return B.validate_weights(model, 1.0).withColumn("total_weight", F.round("total_weight", 4))


NGRAMS = r"""
w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\r\f]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w)
  UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2))
"""


@query("M12_ngrams", f"WITH {NGRAMS} SELECT gram, count(*) AS n FROM g GROUP BY gram")
def ngrams(spark, d):
    return V.gram_totals(documents(spark, d), "doc_id", "text", 3)


@query(
    "M13_collocations",
    f"""
    WITH {NGRAMS}, c AS (SELECT gram, regexp_extract(gram, '^(.*) [^ ]*$', 1) AS head, regexp_extract(gram, ' ([^ ]*)$', 1) AS tail, count(*) AS n FROM g GROUP BY gram),
    h AS (SELECT head, sum(n) AS hn FROM c GROUP BY head), t AS (SELECT tail, sum(n) AS tn FROM c GROUP BY tail), tt AS (SELECT sum(n) AS tot FROM c),
    k AS (SELECT gram, n, CAST(n AS DOUBLE) AS k11, CAST(hn - n AS DOUBLE) AS k12, CAST(tn - n AS DOUBLE) AS k21, CAST(greatest(tot - (hn + tn - n), 0) AS DOUBLE) AS k22
      FROM c JOIN h USING (head) JOIN t USING (tail), tt WHERE n >= 3),
    x AS (SELECT gram, n, greatest(2 * (
      CASE WHEN k11 > 0 THEN k11 * ln(k11) ELSE 0 END + CASE WHEN k12 > 0 THEN k12 * ln(k12) ELSE 0 END
      + CASE WHEN k21 > 0 THEN k21 * ln(k21) ELSE 0 END + CASE WHEN k22 > 0 THEN k22 * ln(k22) ELSE 0 END
      - CASE WHEN k11 + k12 > 0 THEN (k11 + k12) * ln(k11 + k12) ELSE 0 END - CASE WHEN k21 + k22 > 0 THEN (k21 + k22) * ln(k21 + k22) ELSE 0 END
      - CASE WHEN k11 + k21 > 0 THEN (k11 + k21) * ln(k11 + k21) ELSE 0 END - CASE WHEN k12 + k22 > 0 THEN (k12 + k22) * ln(k12 + k22) ELSE 0 END
      + (k11 + k12 + k21 + k22) * ln(k11 + k12 + k21 + k22)), 0) AS llr FROM k)
    SELECT gram, n, round(llr, 4) AS llr FROM x WHERE llr >= 20
    """,
)
def collocations(spark, d):
    grams = V.gram_counts(documents(spark, d), "doc_id", "text", 3)
    return V.collocations(grams, min_support=3, min_llr=20.0).withColumn("llr", F.round("llr", 4))


@query(
    "M13_unigrams_beside",
    f"WITH {TOKENS} SELECT word AS gram, count(*) AS n FROM tok GROUP BY word",
)
def unigram_counts(spark, d):
    return V.unigrams(documents(spark, d), "text")


@query("M14_document_classifier", f"WITH {WEIGHTED} SELECT doc_id, predicted FROM wb")
def document_classifier(spark, d):
    return B.best_label(_weighted(spark, d)[0], "doc_id")


@query(
    "M15_all_year_scorers",
    f"""
    WITH {BM25}, {PHRASE_VECTORS}, norm AS (SELECT year, sqrt(sum(count * count)) AS n FROM counts GROUP BY year),
    ql AS (SELECT query_id, sqrt(sum(q * q)) AS n FROM pv GROUP BY query_id),
    dot AS (SELECT query_id, year, sum(q * count) AS dt FROM pv JOIN counts USING (word) GROUP BY ALL)
    SELECT 'bm25' AS scorer, query_id, year, round(score, 6) AS score FROM bm
    UNION ALL SELECT 'naive_bayes', query_id, year, round(sum(ln(count + 1)) - count(*) * ln(total + 1), 6) FROM hit JOIN totals USING (year) GROUP BY query_id, year, total
    UNION ALL SELECT 'nearest', ql.query_id, norm.year, round(sqrt(greatest(2 - 2 * coalesce(dt, 0) / (ql.n * norm.n), 0)), 6)
      FROM ql CROSS JOIN norm LEFT JOIN dot ON dot.query_id = ql.query_id AND dot.year = norm.year
    """,
)
def all_scorers(spark, d):
    return Y.analyse(year_table(spark, d), phrases(spark, d), whole=True).withColumn("score", F.round("score", 6))


SIMILAR = f"""
{RATINGS}, sim AS (SELECT a.u AS a, b.u AS b, count(*) AS n, corr(a.x, b.x) AS similarity
  FROM r a JOIN r b ON a.i = b.i AND a.u < b.u GROUP BY 1, 2 HAVING count(*) >= 2 AND min(a.x) < max(a.x) AND min(b.x) < max(b.x))
"""


@query("M16_user_similarity", f"WITH {SIMILAR} SELECT a, b, n, round(similarity, 8) AS similarity FROM sim")
def user_similarity(spark, d):
    pairs = REC.user_similarity(ratings_table(spark, d))
    return pairs.withColumn("similarity", F.round("similarity", 8))


BOTH = f"{SIMILAR}, bw AS (SELECT a AS of, b AS other, similarity FROM sim UNION ALL SELECT b, a, similarity FROM sim)"
NEAR = f"""
{BOTH}, nn AS (SELECT of, other, similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY of ORDER BY round(similarity, 12) DESC, other) AS rn FROM bw) WHERE rn <= 75)
"""


@query("M17_threshold_neighbourhood", f"WITH {BOTH} SELECT of, other, round(similarity, 8) AS similarity FROM bw WHERE round(similarity, 8) >= 0.1")
def threshold_near(spark, d):
    pairs = REC.user_similarity(ratings_table(spark, d)).withColumn("similarity", F.round("similarity", 8))
    return REC.near_threshold(pairs, 0.1)


@query("M17_nearest_neighbourhood", f"WITH {NEAR} SELECT of, other, round(similarity, 8) AS similarity FROM nn")
def nearest_near(spark, d):
    return REC.near_n(REC.user_similarity(ratings_table(spark, d), nearest=75), 75).withColumn("similarity", F.round("similarity", 8))


@query(
    "M18_user_recommendations",
    f"""
    WITH {NEAR}, est AS (SELECT of AS u, i, sum(similarity * x) / nullif(sum(similarity), 0) AS e FROM nn JOIN r ON r.u = nn.other GROUP BY 1, 2),
    un AS (SELECT est.u, est.i, e FROM est LEFT JOIN r ON r.u = est.u AND r.i = est.i WHERE r.u IS NULL AND e IS NOT NULL)
    SELECT u AS user, i AS item, round(e, 6) AS estimate, CAST(rn AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY u ORDER BY round(e, 9) DESC, i) AS rn FROM un) WHERE rn <= 3
    """,
)
def user_recommendations(spark, d):
    r = ratings_table(spark, d)
    out = REC.recommend(REC.near_n(REC.user_similarity(r, nearest=75), 75), r, 3)
    return out.select("user", "item", F.round("estimate", 6).alias("estimate"), "rank")


@query(
    "M18_recommendations_for_asked_users",
    f"""
    WITH {BOTH}, asked AS (SELECT c_custkey AS of FROM customer WHERE c_acctbal < 0),
    nn AS (SELECT of, other, similarity FROM bw SEMI JOIN asked USING (of) QUALIFY row_number() OVER (PARTITION BY of ORDER BY round(similarity, 12) DESC, other) <= 100),
    est AS (SELECT of AS u, i, sum(similarity * x) / nullif(sum(similarity), 0) AS e FROM nn JOIN r ON r.u = nn.other GROUP BY 1, 2),
    un AS (SELECT est.u, est.i, e FROM est LEFT JOIN r ON r.u = est.u AND r.i = est.i WHERE r.u IS NULL AND e IS NOT NULL)
    SELECT u AS user, i AS item, round(e, 6) AS estimate, CAST(row_number() OVER (PARTITION BY u ORDER BY round(e, 9) DESC, i) AS INTEGER) AS rank FROM un
    QUALIFY rank <= 5
    """,
)
def asked_recommendations(spark, d):
    """For the customers in debt: the rest of the users meet them, but not each other."""
    r = ratings_table(spark, d)
    asked = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user"))
    near = REC.near_n(REC.user_similarity(r, asked=asked, nearest=100), 100, asked=True)
    return REC.recommend(near, r, 5).select("user", "item", F.round("estimate", 6).alias("estimate"), "rank")


def _xlx(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN ({x}) * ln({x}) ELSE 0 END"


ITEMS = f"""
{RATINGS}, nu AS (SELECT CAST(count(DISTINCT u) AS DOUBLE) AS nu FROM r), c AS (SELECT i, CAST(count(*) AS DOUBLE) AS c FROM r GROUP BY i),
p AS (SELECT a.i AS a, b.i AS b, CAST(count(*) AS DOUBLE) AS k FROM r a JOIN r b ON a.u = b.u AND a.i < b.i GROUP BY 1, 2),
q AS (SELECT a, b, k, ca.c - k AS k12, cb.c - k AS k21, nu - ca.c - cb.c + k AS k22 FROM p JOIN c ca ON ca.i = a JOIN c cb ON cb.i = b, nu),
llr AS (SELECT a, b, CAST(k AS BIGINT) AS n, greatest(2 * ({_xlx('k')} + {_xlx('k12')} + {_xlx('k21')} + {_xlx('k22')} - {_xlx('k + k12')} - {_xlx('k21 + k22')}
   - {_xlx('k + k21')} - {_xlx('k12 + k22')} + {_xlx('k + k12 + k21 + k22')}), 0) AS g FROM q),
isim AS (SELECT a, b, n, 1 - 1 / (1 + g) AS similarity FROM llr)
"""


@query("M19_item_similarity", f"WITH {ITEMS} SELECT a, b, n, round(similarity, 7) AS similarity FROM isim")
def item_similarity(spark, d):
    return REC.item_similarity(ratings_table(spark, d)).withColumn("similarity", F.round("similarity", 7))


@query(
    "M19_item_recommendations",
    f"""
    WITH {ITEMS}, bw AS (SELECT a AS i, b AS o, similarity AS s FROM isim UNION ALL SELECT b, a, similarity FROM isim),
    est AS (SELECT u, o AS i, sum(s * x) / nullif(sum(s), 0) AS e FROM r JOIN bw USING (i) GROUP BY 1, 2),
    un AS (SELECT est.u, est.i, e FROM est LEFT JOIN r ON r.u = est.u AND r.i = est.i WHERE r.u IS NULL)
    SELECT u AS user, i AS item, round(e, 6) AS estimate, CAST(rn AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY u ORDER BY round(e, 9) DESC, i) AS rn FROM un) WHERE rn <= 2
    """,
)
def item_recommendations(spark, d):
    r = ratings_table(spark, d)
    out = REC.recommend_by_items(r, REC.item_similarity(r), 2)
    return out.select("user", "item", F.round("estimate", 6).alias("estimate"), "rank")


@query(
    "M19_similar_to_asked_items",
    f"""
    WITH {ITEMS}, bw AS (SELECT a, b, n, similarity FROM isim UNION ALL SELECT b, a, n, similarity FROM isim)
    SELECT a, b, n, round(similarity, 7) AS similarity FROM bw WHERE a IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 5000)
    """,
)
def similar_to_asked(spark, d):
    """Items like those of suppliers with a small balance, from the users of these items only."""
    asked = table(spark, d, "supplier").where("s_acctbal < 5000").select(F.col("s_suppkey").alias("item"))
    return REC.item_similarity(ratings_table(spark, d), asked=asked).withColumn("similarity", F.round("similarity", 7))


def _hold_out_sql(train: str, seed: str) -> str:
    """Mean error of the ratings outside ``train``, a condition on (u, i)."""
    return f"""
    SELECT {seed} round(avg(abs(est - x)), 6) AS mae, count(est) AS n FROM (
      WITH tr AS (SELECT * FROM r WHERE {train}), te AS (SELECT * FROM r WHERE NOT ({train})),
      sim AS (SELECT a.u AS of, b.u AS other, corr(a.x, b.x) AS s FROM tr a JOIN tr b ON a.i = b.i AND a.u <> b.u
        GROUP BY 1, 2 HAVING count(*) >= 2 AND min(a.x) < max(a.x) AND min(b.x) < max(b.x))
      SELECT te.u, te.i, te.x, sum(s * tr.x) / nullif(sum(s), 0) AS est FROM te JOIN sim ON of = te.u AND s >= 0.1 JOIN tr ON tr.u = other AND tr.i = te.i GROUP BY ALL)
    """


def _split_sql(seed: int) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || u || ':' || i), 1, 8) AS BIGINT) % 100 < 90"


@query("M20_recommender_error", f"WITH {RATINGS} " + " UNION ALL ".join(_hold_out_sql(_split_sql(k), f"{k} AS seed,") for k in (0, 1)))
def recommender_error(spark, d):
    """Hold-out error of two trials; the split is by a digest that SQL repeats."""
    return REC.evaluate(ratings_table(spark, d), seeds=(0, 1)).withColumn("mae", F.round("mae", 6))


@query("M20_hold_out_error", f"WITH {RATINGS} " + _hold_out_sql("(u * 7 + i * 3) % 10 <> 0", ""))
def hold_out(spark, d):
    r = ratings_table(spark, d)
    held = (F.col("user") * 7 + F.col("item") * 3) % 10 == 0
    out = REC.holdout_error(r.where(~held), r.where(held), 0.1)
    return out.withColumn("mae", F.round("mae", 6))


HELD_OUT = "CAST('0x' || substr(md5('0:' || doc_id), 1, 8) AS BIGINT) % 100 < 20"


@query(
    "M21_classifier_evaluation",
    f"""
    WITH {weighted_sql(f"{LANG_QUALITY} WHERE NOT ({HELD_OUT})", f"(SELECT * FROM w WHERE {HELD_OUT} AND doc_id IN (SELECT doc_id FROM labels))")}
    SELECT tests.label, predicted, count(*) AS n FROM ({LANG_QUALITY} WHERE {HELD_OUT}) tests LEFT JOIN wb USING (doc_id) GROUP BY ALL
    """,
)
def evaluation(spark, d):
    """Trained on four fifths of the labels, tested on the rest."""
    return B.evaluate_documents(documents(spark, d), _labels(spark, d), "doc_id", "text", "label")


@query(
    "M22_default_category",
    r"""
    WITH model AS (SELECT lower(p_type) AS word, p_brand AS category, count(*) AS count FROM part GROUP BY ALL),
    v AS (SELECT count(DISTINCT word) AS v FROM model), tot AS (SELECT category, sum(count) AS t FROM model GROUP BY category),
    dw AS (SELECT p_partkey, lower(p_name) AS text, unnest(string_split(lower(p_name), ' ')) AS word FROM part),
    dd AS (SELECT p_partkey, word, count(*) AS m FROM (SELECT p_partkey, word FROM dw UNION ALL
      SELECT p_partkey, lower(p_type) FROM part WHERE p_size > 40) GROUP BY ALL),
    len AS (SELECT p_partkey, sum(m) AS n FROM dd GROUP BY ALL),
    sc AS (SELECT p_partkey, category, sum(m * ln(count + 1)) AS s FROM dd JOIN model USING (word) GROUP BY ALL),
    fin AS (SELECT p_partkey, category, s - n * ln(t + (SELECT v FROM v)) AS score FROM sc JOIN len USING (p_partkey) JOIN tot USING (category)),
    best AS (SELECT p_partkey, category FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY round(score, 9) DESC, category) AS rn FROM fin) WHERE rn = 1)
    SELECT p_partkey, coalesce(category, 'OTHER') AS category FROM part LEFT JOIN best USING (p_partkey)
    """,
)
def default_category(spark, d):
    p = table(spark, d, "part")
    model = p.groupBy(F.lower("p_type").alias("word"), F.col("p_brand").alias("category")).agg(F.count("*").alias("count"))
    text = F.concat_ws(" ", "p_name", F.when(F.col("p_size") > 40, F.col("p_type")))
    out = B.classify(model, p.select("p_partkey", text.alias("text")), "p_partkey", "text", size="vocabulary", default="OTHER")
    return out.select("p_partkey", "category")
