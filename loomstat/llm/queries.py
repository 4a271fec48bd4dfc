"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm import bpe, exact_dedup, hard_negatives, language, near_dedup, packing, pii, quality, quality_rules, sharding, source_divergence, topk, toxicity
from loomstat.llm.common import crc_of_id

VOCABULARY = "word_bpe_49k.json"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _held_out(folds: int, fold: int) -> Column:
    return crc_of_id("doc_id") % folds == fold


def op1_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = near_dedup.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    coded = bpe.encode_and_decode(docs, public_tokenizers.path(VOCABULARY))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    out = _held_out(4, 2)
    model = language.train(docs, ~out)
    found = language.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op4_exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, folder, "documents"))


def quality_model(spark: SparkSession, docs: DataFrame, folder: str) -> quality.RuleModel:
    return quality.train(docs, _table(spark, folder, "labels"), ~_held_out(5, 0))


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    found = quality.score(docs, quality_model(spark, docs, folder))
    return found.select("doc_id", _held_out(5, 0).alias("held_out"), "score", "predicted")


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    out = _held_out(4, 2)
    model = toxicity.train(docs, _table(spark, folder, "labels"), ~out)
    return toxicity.score(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shuffle_into_shards(_table(spark, folder, "documents"))


def op9_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_pii(_table(spark, folder, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["order"] < 4)

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in pii.KINDS[:4]],
        F.sha2(pii.span_list(base), 256).alias("base_sha256"),
        pii.span_list(F.col("pii")).alias("spans"),
        F.transform("pii", lambda s: s["score"]).alias("scores"),
    )


def op11_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, folder, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence.source_divergence(_table(spark, folder, "documents"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS items FROM w),
e AS (SELECT doc_id, unnest(items) AS item FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM e a JOIN e b ON a.item = b.item AND a.doc_id < b.doc_id GROUP BY ALL),
linked AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
           WHERE 100 * shared >= 75 * (len(x.items) + len(y.items) - shared)),
both_ways AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM s UNION SELECT b, seen FROM reach JOIN both_ways ON node = a),
c AS (SELECT node AS doc_id, min(seen) AS component_id FROM reach GROUP BY node),
k AS (SELECT doc_id, CASE WHEN len(items) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(items)) END AS class_id FROM s)
SELECT doc_id, CAST(len(items) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept, class_id
FROM s JOIN c USING (doc_id) JOIN k USING (doc_id)
"""

EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM r WHERE place <= 20
"""

NEGATIVES_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
        row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS place
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE place <= 10
"""

RULES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
n AS (SELECT r, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars FROM w),
line AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
g AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS gram FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) > 5)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT step) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS step FROM twice) GROUP BY r),
s AS (SELECT d.r, doc_id, lang, n_words, CAST(word_chars AS BIGINT) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
      FROM d JOIN n USING (r) LEFT JOIN l USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s),
grid AS (SELECT * FROM (VALUES {grid}) AS x(rule, step, cutoff)),
v AS (SELECT r, lang, 'long_words' AS rule, 1000 * word_chars // greatest(n_words, 1) AS value FROM b WHERE NOT base_failed
      UNION ALL SELECT r, lang, 'short_words', -(1000 * word_chars // greatest(n_words, 1)) FROM b WHERE NOT base_failed
      UNION ALL SELECT r, lang, 'symbols', 1000 * n_symbols // greatest(n_words, 1) FROM b WHERE NOT base_failed
      UNION ALL SELECT r, lang, 'repeated_lines', 1000 * n_dup_lines // greatest(n_lines, 1) FROM b WHERE NOT base_failed
      UNION ALL SELECT r, lang, 'repeated_words', 1000 * n_repeat_words // greatest(n_words, 1) FROM b WHERE NOT base_failed
      UNION ALL SELECT r, lang, 'few_words', -n_words FROM b WHERE NOT base_failed),
mark AS (SELECT doc_id, bool_and(quality = 1) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
held AS (SELECT v.*, good FROM v JOIN b USING (r) JOIN mark ON mark.doc_id = b.doc_id),
c AS (SELECT held.lang, grid.rule, step, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (good AND value > cutoff) AS k,
        count(*) FILTER (NOT good AND value > cutoff) AS hits FROM held JOIN grid USING (rule) GROUP BY ALL),
tests AS (SELECT count(DISTINCT coalesce(lang, chr(0))) * {rules} AS n FROM held),
p AS (SELECT lang, rule, step, cutoff, hits, CASE WHEN k >= n THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i:
        exp(lgamma(n + 1) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({part}) + (n - i) * ln(1 - {part})))) END AS tail FROM c),
chain AS (SELECT *, bool_and(tail <= {delta} / (SELECT n FROM tests)) OVER (PARTITION BY lang, rule ORDER BY step) AS certified FROM p),
chosen AS (SELECT lang, rule, cutoff FROM chain WHERE certified AND hits > 0
           QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY hits DESC, step) = 1),
out AS (SELECT DISTINCT r, v.rule FROM v JOIN chosen ON v.rule = chosen.rule AND v.lang IS NOT DISTINCT FROM chosen.lang WHERE value > cutoff),
names AS (SELECT r, string_agg(out.rule, ',' ORDER BY place) AS rejected_by
          FROM out JOIN (SELECT rule, row_number() OVER () AS place FROM (VALUES {names}) AS x(rule)) USING (rule) GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rejected_by IS NULL AS kept, coalesce(rejected_by, '') AS rejected_by
FROM b LEFT JOIN names USING (r)
"""


def rules_sql(risk: float = 0.02, delta: float = 0.05) -> str:
    """The twin of ``op11_quality_rules``: a rule that rejects small values takes both sides with the sign turned."""
    rules = quality_rules.RULES
    grid = ", ".join(f"('{r.name}', {k}, {c if r.above else -c})" for r in rules for k, c in enumerate(r.cutoffs))
    names = ", ".join(f"('{r.name}')" for r in rules)
    return RULES_SQL.format(grid=grid, names=names, rules=len(rules), part=f"({risk}::DOUBLE / {len(rules)})", delta=f"{delta}::DOUBLE")


DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
total AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
whole AS (SELECT lang, sum(n) AS n FROM total GROUP BY lang),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
p AS (SELECT lang, source, term, coalesce(c.n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(total.n, 0) + 5 * v)::HUGEINT AS p
      FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN total USING (lang, source) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c.n) + 5)) // (any_value(whole.n) + 5 * any_value(v))::HUGEINT AS q
      FROM c JOIN whole USING (lang) JOIN v USING (lang) GROUP BY lang, term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
out AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS place FROM out)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(place AS INTEGER) AS rank FROM r WHERE part = 'pair' OR place <= 50
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_near_duplicates, op2_bpe, op3_language, op4_exact_duplicates, op5_quality, op6_packing, op7_toxicity,
        op8_sharding, op9_top_k, op10_pii, op11_quality_rules, op12_hard_negatives, op13_source_divergence, pipeline,
    )
    return {q.__name__: q for q in own}


def oracle_sql() -> dict[str, str]:
    sql = {
        "op1_near_duplicates": NEAR_SQL,
        "op4_exact_duplicates": EXACT_SQL,
        "op9_top_k": TOP_K_SQL,
        "op11_quality_rules": rules_sql(),
        "op12_hard_negatives": NEGATIVES_SQL,
        "op13_source_divergence": DIVERGENCE_SQL,
    }
    return {name: text.strip() for name, text in sql.items()}
