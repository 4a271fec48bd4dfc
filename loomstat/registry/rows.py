"""Projection, filter and schema queries, and set operations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from loomstat.functions import schema as S
from loomstat.functions import status as ST
from loomstat.functions import text as X
from loomstat.operators import joins as J
from loomstat.operators import metrics as M
from loomstat.operators.grouping import OutputMapper, RowMapper, map_outputs, map_rows
from loomstat.plans import vectors as V
from loomstat.plans import years as Y
from loomstat.registry.base import AGE, COUNTS, METRICS, TOKENS, as_of, documents, metric_table, phrases, query, table, token_rows, year_counts
from loomstat.sources import documents as DOC
from loomstat.sources import tables as TB


@query("P01_without_fields", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def without_fields(spark, d):
    c = table(spark, d, "customer")
    return S.conform(c, S.minus(c.schema, "c_acctbal", "c_mktsegment"))


@query("P02_subset_of_fields", "SELECT c_mktsegment, c_custkey FROM customer")
def subset_fields(spark, d):
    c = table(spark, d, "customer")
    return S.conform(c, S.subset(c.schema, "c_mktsegment", "c_custkey"))


@query("P03_superset_of_fields", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal, 0 AS grade, NULL::VARCHAR AS remark FROM supplier")
def superset_fields(spark, d):
    s = table(spark, d, "supplier")
    more = S.superset(s.schema, S.field("grade", "int", default=0), S.field("remark", "string", nullable=True))
    return S.conform(s, more)


@query(
    "P04_joint_schema",
    "SELECT n_nationkey, n_name AS name, n_regionkey, r_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey",
)
def joint_schema(spark, d):
    n = table(spark, d, "nation").withColumnRenamed("n_name", "name")
    r = table(spark, d, "region").withColumnRenamed("r_name", "name")
    return S.joint_select(n.join(r, n.n_regionkey == r.r_regionkey), n, r)


@query("P05_cloned_field", "SELECT p_partkey, p_brand, p_brand AS brand_copy FROM part")
def cloned_field(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    extra = S.clone_field(p.schema["p_brand"], "brand_copy", nullable=True)
    return p.withColumn(extra.name, F.col("p_brand").alias(extra.name, metadata=extra.metadata))


@query("P06_field_aliases", "SELECT n_nationkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def field_aliases(spark, d):
    c = S.alias_fields(table(spark, d, "customer"), {"c_nationkey": "n_nationkey"})
    return c.join(table(spark, d, "nation"), "n_nationkey").groupBy("n_nationkey").agg(F.count("*").alias("n"))


@query(
    "P07_map_only",
    "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem",
)
def map_only(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


@query("P08_grep", "SELECT doc_id, md5(text) AS text_hash FROM documents WHERE contains(text, '. The')")
def grep(spark, d):
    docs = documents(spark, d).where(X.contains_literal(F.col("text"), ". The"))
    return docs.select("doc_id", F.md5("text").alias("text_hash"))


@query(
    "P09_parse_or_drop",
    "SELECT event_type AS word, CAST(user_id AS INTEGER) AS year, CAST(event_id AS BIGINT) AS count, NULL::BIGINT AS books FROM events WHERE value >= 5",
)
def parse_or_drop(spark, d):
    e = table(spark, d, "events")
    count = F.when(F.col("value") >= 5, F.col("event_id").cast("string")).otherwise("many")
    return Y.parse_counts(e.select(F.concat_ws("\t", "event_type", "user_id", count).alias("value")))


@query(
    "P10_keep_query_words",
    f"""
    WITH {COUNTS}, q AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS term FROM benchmark)
    SELECT word, year, count FROM counts WHERE lower(word) IN (SELECT term FROM q WHERE term <> '')
    """,
)
def keep_query_words(spark, d):
    return J.keep_terms(year_counts(spark, d), "word", Y.phrase_terms(phrases(spark, d)))


STOP = ["the", "of", "and", "der", "die", "le", "la", "de"]


@query(
    "P11_drop_stop_words",
    f"""
    WITH {TOKENS} SELECT lang, word, count(*) AS n FROM tok
    WHERE word NOT IN ({", ".join(f"'{w}'" for w in STOP)}) GROUP BY ALL
    """,
)
def drop_stop_words(spark, d):
    stop = spark.createDataFrame([(w,) for w in STOP], "word string")
    return J.drop_terms(token_rows(spark, d), "word", stop).groupBy("lang", "word").agg(F.count("*").alias("n"))


@query("P12_strip_suffix", "SELECT p_name AS word, count(*) AS n FROM part GROUP BY ALL")
def strip_suffix(spark, d):
    p = table(spark, d, "part")
    word = X.strip_pos(F.concat_ws("_", "p_name", "p_type", "p_brand"))
    return p.groupBy(word.alias("word")).agg(F.count("*").alias("n"))


@query(
    "P13_tokenise",
    r"""
    SELECT doc_id, CAST(unnest(range(0, len(w))) AS INTEGER) AS at, unnest(w) AS word FROM (
      SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\r\f]+'), lambda x: x <> '') AS w FROM documents)
    """,
)
def tokenise(spark, d):
    """Every token with its place in the document."""
    return documents(spark, d).select("doc_id", F.posexplode(X.tokens(F.col("text"))).alias("at", "word"))


def tweets(spark, d):
    """``events`` written as tweets: place, time and two hashtags each."""
    e = table(spark, d, "events")
    tag = lambda c: F.struct(c.alias("text"))
    doc = F.struct(
        F.date_format("ts", "EEE MMM dd HH:mm:ss '+0000' yyyy").alias("created_at"),
        F.struct(F.col("event_type").alias("location")).alias("user"),
        F.struct(
            F.array(tag(F.concat(F.lit("u"), F.col("user_id"))), tag(F.concat(F.lit("k"), F.col("user_id") % 7))).alias("hashtags")
        ).alias("entities"),
    )
    return DOC.parse_json(e.select(F.to_json(doc).alias("value")), "value", DOC.TWEET)


HASHTAGS = """
ht AS (SELECT event_type AS location, year(ts) || '-' || month(ts) || '-' || day(ts) AS date,
              unnest(['u' || user_id, 'k' || (user_id % 7)]) AS hashtag FROM events)
"""


@query("P14_explode_hashtags", f"WITH {HASHTAGS} SELECT location, date, hashtag, count(*) AS n FROM ht GROUP BY ALL")
def explode_hashtags(spark, d):
    return DOC.hashtags(tweets(spark, d)).groupBy("location", "date", "hashtag").agg(F.count("*").alias("n"))


@query(
    "P15_normalise_words",
    f"WITH {TOKENS} SELECT lower(regexp_replace(word, '[[:punct:]]', '', 'g')) AS word, count(*) AS n FROM tok GROUP BY 1",
)
def normalise_words(spark, d):
    return token_rows(spark, d).groupBy(X.normalise_word(F.col("word")).alias("word")).agg(F.count("*").alias("n"))


@query(
    "P16_query_terms",
    "SELECT DISTINCT item_id AS query_id, unnest(string_split(lower(text), ' ')) AS term FROM benchmark",
)
def query_terms(spark, d):
    return phrases(spark, d).select("query_id", F.explode(X.query_terms(F.col("text"))).alias("term"))


PHRASE_VECTORS = r"""
pv AS (SELECT query_id, word, count(*) AS q FROM (
         SELECT item_id AS query_id,
                regexp_replace(unnest(string_split_regex(text, '[ \t\n\r\f]+')), '\p{P}', '', 'g') AS word FROM benchmark)
       WHERE word <> '' GROUP BY ALL)
"""


@query("P17_phrase_vectors", f"WITH {PHRASE_VECTORS} SELECT query_id, word, q FROM pv")
def phrase_vectors(spark, d):
    return Y.phrase_vectors(phrases(spark, d))


ANALYZED = r"""
an AS (SELECT doc_id, term FROM (
         SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:[''.][\p{L}\p{N}]+)*')) AS term FROM documents)
       WHERE term NOT IN (STOPS))
""".replace("STOPS", ", ".join(f"'{w}'" for w in X.ENGLISH_STOP_WORDS))


@query("P18_analyzed_terms", f"WITH {ANALYZED} SELECT term, count(*) AS n FROM an GROUP BY ALL")
def analyzed_terms(spark, d):
    return V.analyzed_grams(documents(spark, d), "doc_id", "text").groupBy("term").agg(F.count("*").alias("n"))


@query(
    "P19_odd_years",
    "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders WHERE year(o_orderdate) % 2 = 1 GROUP BY ALL",
)
def odd_years(spark, d):
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("year"))
    return Y.odd_years(o).groupBy("year").agg(F.count("*").alias("n"))


@query(
    "P20_html_blocks",
    r"""
    WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<li>.*?</li>')) AS block FROM pages)
    SELECT page_id, regexp_extract(block, 'href="([^"]*)"', 1) AS link, trim(regexp_extract(block, '">([^<]*)<', 1)) AS label,
           count(*) AS n FROM b GROUP BY ALL
    """,
)
def html_blocks(spark, d):
    rows = DOC.extract_blocks(
        table(spark, d, "pages"), "html", "<li>", "</li>", {"link": 'href="([^"]*)"', "label": '">([^<]*)<'}, F.col("page_id")
    )
    return rows.groupBy("page_id", "link", "label").agg(F.count("*").alias("n"))


@query("P21_permitted_sources", "SELECT p_partkey AS source FROM part WHERE p_type = 'SMALL' AND p_brand = 'Brand#4'")
def permitted(spark, d):
    p = table(spark, d, "part")
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(c).alias("value")) for a, c in (("type", "p_type"), ("brand", "p_brand"))])
    long = p.select(F.col("p_partkey").alias("source"), F.explode(pairs).alias("_a")).select("source", "_a.*")
    return M.permitted_sources(long, {"type": "SMALL", "brand": "Brand#4", "size": ""})


@query(
    "P22_search_names",
    f"""
    WITH {METRICS} SELECT DISTINCT kind, name FROM (
      SELECT 'host' AS kind, host AS name FROM m UNION ALL SELECT 'metric', metric FROM m)
    WHERE regexp_matches(name, '(?i)(E-[13]|CLICK)')
    """,
)
def search_names(spark, d):
    return M.search_catalog(metric_table(spark, d), "(E-[13]|CLICK)")


@query(
    "P23_host_state",
    f"WITH {METRICS} SELECT host, abs({AGE.format('last_ts')}) <= 240 AS up FROM s, a",
)
def host_state(spark, d):
    m = metric_table(spark, d)
    return M.host_state(m, as_of(m))


@query(
    "P23_host_state_by_report_age",
    """
    WITH x AS (SELECT 'h' || user_id AS host, ts, value AS tn, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS tmax, event_id FROM events),
    y AS (SELECT host, tn, tmax, ts FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts DESC) rn FROM x) WHERE rn = 1)
    SELECT host, CASE WHEN tn <> 0 AND tmax <> 0 THEN tn <= 4 * tmax
      ELSE abs(CAST(floor(epoch((SELECT max(ts) FROM events))) AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT)) <= 240 END AS up FROM y
    """,
)
def host_state_tn(spark, d):
    e = table(spark, d, "events")
    rows = e.select(
        F.concat(F.lit("h"), "user_id").alias("host"), "ts", F.col("value").alias("tn"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("tmax"),
    )
    return M.host_state(rows, as_of(e), "tn", "tmax")


@query(
    "P24_derived_series",
    """
    WITH w AS (SELECT CAST(ts AS DATE) AS day, sum(value) FILTER (event_type = 'click') AS mem_total,
      sum(value) FILTER (event_type = 'error') AS mem_free, sum(value) FILTER (event_type = 'view') AS mem_cached,
      coalesce(sum(value) FILTER (event_type = 'signup'), 0) AS mem_buffers, count(DISTINCT user_id) AS nodes
      FROM events GROUP BY ALL)
    SELECT day, round(greatest((mem_total - mem_free - mem_cached - mem_buffers) * 1024, 0), 3) AS mem_used,
           round(greatest(mem_total / nodes, 0), 6) AS per_node FROM w
    """,
)
def derived_series(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    one = lambda name: F.sum(F.when(F.col("event_type") == name, F.col("value")))
    wide = e.groupBy("day").agg(
        one("click").alias("mem_total"), one("error").alias("mem_free"), one("view").alias("mem_cached"),
        one("signup").alias("mem_buffers"), F.count_distinct("user_id").alias("nodes"),
    )
    out = M.per_node(M.used_memory(wide), "mem_total", "nodes", "per_node")
    return out.select("day", F.round("mem_used", 3).alias("mem_used"), F.round("per_node", 6).alias("per_node"))


@query(
    "P25_host_location",
    """
    SELECT user_id, CAST(CASE WHEN user_id % 3 = 0 THEN user_id % 5 WHEN user_id % 3 = 1 THEN user_id // 20 ELSE -1 END AS INTEGER) AS rack,
      CAST(CASE WHEN user_id % 3 = 0 THEN user_id % 9 WHEN user_id % 3 = 1 THEN user_id % 20 ELSE -1 END AS INTEGER) AS rank,
      CAST(CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS plane
    FROM events GROUP BY ALL
    """,
)
def host_location(spark, d):
    u = F.col("user_id")
    attribute = F.when(u % 3 == 0, F.concat_ws(",", u % 5, u % 9, F.lit(1)))
    host = F.when(u % 3 == 1, F.concat_ws("-", F.lit("compute"), F.floor(u / 20), u % 20)).otherwise(F.concat(F.lit("web"), u))
    users = table(spark, d, "events").select("user_id").distinct()
    return users.select("user_id", ST.location(attribute, host).alias("_p")).select("user_id", "_p.*")


class NetPrice(RowMapper):
    """Small map hook: adds one computed column, counting rows on the way."""

    def __init__(self, rate: float):
        self.rate = rate

    def setup(self):
        self.rows = 0

    def map(self, batch):
        self.rows += len(batch)
        batch["with_tax"] = (batch["o_totalprice"] * self.rate).round(6)
        yield batch

    def cleanup(self):
        return iter(())


@query("F01_row_mapper", "SELECT o_orderkey, o_totalprice, round(o_totalprice * 1.5, 6) AS with_tax FROM orders")
def row_mapper(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return map_rows(o, NetPrice(1.5), "o_orderkey long, o_totalprice double, with_tax double")


class LastOfTask(RowMapper):
    """Small map hook that answers only at the end of its task."""

    def setup(self):
        self.total = 0

    def map(self, batch):
        self.total += int(batch["l_linenumber"].sum())
        return iter(())

    def cleanup(self):
        yield pd.DataFrame({"lines": [self.total]})


@query("F02_mapper_with_flush", "SELECT CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem")
def mapper_flush(spark, d):
    li = table(spark, d, "lineitem").select("l_linenumber")
    return map_rows(li, LastOfTask(), "lines long").agg(F.sum("lines").alias("lines"))


class PriceRouter(OutputMapper):
    """Rows dearer than a share of a given price go to ``dear``, the others to ``cheap``; ``seen`` counts them at the end of a task."""

    def __init__(self, kind, key, price, limit):
        self.kind, self.key, self.price, self.limit = kind, key, price, limit

    def setup(self):
        self.rows = 0

    def map(self, batch):
        self.rows += len(batch)
        dear = batch[self.price] > self.limit
        yield "dear", pd.DataFrame({"kind": self.kind, "key": batch.loc[dear, self.key], "price": batch.loc[dear, self.price]})
        yield "cheap", pd.DataFrame({"kind": self.kind, "key": batch.loc[~dear, self.key], "limit": float(self.limit)})

    def cleanup(self):
        yield "seen", pd.DataFrame({"kind": [self.kind], "rows": [self.rows]})


def _routed(spark, d):
    """Two inputs, each through an instance with settings of its own, into three outputs, in one pass over each."""
    inputs = [
        (table(spark, d, "orders").select("o_orderkey", "o_totalprice"), PriceRouter("order", "o_orderkey", "o_totalprice", 150_000)),
        (table(spark, d, "part").select("p_partkey", "p_retailprice"), PriceRouter("part", "p_partkey", "p_retailprice", 1_500)),
    ]
    outputs = {"dear": "kind string, key long, price double", "cheap": "kind string, key long, limit double", "seen": "kind string, rows long"}
    return map_outputs(inputs, outputs)


ROUTED = """
i AS (SELECT 'order' AS kind, o_orderkey AS key, o_totalprice AS price, 150000.0::DOUBLE AS lim FROM orders UNION ALL SELECT 'part', p_partkey, p_retailprice, 1500.0 FROM part)
"""


@query(
    "F02_mapper_with_named_outputs",
    f"""
    WITH {ROUTED} SELECT 'dear' AS output, kind, key, price, NULL::DOUBLE AS "limit", NULL::BIGINT AS rows FROM i WHERE price > lim
    UNION ALL SELECT 'cheap', kind, key, NULL, lim, NULL FROM i WHERE price <= lim UNION ALL SELECT 'seen', kind, NULL, NULL, NULL, count(*) FROM i GROUP BY kind
    """,
)
def named_outputs(spark, d):
    found = _routed(spark, d)
    seen = found["seen"].groupBy("kind").agg(F.sum("rows").alias("rows"))
    out = None
    for name, df in (("dear", found["dear"]), ("cheap", found["cheap"]), ("seen", seen)):
        rows = df.withColumn("output", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out.select("output", "kind", "key", "price", "limit", "rows")


@query(
    "F05_mapper_instances",
    f"""
    WITH {ROUTED} SELECT kind, lim AS "limit", count(*) FILTER (price <= lim) AS cheap, count(*) AS rows FROM i GROUP BY ALL
    """,
)
def mapper_instances(spark, d):
    """Two instances of one class with different settings: what each counted and where it drew its line."""
    found = _routed(spark, d)
    cheap = found["cheap"].groupBy("kind", "limit").agg(F.count("*").alias("cheap"))
    return cheap.join(found["seen"].groupBy("kind").agg(F.sum("rows").alias("rows")), "kind")


@query(
    "F05_mappers_with_own_settings",
    "SELECT 'order' AS kind, round(sum(o_totalprice * 0.5), 2) AS scaled FROM orders UNION ALL SELECT 'line', round(sum(l_extendedprice * 0.25), 2) FROM lineitem",
)
def own_settings(spark, d):
    """Each input goes through its own mapper instance with its own setting."""

    def scaled(column, kind, factor):
        return lambda df: df.select(F.lit(kind).alias("kind"), (F.col(column) * F.lit(factor)).alias("v"))

    rows = TB.gather([
        (table(spark, d, "orders"), scaled("o_totalprice", "order", 0.5)),
        (table(spark, d, "lineitem"), scaled("l_extendedprice", "line", 0.25)),
    ])
    return rows.groupBy("kind").agg(F.round(F.sum("v"), 2).alias("scaled"))


@query("F06_scalar_function", "SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS level FROM orders")
def scalar_function(spark, d):
    """A user's scalar function as an Arrow batch function."""
    first = F.pandas_udf(lambda s: s.str.split("-").str[0], "string")
    return table(spark, d, "orders").select("o_orderkey", first("o_orderpriority").alias("level"))


@query(
    "U01_union_all",
    "SELECT kind, count(*) AS n FROM (SELECT 'doc' AS kind, text FROM documents UNION ALL SELECT 'item', text FROM benchmark) GROUP BY ALL",
)
def union_all(spark, d):
    a = documents(spark, d).select(F.lit("doc").alias("kind"), "text")
    b = table(spark, d, "benchmark").select(F.lit("item").alias("kind"), "text")
    return a.unionByName(b).groupBy("kind").agg(F.count("*").alias("n"))


@query("U02_distinct_with_first_rank", f"WITH {TOKENS} SELECT word, min(doc_id) AS rank FROM tok GROUP BY ALL")
def first_rank(spark, d):
    return V.first_ranks(token_rows(spark, d).withColumnRenamed("doc_id", "rank"), "word", "rank")


@query("U03_distinct_values", "SELECT DISTINCT p_brand, p_type FROM part")
def distinct_values(spark, d):
    return table(spark, d, "part").select("p_brand", "p_type").distinct()


@query(
    "U04_intersection",
    "SELECT o_custkey AS key FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'",
)
def intersection(spark, d):
    o = table(spark, d, "orders")
    key = F.col("o_custkey").alias("key")
    return o.where("o_orderstatus = 'F'").select(key).intersect(o.where("o_orderpriority = '1-URGENT'").select(key))
