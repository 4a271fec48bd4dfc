"""Window, ranking and ordering queries. Orders are shown as positions."""

from __future__ import annotations

from pyspark import TaskContext
from pyspark.sql import functions as F

from loomstat.functions import ordering as O
from loomstat.functions import schema as S
from loomstat.operators import grouping as G
from loomstat.operators import metrics as M
from loomstat.operators import ranking as R
from loomstat.operators import windows as W
from loomstat.operators.grouping import tagged_union
from loomstat.plans import years as Y
from loomstat.registry.base import COUNTS, METRICS, TOKENS, metric_table, phrases, query, table, token_rows, year_table
from loomstat.registry.rows import HASHTAGS, tweets
from loomstat.sources import documents as DOC


@query(
    "W01_moving_average",
    """
    WITH daily AS (SELECT event_type, CAST(ts AS DATE) AS day, sum(value) AS s, count(value) AS n FROM events GROUP BY ALL)
    SELECT event_type, day, round(sum(s) OVER w / sum(n) OVER w, 6) AS average FROM daily
    WINDOW w AS (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 2 DAYS PRECEDING AND CURRENT ROW)
    """,
)
def moving_average(spark, d):
    e = table(spark, d, "events").withColumnRenamed("ts", "day")
    return W.moving_average(e, "event_type", "day", "value", 3).withColumn("average", F.round("average", 6))


@query(
    "W02_share_of_group_total",
    """
    WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
    SELECT user_id, event_type, round(n / sum(n) OVER (PARTITION BY user_id), 9) AS share FROM c
    """,
)
def share(spark, d):
    e = table(spark, d, "events").withColumn("clicks", F.lit(1))
    return W.share_of_total(e, ["user_id"], ["event_type"], "clicks").withColumn("share", F.round("share", 9))


@query(
    "W03_top_hashtags",
    f"""
    WITH {HASHTAGS}, c AS (SELECT location, date, hashtag, count(*) AS count FROM ht GROUP BY ALL)
    SELECT location, date, hashtag, count, CAST(rn AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY location, date ORDER BY count DESC, hashtag) AS rn FROM c) WHERE rn <= 2
    """,
)
def top_hashtags(spark, d):
    return W.top_counts(DOC.hashtags(tweets(spark, d)), ["location", "date"], "hashtag", 2)


@query(
    "W03_top_words",
    f"""
    WITH {TOKENS}, c AS (SELECT lang, word, count(*) AS count FROM tok GROUP BY ALL)
    SELECT lang, word, count, CAST(rank AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY lang ORDER BY count DESC, word) AS rank FROM c) WHERE rank <= 20
    """,
)
def top_words(spark, d):
    """The report of the most frequent words of each language."""
    return W.top_counts(token_rows(spark, d), ["lang"], "word", 20)


FINGER = f"""
WITH {TOKENS}, c AS (SELECT source, word, count(*) AS count FROM tok GROUP BY ALL),
top AS (SELECT source, word, count FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY count DESC, word) AS rn FROM c) WHERE rn <= 10)
"""


def _fingerprint(spark, d):
    counts = token_rows(spark, d).groupBy("source", "word").agg(F.count("*").alias("count"))
    return W.fingerprint(counts, "source", "word", "count", 10)


@query("W04_topic_fingerprint", FINGER + "SELECT * FROM top")
def fingerprint(spark, d):
    return _fingerprint(spark, d)[0]


@query("W04_fingerprint_totals", FINGER + "SELECT source, CAST(sum(count) AS BIGINT) AS totalcount FROM top GROUP BY source")
def fingerprint_totals(spark, d):
    return _fingerprint(spark, d)[1]


@query(
    "W05_secondary_sort",
    "SELECT o_custkey, o_totalprice, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey",
)
def secondary_sort(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_totalprice", "o_orderkey")
    return W.secondary_sort(o, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()])


@query(
    "W06_rank_with_ties",
    f"WITH {COUNTS} SELECT word, year, count, rank() OVER (ORDER BY word) AS rank FROM counts",
)
def rank_ties(spark, d):
    return R.rank_by(year_table(spark, d), "word")


@query(
    "W07_global_score_rank",
    """
    WITH s AS (SELECT o_custkey, round(sum(o_totalprice), 2) AS score FROM orders GROUP BY ALL)
    SELECT o_custkey, score, row_number() OVER (ORDER BY score DESC, o_custkey) AS rank FROM s
    """,
)
def score_rank(spark, d):
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("score"))
    return R.score_rank(s, "score", ["o_custkey"])


@query(
    "W08_percent_of_total",
    """
    WITH c AS (SELECT CAST(ts AS DATE) AS day, event_type, sum(value) AS v FROM events GROUP BY ALL)
    SELECT day, event_type, round(100 * v / sum(v) OVER (PARTITION BY day), 6) AS percent FROM c
    """,
)
def percent_total(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return W.percent_of_total(e, "day", "event_type", "value").withColumn("percent", F.round("percent", 6))


@query(
    "W09_previous_window",
    """
    WITH c AS (SELECT date_trunc('day', ts)::TIMESTAMP AS ts, event_type, round(sum(value), 4) AS v FROM events GROUP BY ALL)
    SELECT a.ts, a.event_type, a.v, b.v AS previous FROM c a LEFT JOIN c b ON a.event_type = b.event_type AND a.ts = b.ts + INTERVAL 7 DAYS
    """,
)
def previous_window(spark, d):
    e = table(spark, d, "events").select(F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("ts"), "event_type", "value")
    daily = e.groupBy("ts", "event_type").agg(F.round(F.sum("value"), 4).alias("v"))
    return W.with_previous_window(daily, ["event_type"], "ts", "v", 7 * 86400)


def _with_nulls(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        "o_orderkey", F.nullif("o_orderpriority", F.lit("2-HIGH")).alias("prio"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("price")
    )


WITH_NULLS = """
WITH o AS (SELECT o_orderkey, nullif(o_orderpriority, '2-HIGH') AS prio, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS price FROM orders)
"""


@query(
    "O01_null_order_smallest",
    WITH_NULLS + "SELECT o_orderkey, row_number() OVER (ORDER BY prio ASC NULLS FIRST, price DESC NULLS LAST, o_orderkey) - 1 AS position FROM o",
)
def nulls_smallest(spark, d):
    keys = [O.SortKey("prio"), O.SortKey("price", descending=True), O.SortKey("o_orderkey")]
    return R.with_position(_with_nulls(spark, d), O.sort_columns(keys)).select("o_orderkey", "position")


@query(
    "O02_order_text",
    WITH_NULLS + "SELECT o_orderkey, row_number() OVER (ORDER BY prio ASC NULLS LAST, price DESC NULLS FIRST, o_orderkey DESC) - 1 AS position FROM o",
)
def order_text(spark, d):
    columns = O.sort_columns("prio:null_biggest, price:desc|null_biggest, o_orderkey:desc")
    return R.with_position(_with_nulls(spark, d), columns).select("o_orderkey", "position")


@query(
    "O03_source_order",
    """
    WITH r AS (SELECT c_nationkey AS nation, 0 AS ix, c_name AS name, c_acctbal AS amount FROM customer
      UNION ALL SELECT s_nationkey, 1, s_name, s_acctbal FROM supplier)
    SELECT nation, name, row_number() OVER (ORDER BY nation, ix, CASE WHEN ix = 0 THEN amount END DESC NULLS LAST, name) - 1 AS position FROM r
    """,
)
def source_order(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("amount"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    rows = tagged_union({"customers": c, "suppliers": s})
    order = [F.col("nation").asc(), F.col("source_ix").asc(), F.col("amount").desc_nulls_last(), F.col("name").asc()]
    return R.with_position(rows, order).select("nation", "name", "position")


@query(
    "O03_source_between_fields",
    """
    WITH r AS (SELECT c_nationkey AS nation, CAST(floor(c_acctbal / 1000) AS BIGINT) AS band, 0 AS ix, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer
      UNION ALL SELECT s_nationkey, CAST(floor(s_acctbal / 1000) AS BIGINT), 1, s_name, NULL, s_acctbal FROM supplier)
    SELECT nation, band, name, row_number() OVER (ORDER BY nation, band DESC, ix DESC, name, CASE WHEN ix = 0 THEN segment END NULLS FIRST, CASE WHEN ix = 1 THEN balance END DESC NULLS LAST) - 1 AS position FROM r
    """,
)
def source_between(spark, d):
    """The source stands between two common fields of the order text; each source has an order of its own behind them."""
    band = lambda c: F.floor(F.col(c) / 1000).alias("band")
    customers = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), band("c_acctbal"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    suppliers = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), band("s_acctbal"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    rows, order = G.cogroup_rows(
        {"customers": customers, "suppliers": suppliers}, ["nation"], "nation, band:desc, source_ix:desc, name",
        specific_order={"customers": "segment", "suppliers": "balance:desc"},
    )
    return R.with_position(rows, order).select("nation", "band", "name", "position")


@query(
    "O04_order_and_group_by_nested_field",
    "SELECT brand, size, n, row_number() OVER (ORDER BY size DESC, brand) - 1 AS position FROM "
    "(SELECT p_brand AS brand, p_size AS size, count(*) AS n FROM part GROUP BY ALL)",
)
def nested_order(spark, d):
    p = table(spark, d, "part").select(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).alias("about"))
    grouped = p.groupBy(F.col("about.brand").alias("brand"), F.col("about.size").alias("size")).agg(F.count("*").alias("n"))
    return R.with_position(grouped, [F.col("size").desc(), F.col("brand").asc()])


@query(
    "O05_default_order",
    "SELECT l_returnflag, l_linestatus, n, row_number() OVER (ORDER BY l_returnflag NULLS FIRST, l_linestatus NULLS FIRST) - 1 AS position FROM "
    "(SELECT nullif(l_returnflag, 'A') AS l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL)",
)
def default_order(spark, d):
    li = table(spark, d, "lineitem").withColumn("l_returnflag", F.nullif("l_returnflag", F.lit("A")))
    counts = li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return R.with_position(counts, O.sort_columns(O.default_order(["l_returnflag", "l_linestatus"])))


@query(
    "O06_custom_partitioning",
    """
    SELECT c_nationkey, count(DISTINCT c_mktsegment) AS groups, count(*) AS n, round(max(c_acctbal), 2) AS highest, 1 AS partitions FROM customer GROUP BY ALL
    """,
)
def custom_partitioning(spark, d):
    """Groups of nation and segment, dealt by nation alone into a number of partitions of the caller's."""

    def summarise(key, batches):
        rows, highest = 0, None
        for b in batches:
            rows, highest = rows + len(b), b["c_acctbal"].iloc[0] if highest is None else highest
        yield *key, rows, float(highest), TaskContext.get().partitionId()

    c = table(spark, d, "customer").select("c_nationkey", "c_mktsegment", "c_acctbal")
    groups = G.reduce_groups(
        c, ["c_nationkey", "c_mktsegment"], summarise, "c_nationkey int, c_mktsegment string, n long, highest double, part int", order="c_acctbal:desc",
        partition_fields=["c_nationkey"], partitions=12,
    )
    return groups.groupBy("c_nationkey").agg(
        F.count("*").alias("groups"), F.sum("n").alias("n"), F.round(F.max("highest"), 2).alias("highest"), F.count_distinct("part").cast("int").alias("partitions")
    )


@query(
    "O07_scores_descending",
    f"""
    WITH {TOKENS}, s AS (SELECT source, count(DISTINCT word) AS score FROM tok GROUP BY source)
    SELECT source, score FROM s ORDER BY score DESC, source
    """,
)
def scores_descending(spark, d):
    words = token_rows(spark, d).select("source", "word").distinct()
    return words.groupBy("source").agg(F.count("*").alias("score")).orderBy(F.col("score").desc(), "source")


@query("O08_order_by_year", "SELECT o_orderdate, o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders")
def order_by_year(spark, d):
    o = table(spark, d, "orders").select("o_orderdate", "o_orderkey")
    return R.with_position(o, [F.col("o_orderdate").asc(), F.col("o_orderkey").asc()])


@query("O09_top_three", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3")
def top_three(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return o.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(3)


@query("O10_checked_group_job", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL")
def checked_job(spark, d):
    """The builder checks accept this job; tests cover what they reject."""
    c = table(spark, d, "customer")
    keys = O.check_job({"customers": c}, ["c_mktsegment", "c_nationkey"], "c_nationkey:desc, c_mktsegment", "c_nationkey")
    return c.groupBy(*[k.name for k in keys]).agg(F.count("*").alias("n"))


@query(
    "O10_specific_orders",
    """
    WITH r AS (SELECT o_custkey AS customer, 1 AS ix, o_orderkey, o_totalprice, o_orderdate, NULL AS name FROM orders
      UNION ALL SELECT c_custkey, 0, NULL, NULL, NULL, c_name FROM customer)
    SELECT customer, name, o_orderkey, row_number() OVER (ORDER BY customer, ix, CASE WHEN ix = 1 THEN o_orderdate END DESC, o_orderkey) - 1 AS position FROM r
    """,
)
def specific_orders(spark, d):
    """A checked job of two sources: the customer first, then the orders, newest first."""
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("customer"), F.col("c_name").alias("name"))
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    rows, order = G.cogroup_rows(
        {"customers": customers, "orders": orders}, ["customer"], "customer, source_ix", specific_order={"orders": "o_orderdate:desc, o_orderkey"},
        aliases={"orders": {"customer": "o_custkey"}},
    )
    return R.with_position(rows, order).select("customer", "name", "o_orderkey", "position")


@query(
    "O11_hosts_by_metric",
    f"""
    WITH {METRICS} SELECT host, up, value FROM (
      SELECT host, CAST(split_part(host, '-', 3) AS INTEGER) % 4 <> 0 AS up, value FROM l WHERE metric = 'click')
    ORDER BY up, value DESC, host LIMIT 20
    """,
)
def hosts_by_metric(spark, d):
    snap = M.latest(metric_table(spark, d)).where("metric = 'click'")
    up = F.split("host", "-")[2].cast("int") % 4 != 0
    return M.order_hosts(snap.select("host", up.alias("up"), "value"), "descending", 20)


@query(
    "O11_hosts_by_natural_name",
    "SELECT host, row_number() OVER (ORDER BY r, n) - 1 AS position FROM (SELECT DISTINCT 'compute-' || user_id % 12 || '-' || user_id AS host, user_id % 12 AS r, user_id AS n FROM events)",
)
def hosts_by_name(spark, d):
    hosts = table(spark, d, "events").select(F.concat(F.lit("compute-"), F.col("user_id") % 12, F.lit("-"), "user_id").alias("host")).distinct()
    return R.with_position(hosts, [c.asc() for c in O.natural_key(F.col("host"))])


@query(
    "O12_enum_order",
    """
    SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, o_orderkey) - 1 AS position FROM orders
    """,
)
def enum_order(spark, d):
    """An enum sorts by its declared order, not by its text."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    target = S.schema([o.schema["o_orderkey"], S.field("o_orderstatus", "enum", nullable=True, values=["P", "O", "F"])])
    columns = O.sort_columns("o_orderstatus, o_orderkey", target)
    return R.with_position(o, columns).select("o_orderkey", "position")
