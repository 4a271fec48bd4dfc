"""Aggregation, rollup and hook queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstat.functions import schema as S
from loomstat.operators import grouping as G
from loomstat.operators import metrics as M
from loomstat.operators import ranking as R
from loomstat.operators import windows as W
from loomstat.plans import vectors as V
from loomstat.plans import years as Y
from loomstat.registry.base import COUNTS, METRICS, TOKENS, as_of, documents, metric_table, query, table, token_rows, year_counts


@query("A01_topical_word_count", f"WITH {TOKENS} SELECT lang, word, count(*) AS count FROM tok GROUP BY ALL")
def topical_word_count(spark, d):
    """How often each language uses each word; the most frequent ones are W03's."""
    return G.group_count(token_rows(spark, d), ["lang", "word"])


@query(
    "A01_group_sum",
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice), 2) AS price, count(*) AS n FROM lineitem GROUP BY ALL",
)
def group_sum(spark, d):
    out = G.group_sum(
        table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], {"quantity": "l_quantity", "price": "l_extendedprice"}, count="n"
    )
    return out.withColumns({"quantity": F.round("quantity", 2), "price": F.round("price", 2)})


@query(
    "A02_combined_group_reduce",
    "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL",
)
def combined_reduce(spark, d):
    """A reducer fed by pre-aggregated rows: the combiner runs before the hook."""

    def combine(df):
        return df.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))

    def finish(key, batches):
        n, total = 0, 0.0
        for b in batches:
            n, total = n + int(b["n"].sum()), total + float(b["total"].sum())
        yield key[0], n, total

    o = table(spark, d, "orders").select("o_custkey", "o_totalprice")
    out = G.reduce_groups(o, ["o_custkey"], finish, "o_custkey long, n long, total double", combiner=combine)
    return out.withColumn("total", F.round("total", 2))


@query("A03_years_per_word", f"WITH {COUNTS} SELECT word, count(*) AS n_years_with FROM counts GROUP BY word")
def years_per_word(spark, d):
    return Y.years_per_word(year_counts(spark, d))


@query(
    "A04_unique_and_total_words",
    f"WITH {COUNTS} SELECT year, count(*) AS unique_words, CAST(sum(count) AS BIGINT) AS total_words FROM counts GROUP BY year",
)
def unique_total(spark, d):
    return Y.year_totals(year_counts(spark, d))


@query("A05_number_of_groups", f"WITH {COUNTS} SELECT count(DISTINCT year) AS n_years FROM counts")
def number_of_groups(spark, d):
    return Y.year_count(year_counts(spark, d))


@query(
    "A06_global_average",
    f"WITH {COUNTS}, t AS (SELECT year, sum(count) AS n FROM counts GROUP BY year) SELECT round(avg(n), 6) AS avg_words FROM t",
)
def global_average(spark, d):
    return Y.average_words(Y.year_totals(year_counts(spark, d))).select(F.round("avg_words", 6).alias("avg_words"))


@query(
    "A07_clean_and_sum",
    f"""
    WITH {TOKENS} SELECT split_part(word, '_', 1) AS word, year, CAST(sum(n) AS BIGINT) AS count, CAST(sum(b) AS BIGINT) AS books FROM (
      SELECT word || '_' || lang AS word, source AS year, count(*) AS n, count(DISTINCT doc_id) AS b FROM tok GROUP BY ALL) GROUP BY 1, 2
    """,
)
def clean_sum(spark, d):
    per_doc = token_rows(spark, d).groupBy("word", "lang", "source", "doc_id").agg(F.count("*").alias("c"))
    raw = per_doc.groupBy(F.concat_ws("_", "word", "lang").alias("word"), F.col("source").alias("year")).agg(
        F.sum("c").alias("count"), F.count("*").alias("books")
    )
    return Y.clean_counts(raw)


@query(
    "A08_checked_square_sum",
    f"WITH {COUNTS} SELECT year, CAST(sum(count * count) AS BIGINT) AS square_sum FROM counts GROUP BY year",
)
def square_sum(spark, d):
    return G.checked_square_sum(year_counts(spark, d), ["year"], "count")


ROLLUP_ORDER = "l_returnflag, l_linestatus, l_suppkey, l_quantity:desc, l_orderkey, l_linenumber, l_partkey"


def _rollup_rows(spark, d):
    return table(spark, d, "lineitem").select(
        "l_returnflag", "l_linestatus", "l_suppkey", "l_quantity", "l_orderkey", "l_linenumber", "l_partkey"
    )


@query(
    "A09_rollup_events",
    """
    WITH n AS (SELECT *, row_number() OVER w AS place,
        lag(l_returnflag) OVER w AS p0, lag(l_linestatus) OVER w AS p1, lag(l_suppkey) OVER w AS p2,
        lead(l_returnflag) OVER w AS n0, lead(l_linestatus) OVER w AS n1, lead(l_suppkey) OVER w AS n2
      FROM lineitem WINDOW w AS (ORDER BY l_returnflag, l_linestatus, l_suppkey, l_quantity DESC, l_orderkey, l_linenumber, l_partkey)),
    e AS (SELECT 'ELEMENT' AS event, NULL::INTEGER AS depth, l_orderkey, l_linenumber, l_partkey, place, 3 AS step FROM n
      UNION ALL SELECT 'OPEN', 0, l_orderkey, l_linenumber, l_partkey, place, 0 FROM n WHERE p0 IS DISTINCT FROM l_returnflag
      UNION ALL SELECT 'OPEN', 1, l_orderkey, l_linenumber, l_partkey, place, 1 FROM n WHERE (p0, p1) IS DISTINCT FROM (l_returnflag, l_linestatus)
      UNION ALL SELECT 'OPEN', 2, l_orderkey, l_linenumber, l_partkey, place, 2 FROM n WHERE (p0, p1, p2) IS DISTINCT FROM (l_returnflag, l_linestatus, l_suppkey)
      UNION ALL SELECT 'CLOSE', 2, l_orderkey, l_linenumber, l_partkey, place, 4 FROM n WHERE (n0, n1, n2) IS DISTINCT FROM (l_returnflag, l_linestatus, l_suppkey)
      UNION ALL SELECT 'CLOSE', 1, l_orderkey, l_linenumber, l_partkey, place, 5 FROM n WHERE (n0, n1) IS DISTINCT FROM (l_returnflag, l_linestatus)
      UNION ALL SELECT 'CLOSE', 0, l_orderkey, l_linenumber, l_partkey, place, 6 FROM n WHERE n0 IS DISTINCT FROM l_returnflag)
    SELECT event, depth, l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY place, step) - 1 AS position FROM e
    """,
)
def rollup_events(spark, d):
    events = G.rollup_events(_rollup_rows(spark, d), ROLLUP_ORDER, ["l_returnflag", "l_linestatus", "l_suppkey"], "l_returnflag")
    return events.select("event", "depth", "l_orderkey", "l_linenumber", "l_partkey", F.col("seq").alias("position"))


@query(
    "A10_rollup_levels",
    """
    SELECT l_linestatus, l_returnflag, l_suppkey, CASE WHEN grouping(l_suppkey) = 0 THEN 2 ELSE 1 END AS depth,
      count(*) AS n, round(sum(l_quantity), 2) AS quantity
    FROM lineitem GROUP BY GROUPING SETS ((l_linestatus, l_returnflag), (l_linestatus, l_returnflag, l_suppkey))
    """,
)
def rollup_levels(spark, d):
    """Levels follow the sort order, which here is not the group field order."""
    return G.rollup_levels(
        table(spark, d, "lineitem"), "l_linestatus, l_returnflag, l_suppkey", ["l_returnflag", "l_suppkey", "l_linestatus"],
        "l_returnflag", {"n": F.count("*"), "quantity": F.round(F.sum("l_quantity"), 2)},
    )


@query(
    "A11_first_and_last_of_group",
    """
    SELECT l_suppkey, f.l_orderkey AS first_order, f.l_partkey AS first_part, z.l_orderkey AS last_order, z.l_partkey AS last_part FROM (
      SELECT l_suppkey, arg_min(r, rn) AS f, arg_max(r, rn) AS z FROM (
        SELECT l_suppkey, {'l_orderkey': l_orderkey, 'l_partkey': l_partkey} AS r,
          row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem)
      GROUP BY l_suppkey)
    """,
)
def first_last(spark, d):
    edges = G.group_edges(
        table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity:desc, l_orderkey, l_linenumber, l_partkey", ["l_orderkey", "l_partkey"]
    )
    return edges.select(
        "l_suppkey", F.col("first.l_orderkey").alias("first_order"), F.col("first.l_partkey").alias("first_part"),
        F.col("last.l_orderkey").alias("last_order"), F.col("last.l_partkey").alias("last_part"),
    )


EDGE_KEYS = "o_orderpriority, o_orderstatus, o_custkey"


def _edges_sql() -> str:
    """Every level by itself: first and last order of the group, status in its declared order, newest first."""
    order = "o_orderpriority, CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, o_custkey, o_orderdate DESC, o_orderkey DESC"
    levels = []
    for depth, fields in ((1, "o_orderpriority, o_orderstatus"), (2, EDGE_KEYS)):
        below = "o_custkey" if depth == 2 else "NULL::BIGINT"
        levels.append(
            f"SELECT {depth} AS depth, o_orderpriority, o_orderstatus, {below} AS o_custkey, arg_min(o_orderkey, place) AS first_order, arg_max(o_orderkey, place) AS last_order,"
            f" arg_min(o_orderdate, place) AS first_date, arg_max(o_orderdate, place) AS last_date FROM r GROUP BY {fields}"
        )
    return f"WITH r AS (SELECT *, row_number() OVER (ORDER BY {order}) AS place FROM orders) " + " UNION ALL ".join(levels)


@query("A11_first_and_last_of_every_level", _edges_sql())
def edges_of_levels(spark, d):
    """An enum in its declared order, and dates descending."""
    o = table(spark, d, "orders").select("o_orderpriority", "o_orderstatus", "o_custkey", "o_orderdate", "o_orderkey")
    declared = S.schema([S.field("o_orderstatus", "enum", nullable=True, values=["P", "O", "F"]) if f.name == "o_orderstatus" else f for f in o.schema])
    edges = G.rollup_edges(
        o, f"{EDGE_KEYS}, o_orderdate:desc, o_orderkey:desc", ["o_orderpriority", "o_orderstatus", "o_custkey"], "o_orderstatus", ["o_orderkey", "o_orderdate"], declared
    )
    return edges.select(
        "depth", "o_orderpriority", "o_orderstatus", "o_custkey", F.col("first.o_orderkey").alias("first_order"), F.col("last.o_orderkey").alias("last_order"),
        F.col("first.o_orderdate").alias("first_date"), F.col("last.o_orderdate").alias("last_date"),
    )


@query(
    "A12_ordered_group_reducer",
    """
    SELECT o_custkey, count(*) AS orders, CAST(sum(CASE WHEN prev IS NOT NULL AND o_totalprice > prev THEN 1 ELSE 0 END) AS BIGINT) AS rises FROM (
      SELECT o_custkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders)
    GROUP BY o_custkey
    """,
)
def ordered_reducer(spark, d):
    """A reducer that depends on the order: how often the price rose."""

    def rises(key, batches):
        orders = ups = 0
        last = None
        for b in batches:
            prices = b["o_totalprice"].to_numpy()
            if last is not None and len(prices):
                ups += int(prices[0] > last)
            ups += int((prices[1:] > prices[:-1]).sum())
            orders += len(prices)
            last = prices[-1] if len(prices) else last
        yield key[0], orders, ups

    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return G.reduce_groups(o, ["o_custkey"], rises, "o_custkey long, orders long, rises long", order="o_orderdate, o_orderkey")


@query(
    "A13_collocation_counts",
    r"""
    WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\r\f]+'), lambda x: x <> '') AS w FROM documents),
    p AS (SELECT w[i] AS head, w[i + 1] AS tail FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w)),
    g AS (SELECT head || ' ' || tail AS gram, head, tail, count(*) AS n FROM p GROUP BY ALL),
    h AS (SELECT head, CAST(sum(n) AS BIGINT) AS head_n FROM g GROUP BY head), t AS (SELECT tail, CAST(sum(n) AS BIGINT) AS tail_n FROM g GROUP BY tail)
    SELECT gram, head, tail, n, head_n, tail_n FROM g JOIN h USING (head) JOIN t USING (tail) WHERE n >= 2
    """,
)
def collocation_counts(spark, d):
    return V.gram_counts(documents(spark, d), "doc_id", "text", 2).where("n >= 2").drop("total")


@query(
    "A14_document_frequency",
    f"WITH {TOKENS} SELECT word AS term, count(DISTINCT doc_id) AS df FROM tok GROUP BY word",
)
def document_frequency(spark, d):
    return V.document_frequencies(V.term_frequencies(token_rows(spark, d).withColumnRenamed("word", "term"), "doc_id"))


def _steps(spark, d):
    """Latest values in steps of ten."""
    return M.latest(metric_table(spark, d)).withColumn("value", F.floor(F.col("value") / 10).cast("double"))


@query(
    "A15_value_agreement",
    f"""
    WITH {METRICS}, v AS (SELECT metric, floor(value / 10) AS value, host FROM l),
    p AS (SELECT metric, value, count(DISTINCT host) AS n_hosts FROM v GROUP BY ALL)
    SELECT metric, value, n_hosts, count(*) OVER (PARTITION BY metric) = 1 AS same FROM p
    """,
)
def value_agreement(spark, d):
    return M.value_agreement(_steps(spark, d))


@query(
    "A15_members_of_differing_values",
    f"""
    WITH {METRICS}, v AS (SELECT metric, floor(value / 10) AS value, host FROM l)
    SELECT metric, value, host FROM v WHERE metric IN (SELECT metric FROM v GROUP BY metric HAVING min(value) <> max(value))
    """,
)
def differing_members(spark, d):
    return M.disagreeing_members(_steps(spark, d))


@query(
    "A16_sum_and_extreme_hosts",
    f"""
    WITH {METRICS} SELECT metric, round(sum(value), 4) AS total, min(value) AS min_value,
      arg_min(host, (value, host)) AS min_host, max(value) AS max_value, arg_max(host, (value, host)) AS max_host FROM l GROUP BY metric
    """,
)
def extremes(spark, d):
    return M.host_extremes(M.latest(metric_table(spark, d))).withColumn("total", F.round("total", 4))


@query(
    "A17_series_limits_and_average",
    f"""
    WITH {METRICS} SELECT metric, least(min(value), 0) AS low, greatest(max(value), 0) AS high, round(avg(value), 6) AS average FROM m GROUP BY metric
    """,
)
def limits(spark, d):
    return M.series_limits(metric_table(spark, d), ["metric"], "average").withColumn("average", F.round("average", 6))


@query(
    "A18_percentile",
    f"""
    WITH {METRICS} SELECT metric, n, value AS percentile FROM (
      SELECT metric, value, row_number() OVER (PARTITION BY metric ORDER BY value) AS rn, count(*) OVER (PARTITION BY metric) AS n FROM m)
    WHERE rn = (n * 95 + 99) // 100
    """,
)
def percentile(spark, d):
    return R.nearest_rank(metric_table(spark, d), ["metric"], "value", 95)


@query(
    "A19_series_stats",
    """
    WITH m AS (SELECT event_type AS metric, ts, event_id, value - 20 AS value FROM events)
    SELECT metric, arg_max(greatest(value, 0), (ts, greatest(value, 0))) AS last, min(greatest(value, 0)) AS min,
      round(avg(greatest(value, 0)), 6) AS avg, max(greatest(value, 0)) AS max FROM m GROUP BY metric
    """,
)
def stats(spark, d):
    m = metric_table(spark, d).withColumn("value", F.col("value") - 20)
    return M.series_stats(m, ["metric"]).withColumn("avg", F.round("avg", 6))


@query(
    "A20_trend",
    f"""
    WITH {METRICS}, x AS (SELECT metric, value, row_number() OVER (PARTITION BY metric ORDER BY ts, value) AS i FROM m)
    SELECT metric, count(*) AS n, round(regr_slope(value, i), 8) AS slope, round(regr_intercept(value, i), 6) AS intercept,
      round(regr_intercept(value, i) + regr_slope(value, i) * (count(*) + 100), 6) AS projected FROM x GROUP BY metric
    """,
)
def trend(spark, d):
    t = M.trend(metric_table(spark, d), ["metric"], ahead=100)
    return t.select(
        "metric", "n", F.round("slope", 8).alias("slope"), F.round("intercept", 6).alias("intercept"), F.round("projected", 6).alias("projected")
    )


HOST_LOADS = f"""
{METRICS}, hl AS (SELECT host, ((CAST(floor(epoch(as_of)) AS BIGINT) - CAST(floor(epoch(last_ts)) AS BIGINT)) <= 86400) AS up,
  (SELECT l.value FROM l WHERE l.host = s.host AND l.metric = 'click') / 20 AS load FROM s, a)
"""


def host_loads(spark, d):
    """Each host with up/down (a day without report is down) and its last load."""
    m = metric_table(spark, d)
    up = M.age_seconds(F.col("last_ts"), as_of(m)) <= 86400
    loads = M.latest(m).where("metric = 'click'").select("host", (F.col("value") / 20).alias("load"))
    return M.last_seen(m).select("host", up.alias("up")).join(loads, "host", "left")


@query(
    "A21_load_histogram",
    f"""
    WITH {HOST_LOADS} SELECT CASE WHEN NOT up THEN 'down' WHEN load > 1 THEN '100+' WHEN load >= 0.75 THEN '75-100' WHEN load >= 0.5 THEN '50-75'
      WHEN load >= 0.25 THEN '25-50' WHEN load >= 0 THEN '0-25' ELSE 'down' END AS band, count(*) AS hosts FROM hl GROUP BY 1
    """,
)
def load_histogram(spark, d):
    return M.load_histogram(host_loads(spark, d))


@query("A22_sum_of_series", "SELECT date_trunc('hour', ts) AS ts, round(sum(value), 4) AS total FROM events GROUP BY 1")
def sum_series(spark, d):
    hourly = table(spark, d, "events").select(F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("ts"), "value")
    return M.sum_series(hourly).withColumn("total", F.round("total", 4))


@query(
    "A23_hosts_by_rack",
    f"""
    WITH {HOST_LOADS} SELECT host, up, CAST(split_part(host, '-', 2) AS INTEGER) AS rack, CAST(split_part(host, '-', 3) AS INTEGER) AS rank,
      0 AS plane, true AS known FROM hl
    """,
)
def racks(spark, d):
    hosts = host_loads(spark, d).select("host", "up", F.lit(None).cast("string").alias("location"))
    return M.racks(hosts)


@query(
    "A24_cluster_load",
    f"""
    WITH {METRICS}, h AS (SELECT host, split_part(host, '-', 2) AS cluster, sum(value) FILTER (metric = 'click') AS load,
      sum(value) FILTER (metric = 'view') AS cpu FROM l GROUP BY ALL)
    SELECT cluster, round(100 * sum(load) / CASE WHEN coalesce(sum(cpu), 0) = 0 THEN 1 ELSE sum(cpu) END, 6) AS load_percent,
      round(100 * avg(load) / CASE WHEN coalesce(avg(cpu), 0) = 0 THEN 1 ELSE avg(cpu) END, 6) AS utilisation FROM h GROUP BY cluster
    """,
)
def cluster_load(spark, d):
    snap = M.latest(metric_table(spark, d))
    one = lambda name: F.sum(F.when(F.col("metric") == name, F.col("value")))
    hosts = snap.groupBy("host").agg(one("click").alias("load"), one("view").alias("cpu"))
    out = M.cluster_load(hosts.withColumn("cluster", F.split("host", "-")[1]))
    return out.select("cluster", F.round("load_percent", 6).alias("load_percent"), F.round("utilisation", 6).alias("utilisation"))


class SteepestFall(G.RollupState):
    """Rows, sum, and the largest fall from one row to the next: the order of the rows matters, over all cuts."""

    def zero(self):
        return 0, 0.0, None, None, 0.0

    def add(self, state, rows):
        v = rows["l_quantity"].to_numpy()
        fall = float((v[:-1] - v[1:]).max(initial=0.0))
        return self.merge(state, (len(v), float(v.sum()), float(v[0]), float(v[-1]), fall))

    def merge(self, state, later):
        if not state[0] or not later[0]:
            return state if state[0] else later
        fall = max(state[4], later[4], state[3] - later[2])
        return state[0] + later[0], state[1] + later[1], state[2], later[3], fall

    def close(self, depth, field, key, state):
        key = [*key, *[None] * (3 - len(key))]
        yield depth, *key, state[0], round(state[1], 2), state[4]


def _falls_sql() -> str:
    levels = []
    for depth, fields in enumerate(("l_returnflag", "l_returnflag, l_linestatus", "l_returnflag, l_linestatus, l_suppkey")):
        shown = [n if n in fields else f"NULL AS {n}" for n in ("l_returnflag", "l_linestatus", "l_suppkey")]
        levels.append(
            f"SELECT {depth} AS depth, {', '.join(shown)}, count(*) AS n, round(sum(l_quantity), 2) AS quantity, greatest(max(coalesce(before - l_quantity, 0)), 0) AS fall FROM ("
            f"SELECT *, lag(l_quantity) OVER (PARTITION BY {fields} ORDER BY l_returnflag, l_linestatus, l_suppkey, l_quantity DESC, l_orderkey, l_linenumber, l_partkey) AS before FROM lineitem) GROUP BY {fields}"
        )
    return " UNION ALL ".join(levels)


@query("F04_rollup_reducer", _falls_sql())
def rollup_reducer(spark, d):
    """Every group of every level, over three flags, on all cores."""
    return G.rollup_states(
        _rollup_rows(spark, d), ROLLUP_ORDER, ["l_returnflag", "l_linestatus", "l_suppkey"], "l_returnflag", SteepestFall(),
        "depth int, l_returnflag string, l_linestatus string, l_suppkey long, n long, quantity double, fall double",
    )


class FlagTotals(G.RollupHooks):
    """Rollup hooks that add up quantities and answer when a status group closes."""

    def __init__(self):
        self.total = 0.0
        self.rows = 0

    def on_open(self, depth, field, row):
        if field == "l_linestatus":
            self.total, self.rows = 0.0, 0
        return iter(())

    def on_element(self, row):
        self.total += row["l_quantity"]
        self.rows += 1
        return iter(())

    def on_close(self, depth, field, row):
        if field == "l_linestatus":
            yield row["l_returnflag"], row["l_linestatus"], self.rows, self.total


@query(
    "F04_rollup_hooks",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL",
)
def rollup_hooks(spark, d):
    return G.rollup_hooks(
        _rollup_rows(spark, d), ROLLUP_ORDER, ["l_returnflag", "l_linestatus", "l_suppkey"], "l_returnflag", FlagTotals(),
        "l_returnflag string, l_linestatus string, n long, quantity double",
    )
