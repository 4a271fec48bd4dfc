"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstat.operators import grouping as G
from loomstat.operators import joins as J
from loomstat.operators.pairs import pair_sums
from loomstat.operators.ranking import with_position
from loomstat.plans import years as Y
from loomstat.registry.base import (
    COUNTS, METRICS, RATINGS, metric_table, phrases, query, ratings_table, table, token_rows, year_counts, year_table,
)
from loomstat.registry.rows import PHRASE_VECTORS


def _pay_sources(spark, d):
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.length("n_name").alias("salary"))
    people = table(spark, d, "customer").select(
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("money"), F.nullif("c_nationkey", F.lit(3)).alias("home")
    )
    return {"nations": nations, "people": people}


@query(
    "J01_cogroup_in_order",
    """
    WITH rows AS (
      SELECT n_nationkey AS nation, 0 AS source_ix, CAST(length(n_name) AS INTEGER) AS salary, NULL AS name, NULL::DOUBLE AS money FROM nation
      UNION ALL SELECT nullif(c_nationkey, 3), 1, NULL, c_name, c_acctbal FROM customer)
    SELECT *, row_number() OVER (ORDER BY nation NULLS FIRST, source_ix DESC, money NULLS FIRST, name) - 1 AS position FROM rows
    """,
)
def cogroup_in_order(spark, d):
    """Two sources per key: people by money first, then the nation's own row."""
    rows, order = G.cogroup_rows(
        _pay_sources(spark, d), ["nation"], aliases={"people": {"nation": "home"}},
        specific_order={"people": "money, name"}, source_descending=True,
    )
    return with_position(rows, order)


@query(
    "J01_cogroup_reducer",
    """
    SELECT n_nationkey AS nation, count(c_name) AS people, max(CAST(length(n_name) AS BIGINT)) AS salary, round(sum(c_acctbal), 2) AS money
    FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY ALL
    """,
)
def cogroup_reducer(spark, d):
    sources = _pay_sources(spark, d)
    sources["people"] = table(spark, d, "customer").select(
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("money"), F.col("c_nationkey").alias("home")
    )

    def summarise(key, batches):
        people, money, salary = 0, 0.0, None
        for b in batches:
            mine = b[b["source_ix"] == 1]
            people += int(mine["n"].sum())
            money += float(mine["money"].sum())
            found = b.loc[b["source_ix"] == 0, "salary"]
            salary = int(found.iloc[-1]) if len(found) else salary
        yield key[0], people, salary, round(money, 2) if people else None

    # Only sums matter here, so people shrink to one row a nation and task before they move.
    combine = lambda people: people.groupBy("home").agg(F.count("name").alias("n"), F.sum("money").alias("money"))
    return G.reduce_cogroups(
        sources, ["nation"], summarise, "nation int, people long, salary long, money double",
        aliases={"people": {"nation": "home"}}, combiners={"people": combine},
    )


class StatusTotals(G.CogroupState):
    """Orders and lines of a status: rows and largest price of each source."""

    def zero(self, source):
        return 0, None

    def add(self, source, state, rows):
        return self.merge(source, state, (len(rows), float(rows["price"].max())))

    def merge(self, source, state, other):
        highest = [p for p in (state[1], other[1]) if p is not None]
        return state[0] + other[0], max(highest, default=None)

    def close(self, key, states):
        orders, lines = (states.get(name, (None, None)) for name in ("orders", "lines"))
        yield key[0], *orders, *lines


@query(
    "J01_cogroup_states",
    """
    WITH o AS (SELECT o_orderstatus AS status, count(*) AS orders, max(o_totalprice) AS dearest_order FROM orders GROUP BY ALL),
    l AS (SELECT l_linestatus AS status, count(*) AS lines, max(l_extendedprice) AS dearest_line FROM lineitem GROUP BY ALL)
    SELECT status, orders, dearest_order, lines, dearest_line FROM o FULL JOIN l USING (status)
    """,
)
def cogroup_states(spark, d):
    """Three keys, one in the orders only: each is spread over many tasks and its states merge."""
    sources = {
        "orders": table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")),
        "lines": table(spark, d, "lineitem").select(F.col("l_linestatus").alias("state"), F.col("l_extendedprice").alias("price")),
    }
    schema = "status string, orders long, dearest_order double, lines long, dearest_line double"
    return G.cogroup_states(sources, ["status"], StatusTotals(), schema, aliases={"lines": {"status": "state"}})


@query(
    "J02_url_resolution",
    """
    WITH h AS (SELECT source || '/' || doc_id AS url, doc_id AS timestamp, n_chars AS size FROM documents),
    map AS (SELECT source || '/' || doc_id AS nc, 'good/' || quality AS canonical FROM documents JOIN labels USING (doc_id)
      UNION ALL SELECT source || '/' || doc_id, 'clean/' || toxic FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
    one AS (SELECT nc, max(canonical) AS canonical FROM map GROUP BY nc)
    SELECT h.url AS original, canonical AS url, timestamp, size FROM h LEFT JOIN one ON h.url = nc
    """,
)
def url_resolution(spark, d):
    """Labels cover some documents only, and some of them twice: unmapped urls stay, none is multiplied."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    url = F.concat_ws("/", "source", "doc_id")
    hits = docs.select(url.alias("url"), F.col("doc_id").alias("timestamp"), F.col("n_chars").alias("size"))
    known = docs.select("doc_id", url.alias("nc")).join(labels, "doc_id")
    mapping = known.select("nc", F.concat(F.lit("good/"), F.col("quality")).alias("canonical")).unionByName(
        known.where("quality = 1").select("nc", F.concat(F.lit("clean/"), F.col("toxic")).alias("canonical"))
    )
    return J.resolve(hits, mapping, "url", "nc", "canonical", "timestamp")


@query(
    "J03_fan_out_with_array",
    """
    WITH q AS (SELECT item_id, unnest(string_split(text, ' ')) AS word FROM benchmark),
    p AS (SELECT word, list_sort(list(DISTINCT lang)) AS langs FROM (SELECT lang, unnest(string_split_regex(text, '[ \\t\\n\\r\\f]+')) AS word FROM documents) GROUP BY word)
    SELECT item_id, q.word, len(p.langs) AS n_langs, array_to_string(p.langs, '|') AS all_langs FROM q LEFT JOIN p USING (word) WHERE q.word <> ''
    """,
)
def fan_out(spark, d):
    """Every word of the benchmark with the languages that use it; many are in no document."""
    words = table(spark, d, "benchmark").select("item_id", F.explode(F.split("text", " ")).alias("word")).where("word <> ''")
    langs = token_rows(spark, d).groupBy("word").agg(F.sort_array(F.collect_set("lang")).alias("langs"))
    rows = J.fan_out(words, langs, "word", "word", ["langs"])
    n = F.when(F.col("langs").isNotNull(), F.size("langs").cast("bigint"))
    return rows.select("item_id", "word", n.alias("n_langs"), F.array_join("langs", "|").alias("all_langs"))


@query(
    "J04_lookup_with_default",
    f"""
    WITH {COUNTS}, n AS (SELECT count(DISTINCT year) AS n FROM counts),
    idf AS (SELECT word, CAST(((SELECT n FROM n) - count(*) + 0.5) / (count(*) + 0.5) AS DOUBLE) AS idf FROM counts GROUP BY word),
    q AS (SELECT conv_id, turn, word, count(*) AS n FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word FROM conversations) WHERE word <> '' GROUP BY ALL)
    SELECT conv_id, turn, round(sum(n * coalesce(idf, -1)), 3) AS weight, count(*) FILTER (idf IS NULL) AS unknown FROM q LEFT JOIN idf USING (word) GROUP BY ALL
    """,
)
def lookup_default(spark, d):
    """Words of conversations by their weight in the documents; a word that is in none counts as -1."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.split("text", " ")).alias("word")).where("word <> ''")
    counted = turns.groupBy("conv_id", "turn", "word").agg(F.count("*").alias("n"))
    joined = J.lookup(counted, Y.idf_model(year_table(spark, d)), "word", "word", "idf", F.lit(-1.0))
    weight = F.sum(F.col("n") * F.col("idf"))
    return joined.groupBy("conv_id", "turn").agg(F.round(weight, 3).alias("weight"), F.count_if("missed").alias("unknown"))


@query(
    "J05_rows_with_totals_full_outer",
    """
    WITH e AS (SELECT user_id AS key, count(*) AS events, round(sum(value), 2) AS value FROM events GROUP BY ALL),
    o AS (SELECT o_custkey + 100 AS key, count(*) AS orders FROM orders GROUP BY ALL)
    SELECT key, coalesce(events, 0) AS events, value, coalesce(orders, 0) AS orders FROM e FULL JOIN o USING (key)
    """,
)
def totals_outer(spark, d):
    """Users of the events beside customers with orders, whose numbers begin at 100: each side has keys of its own."""
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("value"))
    o = table(spark, d, "orders").groupBy((F.col("o_custkey") + 100).alias("key")).agg(F.count("*").alias("orders"))
    return J.outer_by_key(e, o, "key").na.fill(0, ["events", "orders"])


@query(
    "J06_normalise_by_magnitude",
    f"""
    WITH {COUNTS}, mags AS (SELECT year, sqrt(sum(count * count)) AS mag FROM counts GROUP BY year)
    SELECT word, year, round(count / mag, 9) AS share FROM counts JOIN mags USING (year)
    """,
)
def normalise_magnitude(spark, d):
    counts = year_table(spark, d)
    mags = counts.groupBy("year").agg(F.sqrt(F.sum(F.col("count") * F.col("count"))).alias("mag"))
    return counts.join(mags, "year").select("word", "year", F.round(F.col("count") / F.col("mag"), 9).alias("share"))


@query(
    "J07_dictionary_lookup",
    f"""
    WITH {COUNTS}, q AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS term FROM benchmark)
    SELECT word AS term, count(*) AS n_years, CAST(sum(count) AS BIGINT) AS total FROM counts JOIN q ON word = term WHERE term <> '' GROUP BY ALL
    """,
)
def dictionary_lookup(spark, d):
    known = Y.phrase_terms(phrases(spark, d)).select("term").distinct()
    counts = year_counts(spark, d).withColumnRenamed("word", "term")
    return counts.join(known, "term").groupBy("term").agg(F.count("*").alias("n_years"), F.sum("count").alias("total"))


@query(
    "J08_semi_and_anti",
    """
    SELECT c_mktsegment, count(*) FILTER (c_custkey IN (SELECT user_id FROM events)) AS active,
      count(*) FILTER (c_custkey NOT IN (SELECT user_id FROM events)) AS rest FROM customer GROUP BY ALL
    """,
)
def semi_anti(spark, d):
    """Customers with events, and most of them without."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    keys = table(spark, d, "events").select(F.col("user_id").alias("c_custkey"))
    semi = c.join(keys, "c_custkey", "left_semi").select("c_mktsegment", F.lit(1).alias("a"), F.lit(0).alias("b"))
    anti = c.join(keys, "c_custkey", "left_anti").select("c_mktsegment", F.lit(0).alias("a"), F.lit(1).alias("b"))
    return semi.unionByName(anti).groupBy("c_mktsegment").agg(F.sum("a").alias("active"), F.sum("b").alias("rest"))


@query(
    "J09_vectors_with_missing_terms",
    f"""
    WITH {COUNTS}, {PHRASE_VECTORS}, grid AS (SELECT DISTINCT query_id, year FROM (SELECT DISTINCT query_id FROM pv) CROSS JOIN (SELECT DISTINCT year FROM counts)),
    q2 AS (SELECT query_id, sum(q * q) AS s FROM pv GROUP BY query_id), y2 AS (SELECT year, sum(count * count) AS s FROM counts GROUP BY year),
    d AS (SELECT query_id, year, sum(q * count) AS s FROM pv JOIN counts USING (word) GROUP BY ALL)
    SELECT query_id, year, CAST(q2.s + y2.s - 2 * coalesce(d.s, 0) AS BIGINT) AS squared, d.s IS NOT NULL AS shared
      FROM grid JOIN q2 USING (query_id) JOIN y2 USING (year) LEFT JOIN d USING (query_id, year)
    """,
)
def missing_terms(spark, d):
    """Squared distance of raw count vectors; terms may be missing on either side."""
    return Y.squared_distances(year_table(spark, d), phrases(spark, d), whole=True)


@query(
    "J10_co_rated_pairs",
    f"""
    WITH {RATINGS} SELECT a.i AS a, b.i AS b, CAST(count(*) AS DOUBLE) AS n, CAST(sum(a.x) AS DOUBLE) AS sx, CAST(sum(b.x) AS DOUBLE) AS sy,
      sum(a.x * a.x) AS sxx, sum(b.x * b.x) AS syy, sum(a.x * b.x) AS sxy
    FROM r a JOIN r b ON a.u = b.u AND a.i < b.i GROUP BY 1, 2
    """,
)
def co_rated(spark, d):
    return pair_sums(ratings_table(spark, d), "item", "user", "rating")


@query(
    "J10_co_rated_with_asked",
    f"""
    WITH {RATINGS}, asked AS (SELECT s_suppkey AS i FROM supplier WHERE s_acctbal < 5000)
    SELECT a.i AS a, b.i AS b, CAST(count(*) AS DOUBLE) AS n, CAST(sum(a.x) AS DOUBLE) AS sx, CAST(sum(b.x) AS DOUBLE) AS sy,
      sum(a.x * a.x) AS sxx, sum(b.x * b.x) AS syy, sum(a.x * b.x) AS sxy
    FROM (SELECT * FROM r SEMI JOIN asked USING (i)) a JOIN r b ON a.u = b.u AND a.i <> b.i GROUP BY 1, 2
    """,
)
def co_rated_with_asked(spark, d):
    """Suppliers with a small balance against all others."""
    asked = table(spark, d, "supplier").where("s_acctbal < 5000").select(F.col("s_suppkey").alias("item"))
    return pair_sums(ratings_table(spark, d), "item", "user", "rating", asked=asked)


@query(
    "J11_regex_rules",
    f"""
    WITH {METRICS}, rules AS (SELECT 'e-' || (n_nationkey % 10) || '-.*' || (n_nationkey % 4) || '$' AS hp,
        CASE WHEN n_regionkey = 0 THEN NULL ELSE substr('VCPES', n_regionkey + 1, 1) || '.*[kr]' END AS mp, n_name FROM nation),
    c AS (SELECT DISTINCT host, metric FROM m)
    SELECT host, metric, n_name FROM c JOIN rules ON regexp_matches(host, '(?i)' || hp) AND (mp IS NULL OR regexp_matches(metric, '(?i)' || mp))
    """,
)
def regex_rules(spark, d):
    n = table(spark, d, "nation")
    rules = n.select(
        F.concat(F.lit("e-"), F.col("n_nationkey") % 10, F.lit("-.*"), F.col("n_nationkey") % 4, F.lit("$")).alias("hp"),
        F.when(F.col("n_regionkey") != 0, F.concat(F.substring(F.lit("VCPES"), F.col("n_regionkey") + 1, F.lit(1)), F.lit(".*[kr]"))).alias("mp"),
        "n_name",
    )
    catalog = metric_table(spark, d).select("host", "metric")
    return J.regex_matches(catalog, rules, [("host", "hp"), ("metric", "mp")]).select("host", "metric", "n_name")


EVENT_ROWS = """
ev AS (SELECT event_id, ts AS start_ts, CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts + to_hours(event_id % 48) END AS end_ts,
         'compute-' || (user_id % 3) || '-' AS host_regex FROM events)
"""


def dated_events(spark, d):
    """``events`` as spans: three of four have an end some hours later."""
    e = table(spark, d, "events")
    hours = F.make_dt_interval(F.lit(0), (F.col("event_id") % 48).cast("int"))
    return e.select(
        "event_id",
        F.col("ts").alias("start_ts"),
        F.when(F.col("event_id") % 4 != 0, F.col("ts") + hours).alias("end_ts"),
        F.concat(F.lit("compute-"), F.col("user_id") % 3, F.lit("-")).alias("host_regex"),
    )


@query(
    "J12_events_in_window",
    f"""
    WITH {EVENT_ROWS} SELECT event_id, greatest(start_ts, TIMESTAMP '2024-01-10') AS clip_start,
      CASE WHEN end_ts IS NOT NULL THEN least(end_ts, TIMESTAMP '2024-01-12') END AS clip_end,
      start_ts >= TIMESTAMP '2024-01-10' AS starts_inside FROM ev
    WHERE CASE WHEN end_ts IS NULL THEN start_ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'
          ELSE end_ts >= TIMESTAMP '2024-01-10' AND start_ts <= TIMESTAMP '2024-01-12' END
      AND regexp_matches('compute-1-7', host_regex)
    """,
)
def events_in_window(spark, d):
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    out = J.touching(dated_events(spark, d), at("2024-01-10 00:00:00"), at("2024-01-12 00:00:00"), F.lit("compute-1-7"))
    return out.select("event_id", "clip_start", "clip_end", "starts_inside")


SPANS = """
sp AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + CASE WHEN event_id % 4 = 0 THEN 0
         WHEN event_id % 2500 = 1 THEN 31536000 ELSE (event_id * 37) % 120 END AS e FROM events)
"""


@query(
    "J12_overlap_join",
    f"""
    WITH {SPANS}, o AS (SELECT event_id AS other, CAST(floor(epoch(ts)) AS BIGINT) AS os, CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(value) AS BIGINT) % 60 AS oe FROM events)
    SELECT event_id, other, greatest(s, os) AS first, least(e, oe) AS last FROM sp JOIN o ON s <= oe AND os <= e AND event_id <> other
    """,
)
def overlap(spark, d):
    """Every pair of events that overlap: moments (no end), spans of seconds and, now and then, one of a year."""
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    events = table(spark, d, "events")
    length = F.when(F.col("event_id") % 2500 == 1, F.lit(365 * 86_400)).otherwise((F.col("event_id") * 37) % 120)
    end = F.when(F.col("event_id") % 4 != 0, at + length)
    spans = events.select("event_id", at.alias("s"), end.alias("e"))
    others = events.select(F.col("event_id").alias("other"), at.alias("os"), (at + F.floor("value") % 60).alias("oe"))
    pairs = J.overlap_join(spans, others, ("s", "e"), ("os", "oe"), also=F.col("event_id") != F.col("other"))
    return pairs.select("event_id", "other", F.greatest("s", "os").alias("first"), F.least(F.coalesce("e", "s"), "oe").alias("last"))


@query(
    "J12_events_from_a_time_on",
    f"""
    WITH {EVENT_ROWS} SELECT event_id, greatest(start_ts, TIMESTAMP '2024-01-28') AS clip_start, end_ts AS clip_end, start_ts >= TIMESTAMP '2024-01-28' AS starts_inside
    FROM ev WHERE coalesce(end_ts, start_ts) >= TIMESTAMP '2024-01-28'
    """,
)
def events_from(spark, d):
    """A window that is open at its end."""
    out = J.touching(dated_events(spark, d), F.lit("2024-01-28 00:00:00").cast("timestamp_ntz"))
    return out.select("event_id", "clip_start", "clip_end", "starts_inside")
