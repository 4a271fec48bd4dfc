"""Metric check queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstat.operators import metrics as M
from loomstat.registry.base import AGE, METRICS, as_of, metric_table, query, table

DAY = 86400

CHECK_ROWS = [("click", "more", 30.0), ("error", "less", 5.0), ("view", "equal", 10.0), ("absent", "more", 1.0)]
CHECK_SQL = "checks(metric, operator, limit_value) AS (VALUES ('click','more',30.0::DOUBLE), ('error','less',5.0), ('view','equal',10.0), ('absent','more',1.0))"
STATUS_SQL = """CASE WHEN l.value IS NULL THEN 'UNKNOWN' WHEN (operator = 'less' AND l.value > limit_value) OR (operator = 'more' AND l.value < limit_value)
  OR (operator = 'equal' AND l.value <> limit_value) OR (operator = 'notequal' AND l.value = limit_value) THEN 'OK' ELSE 'CRITICAL' END"""


def checks(spark):
    return spark.createDataFrame(CHECK_ROWS, "metric string, operator string, limit_value double")


@query(
    "C01_threshold_check",
    f"""
    WITH {METRICS}, asked AS (SELECT DISTINCT upper(host) AS host FROM m UNION ALL SELECT 'nowhere')
    SELECT a2.host, 'purchase' AS metric, l.value, CASE WHEN l.value IS NULL THEN 'UNKNOWN' WHEN l.value < 20 THEN 'OK' ELSE 'CRITICAL' END AS status
    FROM asked a2 LEFT JOIN l ON lower(a2.host) = lower(l.host) AND l.metric = 'purchase'
    """,
)
def threshold_check(spark, d):
    m = metric_table(spark, d)
    asked = m.select(F.upper("host").alias("host")).distinct().unionByName(spark.createDataFrame([("nowhere",)], "host string"))
    return M.check_one(M.latest(m), asked, "purchase", "more", 20.0)


@query(
    "C01_text_check",
    """
    WITH lt AS (SELECT user_id, props FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, props DESC) = 1),
    v AS (SELECT 'user-' || user_id AS host, CASE WHEN user_id % 3 = 0 THEN ' 7 ' ELSE 'k' || CAST(props->>'k' AS INTEGER) % 3 END AS value FROM lt),
    asked AS (SELECT DISTINCT upper(host) AS host FROM v UNION ALL SELECT 'nowhere')
    SELECT a.host, 'state' AS metric, value, CASE WHEN value IS NULL THEN 'UNKNOWN' WHEN trim(value) <> 'k1' THEN 'OK' ELSE 'CRITICAL' END AS status
    FROM asked a LEFT JOIN v ON lower(a.host) = v.host
    """,
)
def text_check(spark, d):
    """A metric whose value is text; the limit has blanks around it."""
    e = table(spark, d, "events")
    last = e.groupBy("user_id").agg(F.max_by("props", F.struct("ts", "props")).alias("props"))
    state = F.when(F.col("user_id") % 3 == 0, " 7 ").otherwise(F.concat(F.lit("k"), F.get_json_object("props", "$.k").cast("int") % 3))
    snap = last.select(F.concat(F.lit("user-"), "user_id").alias("host"), F.lit("state").alias("metric"), state.alias("value"), F.lit("").alias("units"))
    asked = snap.select(F.upper("host").alias("host")).distinct().unionByName(spark.createDataFrame([("nowhere",)], "host string"))
    return M.check_one(snap, asked, "state", "equal", " k1")


@query(
    "C02_many_checks",
    f"""
    WITH {METRICS}, {CHECK_SQL}, r AS (SELECT s.host, {STATUS_SQL} AS status
      FROM s CROSS JOIN checks LEFT JOIN l ON l.host = s.host AND l.metric = checks.metric)
    SELECT host, count(*) FILTER (status = 'OK') AS n_ok, count(*) FILTER (status = 'CRITICAL') AS n_critical, count(*) FILTER (status = 'UNKNOWN') AS n_unknown,
      CASE WHEN count(*) FILTER (status <> 'OK') = 0 THEN 'OK' ELSE 'CRITICAL' END AS status FROM r GROUP BY host
    """,
)
def many_checks(spark, d):
    return M.summarise_checks(M.check_many(M.latest(metric_table(spark, d)), checks(spark)))


@query(
    "C03_warning_and_critical",
    f"""
    WITH {METRICS}, k(metric, warn_limit, crit_limit) AS (VALUES ('click', 15.0::DOUBLE, 40.0::DOUBLE), ('error', 10.0, 30.0)),
    r AS (SELECT s.host, CASE WHEN l.value IS NULL THEN NULL WHEN l.value > crit_limit THEN 'CRITICAL' WHEN l.value > warn_limit THEN 'WARNING' ELSE 'OK' END AS x
      FROM s CROSS JOIN k LEFT JOIN l ON l.host = s.host AND l.metric = k.metric)
    SELECT host, count(*) FILTER (x = 'OK') AS n_ok, count(*) FILTER (x = 'WARNING') AS n_warning, count(*) FILTER (x = 'CRITICAL') AS n_critical,
      CASE WHEN count(*) FILTER (x = 'CRITICAL') > 0 THEN 'CRITICAL' WHEN count(*) FILTER (x = 'WARNING') > 0 THEN 'WARNING'
        WHEN count(*) FILTER (x = 'OK') > 0 THEN 'OK' ELSE 'UNKNOWN' END AS status FROM r GROUP BY host
    """,
)
def levels(spark, d):
    rows = [("click", "more", 15.0, "more", 40.0), ("error", "more", 10.0, "more", 30.0)]
    k = spark.createDataFrame(rows, "metric string, warn_op string, warn_limit double, crit_op string, crit_limit double")
    return M.check_levels(M.latest(metric_table(spark, d)), k)


@query(
    "C04_checks_on_matching_hosts",
    f"""
    WITH {METRICS}, {CHECK_SQL}, f AS (SELECT host FROM s, a WHERE regexp_matches(host, '-1*[02468]$') AND {AGE.format('last_ts')} < {DAY})
    SELECT f.host, checks.metric, l.value, {STATUS_SQL} AS status FROM f CROSS JOIN checks LEFT JOIN l ON l.host = f.host AND l.metric = checks.metric
    """,
)
def matching_hosts(spark, d):
    m = metric_table(spark, d)
    return M.check_matching(m, checks(spark), "-1*[02468]$", as_of(m), max_age=DAY, whole=True)


@query(
    "C05_heartbeat",
    f"WITH {METRICS} SELECT host, {AGE.format('last_ts')} AS age, CASE WHEN {AGE.format('last_ts')} < {DAY // 2} THEN 'OK' ELSE 'CRITICAL' END AS status FROM s, a",
)
def heartbeat(spark, d):
    m = metric_table(spark, d)
    return M.heartbeat(m, as_of(m), DAY // 2)


@query(
    "C06_stuck_senders",
    f"""
    WITH {METRICS}, x AS (SELECT host, max(ts) AS last_ts, max(ts) FILTER (metric = 'click') AS click_ts FROM m GROUP BY host)
    SELECT host FROM x, a WHERE {AGE.format('last_ts')} < {DAY} AND {AGE.format('click_ts')} > {DAY}
    """,
)
def stuck(spark, d):
    m = metric_table(spark, d)
    return M.stuck_senders(m, "click", as_of(m), fresh=DAY, stale=DAY)


@query("C07_shared_metrics", f"WITH {METRICS} SELECT DISTINCT metric FROM m WHERE regexp_matches(host, '^compute-[01]-1')")
def shared(spark, d):
    return M.shared_metrics(metric_table(spark, d), "^compute-[01]-1")


@query(
    "C08_latest_value",
    f"WITH {METRICS} SELECT host, metric, value, units FROM l WHERE lower(host) = 'compute-0-3' AND metric = 'view'",
)
def latest_value(spark, d):
    return M.latest_value(metric_table(spark, d), "COMPUTE-0-3", "view")


@query("C08_snapshot", f"WITH {METRICS} SELECT host, metric, value, units FROM l")
def snapshot(spark, d):
    return M.latest(metric_table(spark, d)).drop("ts")
