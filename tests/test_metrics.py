import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomstat.functions import status as ST
from loomstat.operators import metrics as M

T0 = dt.datetime(2024, 1, 1)
AT = lambda s: T0 + dt.timedelta(seconds=s)
def now():
    return F.lit(AT(1000)).cast("timestamp_ntz")

SCHEMA = "host string, metric string, ts timestamp_ntz, value double, units string"

DATA = [
    ("a", "load", AT(900), 1.0, "u"), ("a", "load", AT(990), 3.0, "u"), ("a", "mem", AT(700), 9.0, "MB"),
    ("b", "load", AT(500), 2.0, "u"), ("B2", "load", AT(960), 3.0, "u"), ("B2", "mem", AT(960), 9.0, "MB"),
]


@pytest.fixture
def df(rows):
    return rows.of(DATA, SCHEMA)


@pytest.mark.parametrize(
    "operator,value,limit,first,second",
    [
        ("less", 5.0, 4.0, "OK", False), ("less", 4.0, 4.0, "CRITICAL", False), ("less", 3.0, 4.0, "CRITICAL", True),
        ("more", 3.0, 4.0, "OK", False), ("more", 4.0, 4.0, "CRITICAL", False), ("more", 5.0, 4.0, "CRITICAL", True),
        ("equal", 5.0, 4.0, "OK", False), ("equal", 4.0, 4.0, "CRITICAL", True),
        ("notequal", 4.0, 4.0, "OK", False), ("notequal", 5.0, 4.0, "CRITICAL", True),
        ("less", None, 4.0, "UNKNOWN", None),
    ],
)
def test_the_operator_names_the_bad_side(rows, operator, value, limit, first, second):
    r = rows.of([(operator, value, limit)], "o string, v double, l double").select(
        ST.threshold_status(F.col("o"), F.col("v"), F.col("l")), ST.bad_side(F.col("o"), F.col("v"), F.col("l"))
    ).head()
    assert r[0] == first and (second is None or r[1] == second)


def test_latest(df, rows):
    assert rows.sorted(M.latest(df), "host", "metric", "value") == [("B2", "load", 3.0), ("B2", "mem", 9.0), ("a", "load", 3.0), ("a", "mem", 9.0), ("b", "load", 2.0)]
    assert rows.listed(M.latest_value(df, "b2", "mem")) == [("B2", "mem", 9.0, "MB")]


def test_check_one_names_any_case(df, rows):
    asked = rows.of([("A",), ("b2",), ("zz",)], "host string")
    got = rows.sorted(M.check_one(M.latest(df), asked, "load", "more", 3.0), "host", "status")
    assert got == [("A", "CRITICAL"), ("b2", "CRITICAL"), ("zz", "UNKNOWN")]
    with pytest.raises(ValueError):
        M.check_one(df, asked, "load", "over", 1)


def test_many_checks(df, rows):
    checks = rows.of([("load", "more", 2.5), ("mem", "less", 1.0)], "metric string, operator string, limit_value double")
    got = rows.sorted(M.summarise_checks(M.check_many(M.latest(df), checks)))
    assert got == [("B2", 1, 1, 0, "CRITICAL"), ("a", 1, 1, 0, "CRITICAL"), ("b", 1, 0, 1, "CRITICAL")]


def test_levels_skip_missing(df, rows):
    checks = rows.of([("load", "more", 1.5, "more", 3.0)], "metric string, warn_op string, warn_limit double, crit_op string, crit_limit double")
    got = rows.sorted(M.check_levels(M.latest(df), checks), "host", "status")
    assert got == [("B2", "WARNING"), ("a", "WARNING"), ("b", "WARNING")]
    nothing = rows.of([("gone", "more", 1.5, "more", 3.0)], "metric string, warn_op string, warn_limit double, crit_op string, crit_limit double")
    assert {r["status"] for r in M.check_levels(M.latest(df), nothing).collect()} == {"UNKNOWN"}


def test_fresh_heartbeat_stuck(df, rows):
    assert rows.sorted(M.fresh_hosts(df, now(), "^[aB]")) == [("B2",), ("a",)]
    assert rows.sorted(M.heartbeat(df, now()), "host", "status") == [("B2", "CRITICAL"), ("a", "OK"), ("b", "CRITICAL")]
    assert rows.listed(M.stuck_senders(df, "mem", now())) == [("a",)]


def test_agreement(df, rows):
    got = rows.sorted(M.value_agreement(M.latest(df)))
    assert got == [("load", 2.0, 1, False), ("load", 3.0, 2, False), ("mem", 9.0, 2, True)]
    assert {r["metric"] for r in M.disagreeing_members(M.latest(df)).collect()} == {"load"}


def test_extremes_and_limits(rows):
    df = rows.of([("a", "m", AT(1), -2.0, ""), ("b", "m", AT(1), 5.0, ""), ("c", "m", AT(2), float("inf"), "")], SCHEMA)
    assert rows.listed(M.series_limits(df, ["metric"])) == [("m", -2.0, 5.0)]
    r = M.host_extremes(df.where("host <> 'c'")).head()
    assert (r["total"], r["min_host"], r["max_host"]) == (3.0, "a", "b")
    s = M.series_stats(df.where("host <> 'c'"), ["metric"]).head()
    assert (s["min"], s["avg"], s["max"], s["last"]) == (0.0, 2.5, 5.0, 5.0)


def test_trend_of_a_line(rows):
    df = rows.of([("h", "m", AT(i * i), 2.0 * i + 1, "") for i in range(1, 11)], SCHEMA)
    r = M.trend(df, ["metric"], ahead=5).head()
    assert (round(r["slope"], 9), round(r["intercept"], 9), round(r["projected"], 9)) == (2.0, 1.0, 31.0)


@pytest.mark.parametrize("load,band", [(1.2, "100+"), (1.0, "75-100"), (0.75, "75-100"), (0.5, "50-75"), (0.3, "25-50"), (0.0, "0-25"), (-1.0, "down")])
def test_load_bands(rows, load, band):
    assert rows.of([(load,)], "v double").select(ST.load_bucket(F.col("v"))).head()[0] == band


def test_histogram_counts_down_hosts(rows):
    df = rows.of([("a", True, 0.1), ("b", False, 0.9), ("c", True, 2.0)], "host string, up boolean, load double")
    assert rows.sorted(M.load_histogram(df)) == [("0-25", 1), ("100+", 1), ("down", 1)]


@pytest.mark.parametrize(
    "attribute,host,want",
    [("3,4,1", "x", (3, 4, 1)), ("3, 4", "x", (3, 4, -1)), (None, "compute-7-12.local", (7, 12, 0)), ("", "web", (-1, -1, 0))],
)
def test_location(rows, attribute, host, want):
    assert tuple(rows.of([(attribute, host)], "l string, h string").select(ST.location(F.col("l"), F.col("h"))).head()[0]) == want


@pytest.mark.parametrize("tn,tmax,age,up", [(10.0, 5.0, 999, True), (21.0, 5.0, 0, False), (None, None, 240, True), (0.0, 5.0, 241, False)])
def test_host_up(rows, tn, tmax, age, up):
    df = rows.of([(tn, tmax, age)], "a double, b double, c bigint")
    assert df.select(ST.host_up(F.col("a"), F.col("b"), F.col("c"))).head()[0] is up


def test_racks_and_orders(rows):
    hosts = rows.of([("compute-1-2", None, True), ("compute-1-10", None, False), ("web", None, True), ("z", "0,5,0", True)], "host string, location string, up boolean")
    assert rows.listed(M.racks(hosts), "host") == [("z",), ("compute-1-10",), ("compute-1-2",), ("web",)]
    loads = rows.of([("n10", True, 1.0), ("n9", True, 2.0), ("n1", False, 0.0)], "host string, up boolean, value double")
    assert rows.listed(M.order_hosts(loads, "by name"), "host") == [("n1",), ("n9",), ("n10",)]
    assert rows.listed(M.order_hosts(loads, "descending", 2), "host") == [("n1",), ("n9",)]
    with pytest.raises(ValueError):
        M.order_hosts(loads, "sideways")


def test_permits(rows):
    df = rows.of([("s1", "os", "x"), ("s1", "dc", "1"), ("s2", "os", "x"), ("s2", "dc", "2")], "source string, attribute string, value string")
    assert rows.listed(M.permitted_sources(df, {"os": "x", "dc": "1"})) == [("s1",)]
    assert rows.sorted(M.permitted_sources(df, {"os": ""})) == [("s1",), ("s2",)]


def test_cluster_load_without_cpus(rows):
    df = rows.of([("c", 2.0, 4), ("c", 2.0, 4), ("d", 3.0, 0)], "cluster string, load double, cpu int")
    assert rows.sorted(M.cluster_load(df)) == [("c", 50.0, 50.0), ("d", 300.0, 300.0)]


def test_used_memory_optional_parts(rows):
    wide = rows.of([(100.0, 20.0, 30.0)], "mem_total double, mem_free double, mem_cached double")
    assert M.used_memory(wide, 1).head()["mem_used"] == 50.0
    more = wide.withColumns({"mem_buffers": F.lit(60.0), "mem_shared": F.lit(None).cast("double")})
    assert M.used_memory(more, 1).head()["mem_used"] == 0.0


def test_no_bound_on_checks(df, spark):
    checks = spark.range(10_001).select(F.concat(F.lit("m"), "id").alias("metric"), F.lit("more").alias("operator"), F.lit(2.5).alias("limit_value"))
    checks = checks.union(spark.sql("select 'load', 'more', 2.5"))
    got = {r["host"]: (r["n_critical"], r["n_ok"], r["n_unknown"]) for r in M.summarise_checks(M.check_many(M.latest(df), checks)).collect()}
    assert got == {"a": (1, 0, 10_001), "B2": (1, 0, 10_001), "b": (0, 1, 10_001)}
    levels = checks.selectExpr("metric", "'more' warn_op", "1.5D warn_limit", "'more' crit_op", "3.5D crit_limit")
    assert {r["host"]: r["n_warning"] for r in M.check_levels(M.latest(df), levels).collect()} == {"a": 1, "B2": 1, "b": 1}


def test_text_values_are_compared_trimmed(rows):
    snap = rows.of([("A", "state", " up "), ("b", "state", "down"), ("c", "state", None), ("d", "state", "7.0"), ("d", "other", "up")], "host string, metric string, value string")
    snap = snap.withColumn("units", F.lit(""))
    hosts = rows.of([("a",), ("B",), ("c",), ("d",), ("e",)], "host string")
    status = lambda operator, limit: {r["host"]: r["status"] for r in M.check_one(snap, hosts, "state", operator, limit).collect()}
    # The operator names the bad side: "equal" is critical where the two are the same.
    assert status("equal", "up ") == {"a": "CRITICAL", "B": "OK", "c": "UNKNOWN", "d": "OK", "e": "UNKNOWN"}
    assert status("notequal", "up") == {"a": "OK", "B": "CRITICAL", "c": "UNKNOWN", "d": "CRITICAL", "e": "UNKNOWN"}
    assert status("more", 9) == {"a": "UNKNOWN", "B": "UNKNOWN", "c": "UNKNOWN", "d": "OK", "e": "UNKNOWN"}
    assert status("equal", 7.0)["d"] == "CRITICAL" and status("less", "9")["d"] == "CRITICAL"
    with pytest.raises(ValueError):
        M.check_one(snap, hosts, "state", "less", "many")


def test_ignored_hosts_and_unknown_values(rows):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, 0) + dt.timedelta(seconds=s)
    df = rows.of([(h, m, t(s), 1.0) for h in ("web-1", "db-1") for m, s in (("load", 0), ("cpu", 290))], "host string, metric string, ts timestamp_ntz, value double")
    now = F.lit(t(300)).cast("timestamp_ntz")
    names = lambda **k: [r[0] for r in M.stuck_senders(df, "load", now, **k).orderBy("host").collect()]
    assert names() == ["db-1", "web-1"] and names(ignore="^db") == ["web-1"] and names(ignore="1$") == []
    snap = rows.of([("m", 1.0, "a"), ("m", None, "b"), ("n", 1.0, "a"), ("n", 2.0, "b"), ("n", None, "c"), ("o", None, "a")], "metric string, value double, host string")
    assert rows.sorted(M.value_agreement(snap)) == [("m", 1.0, 1, True), ("n", 1.0, 1, False), ("n", 2.0, 1, False)]
    assert rows.sorted(M.disagreeing_members(snap)) == [("n", 1.0, "a"), ("n", 2.0, "b")]


def test_every_check_of_matching_hosts_has_a_row(rows):
    m = rows.of([("h-2", "cpu", dt.datetime(2024, 1, 1), 5.0, "u"), ("h-3", "cpu", dt.datetime(2024, 1, 1), 5.0, "u")], "host string, metric string, ts timestamp_ntz, value double, units string")
    checks = rows.of([("cpu", ">", 1.0), ("mem", ">", 1.0), ("net", ">", 1.0)], "metric string, operator string, limit_value double")
    out = M.check_matching(m, checks, "2$", F.lit("2024-01-01 00:00:01").cast("timestamp_ntz"), whole=True)
    assert [(h, n, v) for h, n, v in rows.sorted(out, "host", "metric", "value")] == [("h-2", "cpu", 5.0), ("h-2", "mem", None), ("h-2", "net", None)]
