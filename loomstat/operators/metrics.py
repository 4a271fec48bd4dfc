"""Checks and summaries over metric tables ``(host, metric, ts, value, units)``.

``as_of`` is always a parameter, never the clock. Results are long tables: the
hosts behind a value are rows, not one growing list.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat.functions import status as ST
from loomstat.functions.ordering import natural_key
from loomstat.operators.ranking import position_in_group


def latest(df: DataFrame) -> DataFrame:
    """Newest row per (host, metric); ties by the larger value."""
    by = F.struct("ts", "value")
    newest = F.max_by(F.struct("value", "units", "ts"), by)
    return df.groupBy("host", "metric").agg(newest.alias("_l")).select("host", "metric", "_l.*")


def last_seen(df: DataFrame) -> DataFrame:
    return df.groupBy("host").agg(F.max("ts").alias("last_ts"))


def age_seconds(ts: Column, as_of: Column) -> Column:
    return F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(ts.cast("timestamp"))


# ---- sources and hosts -----------------------------------------------------------


def permitted_sources(attributes: DataFrame, chosen: Mapping[str, str]) -> DataFrame:
    """Sources that carry every chosen attribute value.

    ``attributes`` is long: (source, attribute, value). Empty choices are ignored.
    """
    active = {k: v for k, v in chosen.items() if v != ""}
    if not active:
        return attributes.select("source").distinct()
    hit = F.lit(False)
    for attribute, value in active.items():
        hit = hit | ((F.col("attribute") == attribute) & (F.col("value") == value))
    matched = attributes.where(hit).groupBy("source").agg(F.count_distinct("attribute").alias("_n"))
    return matched.where(F.col("_n") == len(active)).select("source")


def search_catalog(df: DataFrame, pattern: str) -> DataFrame:
    """Hosts and metrics whose name matches, any case: (kind, name)."""
    names = df.select(
        F.explode(
            F.array(
                F.struct(F.lit("host").alias("kind"), F.col("host").cast("string").alias("name")),
                F.struct(F.lit("metric").alias("kind"), F.col("metric").alias("name")),
            )
        ).alias("_n")
    ).select("_n.*")
    return names.where(F.col("name").rlike("(?i)" + pattern)).distinct()


def host_state(df: DataFrame, as_of: Column, tn: str | None = None, tmax: str | None = None) -> DataFrame:
    """``(host, up)`` from time-since-report fields, else from the last report."""
    seen = last_seen(df)
    if tn is None:
        none = F.lit(None).cast("double")
        return seen.select("host", ST.host_up(none, none, age_seconds(F.col("last_ts"), as_of)).alias("up"))
    newest = df.groupBy("host").agg(
        F.max("ts").alias("last_ts"), F.max_by(tn, "ts").alias("_tn"), F.max_by(tmax, "ts").alias("_tmax")
    )
    return newest.select("host", ST.host_up(F.col("_tn"), F.col("_tmax"), age_seconds(F.col("last_ts"), as_of)).alias("up"))


def racks(hosts: DataFrame) -> DataFrame:
    """Hosts with rack, rank and plane in rack order; unknown places last.

    ``hosts`` has host, location (text or null) and up.
    """
    place = ST.location(F.col("location"), F.col("host"))
    out = hosts.select("host", "up", place.alias("_p")).select("host", "up", "_p.*")
    known = (F.col("rack") >= 0) & (F.col("rank") >= 0) & (F.col("plane") >= 0)
    return out.withColumn("known", known).orderBy(F.col("known").desc(), "rack", F.col("rank").desc(), "host")


def order_hosts(df: DataFrame, how: str, k: int | None = None) -> DataFrame:
    """Hosts (host, up, value): down hosts first, then by value or natural name."""
    down_first = F.col("up").asc()
    keys = {
        "descending": [F.col("value").desc(), F.col("host").asc()],
        "ascending": [F.col("value").asc(), F.col("host").asc()],
        "by name": [c.asc() for c in natural_key(F.col("host"))],
    }
    if how not in keys:
        raise ValueError(f"order must be one of {sorted(keys)}")
    out = df.orderBy(down_first, *keys[how])
    return out if k is None else out.limit(k)


# ---- checks ----------------------------------------------------------------------


def check_one(snapshot: DataFrame, hosts: DataFrame, metric: str, operator: str, limit: float | str) -> DataFrame:
    """Status of one metric for each asked host name (any case).

    Several snapshot hosts may differ only by case; the smallest name answers. Values may be
    numbers or text. A limit given as text, or a text value, makes "equal" and "notequal" compare trimmed
    texts; "less" and "more" compare numbers, and a text that is none is UNKNOWN.
    """
    if operator not in ST.OPERATORS:
        raise ValueError(f"operator must be one of {ST.OPERATORS}")
    value = snapshot.where(F.col("metric") == metric)
    values = value.groupBy(F.lower("host").alias("_h")).agg(F.min_by(F.struct("value", "units"), "host").alias("_v"))
    joined = hosts.select("host").join(values, F.lower("host") == F.col("_h"), "left")
    texts = isinstance(limit, str) or isinstance(snapshot.schema["value"].dataType, T.StringType)
    if texts and operator in ("equal", "notequal"):
        state = ST.threshold_status(F.lit(operator), F.trim(F.col("_v.value").cast("string")), F.lit(str(limit).strip()))
    else:
        number = F.col("_v.value").try_cast("double")
        try:
            bound = float(limit)
        except ValueError:
            raise ValueError(f"{operator!r} needs a number, not {limit!r}") from None
        state = ST.threshold_status(F.lit(operator), number, F.lit(bound))
    return joined.select("host", F.lit(metric).alias("metric"), F.col("_v.value").alias("value"), state.alias("status"))


def check_many(snapshot: DataFrame, checks: DataFrame) -> DataFrame:
    """Every check (metric, operator, limit_value) on every host: host, metric, value, status, n_checks.

    A row per check whose metric the host has (``n_checks`` 1), and one per host for all
    checks whose metric it lacks: metric and value null, UNKNOWN, and how many they are. Values
    meet checks on the metric, so hosts and checks are not crossed.
    """
    n = checks.agg(F.count("*").alias("n")).scalar()
    asked = checks.select(F.col("metric").alias("_m"), "operator", "limit_value")
    rows = snapshot.select("host", "metric", "value").join(asked, F.col("metric") == F.col("_m"))
    state = ST.threshold_status(F.col("operator"), F.col("value"), F.col("limit_value"))
    known = rows.select("host", "metric", "value", state.alias("status"), F.lit(1).cast("bigint").alias("n_checks"))
    kinds = {f.name: f.dataType for f in snapshot.schema}
    found = F.count(F.col("_m"))
    rest = snapshot.select("host", "metric").join(asked.select("_m"), F.col("metric") == F.col("_m"), "left")
    rest = rest.groupBy("host").agg((n - found).alias("n_checks")).where("n_checks > 0")
    rest = rest.select(
        "host", F.lit(None).cast(kinds["metric"]).alias("metric"), F.lit(None).cast(kinds["value"]).alias("value"), F.lit(ST.UNKNOWN).alias("status"), "n_checks"
    )
    return known.unionByName(rest)


def summarise_checks(results: DataFrame) -> DataFrame:
    """Per host: counts by status, CRITICAL if anything is not OK."""
    n = lambda status: F.coalesce(F.sum(F.when(F.col("status") == status, F.col("n_checks"))), F.lit(0).cast("bigint"))
    bad = F.count_if(F.col("status") != ST.OK)
    return results.groupBy("host").agg(
        n(ST.OK).alias("n_ok"),
        n(ST.CRITICAL).alias("n_critical"),
        n(ST.UNKNOWN).alias("n_unknown"),
        F.when(bad == 0, F.lit(ST.OK)).otherwise(F.lit(ST.CRITICAL)).alias("status"),
    )


def check_levels(snapshot: DataFrame, checks: DataFrame) -> DataFrame:
    """Warning and critical levels per host; missing metrics are skipped.

    ``checks``: metric, warn_op, warn_limit, crit_op, crit_limit. A host without
    any of the metrics is UNKNOWN.
    """
    level = ST.two_level_status(
        F.col("value"), F.col("warn_op"), F.col("warn_limit"), F.col("crit_op"), F.col("crit_limit")
    )
    rows = snapshot.join(checks.withColumn("_c", F.lit(True)), "metric", "left").withColumn("_s", F.when(F.col("_c"), level))
    counts = rows.groupBy("host").agg(*[F.count_if(F.col("_s") == s).alias(n) for s, n in (
        (ST.OK, "n_ok"), (ST.WARNING, "n_warning"), (ST.CRITICAL, "n_critical"))])
    worst = (
        F.when(F.col("n_critical") > 0, F.lit(ST.CRITICAL))
        .when(F.col("n_warning") > 0, F.lit(ST.WARNING))
        .when(F.col("n_ok") > 0, F.lit(ST.OK))
        .otherwise(F.lit(ST.UNKNOWN))
    )
    return counts.withColumn("status", worst)


def fresh_hosts(df: DataFrame, as_of: Column, pattern: str = "", max_age: int = 60) -> DataFrame:
    """Hosts matching a pattern and seen less than ``max_age`` seconds ago."""
    seen = last_seen(df.where(F.col("host").cast("string").rlike(pattern)) if pattern else df)
    return seen.where(age_seconds(F.col("last_ts"), as_of) < max_age).select("host")


def check_matching(
    df: DataFrame, checks: DataFrame, pattern: str, as_of: Column, max_age: int = 60, ignore_unknown: bool = False, whole: bool = False
) -> DataFrame:
    """All checks on fresh hosts that match a pattern; with ``whole`` every check of every host in its own row, without ``n_checks``."""
    hosts = fresh_hosts(df, as_of, pattern, max_age)
    if whole:
        values = latest(df).select("host", F.col("metric").alias("_m"), "value")
        asked = hosts.select("host").distinct().crossJoin(checks.select("metric", "operator", "limit_value"))
        rows = asked.join(values, asked["host"].eqNullSafe(values["host"]) & (F.col("metric") == F.col("_m")), "left")
        state = ST.threshold_status(F.col("operator"), F.col("value"), F.col("limit_value"))
        out = rows.select(asked["host"], "metric", "value", state.alias("status"))
        return out.where(F.col("status") != ST.UNKNOWN) if ignore_unknown else out
    out = check_many(latest(df).join(hosts, "host", "left_semi"), checks)
    return out.where(F.col("status") != ST.UNKNOWN) if ignore_unknown else out


def heartbeat(df: DataFrame, as_of: Column, threshold: int = 25) -> DataFrame:
    """OK while the last report is younger than the threshold."""
    age = age_seconds(F.col("last_ts"), as_of)
    return last_seen(df).select(
        "host", age.alias("age"), F.when(age < threshold, F.lit(ST.OK)).otherwise(F.lit(ST.CRITICAL)).alias("status")
    )


def stuck_senders(df: DataFrame, metric: str, as_of: Column, fresh: int = 60, stale: int = 180, ignore: str = "") -> DataFrame:
    """Hosts still reporting whose given metric is older than ``stale``; hosts whose name matches ``ignore`` are passed over."""
    kept = df.where(~F.coalesce(F.col("host").cast("string").rlike(ignore), F.lit(False))) if ignore else df
    seen = kept.groupBy("host").agg(
        F.max("ts").alias("last_ts"), F.max(F.when(F.col("metric") == metric, F.col("ts"))).alias("metric_ts")
    )
    fresh_now = age_seconds(F.col("last_ts"), as_of) < fresh
    return seen.where(fresh_now & (age_seconds(F.col("metric_ts"), as_of) > stale)).select("host")


def shared_metrics(df: DataFrame, pattern: str) -> DataFrame:
    """Names of all metrics of the matching hosts."""
    return df.where(F.col("host").cast("string").rlike(pattern)).select("metric").distinct()


def latest_value(df: DataFrame, host: str, metric: str) -> DataFrame:
    """Newest value and unit of one metric of one host (name in any case)."""
    wanted = (F.lower(F.col("host").cast("string")) == host.lower()) & (F.col("metric") == metric)
    return latest(df.where(wanted)).select("host", "metric", "value", "units")


def value_agreement(snapshot: DataFrame) -> DataFrame:
    """Per (metric, value): how many hosts hold it, and whether all hosts that have one agree.

    A null is no value: its host neither agrees nor differs, here and in ``disagreeing_members``.
    """
    per_value = snapshot.where("value is not null").groupBy("metric", "value").agg(F.count_distinct("host").alias("n_hosts"))
    per_metric = per_value.groupBy("metric").agg(F.count("*").alias("n_values"))
    out = per_value.join(per_metric, "metric")
    return out.select("metric", "value", "n_hosts", (F.col("n_values") == 1).alias("same"))


def disagreeing_members(snapshot: DataFrame) -> DataFrame:
    """(metric, value, host) of every metric that is not the same everywhere; hosts without a value are left out."""
    known = snapshot.where("value is not null")
    spread = known.groupBy("metric").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    differing = spread.where(F.col("_lo") != F.col("_hi")).select("metric")
    return known.select("metric", "value", "host").join(differing, "metric", "left_semi")


# ---- summaries -------------------------------------------------------------------


def host_extremes(snapshot: DataFrame) -> DataFrame:
    """Per metric: sum over hosts, and both extreme values with their host."""
    up, down = F.struct("value", "host"), F.struct("value", "host")
    return snapshot.groupBy("metric").agg(
        F.sum("value").alias("total"),
        F.min("value").alias("min_value"),
        F.min_by("host", down).alias("min_host"),
        F.max("value").alias("max_value"),
        F.max_by("host", up).alias("max_host"),
    )


def series_limits(df: DataFrame, keys: Sequence[str], average: str | None = None) -> DataFrame:
    """Smallest and largest finite value per key, both widened to include 0; with ``average`` also the mean, in the same pass."""
    v = F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value"))
    zero = F.lit(0.0)
    ends = [F.least(F.coalesce(F.min(v), zero), zero).alias("low"), F.greatest(F.coalesce(F.max(v), zero), zero).alias("high")]
    return df.groupBy(*keys).agg(*ends, *([F.avg("value").alias(average)] if average else []))


def series_average(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg("value").alias("average"))


def series_stats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last, min, avg and max with negative values counted as 0."""
    v = F.greatest(F.col("value"), F.lit(0.0))
    return df.groupBy(*keys).agg(
        F.max_by(v, F.struct(F.col("ts"), v)).alias("last"),
        F.min(v).alias("min"),
        F.avg(v).alias("avg"),
        F.max(v).alias("max"),
    )


def trend(df: DataFrame, keys: Sequence[str], ahead: int = 0) -> DataFrame:
    """Least-squares line over the sample index 1..n of each series.

    ``projected`` is the line ``ahead`` samples after the last one. The index
    comes from a distributed position, so a series of any length is fine.
    """
    placed = position_in_group(df.select(*keys, "ts", "value"), keys, [F.col("ts").asc(), F.col("value").asc()], "_i")
    x = (F.col("_i") + 1).cast("double")
    fit = placed.groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope("value", x).alias("slope"), F.regr_intercept("value", x).alias("intercept")
    )
    return fit.withColumn("projected", F.col("intercept") + F.col("slope") * (F.col("n") + F.lit(ahead)))


def load_histogram(hosts: DataFrame, scale: float = 1.0) -> DataFrame:
    """Hosts (up, load) per load band; down hosts have a band of their own."""
    band = ST.load_bucket(F.when(F.col("up"), F.col("load")).otherwise(F.lit(-1.0)), scale)
    return hosts.groupBy(band.alias("band")).agg(F.count("*").alias("hosts"))


def sum_series(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Element-wise sum of all series per time."""
    return df.groupBy(ts).agg(F.sum("value").alias("total"))


def cluster_load(df: DataFrame) -> DataFrame:
    """Per cluster: 100·Σload / Σcpu (no cpu counts as 1) and the average ratio.

    ``df`` has cluster, load and cpu, one row per host.
    """
    def ratio(load: Column, cpu: Column) -> Column:
        return F.lit(100.0) * load / F.when(F.coalesce(cpu, F.lit(0)) == 0, F.lit(1.0)).otherwise(cpu.cast("double"))

    return df.groupBy("cluster").agg(
        ratio(F.sum("load"), F.sum("cpu")).alias("load_percent"), ratio(F.avg("load"), F.avg("cpu")).alias("utilisation")
    )


def used_memory(wide: DataFrame, scale: float = 1024.0) -> DataFrame:
    """used = total − free − cached − shared − buffers (the last two optional), never below 0."""
    part = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in wide.columns else F.lit(0.0)
    used = F.col("mem_total") - F.col("mem_free") - F.col("mem_cached") - part("mem_shared") - part("mem_buffers")
    return wide.withColumn("mem_used", F.greatest(used * F.lit(scale), F.lit(0.0)))


def per_node(df: DataFrame, value: str, nodes: str, name: str) -> DataFrame:
    """A summed series divided by its number of nodes, never below 0."""
    return df.withColumn(name, F.greatest(F.try_divide(F.col(value).cast("double"), F.col(nodes)), F.lit(0.0)))
