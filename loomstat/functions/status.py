"""Status expressions for metric snapshots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OK, WARNING, CRITICAL, UNKNOWN = "OK", "WARNING", "CRITICAL", "UNKNOWN"
OPERATORS = ("less", "more", "equal", "notequal")

# Load scale buckets, highest first, with the lowest share in each.
LOAD_BUCKETS = [("75-100", 0.75), ("50-75", 0.50), ("25-50", 0.25), ("0-25", 0.0)]


def good_side(operator: Column, value: Column, limit: Column) -> Column:
    """True on the good side of a limit; the operator names the bad side.

    "less" is good strictly above the limit, "more" strictly below it, "equal"
    while the two differ, "notequal" while they agree. On the limit is bad.
    """
    return (
        F.when(operator == "less", value > limit)
        .when(operator == "more", value < limit)
        .when(operator == "equal", value != limit)
        .when(operator == "notequal", value == limit)
        .otherwise(F.lit(False))
    )


def bad_side(operator: Column, value: Column, limit: Column) -> Column:
    """True strictly on the bad side; exactly on the limit is still good."""
    return (
        F.when(operator == "less", value < limit)
        .when(operator == "more", value > limit)
        .when(operator == "equal", value == limit)
        .when(operator == "notequal", value != limit)
        .otherwise(F.lit(False))
    )


def threshold_status(operator: Column, value: Column, limit: Column) -> Column:
    """OK / CRITICAL, or UNKNOWN when there is no value."""
    return (
        F.when(value.isNull(), F.lit(UNKNOWN))
        .when(good_side(operator, value, limit), F.lit(OK))
        .otherwise(F.lit(CRITICAL))
    )


def two_level_status(
    value: Column, warn_op: Column, warn_limit: Column, crit_op: Column, crit_limit: Column
) -> Column:
    """CRITICAL, else WARNING, else OK; null when there is no value."""
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(bad_side(crit_op, value, crit_limit), F.lit(CRITICAL))
        .when(bad_side(warn_op, value, warn_limit), F.lit(WARNING))
        .otherwise(F.lit(OK))
    )


def host_up(tn: Column, tmax: Column, age_seconds: Column) -> Column:
    """Alive while ``tn <= 4·tmax``; without those, while at most 240 s old."""
    known = F.coalesce(tn, F.lit(0)).cast("double").__ne__(0.0) & F.coalesce(tmax, F.lit(0)).cast("double").__ne__(0.0)
    return F.when(known, tn <= 4 * tmax).otherwise(F.abs(age_seconds) <= 240)


def load_bucket(load: Column, scale: float = 1.0) -> Column:
    """Name of the load band: "100+", four quarters, or "down" below zero."""
    scaled = load / F.lit(float(scale))
    out = F.when(scaled > 1.0, F.lit("100+"))
    for name, floor in LOAD_BUCKETS:
        out = out.when(scaled >= floor, F.lit(name))
    return out.otherwise(F.lit("down"))


def location(attribute: Column, host: Column) -> Column:
    """Struct (rack, rank, plane) from "rack,rank,plane", else from
    ``compute-<rack>-<rank>``, else −1 for what is unknown (plane 0)."""
    given = r"^\s*(\d+)\s*,\s*(\d+)"
    named = r"^compute-(\d+)-(\d+)"

    def part(text: Column, pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast("int")

    has = attribute.rlike(given)
    plane = part(attribute, r"^\s*\d+\s*,\s*\d+\s*,\s*(-?\d+)", 1)
    pick = lambda i: F.coalesce(F.when(has, part(attribute, given, i)), part(host, named, i), F.lit(-1))
    return F.struct(
        pick(1).alias("rack"),
        pick(2).alias("rank"),
        F.when(has, F.coalesce(plane, F.lit(-1))).otherwise(F.lit(0)).alias("plane"),
    )
