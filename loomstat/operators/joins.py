"""Lookup, fan-out, semi/anti, regex and interval joins.

No join here carries a broadcast hint: the planner (and AQE at run time) checks
the actual size against its threshold and otherwise shuffles, splitting skewed
partitions. Keys compare null-safe where the grouping treats nulls as equal.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.session import materialise, spread


def resolve(hits: DataFrame, mapping: DataFrame, key: str, map_key: str, canonical: str, order: str) -> DataFrame:
    """Replace ``key`` by its canonical value (null when unmapped).

    The mapping is first cut to one row per key (its greatest value), so a
    repeated mapping never multiplies hits. Rows are sorted by original key and
    ``order``; the original key is kept as ``original``.
    """
    one = mapping.groupBy(F.col(map_key).alias("_key")).agg(F.max(canonical).alias("_canonical"))
    joined = hits.join(one, F.col(key).eqNullSafe(F.col("_key")), "left")
    others = [c for c in hits.columns if c != key]
    return joined.select(F.col(key).alias("original"), F.col("_canonical").alias(key), *others).orderBy("original", order)


def fan_out(many: DataFrame, one: DataFrame, many_key: str, one_key: str, payload: Sequence[str]) -> DataFrame:
    """Each row of ``many`` with the payload (arrays included) of its parent, or nulls."""
    parent = one.select(F.col(one_key).alias("_key"), *payload)
    return many.join(parent, F.col(many_key) == F.col("_key"), "left").drop("_key")


def lookup(rows: DataFrame, model: DataFrame, key: str, model_key: str, value: str, default: Column) -> DataFrame:
    """``rows`` with ``value`` of the model, ``default`` where the key is unknown, and ``missed``, whether it was.

    The model has one row per key; a null value of a known key stays null.
    """
    known = model.select(F.col(model_key).alias("_key"), F.col(value).alias("_value"), F.lit(True).alias("_known"))
    joined = rows.join(known, F.col(key) == F.col("_key"), "left")
    missed = F.col("_known").isNull()
    return joined.select(*rows.columns, F.when(missed, default).otherwise(F.col("_value")).alias(value), missed.alias("missed"))


def outer_by_key(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join on one null-safe key, kept as a single column."""
    r = right.withColumnRenamed(key, "_key")
    joined = left.join(r, left[key].eqNullSafe(r["_key"]), "full_outer")
    rest = [c for c in left.columns if c != key] + [c for c in right.columns if c != key]
    return joined.select(F.coalesce(left[key], r["_key"]).alias(key), *rest)


def keep_terms(df: DataFrame, column: str, terms: DataFrame, term: str = "term") -> DataFrame:
    """Rows whose lower-cased word is among the terms."""
    wanted = terms.select(F.col(term).alias("_term")).distinct()
    return df.join(wanted, F.lower(column) == F.col("_term"), "left_semi")


def drop_terms(df: DataFrame, column: str, stop: DataFrame, term: str = "word") -> DataFrame:
    """Rows whose word, case and all, is not a stop word. Null words stay."""
    return df.join(stop.select(F.col(term).alias("_term")), F.col(column) == F.col("_term"), "left_anti")


#: Length of the pieces of text that the index of names is made of.
GRAM = 3


def required_literal(pattern: str | None) -> str | None:
    """The longest run of ASCII characters, in lower case, that every match of the pattern holds; None if none is sure.

    Only what is plain is read: characters outside of groups and classes that no
    quantifier makes optional. A top-level alternative, inline flags or quoting give None.
    """
    if pattern is None:
        return None
    runs, run, at, n = [], "", 0, len(pattern)
    while at < n:
        c = pattern[at]
        if c == "|" or pattern.startswith(("(?", "\\Q", "\\E"), at):
            return None
        literal, step = None, 1
        if c == "\\":
            step = 2
            if at + 1 >= n or pattern[at + 1].isalnum():
                if at + 1 < n and pattern[at + 1] not in "dDwWsSbB":
                    return None  # a code, a reference or something rarer
            else:
                literal = pattern[at + 1]
        elif c in "([":
            end = _closing(pattern, at)
            if end is None:
                return None
            step = end - at
        elif c not in ".^$)]{}?*+" and " " <= c <= "~":
            literal = c
        after = pattern[at + step : at + step + 1]
        if literal is not None and after not in ("?", "*", "{") and " " <= literal <= "~":
            run += literal
            if after == "+":  # once is sure, what follows it is not next to what came before
                runs.append(run)
                run = ""
        else:
            runs.append(run)
            run = ""
        at += step
        while at < n and pattern[at] in "?*+":
            at += 1
        if at < n and pattern[at] == "{":
            end = pattern.find("}", at)
            if end < 0:
                return None
            at = end + 1
            while at < n and pattern[at] in "?*+":
                at += 1
    best = max([*runs, run], key=len).lower()
    return best if len(best) >= GRAM else None


def _closing(pattern: str, at: int) -> int | None:
    """Just behind the group or class that opens at ``at``; None where that is not plain to see."""
    depth, klass = 0, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            if pattern.startswith("\\Q", at):
                return None
            at += 1
        elif klass:
            if c == "[" or (c == "]" and pattern[at - 1] in "[^"):
                return None  # classes in classes, or a bracket as a member
            klass -= c == "]"
            if not klass and not depth:
                return at + 1
        elif c == "[":
            klass = 1
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return at + 1
        at += 1
    return None


def _literals(patterns: Column) -> Column:
    """The required literals of a column of patterns, in Arrow batches."""

    def read(batch: pd.Series) -> pd.Series:
        return batch.map(lambda p: required_literal(p) if isinstance(p, str) else None)

    return F.pandas_udf(read, "string")(patterns)


def _grams(text: Column) -> Column:
    """The distinct pieces of ``GRAM`` characters of a text; none of a null or shorter one."""
    starts = F.sequence(F.lit(1), F.length(text) - (GRAM - 1))
    pieces = F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(GRAM))))
    return F.when(F.length(text) >= GRAM, pieces).otherwise(F.array().cast("array<string>"))


def _placed_grams(k: int) -> Column:
    """The pieces of the literal of the k-th test, each with that number."""
    return F.transform(_grams(F.col(f"_l{k}")), lambda g: F.struct(F.lit(k).alias("_at"), g.alias("_gram")))


def regex_matches(catalog: DataFrame, rules: DataFrame, tests: Sequence[tuple[str, str]], slice_rows: int = 4096, chunk: int = 256) -> DataFrame:
    """Pairs of distinct catalog rows and rules where every pattern is found, any case.

    ``tests`` lists (catalog column, rule pattern column); a null pattern matches
    everything. The sides must not share column names.

    An index of required literals: a pattern that must hold a literal is only tested on
    names that hold the rarest of the literal's three-character pieces; a piece in many names is cut into slices
    of about ``slice_rows``. Rules without any literal are cut into chunks and tested on
    every slice of the catalog, as many of both as the data need. Only matches leave a task.
    """
    names, asked_for = catalog.columns, list(dict.fromkeys(p for _, p in tests))
    left = materialise(catalog.distinct(), "names")
    alias = {p: f"_p{k}" for k, p in enumerate(asked_for)}
    asked = rules.select(*[F.col(p).alias(alias[p]) for p in asked_for]).distinct()
    patterns = list(alias.values())
    found = F.lit(True)
    for column, pattern in tests:
        hit = F.rlike(F.col(column).cast("string"), F.concat(F.lit("(?i)"), F.col(alias[pattern])))
        found = found & F.coalesce(hit, F.col(alias[pattern]).isNull())

    marked = asked.withColumns({f"_l{k}": _literals(F.col(alias[p])) for k, (_, p) in enumerate(tests)})
    marked = marked.withColumn("_pieces", F.concat(*[_placed_grams(k) for k in range(len(tests))])).select(*patterns, "_pieces")
    marked = materialise(marked, "patterns")

    # Names by piece, and how many names have it.
    index = None
    for k, (column, _) in enumerate(tests):
        values = left.select(F.col(column).cast("string").alias("_value")).distinct()
        part = values.select(F.lit(k).alias("_at"), "_value", F.explode(_grams(F.lower("_value"))).alias("_gram"))
        index = part if index is None else index.unionByName(part)
    sizes = index.groupBy("_at", "_gram").agg(F.ceil(F.count("*") / F.lit(slice_rows)).cast("int").alias("_n"), F.count("*").alias("_count"))
    # A piece that no name has means that nothing matches: the rule drops out here.
    wanted = marked.select(*patterns, F.explode("_pieces").alias("_p")).select(*patterns, "_p.*").join(sizes, ["_at", "_gram"], "left")
    order = F.struct(F.coalesce("_count", F.lit(0)), "_at", "_gram")
    rarest = wanted.groupBy(*patterns).agg(F.min_by(F.struct("_at", "_gram", "_n"), order).alias("_best")).select(*patterns, "_best.*")
    rarest = rarest.where("_n is not null").withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    large = sizes.where("_n > 1").select("_at", "_gram", "_n")
    index = index.join(large, ["_at", "_gram"], "left").withColumn("_slice", F.pmod(F.xxhash64("_value"), F.coalesce("_n", F.lit(1))).cast("int")).drop("_n")
    candidates = rarest.join(index, ["_at", "_gram", "_slice"]).select(*patterns, "_at", "_value")
    matched = None
    for k, (column, _) in enumerate(tests):
        mine = candidates.where(F.col("_at") == k).drop("_at")
        hits = left.join(mine, F.col(column).cast("string") == F.col("_value")).where(found).select(*names, *patterns)
        matched = hits if matched is None else matched.unionByName(hits)

    plain = marked.where(F.size("_pieces") == 0).select(*patterns)
    chunks, slices = (max(1, -(-df.count() // size)) for df, size in ((plain, chunk), (left, slice_rows)))
    rows = left.withColumn("_slice", F.pmod(F.xxhash64(*names), F.lit(slices)).cast("int")).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    every = plain.withColumn("_chunk", F.pmod(F.xxhash64(*patterns), F.lit(chunks)).cast("int")).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    matched = matched.unionByName(rows.join(every, ["_chunk", "_slice"]).where(found).select(*names, *patterns))

    same = F.lit(True)
    for p, q in alias.items():
        same = same & F.col(p).eqNullSafe(F.col(q))
    return matched.join(rules, same).select(*names, *rules.columns)


def touching(events: DataFrame, start: Column | None = None, end: Column | None = None, host: Column | None = None) -> DataFrame:
    """Events overlapping one window, clipped to it; a side that is not given is open.

    An event without an end is a moment: it counts when it starts inside the
    window, and its clipped end stays null. With ``host`` given, the event's ``host_regex`` must be found in it.
    """
    s, e = F.col("start_ts"), F.col("end_ts")
    inside, starts_inside = s.isNotNull(), F.lit(True)
    if start is not None:
        inside, starts_inside = inside & (F.coalesce(e, s) >= start), s >= start
    if end is not None:
        inside = inside & (s <= end)
    if host is not None:
        inside = inside & F.rlike(host, F.col("host_regex"))
    return events.where(inside).withColumns(
        {
            "clip_start": s if start is None else F.greatest(s, start),
            "clip_end": e if end is None else F.when(e.isNotNull(), F.least(e, end)),
            "starts_inside": starts_inside,
        }
    )


#: Levels are this far apart: more levels are more keys a row, fewer are more candidates a bucket.
STEP = 4
#: Cells that one busy bucket is cut into at most; the rows of one side are copied into as many, so it must not grow with the data.
CELLS = 512


#: Rows of a side with ranges longer than nearly all others that are given to every task of the other side, at most.
LONG = 2**14


def _ends(start: Column, end: Column) -> tuple[Column, Column]:
    return start.cast("bigint"), F.coalesce(end, start).cast("bigint")


def _level(s: Column, e: Column) -> Column:
    """The least multiple of STEP whose power of two the range's length fits; 63 is the highest level."""
    bits = F.when(e == s, F.lit(0)).otherwise(F.length(F.bin(e - s)))
    return F.least(F.ceil(bits / F.lit(STEP)) * F.lit(STEP), F.lit(63)).cast("int")


def _levelled(df: DataFrame, start: str, end: str, side: str) -> DataFrame:
    """Rows with a non-empty range as (row, start, end, level)."""
    s, e = _ends(F.col(start), F.col(end))
    row = F.struct(*[F.col(c) for c in df.columns])
    out = df.where(s.isNotNull() & (s <= e))
    return out.select(row.alias(f"{side}row"), s.alias(f"{side}s"), e.alias(f"{side}e"), _level(s, e).alias(f"{side}level"))


def _levels(df: DataFrame, side: str) -> Column:
    """The levels in use, at most 64 numbers, as a scalar."""
    return df.agg(F.collect_set(f"{side}level")).scalar()


def _keyed(df: DataFrame, side: str, others: Column) -> DataFrame:
    """Each row under (level, bucket) at its own level and at the higher levels of the other side: two buckets a level at most."""
    own = F.col(f"{side}level")
    at = df.withColumn("level", F.explode(F.array_union(F.array(own), others))).where(F.col("level") >= own)
    first, last = (F.call_function("shiftright", F.col(f"{side}{end}"), F.col("level")) for end in "se")
    return at.withColumn("bucket", F.explode(F.when(first == last, F.array(first)).otherwise(F.array(first, last))))


def _cut(busy: DataFrame) -> DataFrame:
    """``busy`` with the slices ln and rn of its buckets' sides made fewer where they would make more cells than CELLS."""
    shrink = F.least(F.lit(1.0), F.sqrt(F.lit(float(CELLS)) / (F.col("ln").cast("double") * F.col("rn"))))
    left = busy.withColumn("ln", F.greatest(F.lit(1), F.least(F.floor(F.col("ln") * shrink), F.lit(CELLS))).cast("int"))
    return left.withColumn("rn", F.greatest(F.lit(1), F.least(F.col("rn"), F.floor(F.lit(CELLS) / F.col("ln")))).cast("int"))


def overlap_join(
    left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str], also: Column | None = None, slice_rows: int = 4096
) -> DataFrame:
    """Pairs whose closed ranges of whole numbers overlap, all columns of both sides.

    An end that is null makes the range a moment, its start. A null start, or an end before the
    start, matches nothing. ``also`` is a further condition on the columns of both
    sides; the sides must not share column names.

    Intervals in levels: a range lies on the least level whose buckets are at least as
    long as it, so it touches two buckets at most, however long it is. Ranges of two levels
    meet in the buckets of the higher one, and a pair is taken where its overlap
    begins. A year beside a second costs the year nothing and the second one more
    key. A bucket with more rows than ``slice_rows`` on a side is cut into slices by a
    row hash, each slice of one side meeting each of the other in a key of its own, CELLS at
    most; so what is copied grows with the rows, not with their square.
    Levels below one that holds a good part of the rows are raised to it, and ranges above it, if they are few, are
    given to every task, so that the many rows need no key for them. One job counts the levels.
    """
    shared = {c.lower() for c in left.columns} & {c.lower() for c in right.columns}
    if shared:
        raise ValueError(f"both sides have {sorted(shared)}")
    sides = {"l": _levelled(left, *left_range, "l"), "r": _levelled(right, *right_range, "r")}
    base, long = _raised({side: {r[0]: r[1] for r in df.groupBy(f"{side}level").count().collect()} for side, df in sides.items()})
    sides = {side: df.withColumn(f"{side}level", F.greatest(f"{side}level", F.lit(base))) for side, df in sides.items()}
    rare = {side: df.where(F.col(f"{side}level") > base) if side in long else None for side, df in sides.items()}
    short = {side: df if rare[side] is None else df.where(F.col(f"{side}level") <= base) for side, df in sides.items()}
    joined = [_sliced(short["l"], short["r"], slice_rows)]
    for mine, others in ((rare["l"], sides["r"]), (rare["r"], short["l"])):
        if mine is not None:
            joined.append(_given(mine, others, *("lr" if mine is rare["l"] else "rl")))
    (ls, le), (rs, re) = (_ends(*[F.col(f"{side}row").getField(c) for c in ends]) for side, ends in (("l", left_range), ("r", right_range)))
    begins = F.call_function("shiftright", F.greatest(ls, rs), F.col("level")) == F.col("bucket")
    met = joined[0]
    for more in joined[1:]:
        met = met.unionByName(more)
    found = met.where((ls <= re) & (rs <= le) & begins & (F.col("lown") | F.col("rown"))).select("lrow.*", "rrow.*")
    return found if also is None else found.where(also)


def _raised(counts: dict[str, dict[int, int]]) -> tuple[int, set[str]]:
    """The level that all lower ones are raised to, and the sides with so few rows above it that they are given to every task.

    A quarter of the rows up to a level lie on it already, so the candidates of its buckets are four times as many at most.
    """
    both = {level: sum(side.get(level, 0) for side in counts.values()) for side in counts.values() for level in side}
    below = lambda rows, top: sum(n for level, n in rows.items() if level <= top)
    base = max((level for level, n in both.items() if 4 * n >= below(both, level)), default=0)
    above = {side: sum(rows.values()) - below(rows, base) for side, rows in counts.items()}
    return base, {side for side, n in above.items() if 0 < n <= LONG and 64 * n <= sum(counts[side].values())}


def _owned(df: DataFrame, side: str, others: Column) -> DataFrame:
    # Only the rows move, and whether this is their own level: their range is read from them again after the join.
    own = (F.col(f"{side}level") == F.col("level")).alias(f"{side}own")
    return _keyed(df, side, others).select("level", "bucket", own, f"{side}row")


def _given(few: DataFrame, many: DataFrame, side: str, other: str) -> DataFrame:
    """Candidates of a few long ranges, at most LONG, with rows that stay where they are."""
    few = materialise(few, "long-ranges")
    keyed = _owned(spread(many), other, _levels(few, side))
    return keyed.join(F.broadcast(_owned(few, side, _levels(many, other))), ["level", "bucket"])


def _sliced(left: DataFrame, right: DataFrame, slice_rows: int) -> DataFrame:
    """Candidates of both sides by bucket, busy buckets in slices."""
    sides = {"l": left, "r": right}
    keyed = {side: _owned(df, side, _levels(sides["r" if side == "l" else "l"], "r" if side == "l" else "l")) for side, df in sides.items()}
    keys = ["level", "bucket"]
    # Busy buckets only: each side counted before its rows move, a key that one side lacks is left out.
    counts = {side: df.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(slice_rows)).alias(f"{side}n")) for side, df in keyed.items()}
    busy = _cut(counts["l"].join(counts["r"], keys).where((F.col("ln") > 1) | (F.col("rn") > 1)))
    parts = {}
    for side, other in (("l", "r"), ("r", "l")):
        rows = keyed[side].join(busy, keys, "left")
        mine, theirs = (F.coalesce(f"{x}n", F.lit(1)) for x in (side, other))
        rows = rows.withColumn(f"{side}slice", F.pmod(F.xxhash64(f"{side}row"), mine).cast("int"))
        parts[side] = rows.withColumn(f"{other}slice", F.explode(F.sequence(F.lit(0), theirs - 1))).drop("ln", "rn")
    return parts["l"].join(parts["r"], [*keys, "lslice", "rslice"]).drop("lslice", "rslice")
