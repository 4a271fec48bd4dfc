import datetime as dt
import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomstat.functions import schema as S
from loomstat.functions.text import tokens
from loomstat.operators import grouping as G

PEOPLE = "country string, age int, name string, height int"
FIRST = [
    ("ES", 20, "listo", 250), ("US", 14, "beber", 202), ("US", 14, "perro", 180), ("US", 14, "perro", 170),
    ("US", 15, "jauja", 160), ("US", 16, "listo", 160), ("XE", 20, "listo", 230),
]
ORDER = "country, age, name, height:desc"


def events(rows, data, rollup_from, groups):
    df = G.rollup_events(rows.of(data, PEOPLE).repartition(3), ORDER, groups, rollup_from)
    return [
        (r["event"] if r["depth"] is None else f"{r['event']} {r['depth']}", tuple(r[c] for c in ("country", "age", "name", "height")))
        for r in df.orderBy("seq").collect()
    ]


def expected(data, first, last):
    """The sequence written out from the definition: compare neighbouring keys."""
    out = []
    for i, row in enumerate(data):
        def split(other):
            if other is None:
                return first
            same = len(list(itertools.takewhile(lambda p: p[0] == p[1], zip(row[: last + 1], other[: last + 1]))))
            return max(first, same)

        before = data[i - 1] if i else None
        after = data[i + 1] if i + 1 < len(data) else None
        out += [(f"OPEN {d}", row) for d in range(split(before), last + 1)]
        out.append(("ELEMENT", row))
        out += [(f"CLOSE {d}", row) for d in range(last, split(after) - 1, -1)]
    return out


def test_rollup_from_the_first_field(rows):
    got = events(rows, FIRST, "country", ["country", "age", "name"])
    assert len(got) == 35
    assert got[:7] == [("OPEN 0", FIRST[0]), ("OPEN 1", FIRST[0]), ("OPEN 2", FIRST[0]), ("ELEMENT", FIRST[0]),
                       ("CLOSE 2", FIRST[0]), ("CLOSE 1", FIRST[0]), ("CLOSE 0", FIRST[0])]
    assert got == expected(FIRST, 0, 2)


def test_rollup_levels_follow_the_sort_order(rows):
    data = FIRST[:-1] + [("XE", 16, "listo", 230)]
    got = events(rows, data, "age", ["age", "name", "country"])
    assert got == expected(data, 1, 2)
    assert {e.split()[-1] for e, _ in got if e != "ELEMENT"} == {"1", "2"}


def test_rollup_of_nothing(rows):
    assert events(rows, [], "country", ["country", "age", "name"]) == []


def test_rollup_random(rows):
    rng = random.Random(11)
    data = sorted({(rng.choice("AB"), rng.randint(0, 2), rng.choice("xy"), -rng.randint(0, 99)) for _ in range(80)})
    data = [(a, b, c, -d) for a, b, c, d in data]
    assert events(rows, data, "country", ["country", "age", "name"]) == expected(data, 0, 2)


def test_levels_are_the_union_of_group_bys(rows):
    df = rows.of(FIRST, PEOPLE)
    got = rows.sorted(G.rollup_levels(df, ORDER, ["country", "age", "name"], "country", {"n": F.count("*"), "h": F.sum("height")}))
    parts = []
    for depth, keys in enumerate((["country"], ["country", "age"], ["country", "age", "name"])):
        for r in df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("height").alias("h")).collect():
            parts.append(tuple(r[k] if k in keys else None for k in ("country", "age", "name")) + (depth, r["n"], r["h"]))
    assert got == sorted(parts, key=repr)


def test_null_group_values_and_levels(rows):
    df = rows.of([(None, 1), (None, 2), ("a", 3)], "k string, v int")
    got = G.rollup_levels(df, "k, v", ["k", "v"], "k", {"n": F.count("*")})
    assert rows.sorted(got.where("depth = 0"), "k", "n") == sorted([(None, 2), ("a", 1)], key=repr)


def test_word_count(rows):
    words = rows.of([("hola don pepito hola don jose",)], "line string").select(F.explode(tokens(F.col("line"))).alias("word"), F.lit(1).alias("one"))
    got = rows.sorted(G.group_sum(words, ["word"], {"count": "one"}))
    assert got == [("don", 2), ("hola", 2), ("jose", 1), ("pepito", 1)]


def test_null_keys_form_one_group(rows):
    df = rows.of([(None, 1), (None, 2), (1, 5)], "k int, v int")
    assert rows.sorted(G.group_sum(df, ["k"], {"s": "v"})) == sorted([(None, 3), (1, 5)], key=repr)


def test_square_sum_overflow_is_an_error(rows):
    ok = rows.of([(1, 3), (1, 4)], "k int, v bigint")
    assert rows.listed(G.checked_square_sum(ok, ["k"], "v")) == [(1, 25)]
    big = rows.of([(1, 2**32), (1, 2**32)], "k int, v bigint")
    with pytest.raises(Exception, match="overflow"):
        G.checked_square_sum(big, ["k"], "v").collect()


def test_first_and_last(rows):
    got = G.group_edges(rows.of(FIRST, PEOPLE), ["country"], "age, height:desc", ["name", "height"])
    assert rows.sorted(got.select("country", "first.height", F.col("last.height").alias("l")))[1] == ("US", 202, 160)
    by_name = G.group_edges(rows.of(FIRST, PEOPLE), ["country"], "name:desc, height", ["name"])
    got = {r["country"]: (r["first"]["name"], r["last"]["name"]) for r in by_name.collect()}
    assert got == {c: (max(r[2] for r in FIRST if r[0] == c), min(r[2] for r in FIRST if r[0] == c)) for c in {r[0] for r in FIRST}}


@pytest.mark.parametrize("mark", ["", ":desc", ":null_biggest", ":desc|null_biggest"])
def test_first_and_last_of_every_level(rows, mark):
    """Enum, date and text fields, both directions, nulls and repeated rows, at every rollup level."""
    rng = random.Random(len(mark))
    days = [None, dt.date(2024, 1, 2), dt.date(2023, 5, 6), dt.date(2024, 3, 1)]
    data = [(rng.choice("ab"), rng.choice(["LOW", "HIGH", None]), rng.choice(days), rng.choice(["x", "é", None, "Z"]), i // 2) for i in range(80)]
    df = rows.of(data, "g string, e string, d date, t string, n int").repartition(4)
    declared = S.schema([df.schema["g"], S.field("e", "enum", nullable=True, values=["LOW", "MID", "HIGH"]), *[df.schema[c] for c in "dtn"]])
    order = f"g, e{mark}, d{mark}, t{mark}, n"
    got = G.rollup_edges(df, order, ["g", "e", "d"], "e", ["t", "n"], declared).collect()

    def rank(value, index):
        values = {1: ["LOW", "MID", "HIGH"], 2: sorted(d for d in days if d), 3: sorted(["x", "é", "Z"], key=str.encode)}[index]
        if value is None:
            at = len(values) if "null_biggest" in mark else -1
        else:
            at = values.index(value)
        return -at if "desc" in mark else at

    whole = sorted(data, key=lambda r: (r[0], rank(r[1], 1), rank(r[2], 2), rank(r[3], 3), r[4]))
    want = {}
    for depth in (1, 2):
        for r in whole:
            key = (depth, *r[: depth + 1], *[None] * (2 - depth))
            first, _ = want.get(key, ((r[3], r[4]), None))
            want[key] = (first, (r[3], r[4]))
    assert {(r["depth"], r["g"], r["e"], r["d"]): (tuple(r["first"]), tuple(r["last"])) for r in got} == want


class Spread(G.RollupState):
    """Rows, sum, first and last value of a group: the order matters."""

    def zero(self):
        return None

    def add(self, state, rows):
        values = rows["height"].tolist()
        return self.merge(state, (len(values), sum(values), values[0], values[-1]))

    def merge(self, state, later):
        if state is None or later is None:
            return later if state is None else state
        return state[0] + later[0], state[1] + later[1], state[2], later[3]

    def close(self, depth, field, key, state):
        yield depth, field, "|".join(map(str, key)), *state


@pytest.mark.parametrize("rollup_from", ["country", "age"])
def test_rollup_states_merge_over_partition_edges(spark, rows, rollup_from):
    """Two countries over many partitions, batches of three rows: most groups are cut somewhere."""
    saved = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    for key, value in zip(saved, ("false", "3", "7")):
        spark.conf.set(key, value)
    try:
        rng = random.Random(5)
        data = sorted((rng.choice(["A", "B", "B", "B"]), rng.randint(0, 1), rng.choice("xy"), -i) for i in range(90))
        data = [(a, b, c, -d) for a, b, c, d in data]
        df = rows.of(data, PEOPLE).repartition(5)
        schema = "depth int, field string, key string, n long, total long, first long, last long"
        got = sorted(tuple(r) for r in G.rollup_states(df, ORDER, ["country", "age", "name"], rollup_from, Spread(), schema).collect())
    finally:
        for key, value in saved.items():
            spark.conf.set(key, value)
    want = []
    for depth in range(["country", "age"].index(rollup_from), 3):
        for key, group in itertools.groupby(data, key=lambda r: r[: depth + 1]):
            values = [r[3] for r in group]
            want.append((depth, ["country", "age", "name"][depth], "|".join(map(str, key)), len(values), sum(values), values[0], values[-1]))
    assert got == sorted(want)
    assert G.rollup_states(df.limit(0), ORDER, ["country", "age", "name"], rollup_from, Spread(), schema).collect() == []


def test_rollup_events_are_numbered_without_gaps(rows):
    rng = random.Random(6)
    data = [(rng.choice("AB"), rng.randint(0, 2), rng.choice("xyz"), i) for i in range(70)]
    seq = [r["seq"] for r in G.rollup_events(rows.of(data, PEOPLE).repartition(6), ORDER, ["country", "age", "name"], "age").orderBy("seq").collect()]
    assert seq == list(range(len(seq)))


class Totals(G.CogroupState):
    def zero(self, source):
        return [0, 0]

    def add(self, source, state, rows):
        column = "money" if source == "user" else "size"
        return [state[0] + len(rows), state[1] + int(rows[column].sum())]

    def merge(self, source, state, other):
        return [a + b for a, b in zip(state, other)]

    def close(self, key, states):
        yield key[0], str(sorted(states.items()))


@pytest.mark.parametrize("slices", [1, 8])
def test_cogroup_states_spread_a_hot_key(rows, slices):
    users = [("hot" if i % 3 else f"u{i}", i) for i in range(200)] + [(None, 7), (None, 8)]
    sizes = [("hot", 5), ("hot", 6), ("alone", 1)]
    sources = {"user": rows.of(users, "home string, money int").repartition(4), "place": rows.of(sizes, "k string, size int")}
    got = dict(rows.sorted(G.cogroup_states(sources, ["k"], Totals(), "k string, t string", aliases={"user": {"k": "home"}}, slices=slices)))
    want = {}
    for k in {k for k, _ in users + sizes}:
        found = {}
        for source, data in (("user", users), ("place", sizes)):
            mine = [v for x, v in data if x == k]
            if mine:
                found[source] = [len(mine), sum(mine)]
        want[k] = str(sorted(found.items()))
    assert got == want


def test_combiner_of_one_source(rows):
    people = rows.of([("a", 1), ("a", 2), ("b", 3)], "k string, v long")
    places = rows.of([("a", 9)], "k string, w long")
    seen = lambda key, batches: iter([(key[0], sum(len(b) for b in batches))])
    combine = {"people": lambda df: df.groupBy("k").agg(F.sum("v").alias("v"))}
    got = G.reduce_cogroups({"people": people, "places": places}, ["k"], seen, "k string, n long", combiners=combine)
    assert rows.sorted(got) == [("a", 2), ("b", 1)]
    with pytest.raises(ValueError):
        G.reduce_cogroups({"people": people}, ["k"], seen, "k string, n long", combiners={"nobody": lambda df: df})


def test_source_order_between_other_fields(rows):
    a, b = rows.of([("k", 2, 1.0), ("k", 1, 5.0), ("j", 1, 1.0)], "k string, x int, p double"), rows.of([("k", 1, 7), ("k", 2, 8), ("k", 1, 6)], "k string, x int, q int")
    out, columns = G.cogroup_rows({"a": a, "b": b}, ["k"], "k, x, source_ix:desc", specific_order={"b": "q:desc"})
    got = [(r["k"], r["x"], r["source_ix"], r["q"]) for r in out.orderBy(*columns).collect()]
    assert got == [("j", 1, 0, None), ("k", 1, 1, 7), ("k", 1, 1, 6), ("k", 1, 0, None), ("k", 2, 1, 8), ("k", 2, 0, None)]
    out, columns = G.cogroup_rows({"a": a, "b": b}, ["k"], "k, source_ix, x:desc")
    assert [(r["x"], r["source_ix"]) for r in out.where("k = 'k'").orderBy(*columns).collect()] == [(2, 0), (1, 0), (2, 1), (1, 1), (1, 1)]


def test_partition_fields_keep_groups_whole(rows):
    data = [(a, b, i) for i, (a, b) in enumerate(itertools.product("xyz", range(4)))] * 2
    df = rows.of(data, "a string, b int, v int")

    def where(key, batches):
        from pyspark import TaskContext

        yield *key, sum(int(b["v"].sum()) for b in batches), TaskContext.get().partitionId()

    schema = "a string, b int, total long, part int"
    got = G.reduce_groups(df, ["a", "b"], where, schema, partition_fields=["a"], partitions=5).collect()
    assert {(r["a"], r["b"]): r["total"] for r in got} == {(a, b): 2 * v for a, b, v in data}
    assert all(len({r["part"] for r in got if r["a"] == a}) == 1 for a in "xyz")
    trace = G.rollup_hooks(df, "a, b", ["a", "b"], "b", G.RollupHooks(), "x int", partition_fields=["a"], partitions=3)
    assert trace.count() == 0
    for wrong in (["v"], [], ["nothing"], ["a", "a"]):
        with pytest.raises(ValueError):
            G.reduce_groups(df, ["a", "b"], where, schema, partition_fields=wrong)
    with pytest.raises(ValueError):  # b is below the field that the rollup starts from
        G.rollup_hooks(df, "a, b", ["a", "b"], "a", G.RollupHooks(), "x int", partition_fields=["b"])


class Router(G.OutputMapper):
    """Rows above a limit of its own go to one output, the others to another; the count comes at the end."""

    def __init__(self, column, limit):
        self.column, self.limit = column, limit

    def setup(self):
        self.rows = 0

    def map(self, batch):
        self.rows += len(batch)
        high = batch[self.column] > self.limit
        yield "high", pd.DataFrame({"v": batch.loc[high, self.column]})
        yield "low", pd.DataFrame({"v": batch.loc[~high, self.column], "limit": float(self.limit)})

    def cleanup(self):
        yield "seen", pd.DataFrame({"limit": [self.limit], "n": [self.rows]})


def test_mappers_with_settings_and_named_outputs(spark, rows):
    one, two = spark.range(10).withColumnRenamed("id", "a"), spark.range(100).repartition(3).withColumnRenamed("id", "b")
    outputs = {"high": "v long", "low": "v long, limit double", "seen": "limit long, n long", "never": "x string"}
    got = G.map_outputs([(one, Router("a", 6)), (two, Router("b", 90))], outputs)
    assert set(got) == set(outputs) and got["low"].dtypes == [("v", "bigint"), ("limit", "double")]
    assert sorted(r["v"] for r in got["high"].collect()) == sorted([7, 8, 9, *range(91, 100)])
    assert got["low"].where("limit = 6").count() == 7 and got["low"].where("limit = 90").count() == 91
    totals = {r["limit"]: r["n"] for r in got["seen"].groupBy("limit").agg(F.sum("n").alias("n")).collect()}
    assert totals == {6: 10, 90: 100} and got["never"].count() == 0
    plan = got["high"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(output" in plan
    with pytest.raises(Exception, match="no output"):
        G.map_outputs([(one, Router("a", 6))], {"high": "v long"})


def test_cogroup_source_order(rows):
    countries = rows.of([("ES", 1000), ("FR", 1500)], "country string, averageSalary int")
    users = rows.of([("Pere", 100, "ES"), ("Iván", 50, "ES"), ("Eric", 150, "FR")], "name string, money int, my_country string")

    def names(key, batches):
        seen = []
        for b in batches:
            seen += [n if ix else f"average {int(s)}" for ix, n, s in zip(b["source_ix"], b["name"], b["averageSalary"].fillna(0))]
        yield key[0], ", ".join(seen)

    got = G.reduce_cogroups(
        {"country": countries, "user": users}, ["country"], names, "country string, seen string",
        aliases={"user": {"country": "my_country"}}, specific_order={"user": "money"}, source_descending=True,
    )
    assert rows.sorted(got) == [("ES", "Iván, Pere, average 1000"), ("FR", "Eric, average 1500")]
    with pytest.raises(ValueError):
        G.cogroup_rows({"country": countries}, ["country"], specific_order={"nobody": "money"})


def test_ordered_reducer_streams_a_long_group(spark, rows):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")

    def check(key, batches):
        count, last, ordered, n = 0, None, True, 0
        for b in batches:
            values = b["v"].tolist()
            ordered &= values == sorted(values) and (last is None or values[0] >= last)
            last, count, n = values[-1], count + len(values), n + 1
        yield key[0], count, ordered, n

    try:
        df = spark.range(5000).selectExpr("IF(id % 10 = 0, 1, 0) AS k", "CAST(hash(id) AS bigint) AS v")
        got = G.reduce_groups(df, ["k"], check, "k int, count int, ordered boolean, batches int", order="v").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    by_key = {r["k"]: r for r in got}
    assert by_key[0]["count"] == 4500 and by_key[1]["count"] == 500
    assert all(r["ordered"] for r in got) and by_key[0]["batches"] > 1


def test_mapper_hooks(spark):
    class Doubler(G.RowMapper):
        def __init__(self, factor):
            self.factor = factor

        def setup(self):
            self.seen = 0

        def map(self, batch):
            self.seen += len(batch)
            yield pd.DataFrame({"v": list(batch["id"] * self.factor) * 2})

        def cleanup(self):
            yield pd.DataFrame({"v": [-self.seen]})

    got = [r[0] for r in G.map_rows(spark.range(0, 10, 1, 2), Doubler(3), "v bigint").collect()]
    assert sorted(v for v in got if v > 0) == sorted([3 * i for i in range(1, 10)] * 2)
    assert sum(v for v in got if v < 0) == -10


def test_rollup_hooks(rows):
    class Trace(G.RollupHooks):
        def on_open(self, depth, field, row):
            yield f"open {field}", row["country"]

        def on_close(self, depth, field, row):
            yield f"close {field}", row["country"]

    got = G.rollup_hooks(rows.of(FIRST, PEOPLE), ORDER, ["country", "age", "name"], "country", Trace(), "event string, country string")
    us = [r["event"] for r in got.collect() if r["country"] == "US"]
    assert us[0] == "open country" and us[-1] == "close country" and us.count("open age") == us.count("close age") == 3


def test_reducer_sees_null_and_mixed_keys(rows):
    data = [(None, "a", 1), (None, None, 2), (1, "a", 3), (1, None, 4), (None, "a", 5)]

    def total(key, batches):
        yield *key, sum(int(b["v"].sum()) for b in batches)

    got = G.reduce_groups(rows.of(data, "x int, y string, v int"), ["x", "y"], total, "x int, y string, v bigint")
    assert rows.sorted(got) == sorted([(None, "a", 6), (None, None, 2), (1, "a", 3), (1, None, 4)], key=repr)


def test_reducer_keeps_long_null_and_nan_keys_apart(spark, rows):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "2")  # groups go on over batch edges
    big, nan = 2**53, float("nan")
    data = [(big, 1.0), (big + 1, 1.0), (None, 1.0), (None, nan), (None, nan), (None, nan), (None, nan), (None, nan), (7, None), (7, None), (7, None)]

    def count(key, batches):
        yield key[0], str(key[1]), sum(len(b) for b in batches)

    try:
        got = G.reduce_groups(rows.of(data, "x long, y double").coalesce(1), ["x", "y"], count, "x long, y string, n long")
        found = rows.sorted(got)
    finally:
        spark.conf.set(key, old)
    want = [(big, "1.0", 1), (big + 1, "1.0", 1), (None, "1.0", 1), (None, "nan", 5), (7, "None", 3)]
    assert found == sorted(want, key=repr)


def test_cogroup_keeps_long_values_whole(rows):
    big = 2**53 + 1
    left, right = rows.of([(1, big)], "k int, v long"), rows.of([(1, big + 2)], "k int, w long")

    def values(key, batches):
        v, w = None, None
        for b in batches:
            for x, y in zip(b["v"], b["w"]):
                v, w = v if pd.isna(x) else int(x), w if pd.isna(y) else int(y)
        yield key[0], v, w

    got = G.reduce_cogroups({"left": left, "right": right}, ["k"], values, "k int, v long, w long")
    assert rows.sorted(got) == [(1, big, big + 2)]


def test_reducer_that_stops_early(spark, rows):
    def first(key, batches):
        yield key[0], int(next(batches)["v"].iloc[0])

    df = spark.range(3000).selectExpr("id % 3 AS k", "id AS v")
    got = G.reduce_groups(df, ["k"], first, "k bigint, v bigint", order="v:desc")
    assert rows.sorted(got) == [(0, 2997), (1, 2998), (2, 2999)]


def test_rollup_over_many_partitions(spark, rows):
    """Groups cross partition edges when small partitions are not merged."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        rng = random.Random(21)
        data = sorted({(rng.choice("AB"), rng.randint(0, 1), rng.choice("xy"), -i) for i in range(60)})
        data = [(a, b, c, -d) for a, b, c, d in data]
        assert events(rows, data, "country", ["country", "age", "name"]) == expected(data, 0, 2)
    finally:
        spark.conf.set(key, old)


def test_rollup_hooks_sort_packed_runs(spark, rows):
    """A task of hooks sorts a few compressed runs, not every event of its hierarchy."""

    class Sums(G.RollupHooks):
        def __init__(self):
            self.seen = []

        def on_element(self, row):
            self.seen.append(row["v"])
            return iter(())

        def on_close(self, depth, field, row):
            if field == "g":
                yield row["g"], self.seen == sorted(self.seen), len(self.seen)
                self.seen = []

    data = [(None if k % 3 == 2 else "ab"[k % 3], k % 50, k) for k in range(9000)]
    got = G.rollup_hooks(rows.of(data, "g string, h int, v int").repartition(7), "g, h, v", ["g", "h"], "g", Sums(), "g string, ordered boolean, n long")
    assert rows.sorted(got.select("g", "n")) == sorted([("a", 3000), ("b", 3000), (None, 3000)], key=repr)
    assert "_run" in got._jdf.queryExecution().optimizedPlan().toString()
