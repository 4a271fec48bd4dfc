import random

import pytest
from pyspark.sql import functions as F

from loomstat.functions import ordering as O
from loomstat.functions import schema as S
from loomstat.operators import ranking as R


def test_order_text():
    a, b, c = O.parse_order("x:desc|null_biggest, y , z:NULL_SMALLEST")
    assert (a.name, a.descending, a.null_biggest) == ("x", True, True)
    assert (b.name, b.descending, b.null_biggest) == ("y", False, False)
    assert (c.name, c.descending) == ("z", False)


@pytest.mark.parametrize("text", ["x:up", "x,,y", "x,x", ""])
def test_order_text_rejects(text):
    with pytest.raises(ValueError):
        O.parse_order(text)


@pytest.mark.parametrize(
    "mark,want",
    [
        ("asc|null_smallest", [None, 1, 2]),
        ("desc|null_smallest", [2, 1, None]),
        ("asc|null_biggest", [1, 2, None]),
        ("desc|null_biggest", [None, 2, 1]),
    ],
)
def test_null_order(rows, mark, want):
    df = rows.of([(2,), (None,), (1,)], "v int").orderBy(*O.sort_columns("v:" + mark))
    assert [r[0] for r in df.collect()] == want


def test_enum_sorts_by_declared_order(rows):
    target = S.schema([S.field("e", "enum", nullable=True, values=["LOW", "MID", "HIGH"])])
    df = rows.of([("HIGH",), (None,), ("LOW",), ("MID",)], "e string")
    assert [r[0] for r in df.orderBy(*O.sort_columns("e", target)).collect()] == [None, "LOW", "MID", "HIGH"]


def test_natural_names(rows):
    df = rows.of([("n10",), ("n9",), ("m100",), ("n",), ("n9b",)], "h string")
    assert [r[0] for r in df.orderBy(*O.natural_key(F.col("h"))).collect()] == ["m100", "n", "n9", "n9b", "n10"]


def test_natural_names_with_several_numbers(rows):
    names = ["compute-10-2", "compute-0-10", "compute-0-2", "compute-2-1", "compute-0-1"]
    df = rows.of([(n,) for n in names], "h string")
    got = [r[0] for r in df.orderBy(*O.natural_key(F.col("h"))).collect()]
    assert got == ["compute-0-1", "compute-0-2", "compute-0-10", "compute-2-1", "compute-10-2"]


def test_job_checks(rows):
    a = rows.of([(1, "x")], "k int, s string")
    b = rows.of([(1,)], "k bigint")
    assert [k.name for k in O.check_job({"a": a}, ["k"])] == ["k"]
    bad = [
        ({}, ["k"], None, None),
        ({"a": a}, [], None, None),
        ({"a": a}, ["k", "k"], None, None),
        ({"a": a}, ["gone"], None, None),
        ({"a": a, "b": b}, ["k"], None, None),
        ({"a": a}, ["k"], "s", None),
        ({"a": a}, ["k"], "s, k", None),
        ({"a": a}, ["k"], "k, gone", None),
        ({"a": a}, ["k"], "k, s", "s"),
    ]
    for sources, keys, order, rollup in bad:
        with pytest.raises(ValueError):
            O.check_job(sources, keys, order, rollup)


def test_job_checks_on_source_and_specific_orders(rows):
    a, b = rows.of([(1, "x", 2)], "k int, s string, n int"), rows.of([(1, "y", 2.0)], "k int, t string, n double")
    both = {"a": a, "b": b}
    assert [k.name for k in O.check_job(both, ["k"], "k, source_ix:desc", specific={"a": "s, n:desc", "b": "t"})] == ["k", "source_ix"]
    bad = [
        (both, "source_ix, k", None),  # before the group fields
        (both, "k, source_ix, source_ix", None),
        (both, "k, n", None),  # types differ, but an order field only needs to be there: see below
        ({"a": a}, "k, source_ix", None),
        (both, "k", {"c": "s"}),
        (both, "k", {"a": []}),
        (both, "k", {"a": "t"}),
        (both, "k", {"a": "k"}),
        (both, "k", {"a": "s, s"}),
        (both, "k", {"a": "source_ix"}),
        (both, "k, n", {"a": "n"}),
    ]
    for at, (sources, order, specific) in enumerate(bad):
        if at == 2:
            assert O.check_job(sources, ["k"], order, specific=specific)
            continue
        with pytest.raises(ValueError):
            O.check_job(sources, ["k"], order, specific=specific)
    with pytest.raises(ValueError):
        O.check_job({"a": a.withColumnRenamed("n", "source_ix"), "b": b}, ["k"])


def test_reversed_keys_sort_the_other_way_round(rows):
    for mark in ("", ":desc", ":null_biggest", ":desc|null_biggest"):
        df = rows.of([(2,), (None,), (1,), (3,)], "v int")
        key = O.parse_order(f"v{mark}")[0]
        up, down = ([r[0] for r in df.orderBy(k.column()).collect()] for k in (key, key.reversed()))
        assert up == down[::-1]


def test_positions_match_a_sort(spark, rows):
    rng = random.Random(3)
    data = [(rng.randint(0, 30), rng.random(), i) for i in range(3000)]
    df = rows.of(data, "k int, v double, id int").repartition(7)
    got = R.with_position(df, [F.col("k").asc(), F.col("v").desc()])
    want = {r[2]: i for i, r in enumerate(sorted(data, key=lambda r: (r[0], -r[1])))}
    assert {r["id"]: r["position"] for r in got.collect()} == want


def test_positions_in_a_group_holding_most_rows(rows):
    data = [("hot" if i % 10 else "cold", i) for i in range(1000)]
    got = R.position_in_group(rows.of(data, "k string, v int"), ["k"], [F.col("v").desc()])
    for key in ("hot", "cold"):
        mine = sorted((r["position"], -r["v"]) for r in got.where(F.col("k") == key).collect())
        assert [p for p, _ in mine] == list(range(len(mine)))
        assert mine == sorted(mine, key=lambda t: t[1])


def test_rank_with_ties_and_nulls(rows):
    df = rows.of([("b",), ("a",), ("b",), (None,), ("c",)], "w string")
    assert rows.sorted(R.rank_by(df, "w")) == sorted([(None, 1), ("a", 2), ("b", 3), ("b", 3), ("c", 5)], key=repr)


@pytest.mark.parametrize("percent", [1, 50, 95, 99.9, 100])
def test_nearest_rank_against_brute_force(rows, percent):
    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.9 else "cold", rng.choice([0.0, 0.0, 1.5, rng.random()])) for _ in range(700)]
    got = {r["k"]: r["percentile"] for r in R.nearest_rank(rows.of(data, "k string, v double"), ["k"], "v", percent).collect()}
    for key in ("hot", "cold"):
        values = sorted(v for k, v in data if k == key)
        want = values[-(-len(values) * round(percent * 10000) // 1_000_000) - 1]
        assert got[key] == want


def test_empty_input(rows):
    empty = rows.of([], "k string, v double")
    assert R.with_position(empty, [F.col("v").asc()]).count() == 0
    assert R.nearest_rank(empty, ["k"], "v", 95).count() == 0
