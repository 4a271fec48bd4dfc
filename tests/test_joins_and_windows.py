import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from loomstat.operators import joins as J
from loomstat.operators import windows as W
from loomstat.operators.pairs import pair_sums


def test_url_resolution(rows):
    mapping = rows.of([("a", "A"), ("b", "B"), (None, "N"), ("a", "A0")], "nc string, canonical string")
    hits = rows.of([("a", 2, "x"), ("a", 1, "y"), ("q", 5, "z"), (None, 9, "w")], "url string, timestamp int, ip string")
    got = rows.listed(J.resolve(hits, mapping, "url", "nc", "canonical", "timestamp"), "original", "url", "timestamp")
    assert got == [(None, "N", 9), ("a", "A0", 1), ("a", "A0", 2)] + [("q", None, 5)]


def test_fan_out_keeps_unmatched_empty(rows):
    tweets = rows.of([(1, ["h1", "h2"]), (2, ["h3"])], "id int, hashtags array<string>")
    retweets = rows.of([("eric", 1), ("eric", 2), ("marianico", 2), ("lost", 9)], "username string, tweet_id int")
    got = rows.sorted(J.fan_out(retweets, tweets, "tweet_id", "id", ["hashtags"]))
    assert got == sorted([("eric", 1, ["h1", "h2"]), ("eric", 2, ["h3"]), ("marianico", 2, ["h3"]), ("lost", 9, None)], key=repr)


def test_full_outer_with_null_key(rows):
    a = rows.of([(1, "x"), (None, "n")], "k int, a string")
    b = rows.of([(None, 5), (2, 6)], "k int, b int")
    assert rows.sorted(J.outer_by_key(a, b, "k")) == sorted([(1, "x", None), (None, "n", 5), (2, None, 6)], key=repr)


def test_stop_words_are_exact(rows):
    words = rows.of([("bar",), ("Bar",), ("foo",), (None,)], "word string")
    stop = rows.of([("bar",), ("bloh",)], "word string")
    assert rows.sorted(J.drop_terms(words, "word", stop)) == sorted([("Bar",), ("foo",), (None,)], key=repr)


HOSTS = [(f"{p}{i}", m) for p in ("web-", "DB-", "front.Web") for i in range(12) for m in ("cpu_user", "mem", None)] + [("a", "é-mem"), (None, "mem"), ("", "")]


def regex_hits(rules):
    hit = lambda p, v: p is None or (v is not None and re.search(p, v, re.I | re.A) is not None)
    return sorted(((h, m, hp, mp) for h, m in HOSTS for hp, mp in rules if hit(hp, h) and hit(mp, m)), key=repr)


@pytest.mark.parametrize("slice_rows, chunk", [(1, 1), (5, 2), (4096, 256)])
def test_regex_join_matches_brute_force(rows, slice_rows, chunk):
    rules = [("web-1", None), ("db-[24]$", "CPU"), (".*", "^mem$"), ("none", "x"), (None, "user"), ("web-1", None), (None, None), ("t.web(1|2)+", "em$"), ("WEB-?1", "(cpu|mem)")]
    got = J.regex_matches(
        rows.of(HOSTS + HOSTS, "host string, metric string"), rows.of(rules, "hp string, mp string"), [("host", "hp"), ("metric", "mp")], slice_rows, chunk
    )
    assert rows.sorted(got, "host", "metric", "hp", "mp") == regex_hits(rules)


def random_pattern(rng):
    parts = []
    for _ in range(rng.randint(1, 4)):
        part = rng.choice(["web", "WEB-", "db", "front", "cpu", "_user", "mem", "e", "-", r"\.", ".", "[0-9]", "[^a-c]", r"\d", "(web|db)", "(me(m)?)", "b-1", "é", r"\-"])
        parts.append(part + rng.choice(["", "", "", "?", "*", "+", "{1,2}", "+?"]))
    return rng.choice(["", "", "^", "(a|)"]) + "".join(parts) + rng.choice(["", "", "$", "|mem"])


def test_regex_join_equals_the_plain_test_on_random_rules(rows):
    rng = random.Random(12)
    rules = [(random_pattern(rng), rng.choice([None, random_pattern(rng), "mem"])) for _ in range(150)]
    assert sum(J.required_literal(h) is not None for h, _ in rules) > 30
    got = J.regex_matches(rows.of(HOSTS, "host string, metric string"), rows.of(rules, "hp string, mp string"), [("host", "hp"), ("metric", "mp")], 7)
    assert rows.sorted(got, "host", "metric", "hp", "mp") == regex_hits(rules)


def test_required_literals():
    found = {
        "web-1": "web-1", "^Host[0-9]+cpu$": "host", "a|web": None, "(web|db)front": "front", "(?i)web": None, "we?bx": None, "colou?red": "colo",
        "ab+cde": "cde", "abc+d": "abc", r"a\.b": "a.b", r"web\d": "web", r"\Qweb\E": None, r"\x41web": None, "[]a]web": None, "[[a]web": None, "webé": "web", "x{3}web": "web",
        "(a(b|c)|[)])web": "web", "(web": None, "": None, None: None, "ab": None, "web*": None, "weba*": "web",
    }
    assert {p: J.required_literal(p) for p in found} == found


def test_regex_join_without_rules(rows):
    empty = rows.of([], "hp string")
    assert J.regex_matches(rows.of([("a",)], "host string"), empty, [("host", "hp")]).count() == 0


def spans(rng, n, longest, width=100):
    out = []
    for i in range(n):
        s = rng.randint(-width, width)
        out.append((i, s, rng.choice([s, s + rng.randint(0, longest), s + rng.randint(0, 5), None, s - 1])))
    return out + [(n, None, 4), (n + 1, -(10**9), 10**9), (n + 2, 3, 3 + 2**20)]


def overlapping(a, b, also=lambda x, y: True):
    end = lambda r: r[1] if r[2] is None else r[2]
    ok = lambda r: r[1] is not None and r[1] <= end(r)
    return sorted((x[0], y[0]) for x in a for y in b if ok(x) and ok(y) and x[1] <= end(y) and y[1] <= end(x) and also(x, y))


@pytest.mark.parametrize("longest, slice_rows", [(0, 4096), (30, 4096), (500, 3), (30, 1)])
def test_overlap_join_matches_brute_force(rows, longest, slice_rows):
    rng = random.Random(longest + slice_rows)
    a, b = spans(rng, 60, longest), spans(rng, 50, 7)
    left, right = rows.of(a, "i int, s bigint, e bigint"), rows.of(b, "j int, s2 int, e2 int")
    got = J.overlap_join(left, right, ("s", "e"), ("s2", "e2"), slice_rows=slice_rows)
    assert got.columns == ["i", "s", "e", "j", "s2", "e2"]
    assert sorted((r["i"], r["j"]) for r in got.collect()) == overlapping(a, b)
    some = J.overlap_join(left, right, ("s", "e"), ("s2", "e2"), also=F.col("i") < F.col("j"), slice_rows=slice_rows)
    assert sorted((r["i"], r["j"]) for r in some.collect()) == overlapping(a, b, lambda x, y: x[0] < y[0])


def test_overlap_join_of_repeated_rows_and_empty_sides(rows):
    one = rows.of([(1, 5, 9), (1, 5, 9), (2, 9, 9)], "i int, s int, e int")
    two = rows.of([(1, 9, 12), (1, 9, 12)], "j int, s2 int, e2 int")
    assert J.overlap_join(one, two, ("s", "e"), ("s2", "e2"), slice_rows=1).count() == 6
    assert J.overlap_join(one.limit(0), two, ("s", "e"), ("s2", "e2")).count() == 0
    assert J.overlap_join(one, two.limit(0), ("s", "e"), ("s2", "e2")).count() == 0
    with pytest.raises(ValueError):
        J.overlap_join(one, one, ("s", "e"), ("s", "e"))


def test_a_long_range_beside_short_ones_makes_few_keys(rows):
    """A range of a year among seconds has two keys at its own level; each second has its own and two at the year's."""
    short = rows.of([(i, i, i) for i in range(200)], "i int, s bigint, e bigint")
    year = rows.of([(0, 0, 31_536_000)], "j int, s2 bigint, e2 bigint")
    sides = {"l": J._levelled(short, "s", "e", "l"), "r": J._levelled(year, "s2", "e2", "r")}
    assert J._keyed(sides["r"], "r", J._levels(sides["l"], "l")).count() <= 2
    assert J._keyed(sides["l"], "l", J._levels(sides["r"], "r")).count() == 400


def test_events_in_window(rows):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    ev = rows.of(
        [(1, t(1), t(5), "web"), (2, t(1), None, "web"), (3, t(4), None, "web"), (4, t(6), t(9), "db"), (5, t(8), t(20), "web"), (6, t(0), t(2), "web")],
        "event_id int, start_ts timestamp_ntz, end_ts timestamp_ntz, host_regex string",
    )
    at = lambda h: F.lit(t(h)).cast("timestamp_ntz")
    got = rows.sorted(J.touching(ev, at(3), at(10), F.lit("web-7")), "event_id", "clip_start", "clip_end", "starts_inside")
    assert got == [(1, t(3), t(5), False), (3, t(4), None, True), (5, t(8), t(10), True)]
    ids = lambda df: [r["event_id"] for r in df.orderBy("event_id").collect()]
    assert ids(J.touching(ev, start=at(5))) == [1, 4, 5] and ids(J.touching(ev, end=at(1))) == [1, 2, 6]
    assert ids(J.touching(ev)) == [1, 2, 3, 4, 5, 6]
    late = J.touching(ev, start=at(5)).where("event_id = 1").select("clip_start", "clip_end", "starts_inside").head()
    assert tuple(late) == (t(5), t(5), False)


def test_pair_sums_match_brute_force(rows):
    rng = random.Random(4)
    data = {(rng.randint(0, 40), rng.randint(0, 15) if rng.random() < 0.7 else 3): float(rng.randint(1, 5)) for _ in range(400)}
    df = rows.of([(r, c, v) for (r, c), v in data.items()], "r bigint, c bigint, v double")
    for block_rows, block_cols in ((512, 1024), (7, 4), (1, 1)):
        got = {(p["a"], p["b"]): tuple(p[c] for c in ("n", "sx", "sy", "sxx", "syy", "sxy")) for p in pair_sums(df, "r", "c", "v", block_rows, block_cols).collect()}
        want = {}
        ids = sorted({r for r, _ in data})
        for i in ids:
            for j in ids:
                common = [c for c in range(16) if i < j and (i, c) in data and (j, c) in data]
                if common:
                    xs, ys = [data[i, c] for c in common], [data[j, c] for c in common]
                    dot = lambda p, q: sum(a * b for a, b in zip(p, q))
                    want[i, j] = (len(common), sum(xs), sum(ys), dot(xs, xs), dot(ys, ys), dot(xs, ys))
        assert got == want


@pytest.mark.parametrize("sizes", [(512, 1024), (7, 4), (1, 1)])
def test_pair_sums_of_asked_rows(rows, sizes):
    rng = random.Random(5)
    data = {(rng.randint(0, 30), rng.randint(0, 12)): float(rng.randint(1, 5)) for _ in range(200)}
    df = rows.of([(r, c, v) for (r, c), v in data.items()], "r bigint, c bigint, v double")
    asked = rows.of([(3,), (3,), (8,), (29,), (99,)], "r bigint")
    got = {(p["a"], p["b"]): tuple(p[c] for c in ("n", "sx", "sy", "sxx", "syy", "sxy")) for p in pair_sums(df, "r", "c", "v", *sizes, asked=asked).collect()}
    want = {}
    for i in (3, 8, 29):
        for j in {r for r, _ in data} - {i}:
            common = [c for c in range(13) if (i, c) in data and (j, c) in data]
            if common:
                xs, ys = [data[i, c] for c in common], [data[j, c] for c in common]
                dot = lambda p, q: sum(a * b for a, b in zip(p, q))
                want[i, j] = (len(common), sum(xs), sum(ys), dot(xs, xs), dot(ys, ys), dot(xs, ys))
    assert got == want


def test_pairs_are_summed_in_one_shuffle_of_lists(rows):
    """The sums of a cell take no shuffle of their own, so no pair crosses one."""
    df = rows.of([(r, c, 1.0) for r in range(12) for c in range(9)], "r bigint, c bigint, v double")
    for asked in (None, rows.of([(3,), (4,)], "r bigint")):
        pairs = pair_sums(df, "r", "c", "v", 1, 1, asked=asked)
        assert pairs.count() == (66 if asked is None else 22)
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        above = plan[: plan.index("shufflepartitionidpassthrough")]
        assert above.count("Exchange") == 1 and above.count("Generate inline") == 2


def test_pair_sums_of_null_rows_and_columns(rows):
    df = rows.of([(1, 1, 2.0), (2, 1, 3.0), (None, 1, 9.0), (3, None, 9.0), (4, None, 9.0), (5, 1, None)], "r bigint, c bigint, v double")
    assert rows.sorted(pair_sums(df, "r", "c", "v"), "a", "b", "n", "sxy") == [(1, 2, 1.0, 6.0), (3, 4, 1.0, 81.0)]


@pytest.mark.parametrize("chunk", [1, 40, 2**20])
def test_cells_sum_some_rows_at_a_time_and_keep_the_best(chunk, monkeypatch):
    """Rows of more products than a chunk, sparse rows, repeated entries and nulls give the sums of all products."""
    import numpy as np
    import pyarrow as pa

    from loomstat.operators import pairs

    monkeypatch.setattr(pairs, "CHUNK", chunk)
    rng = random.Random(6)
    pick = lambda many: None if rng.random() < 0.1 else rng.randint(0, many) * 1000
    left = [(k % 5, pick(9), rng.choice([None, 1.0, 2.0])) for k in range(60)]
    right = [(k % 6, pick(30), rng.choice([None, 3.0, 5.0])) for k in range(80)]
    table = pa.table(
        {
            "_row": pa.array([r for r, _, _ in left + right], pa.int64()),
            "_same": pa.array([False] * 140),
            "_side": pa.array([0] * 60 + [1] * 80, pa.int32()),
            "a": pa.array([a for _, a, _ in left] + [None] * 80, pa.int64()),
            "x": pa.array([x for _, _, x in left] + [None] * 80, pa.float64()),
            "b": pa.array([None] * 60 + [b for _, b, _ in right], pa.int64()),
            "y": pa.array([None] * 60 + [y for _, _, y in right], pa.float64()),
        }
    )
    sums = {"both": lambda x, y, has_x, has_y: np.where(has_x & has_y, x * y, 0.0), "y": lambda x, y, has_x, has_y: y}
    want = {}
    for k, a, x in left:
        for m, b, y in right:
            if k == m:
                n, s, t = want.get((a, b), (0, 0.0, 0.0))
                want[a, b] = (n + 1, s + (x or 0) * (y or 0), t + (y or 0))
    taken = lambda best: [r for c in pairs._sum_cell(table, sums, False, False, best) for r in zip(*[x.to_pylist() for x in c])]
    assert {(a, b): tuple(v) for a, b, *v in taken(None)} == want and len(taken(None)) == len(want)
    best = pairs.Best(lambda total, a, b: (total["both"], total["y"] > 0), 3, 1)
    low = lambda b: (b is not None, b or 0)
    rows_of = {a: sorted((-v[1], *low(b)) for (c, b), v in want.items() if c == a and v[2] > 0)[:3] for a in {a for a, _ in want}}
    got = {}
    for a, b, n, score, rounded in taken(best):
        assert score == rounded and n == want[a, b][0]
        got.setdefault(a, []).append((-score, *low(b)))
    assert {a: sorted(v) for a, v in got.items()} == {a: v for a, v in rows_of.items() if v}


def test_moving_average(rows):
    data = [("url1", "2011-02-28", 100), ("url1", "2011-02-27", 50), ("url1", "2011-02-24", 25),
            ("url2", "2011-02-28", 100), ("url2", "2011-02-26", 50), ("url2", "2011-02-25", 25)]
    got = W.moving_average(rows.of(data, "url string, date string, visits int"), "url", "date", "visits", 3)
    assert [r["average"] for r in got.orderBy("url", F.col("date").desc()).collect()] == [75, 50, 25, 75, 37.5, 25]


def test_moving_average_over_repeated_days(rows):
    data = [("u", "2011-02-28", 10), ("u", "2011-02-28", 20), ("u", "2011-02-27", 60)]
    got = W.moving_average(rows.of(data, "url string, date string, visits int"), "url", "date", "visits", 2)
    assert [r["average"] for r in got.orderBy("date").collect()] == [60, 30]


def test_normalised_activity(rows):
    data = [("u1", "f1", 10), ("u1", "f1", 20), ("u1", "f2", 30), ("u2", "f1", 10), ("u2", "f2", 10), ("u2", "f3", 10)]
    got = rows.sorted(W.share_of_total(rows.of(data, "user string, feature string, clicks int"), ["user"], ["feature"], "clicks"))
    assert [(u, f, round(s, 4)) for u, f, s in got] == [("u1", "f1", 0.5), ("u1", "f2", 0.5), ("u2", "f1", 0.3333), ("u2", "f2", 0.3333), ("u2", "f3", 0.3333)]
    zero = W.share_of_total(rows.of([("u", "f", 0)], "user string, feature string, clicks int"), ["user"], ["feature"], "clicks")
    assert rows.listed(zero) == [("u", "f", None)]


def test_fingerprint(rows):
    data = [("a", 1, 10), ("b", 1, 1), ("c", 1, 5), ("a", 2, 10), ("b", 2, 9), ("c", 2, 5)]
    top, totals = W.fingerprint(rows.of(data, "word string, topic int, count int"), "topic", "word", "count", 2)
    assert rows.sorted(top, "topic", "word") == [(1, "a"), (1, "c"), (2, "a"), (2, "b")]
    assert rows.sorted(totals) == [(1, 15), (2, 19)]


def test_secondary_sort_and_sum(rows):
    data = [(10, 3), (5, 3), (5, 30), (10, 10)]
    df = rows.of(data, "first int, second int")
    assert rows.listed(W.secondary_sort(df, ["first"], [F.col("second").asc()])) == [(5, 3), (5, 30), (10, 3), (10, 10)]


def test_previous_window(rows):
    t = lambda d: dt.datetime(2024, 1, d)
    df = rows.of([("a", t(1), 1.0), ("a", t(8), 2.0), (None, t(1), 5.0), (None, t(8), 6.0)], "k string, ts timestamp_ntz, v double")
    got = W.with_previous_window(df, ["k"], "ts", "v", 7 * 86400)
    assert rows.sorted(got, "k", "v", "previous") == sorted([("a", 1.0, None), ("a", 2.0, 1.0), (None, 5.0, None), (None, 6.0, 5.0)], key=repr)


def test_top_n_beyond_the_size_that_spark_limits(spark, rows):
    rng = random.Random(8)
    data = [("hot" if rng.random() < 0.8 else rng.choice("ab"), rng.randint(0, 500), i) for i in range(4000)]
    got = W.top_n(rows.of(data, "g string, v int, i int").repartition(5), ["g"], [F.col("v").desc(), F.col("i").asc()], 1500)
    want = []
    for g in ("hot", "a", "b"):
        mine = sorted((r for r in data if r[0] == g), key=lambda r: (-r[1], r[2]))[:1500]
        want += [(*r, k) for k, r in enumerate(mine, 1)]
    assert rows.sorted(got, "g", "v", "i", "rank") == sorted(want, key=repr)


def test_overlap_join_deals_few_copies(rows):
    """Ranges of many lengths have few keys a row, and a busy bucket is not cut into ever more cells."""
    short = rows.of([(i, 1000 * i, 1000 * i + 2 ** (i % 8) - 1) for i in range(160)], "i int, s bigint, e bigint")
    lengths = rows.of([(i, 1000 * i, 1000 * i + 2 ** (i % 7) - 1) for i in range(160)], "j int, s2 bigint, e2 bigint")
    sides = {"l": J._levelled(short, "s", "e", "l"), "r": J._levelled(lengths, "s2", "e2", "r")}
    assert J._keyed(sides["l"], "l", J._levels(sides["r"], "r")).count() <= 160 * 3
    busy = rows.of([(1, 1, 8790), (2, 8790, 1), (3, 100, 100), (4, 3, 4), (5, 30_000, 20_000), (6, 1, 1)], "bucket int, ln bigint, rn bigint")
    cut = {r["bucket"]: (r["ln"], r["rn"]) for r in J._cut(busy).collect()}
    assert cut[1] == (1, 512) and cut[2] == (512, 1) and cut[4] == (3, 4) and cut[6] == (1, 1)
    assert all(256 <= cut[k][0] * cut[k][1] <= 512 for k in (3, 5))


def test_an_entry_is_dealt_once_however_many_cells(rows, monkeypatch):
    """Blocks meet in a product that reads them in place; lists were copied into every cell of the other side."""
    from loomstat.operators import pairs

    monkeypatch.setattr(pairs, "ENTRIES", 20)
    data = {(r * 7, c): float((r * c) % 5) for r in range(30) for c in range(8) if (r + c) % 3}
    df = rows.of([(r, c, v) for (r, c), v in data.items()], "a bigint, k bigint, x double")
    packed = pairs._packed(df.select("k", "a", "x"), "a", "x", 12).collect()
    blocks = [pairs.Block.read({b["name"]: bytes(b["data"]) for b in r["_list"]}) for r in packed]
    assert sum(len(b.rows) for b in blocks) == len(data) and len({i for b in blocks for i in b.ids.to_pylist()}) == sum(len(b.ids) for b in blocks)
    got = pair_sums(df.withColumnsRenamed({"a": "r", "k": "c", "x": "v"}), "r", "c", "v")
    want = {(a, b): sum((a, c) in data and (b, c) in data for c in range(8)) for a in range(0, 210, 7) for b in range(a + 7, 210, 7)}
    assert {(p["a"], p["b"]): p["n"] for p in got.collect()} == {k: n for k, n in want.items() if n}
    assert "CartesianProduct" in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("candidates", [0, 5, 2**20])
def test_leaders_of_rows_over_many_blocks(candidates, monkeypatch):
    """One block after the other comes by, and the best of each row are those of all blocks, with their places; ties by id, a null first."""
    import numpy as np
    import pyarrow as pa

    from loomstat.operators import pairs

    monkeypatch.setattr(pairs, "CANDIDATES", candidates)
    rng = random.Random(9)
    left = pairs.Block(pa.array([None, 3, 8], pa.int64()), pa.array([0]), np.zeros(2, np.int64), np.zeros(0, np.int32), pa.array([], pa.float64()))
    leaders, every = pairs._Leaders(left, 4), []
    for block in range(6):
        ids = [None, *range(block, 60, 6)] if block == 2 else list(range(block, 60, 6))
        found = [(a, b, float(rng.randint(0, 4))) for a in range(3) for b in range(len(ids)) if rng.random() < 0.8]
        every += [(left.ids[a].as_py(), ids[b], s) for a, b, s in found]
        at, to, score = (np.array(c) for c in zip(*found))
        leaders.add(at, pa.array(ids, pa.int64()), to, {"n": at * 0 + 1, "score": score, "rounded": score})
    got = [r for c in leaders.given() for r in zip(*[x.to_pylist() for x in c])]
    want = [(a, b, 1, s, s, k) for i in (None, 3, 8) for k, (a, b, s) in enumerate(sorted((r for r in every if r[0] == i), key=lambda r: (-r[2], r[1] is not None, r[1] or 0))[:4], 1)]
    assert got == want


def test_few_long_ranges_cost_the_others_no_key(rows):
    """Short ranges lie on one level, and a few long ones go to every task; each row had a key at every level in use."""
    rng = random.Random(13)
    a = [(i, s := rng.randint(0, 20_000), s + (0 if i % 4 == 0 else rng.randint(1, 100))) for i in range(300)] + [(300, 50, 30_000), (301, 9_000, 2_000_000)]
    b = [(i, s := rng.randint(0, 20_000), s + rng.randint(0, 60)) for i in range(200)] + [(200, 10_000, 18_000), (201, 1, None), (202, None, 5), (203, 9, 8)]
    left, right = rows.of(a, "i int, s bigint, e bigint"), rows.of(b, "j int, s2 int, e2 int")
    counts = {side: {r[0]: r[1] for r in df.groupBy(f"{side}level").count().collect()} for side, df in (("l", J._levelled(left, "s", "e", "l")), ("r", J._levelled(right, "s2", "e2", "r")))}
    assert J._raised(counts) == (8, {"l", "r"})
    assert J._raised({"l": {0: 9}, "r": {28: 1}}) == (0, set()) and J._raised({"l": {}, "r": {}}) == (0, set())
    got = J.overlap_join(left, right, ("s", "e"), ("s2", "e2"), slice_rows=50)
    assert sorted((r["i"], r["j"]) for r in got.collect()) == overlapping(a, b)
    some = J.overlap_join(left, right, ("s", "e"), ("s2", "e2"), also=F.col("i") > F.col("j"))
    assert sorted((r["i"], r["j"]) for r in some.collect()) == overlapping(a, b, lambda x, y: x[0] > y[0])
