import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat.functions.text import tokens
from loomstat.operators import windows as W
from loomstat.sources import documents as DOC
from loomstat.sources import generators as GEN
from loomstat.sources import tables as TB


def test_topical_word_count(spark, rows, tmp_path):
    docs = [(1, "foo bar bar"), (1, "foo blah bloh"), (2, "bar bar bor")]
    (tmp_path / "in.json").write_text("\n".join(json.dumps({"topicId": t, "text": x}) for t, x in docs))
    df = DOC.read_json_lines(spark, str(tmp_path), "topicId int, text string")
    counts = df.select("topicId", F.explode(tokens(F.col("text"))).alias("word")).groupBy("topicId", "word").count()
    assert rows.sorted(counts) == [(1, "bar", 2), (1, "blah", 1), (1, "bloh", 1), (1, "foo", 2), (2, "bar", 2), (2, "bor", 1)]


def test_top_hashtags_from_tweets(rows):
    def tweet(place, day, tags):
        return json.dumps({"created_at": f"Sun Jan {day:02d} 10:00:00 +0000 2014", "user": {"location": place}, "entities": {"hashtags": [{"text": t} for t in tags]}})

    lines = [tweet("l1", 5, ["h1", "h2"]), tweet("l1", 5, ["h1"]), tweet("l1", 6, ["h2"]), tweet("l2", 5, ["h4"]), tweet("l2", 6, [])]
    df = DOC.parse_json(rows.of([(t,) for t in lines], "value string"), "value", DOC.TWEET)
    got = rows.sorted(W.top_counts(DOC.hashtags(df), ["location", "date"], "hashtag", 1), "location", "date", "hashtag", "count")
    assert got == [("l1", "2014-1-5", "h1", 2), ("l1", "2014-1-6", "h2", 1), ("l2", "2014-1-5", "h4", 1)]


def test_files_per_category(spark, rows, tmp_path):
    for category, title in (("comedies", "a b.txt"), ("poems", "p+q.txt"), ("histories", "h.txt")):
        (tmp_path / category).mkdir()
        (tmp_path / category / title).write_text(f"line of {category}\n")
    got = rows.sorted(DOC.read_categories(spark, str(tmp_path)))
    assert got == [("comedies", "a b.txt", "line of comedies"), ("histories", "h.txt", "line of histories"), ("poems", "p+q.txt", "line of poems")]
    whole = rows.sorted(DOC.read_whole_files(spark, str(tmp_path / "histories")), "name", "text")
    assert whole == [("h.txt", "line of histories\n")]


def test_labelled_lines_skip_short_ones(rows):
    df = rows.of([("art\t12\tsome\ttext",), ("broken\t1",)], "value string")
    assert rows.listed(DOC.labelled_lines(df)) == [("/art/12", "art", "some\ttext")]


def test_html_blocks(rows):
    html = 'id=7 <!-- s --><b id="r_1">x</b> u: "ann" <!-- e --> junk <!-- s --><b id="r_2">\ny </b><!-- e -->'
    got = DOC.extract_blocks(
        rows.of([(html,)], "html string"), "html", r"\Q<!-- s -->\E", r"\Q<!-- e -->\E",
        {"rid": r'id="r_(\d+)"', "body": r">([^<]*)</b>", "user": r'u: "([^"]*)"'}, F.regexp_extract("html", r"id=(\d+)", 1),
    )
    assert rows.sorted(got) == [("7", 0, "1", "x", "ann"), ("7", 1, "2", "\ny", None)] or rows.sorted(got)[1][3].strip() == "y"


def test_flat_documents(rows, tmp_path):
    DOC.write_flat_documents(rows.of([("x", 1)], "c string, n int"), str(tmp_path / "o"), by="c")
    assert (tmp_path / "o" / "c=x").is_dir()
    for bad in ("a array<int>", "a binary", "a struct<b:int>"):
        with pytest.raises(ValueError):
            DOC.check_flat(T._parse_datatype_string(bad))


def test_catalog_types(rows):
    df = rows.of([(1, 2)], "a smallint, b tinyint")
    assert TB.named_columns(df, ["x", "y"]).dtypes == [("x", "int"), ("y", "int")]
    with pytest.raises(ValueError):
        TB.named_columns(df, ["x"])
    with pytest.raises(ValueError):
        TB.widen_flat(rows.of([([1],)], "a array<int>"))


def test_named_outputs_and_counters(spark, rows, tmp_path):
    df = rows.of([("Pere", 100, "ES"), ("Eric", 5, "FR")], "name string, money int, country string")
    paths = TB.write_outputs(df, {"all": lambda d: d, "rich": lambda d: d.where("money > 50")}, str(tmp_path / "o"))
    assert spark.read.parquet(paths["all"]).count() == 2 and spark.read.parquet(paths["rich"]).count() == 1
    with pytest.raises(ValueError):
        TB.write_outputs(df, {"a/b": lambda d: d}, str(tmp_path / "p"))
    TB.write_by_name(df, "country", str(tmp_path / "n"), files_per_name=2)
    assert {p.name for p in (tmp_path / "n").glob("country=*")} == {"country=ES", "country=FR"}
    flow, seen = TB.counted(df, {"rich": F.col("money") > 50, "all": F.lit(True)})
    flow.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rich": 1, "all": 2}


def test_many_inputs(rows):
    a, b = rows.of([(1,)], "x int"), rows.of([(2,)], "y int")
    got = TB.gather([(a, lambda d: d.select(F.col("x").alias("v"))), (b, lambda d: d.select(F.col("y").alias("v")))])
    assert rows.sorted(got) == [(1,), (2,)]
    with pytest.raises(ValueError):
        TB.gather([])


def test_series_export_drops_nan(rows):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    df = rows.of([(t, "m", 1.5), (t, "n", float("nan"))], "ts timestamp_ntz, metric string, value double")
    assert rows.listed(TB.wide_series(df, "ts", "metric", "value", ["m", "n"])) == [(t, 1.5, None)]
    assert rows.listed(TB.json_points(df, "ts", "metric", "value"), "datapoint") == [("[1.5,1704067200]",)]


def test_avro_is_only_claimed_when_present(spark, rows, tmp_path):
    if not TB.avro_available(spark):
        with pytest.raises(Exception):
            TB.write_nested(rows.of([(1,)], "a int"), str(tmp_path / "a"), fmt="avro")
    df = rows.of([((1, ["x"]),)], "s struct<a:int,b:array<string>>")
    TB.write_nested(df, str(tmp_path / "p"), compression="gzip")
    assert rows.listed(TB.read_nested(spark, str(tmp_path / "p"))) == rows.listed(df)


def test_generators_repeat(spark, rows):
    makers = [
        lambda: GEN.visits(spark, 3, 4), lambda: GEN.payments(spark, 2, 3, 4), lambda: GEN.int_pairs(spark, 20, 5),
        lambda: GEN.topic_texts(spark, 5, 2, 9), lambda: GEN.tweets(spark, 5, 2, 3), lambda: GEN.activity(spark, 9, 3, 3),
        lambda: GEN.url_data(spark, 5, 4, 2)[0], lambda: GEN.url_data(spark, 5, 4, 2)[1],
    ]
    for make in makers:
        first = rows.sorted(make())
        assert first and first == rows.sorted(make())
    days = rows.sorted(GEN.visits(spark, 1, 3), "date")
    assert [str(d[0]) for d in days] == ["2012-12-29", "2012-12-30", "2012-12-31"]
    pairs = rows.sorted(GEN.int_pairs(spark, 200, 5))
    assert {v for p in pairs for v in p} == {1, 2, 3, 4, 5}
    assert GEN.payments(spark, 2, 3, 4).groupBy("dep", "person", "date").count().count() == 24
    tagged = DOC.hashtags(DOC.parse_json(GEN.tweets(spark, 5, 2, 3), "value", DOC.TWEET))
    assert tagged.where("date IS NOT NULL").count() == 5
