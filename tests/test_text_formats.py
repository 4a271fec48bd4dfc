import pytest
from pyspark.sql import functions as F

from loomstat.functions import schema as S
from loomstat.sources import delimited as D


def tokens(spark, line, **fmt):
    f = D.TextFormat(**fmt)
    return spark.createDataFrame([(line,)], "value string").select(D.split_line(F.col("value"), f)).head()[0]


def test_plain_split_keeps_empty_end(spark):
    assert tokens(spark, "Hello,1,2,", separator=",") == ["Hello", "1", "2", ""]


def test_text_around_quotes_is_dropped(spark):
    line = ' "\\"Hello\\"" ,1"hello","hello"1'
    assert tokens(spark, line, separator=",", quote='"', escape="\\") == ['"Hello"', "hello", "hello"]


@pytest.mark.parametrize(
    "options,nulls",
    [
        ({"null_marker": ""}, [1]),
        ({"strict_quotes": True}, [1, 2, 3]),
        ({"null_marker": "\\N"}, [2]),
        ({}, []),
    ],
)
def test_null_rules(spark, options, nulls):
    got = tokens(spark, '"Hello",,\\N,3', separator=",", quote='"', escape="\\", **options)
    assert len(got) == 4 and [i for i, t in enumerate(got) if t is None] == nulls


def test_blank_marker_only_hits_unquoted(spark):
    assert tokens(spark, '"3"," ","", ,', separator=",", quote='"', escape="\\", null_marker=" ") == ["3", " ", "", None, ""]


def test_marker_without_quotes(spark):
    assert tokens(spark, "a|\\N|", separator="|", null_marker="\\N") == ["a", None, ""]


def test_separator_inside_quotes(spark):
    assert tokens(spark, '1;"a;b";c', separator=";", quote='"') == ["1", "a;b", "c"]


@pytest.mark.parametrize("line", ['a,"open', 'a,"open\\"', '"x'])
def test_unclosed_quote_gives_no_tokens(spark, line):
    assert tokens(spark, line, separator=",", quote='"', escape="\\") is None


def test_long_quoted_field(spark):
    body = "word " * 40_000
    assert tokens(spark, f'1,"{body}",2', separator=",", quote='"', escape="\\") == ["1", body, "2"]


def test_many_escapes_in_one_field(spark):
    body = '\\"x' * 3_000
    assert tokens(spark, f'"{body}"', separator=",", quote='"', escape="\\") == ['"x' * 3_000]


def test_bad_and_short_lines_give_nulls(spark, rows):
    lines = rows.of([("1,x",), ("2",), ('"open',), ("nope,y",)], "value string")
    fmt = D.TextFormat(separator=",", quote='"')
    got = rows.sorted(D.parse_lines(lines, S.parse("a:int?, b:string?"), fmt))
    assert got == sorted([(1, "x"), (2, None), (None, None), (None, "y")], key=repr)


def test_numbers_are_lenient(rows):
    lines = rows.of([("+10; 7 ;-;;1.5;TRUE",), ("x;1e3;.;+1.25;9999999999;yes",)], "value string")
    schema = S.parse("a:int?, b:double?, c:float?, d:double?, e:int?, f:boolean?")
    got = rows.listed(D.parse_lines(lines, schema, D.TextFormat(separator=";")))
    assert got == [(10, 7.0, None, None, None, True), (None, 1000.0, None, 1.25, None, False)]


def test_strict_numbers_all_null(rows):
    fmt = D.TextFormat(separator=",", quote='"', escape="\\", strict_quotes=True)
    lines = rows.of([(",-, ,.",)], "value string")
    assert rows.listed(D.parse_lines(lines, S.parse("a:int?, b:long?, c:float?, d:double?"), fmt)) == [(None,) * 4]


def test_columns_by_position(rows):
    lines = rows.of([("a 1.5 b c 7 d true e",)], "value string")
    schema = S.parse("x:float?, y:int?, z:boolean?")
    assert rows.listed(D.parse_lines(lines, schema, D.TextFormat(separator=" "), positions=[1, 4, 6])) == [(1.5, 7, True)]


def test_enum_token(rows):
    schema = S.schema([S.field("e", "enum", nullable=True, values=["UP", "DOWN"])])
    lines = rows.of([(" UP ",), ("side",)], "value string")
    assert rows.listed(D.parse_lines(lines, schema)) == [("UP",), (None,)]


def test_fixed_width(rows):
    lines = rows.of([("1000  - ",), (" +20 abc",), ("short",)], "value string")
    got = D.parse_fixed_width(lines, S.parse("a:int?, b:string?"), [(0, 3), (5, 7)], null_marker="-")
    assert rows.listed(got) == [(1000, None), (20, "abc"), (None, None)]


@pytest.mark.parametrize("ranges", [[(3, 1), (4, 5)], [(-1, 2), (4, 5)], [(0, 1)]])
def test_fixed_width_ranges_checked(rows, ranges):
    with pytest.raises(ValueError):
        D.parse_fixed_width(rows.of([("x",)], "value string"), S.parse("a:int?, b:int?"), ranges)


@pytest.mark.parametrize("bad", [{"separator": "ab"}, {"separator": '"', "quote": '"'}, {"quote": ""}])
def test_format_checked(bad):
    with pytest.raises(ValueError):
        D.TextFormat(**bad)


def test_write_line(rows):
    df = rows.of([("Joe", None, None, '"Joan"', "")], "a string, b string, c string, d string, e string")
    fmt = D.TextFormat(separator=",", quote='"', escape="\\", null_marker="\\N")
    assert rows.listed(df.select(D.format_line(df, fmt))) == [('"Joe",\\N,\\N,"\\"Joan\\"",""',)]


@pytest.mark.parametrize("escape", ["\\", "$", "^", "'"])
def test_every_escape_character_round_trips(rows, escape):
    df = rows.of([(f'a{escape}b"c', 1)], "s string, n int")
    fmt = D.TextFormat(separator=",", quote='"', escape=escape, null_marker="")
    lines = df.select(D.format_line(df, fmt).alias("value"))
    assert rows.listed(D.parse_lines(lines, df.schema, fmt)) == [(f'a{escape}b"c', 1)]


def test_write_null_without_marker_fails(rows):
    df = rows.of([(None,)], "a string")
    with pytest.raises(Exception, match="no null marker"):
        df.select(D.format_line(df, D.TextFormat())).collect()


def test_binary_cannot_be_written(rows):
    df = rows.of([(b"x",)], "a binary")
    with pytest.raises(ValueError):
        D.format_line(df, D.TextFormat())


def test_header_is_dropped_once_per_file(spark, rows, tmp_path):
    df = rows.of([(i, f"n{i}", None if i % 3 else "x") for i in range(50)], "id int, name string, opt string").repartition(4)
    fmt = D.TextFormat(separator="|", quote='"', escape="\\", null_marker="\\N", header=True)
    path = str(tmp_path / "out")
    D.write_delimited(df, path, fmt)
    first = sorted((tmp_path / "out").glob("part-*"))[0].read_text().splitlines()[0]
    assert first == "id|name|opt"
    assert rows.sorted(D.read_delimited(spark, path, df.schema, fmt)) == rows.sorted(df)


def test_header_with_many_splits_and_blank_lines(spark, rows, tmp_path):
    (tmp_path / "a.txt").write_text("h\n" + "\n".join(["1", "", "2"] * 500) + "\n")
    (tmp_path / "b.txt").write_text("h\n3\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        df = D.read_delimited(spark, str(tmp_path), S.parse("n:int?"), D.TextFormat(header=True))
        counts = rows.sorted(df.groupBy("n").count())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert counts == sorted([(1, 500), (2, 500), (3, 1), (None, 500)], key=repr)


def test_compressed_round_trip_of_many_lines(spark, rows, tmp_path):
    df = spark.range(10_000).selectExpr("'a' AS a", "'b c' AS b")
    path = str(tmp_path / "gz")
    D.write_delimited(df, path, D.TextFormat(separator=" "), compression="gzip")
    assert D.read_delimited(spark, path, S.parse("a:string?, b:string?"), D.TextFormat(separator=" ")).count() == 10_000
