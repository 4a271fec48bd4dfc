"""Sources and sinks over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat.functions import schema as S
from loomstat.registry.base import documents, query, table
from loomstat.session import scratch_path
from loomstat.sources import delimited as D
from loomstat.sources import documents as DOC
from loomstat.sources import tables as TB

PIPE_QUOTED = D.TextFormat(separator="|", quote='"', escape="\\", null_marker="\\N")


def _odd_names(spark, d):
    """Parts with quotes, separators, backslashes and nulls in their text."""
    p = table(spark, d, "part")
    name = F.concat(F.lit('a "'), "p_name", F.lit('" | \\ '), "p_type")
    return p.select(
        "p_partkey", name.alias("p_name"), F.nullif("p_type", F.lit("SMALL")).alias("p_type"), "p_size", "p_retailprice"
    )


ODD_NAMES = """
SELECT p_partkey, 'a "' || p_name || '" | \\ ' || p_type AS p_name, nullif(p_type, 'SMALL') AS p_type,
       p_size, p_retailprice FROM part
""".replace("\\\\", "\\")


@query("S01_delimited_lines_to_rows", ODD_NAMES)
def delimited_lines(spark, d):
    rows = _odd_names(spark, d)
    lines = rows.select(D.format_line(rows, PIPE_QUOTED).alias("value"))
    return D.parse_lines(lines, rows.schema, PIPE_QUOTED)


@query(
    "S02_columns_by_position",
    "SELECT o_totalprice, o_orderkey, o_orderstatus = 'F' AS is_f FROM orders",
)
def columns_by_position(spark, d):
    o = table(spark, d, "orders")
    flag = F.when(F.col("o_orderstatus") == "F", "True").otherwise("no")
    lines = o.select(F.concat_ws(" ", "o_orderkey", "o_custkey", "o_totalprice", flag).alias("value"))
    schema = S.parse("o_totalprice:double?, o_orderkey:long?, is_f:boolean?")
    return D.parse_lines(lines, schema, D.TextFormat(separator=" "), positions=[2, 0, 3])


@query(
    "S03_lenient_casts",
    """
    SELECT event_id, value, NULL::INTEGER AS bad_int, NULL::BIGINT AS from_fraction,
           event_type = 'click' AS flag, NULL::DOUBLE AS missing FROM events
    """,
)
def lenient_casts(spark, d):
    e = table(spark, d, "events")
    flag = F.when(F.col("event_type") == "click", " TRUE ").otherwise(F.col("event_type"))
    text = F.concat_ws(",", F.concat(F.lit(" +"), "event_id"), F.concat(F.lit("+"), F.col("value").cast("string")),
                       "event_type", F.format_string("%.2f", "value"), flag)
    schema = S.parse("event_id:long?, value:double?, bad_int:int?, from_fraction:long?, flag:boolean?, missing:double?")
    return D.parse_lines(e.select(text.alias("value")), schema, D.TextFormat(separator=","))


@query(
    "S04_strict_quotes_and_null_marker",
    "SELECT c_custkey AS id, c_name AS quoted, NULL::VARCHAR AS bare, NULL::VARCHAR AS marked FROM customer",
)
def strict_quotes(spark, d):
    c = table(spark, d, "customer")
    q = F.lit('"')
    text = F.concat_ws(",", F.concat(q, "c_custkey", q), F.concat(F.lit("x "), q, "c_name", q, F.lit(" y")), "c_mktsegment", F.lit("\\N"))
    schema = S.parse("id:long?, quoted:string?, bare:string?, marked:string?")
    fmt = D.TextFormat(separator=",", quote='"', escape="\\", null_marker="\\N", strict_quotes=True)
    return D.parse_lines(c.select(text.alias("value")), schema, fmt)


@query(
    "S05_fixed_width",
    "SELECT event_id, event_type, nullif(value, 0.01) AS value FROM events",
)
def fixed_width(spark, d):
    e = table(spark, d, "events")
    value = F.when(F.col("value") == 0.01, F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("value").cast("string")))
    text = F.concat(F.lpad(F.col("event_id").cast("string"), 12, " "), F.lit("|"), F.rpad("event_type", 10, " "), F.lpad(value, 14, " "))
    schema = S.parse("event_id:long?, event_type:string?, value:double?")
    return D.parse_fixed_width(e.select(text.alias("value")), schema, [(0, 11), (13, 22), (23, 36)], null_marker="-")


@query(
    "S06_text_lines",
    r"""
    SELECT line, count(*) AS n FROM (
      SELECT unnest(string_split_regex(text, '\r\n|\n|\r')) AS line FROM documents) GROUP BY line
    """,
)
def text_lines(spark, d):
    path = scratch_path(spark, "lines")
    documents(spark, d).select("text").write.text(path)
    return D.read_lines(spark, path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query(
    "S07_json_documents",
    r"""
    SELECT event_type, CAST(sum(CAST(regexp_extract(props, '"k": (\d+)', 1) AS BIGINT)) AS BIGINT) AS sum_k, count(*) AS n
    FROM events GROUP BY event_type
    """,
)
def json_documents(spark, d):
    rows = DOC.parse_json(table(spark, d, "events"), "props", "k bigint", keep=["event_type"])
    return rows.groupBy("event_type").agg(F.sum("k").alias("sum_k"), F.count("*").alias("n"))


@query(
    "S08_nested_rows",
    "SELECT vec_id, label, CAST(unnest(range(0, len(embedding))) AS INTEGER) AS at, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings",
)
def nested_rows(spark, d):
    path = scratch_path(spark, "nested")
    e = table(spark, d, "embeddings")
    TB.write_nested(e.select(F.struct("vec_id", "label").alias("head"), "embedding"), path, compression="snappy")
    back = TB.read_nested(spark, path)
    rows = back.select("head.vec_id", "head.label", F.posexplode("embedding").alias("at", "value"))
    return rows.withColumn("value", F.col("value").cast("double"))


@query("S09_table_file_round_trip", "SELECT * FROM supplier")
def table_files(spark, d):
    path = scratch_path(spark, "tuples")
    TB.write_table_files(table(spark, d, "supplier"), path)
    return TB.read_table_files(spark, path)


@query(
    "S10_read_as_other_schema",
    """
    SELECT c_name, nullif(c_mktsegment, 'FURNITURE') AS c_mktsegment, 7 AS added_int, 'none' AS added_text,
           NULL::BIGINT AS added_null FROM customer
    """,
)
def read_as(spark, d):
    c = table(spark, d, "customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("FURNITURE")))
    target = S.schema(
        [
            S.field("c_name", "string"),
            S.field("c_mktsegment", "string", nullable=True, default="other"),
            S.field("added_int", "int", default=7),
            S.field("added_text", "string", default="none"),
            S.field("added_null", "long", nullable=True),
        ]
    )
    return S.conform(c, target)


@query("S11_catalog_table", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def catalog_table(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("catalog_orders")
    return TB.read_catalog(spark, "catalog_orders", ["o_orderkey", "o_custkey", "o_totalprice"])


@query("S12_named_positional_columns", "SELECT p_partkey AS key, p_size AS size, p_brand AS brand FROM part")
def named_positional(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("smallint"), "p_brand")
    return TB.named_columns(p, ["key", "size", "brand"])


@query(
    "S13_whole_files",
    "SELECT c_nationkey, CAST(sum(length(c_name) + 1) AS BIGINT) AS characters FROM customer GROUP BY c_nationkey",
)
def whole_files(spark, d):
    path = scratch_path(spark, "whole")
    c = table(spark, d, "customer")
    c.select("c_nationkey", "c_name").write.partitionBy("c_nationkey").text(path)
    files = DOC.read_whole_files(spark, f"{path}/*/*.txt")
    key = F.regexp_extract("folder", r"c_nationkey=(\d+)", 1).cast("int")
    return files.groupBy(key.alias("c_nationkey")).agg(F.sum(F.length("text")).alias("characters"))


@query("S14_delimited_write_and_read", ODD_NAMES)
def delimited_write(spark, d):
    path = scratch_path(spark, "delimited")
    fmt = D.TextFormat(separator=",", quote='"', escape="\\", null_marker="\\N", header=True)
    rows = _odd_names(spark, d)
    D.write_delimited(rows, path, fmt)
    return D.read_delimited(spark, path, rows.schema, fmt)


@query(
    "S15_many_inputs",
    """
    SELECT c_name AS name, c_nationkey AS nation, 'customer' AS kind FROM customer
    UNION ALL SELECT s_name, s_nationkey, 'supplier' FROM supplier
    """,
)
def many_inputs(spark, d):
    def named(prefix, kind):
        return lambda df: df.select(
            F.col(f"{prefix}_name").alias("name"), F.col(f"{prefix}_nationkey").alias("nation"), F.lit(kind).alias("kind")
        )

    return TB.gather([
        (table(spark, d, "customer"), named("c", "customer")),
        (table(spark, d, "supplier"), named("s", "supplier")),
    ])


@query(
    "S16_named_outputs",
    """
    SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL
    UNION ALL
    SELECT o_orderpriority, count(*), round(sum(o_totalprice), 2) FROM orders GROUP BY ALL
    """,
)
def named_outputs(spark, d):
    root = scratch_path(spark, "outputs")

    def by(column):
        return lambda df: df.groupBy(F.col(column).alias("status")).agg(
            F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
        )

    o = table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", "o_totalprice")
    paths = TB.write_outputs(o, {"status": by("o_orderstatus"), "priority": by("o_orderpriority")}, root)
    return spark.read.parquet(paths["status"]).unionByName(spark.read.parquet(paths["priority"]))


@query("S17_outputs_named_per_row", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def outputs_per_row(spark, d):
    path = scratch_path(spark, "by-name")
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    TB.write_by_name(o, "o_orderpriority", path, files_per_name=4)
    return spark.read.parquet(path)


@query(
    "S18_record_counters",
    """
    SELECT count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (value > 50) AS large, count(*) AS seen FROM events
    """,
)
def record_counters(spark, d):
    rows, seen = TB.counted(
        table(spark, d, "events"),
        {"errors": F.col("event_type") == "error", "large": F.col("value") > 50, "seen": F.lit(True)},
    )
    rows.write.format("noop").mode("overwrite").save()
    counts = seen.get
    return TB.from_rows(spark, [(counts["errors"], counts["large"], counts["seen"])], "errors bigint, large bigint, seen bigint")


@query("S19_compressed_text", "SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem")
def compressed_text(spark, d):
    path = scratch_path(spark, "gzip")
    fmt = D.TextFormat(separator="\t")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    D.write_delimited(li, path, fmt, compression="gzip")
    return D.read_delimited(spark, path, li.schema, fmt)


@query(
    "S20_category_folders",
    r"""
    SELECT source AS category, 'lang=' || lang AS title, line AS text FROM (
      SELECT source, lang, unnest(string_split_regex(text, '\r\n|\n|\r')) AS line FROM documents)
    """,
)
def category_folders(spark, d):
    """Every line with its folder and title; Spark names files itself, so the title here is a folder too."""
    path = scratch_path(spark, "categories")
    documents(spark, d).select("source", "lang", "text").write.partitionBy("source", "lang").text(path)
    rows = DOC.read_categories(spark, f"{path}", depth=3)
    return rows.select(F.regexp_extract("category", "source=(.*)", 1).alias("category"), "title", "text")


@query(
    "S21_flat_documents",
    """
    SELECT '{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '","s_nationkey":' || s_nationkey || '}' AS document
    FROM supplier
    """,
)
def flat_documents(spark, d):
    return DOC.flat_documents(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"))


@query(
    "S22_scalar_feeds_next_job",
    """
    SELECT o_orderstatus, count(*) AS n FROM orders
    WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders) GROUP BY ALL
    """,
)
def scalar_feeds(spark, d):
    o = table(spark, d, "orders")
    average = o.agg(F.avg("o_totalprice").alias("a")).scalar()
    return o.where(F.col("o_totalprice") > average).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query(
    "S23_labelled_lines",
    "SELECT '/' || p_brand || '/' || p_partkey AS key, p_brand AS label, p_name || chr(9) || p_type AS text FROM part WHERE p_size > 10",
)
def labelled_lines(spark, d):
    p = table(spark, d, "part")
    full = F.concat_ws("\t", "p_brand", "p_partkey", "p_name", "p_type")
    line = F.when(F.col("p_size") > 10, full).otherwise(F.concat_ws("\t", "p_brand", "p_partkey"))
    return DOC.labelled_lines(p.select(line.alias("value")))


@query(
    "S24_wide_series",
    """
    SELECT CAST(ts AS DATE) AS day,
      round(sum(value) FILTER (event_type = 'click'), 4) AS click, round(sum(value) FILTER (event_type = 'error'), 4) AS error,
      round(sum(value) FILTER (event_type = 'purchase'), 4) AS purchase, round(sum(value) FILTER (event_type = 'signup'), 4) AS signup,
      round(sum(value) FILTER (event_type = 'view'), 4) AS view
    FROM events GROUP BY ALL
    """,
)
def wide_series(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    names = ["click", "error", "purchase", "signup", "view"]
    wide = TB.wide_series(e, "day", "event_type", "value", names)
    return wide.select("day", *[F.round(n, 4).alias(n) for n in names])


@query(
    "S24_json_points",
    """
    SELECT event_type, event_id, '[' || value || ',' || CAST(floor(epoch(ts)) AS BIGINT) || ']' AS datapoint FROM events
    """,
)
def json_points(spark, d):
    e = table(spark, d, "events")
    keyed = e.select(F.concat_ws(":", "event_type", "event_id").alias("key"), "ts", "value")
    points = TB.json_points(keyed, "ts", "key", "value")
    return points.select(
        F.substring_index("key", ":", 1).alias("event_type"), F.substring_index("key", ":", -1).cast("bigint").alias("event_id"), "datapoint"
    )


@query(
    "S25_collection_as_input",
    """
    SELECT w.weight, count(*) AS n FROM orders JOIN (VALUES ('1-URGENT', 5), ('2-HIGH', 3), ('5-LOW', 1)) w(p, weight)
    ON o_orderpriority = w.p GROUP BY ALL
    """,
)
def collection_input(spark, d):
    weights = TB.from_rows(spark, [("1-URGENT", 5), ("2-HIGH", 3), ("5-LOW", 1)], "p string, weight int")
    o = table(spark, d, "orders")
    return o.join(weights, o.o_orderpriority == weights.p).groupBy("weight").agg(F.count("*").alias("n"))
