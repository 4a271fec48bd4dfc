"""Delimited and fixed-width text in both directions.

Reading never fails on a bad value: a token that cannot be cast is null, a line
that cannot be split gives a row of nulls, a short line gives nulls at its end.
All splitting is regular-expression work inside the JVM; the only Python pass is
the optional removal of a header line per file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat.functions.casting import lenient_field


@dataclass(frozen=True)
class TextFormat:
    """How a delimited file is written.

    ``quote`` and ``escape`` may be None. ``null_marker`` is the unquoted text
    that stands for null (``""`` also matches blanks). ``strict_quotes`` reads
    every unquoted token as null.
    """

    separator: str = "\t"
    quote: str | None = None
    escape: str | None = None
    null_marker: str | None = None
    strict_quotes: bool = False
    header: bool = False

    def __post_init__(self):
        for name in ("separator", "quote", "escape"):
            value = getattr(self, name)
            if value is not None and len(value) != 1:
                raise ValueError(f"{name} must be one character")
        if self.quote is not None and self.quote == self.separator:
            raise ValueError("quote and separator must differ")


def _in_class(ch: str) -> str:
    return re.escape(ch) if ch not in "^]\\-[&~" else "\\" + ch


def _one(ch: str) -> str:
    return "[" + _in_class(ch) + "]"


def split_line(line: Column, fmt: TextFormat) -> Column:
    """Tokens of one line as ``array<string>``; null when quotes do not close.

    Text around the quotes of a quoted token is dropped. The escape character
    works only inside quotes.
    """
    marker = fmt.null_marker

    def marked_null(token: Column) -> Column:
        if marker is None:
            return token
        hit = token == marker
        if marker == "":
            hit = hit | (F.trim(token) == "")
        return F.when(~hit, token)

    if fmt.quote is None:
        parts = F.split(line, _one(fmt.separator), -1)
        return parts if marker is None else F.transform(parts, marked_null)

    s, q = _in_class(fmt.separator), _in_class(fmt.quote)
    if fmt.escape is not None:
        e = _in_class(fmt.escape)
        body = f"[^{q}{e}]*+(?:[{e}].[^{q}{e}]*+)*+"
    else:
        body = f"[^{q}]*+"
    pattern = f"(?s)(?:[^{s}{q}]*+[{q}]{body}[{q}][^{s}]*+|[^{s}{q}]*+)[{s}]"
    ended = F.concat(line, F.lit(fmt.separator))
    raw = F.regexp_extract_all(ended, F.lit(pattern), F.lit(0))

    inside = f"(?s)^[^{q}]*+[{q}]({body})[{q}].*$"

    def token(piece: Column) -> Column:
        quoted = F.regexp_replace(piece, inside, "$1")
        if fmt.escape is not None:
            quoted = F.regexp_replace(quoted, f"(?s){_one(fmt.escape)}(.)", "$1")
        if fmt.strict_quotes:
            return F.when(piece.contains(fmt.quote), quoted)
        bare = F.substring(piece, F.lit(1), F.length(piece) - 1)
        return F.when(piece.contains(fmt.quote), quoted).otherwise(marked_null(bare))

    covered = F.aggregate(raw, F.lit(0), lambda n, p: n + F.length(p))
    return F.when(covered == F.length(ended), F.transform(raw, token))


def parse_lines(
    lines: DataFrame,
    schema: T.StructType,
    fmt: TextFormat = TextFormat(),
    positions: Sequence[int] | None = None,
    keep: Sequence[str] = (),
    value: str = "value",
) -> DataFrame:
    """Typed rows from a column of lines; ``positions`` picks one token per field."""
    if positions is not None and len(positions) != len(schema):
        raise ValueError("one position per field is needed")
    at = list(positions) if positions is not None else list(range(len(schema)))
    split = lines.select(*keep, split_line(F.col(value), fmt).alias("_tokens"))
    return split.select(
        *keep, *[lenient_field(F.get("_tokens", F.lit(i)), f).alias(f.name) for i, f in zip(at, schema)]
    )


def parse_fixed_width(
    lines: DataFrame,
    schema: T.StructType,
    ranges: Sequence[tuple[int, int]],
    null_marker: str | None = None,
    keep: Sequence[str] = (),
    value: str = "value",
) -> DataFrame:
    """Typed rows from inclusive ``(first, last)`` character ranges, from 0.

    Tokens are trimmed. A line shorter than any range gives a row of nulls.
    """
    if len(ranges) != len(schema):
        raise ValueError("one range per field is needed")
    if any(first < 0 or last < first for first, last in ranges):
        raise ValueError("a range needs 0 <= first <= last")
    marker = None if null_marker is None else null_marker.strip()
    fits = F.length(value) > max(last for _, last in ranges)
    out = []
    for (first, last), f in zip(ranges, schema):
        token = F.substring(F.col(value), first + 1, last - first + 1)
        usable = fits if marker is None else fits & (F.trim(token) != marker)
        out.append(lenient_field(F.when(usable, token), f, trim_text=True).alias(f.name))
    return lines.select(*keep, *out)


def _drop_first_line(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Remove the first line of every file, seen where its first block begins."""
    previous = None
    for batch in batches:
        files, starts = batch.column("file").to_pylist(), batch.column("start").to_pylist()
        mask = []
        for block in zip(files, starts):
            mask.append(not (block[1] == 0 and block != previous))
            previous = block
        yield batch.select(["value"]).filter(pa.array(mask, pa.bool_()))


def read_lines(spark: SparkSession, path, header: bool = False) -> DataFrame:
    """Plain text lines as ``value``; compressed files are read whole per task."""
    lines = spark.read.text(path)
    if not header:
        return lines
    tagged = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    return tagged.mapInArrow(_drop_first_line, "value string")


def read_delimited(
    spark: SparkSession, path, schema: T.StructType, fmt: TextFormat = TextFormat(), positions: Sequence[int] | None = None
) -> DataFrame:
    return parse_lines(read_lines(spark, path, fmt.header), schema, fmt, positions)


def read_fixed_width(
    spark: SparkSession,
    path,
    schema: T.StructType,
    ranges: Sequence[tuple[int, int]],
    null_marker: str | None = None,
    header: bool = False,
) -> DataFrame:
    return parse_fixed_width(read_lines(spark, path, header), schema, ranges, null_marker)


def _plain_text(name: str, kind: T.DataType) -> Column:
    if isinstance(kind, (T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
        raise ValueError(f"{name}: {kind.simpleString()} cannot be written as text")
    return F.col(f"`{name}`").cast("string")


def format_line(df: DataFrame, fmt: TextFormat) -> Column:
    """One text line per row. A null without a null marker is an error."""
    parts = []
    for f in df.schema:
        text = _plain_text(f.name, f.dataType)
        body = text
        if fmt.escape is not None:
            special = _in_class(fmt.escape) + (_in_class(fmt.quote) if fmt.quote else "")
            # In a Java replacement text both "\\" and "$" need a backslash.
            lead = "\\" + fmt.escape if fmt.escape in "\\$" else fmt.escape
            body = F.regexp_replace(body, f"([{special}])", lead + "$1")
        if fmt.quote is not None:
            body = F.concat(F.lit(fmt.quote), body, F.lit(fmt.quote))
        if fmt.null_marker is None:
            missing = F.raise_error(F.lit(f"null in field {f.name} and no null marker")).cast("string")
        else:
            missing = F.lit(fmt.null_marker)
        parts.append(F.when(text.isNull(), missing).otherwise(body))
    return F.concat_ws(fmt.separator, *parts)


def write_delimited(df: DataFrame, path: str, fmt: TextFormat, mode: str = "error", compression: str | None = None) -> None:
    """Write lines of ``format_line``; with ``header`` each part file starts with the names."""
    lines = df.select(format_line(df, fmt).alias("value"))
    if not fmt.header:
        writer = lines.write.mode(mode)
        writer = writer.option("compression", compression) if compression else writer
        writer.text(path)
        return
    # The one-column CSV writer adds the header; quoting is switched off.
    writer = lines.withColumnRenamed("value", fmt.separator.join(df.columns)).write.mode(mode)
    for key, value in {
        "header": "true",
        "sep": "\u0001",
        "quote": "\u0000",
        "escapeQuotes": "false",
        "emptyValue": "",
        "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false",
    }.items():
        writer = writer.option(key, value)
    if compression:
        writer = writer.option("compression", compression)
    writer.csv(path)
