"""Forgiving casts for text fields: a bad value becomes null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lenient_number(text: Column, kind: T.DataType) -> Column:
    """Trim, allow one leading ``+``, then ``try_cast``.

    Integers accept digits with an optional sign only, so ``1.5`` and ``1e3``
    are null for an int; floats accept what a Java float literal accepts.
    """
    value = F.regexp_replace(F.trim(text), r"^\+", "")
    if isinstance(kind, (T.IntegerType, T.LongType)):
        value = F.when(value.rlike(r"^[+-]?[0-9]+$"), value)
    return value.try_cast(kind)


def lenient_boolean(text: Column) -> Column:
    """True for the word "true" in any case, false for any other non-null text."""
    return F.lower(F.trim(text)) == "true"


def lenient_field(text: Column, f: T.StructField, trim_text: bool = False) -> Column:
    """Cast one text token to the declared field type."""
    kind = f.dataType
    values = (f.metadata or {}).get("enum")
    if values:
        word = F.trim(text)
        return F.when(word.isin(values), word)
    if isinstance(kind, T.NumericType):
        return lenient_number(text, kind)
    if isinstance(kind, T.BooleanType):
        return lenient_boolean(text)
    if isinstance(kind, T.StringType):
        return F.trim(text) if trim_text else text
    raise ValueError(f"{f.name}: text cannot be read as {kind.simpleString()}")
