"""Schema declaration, editing and evolution on plain ``StructType``s."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The primitive type names of the declaration language.
PRIMITIVES = {
    "int": T.IntegerType(),
    "long": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "string": T.StringType(),
    "bytes": T.BinaryType(),
}

_PYTHON_KINDS = {
    "int": (int,),
    "long": (int,),
    "float": (float, int),
    "double": (float, int),
    "boolean": (bool,),
    "string": (str,),
    "bytes": (bytes, bytearray),
}


def _no_repeats(names: Iterable[str]) -> None:
    seen: set[str] = set()
    for name in names:
        if name in seen:
            raise ValueError(f"duplicate field name {name!r}")
        seen.add(name)


def field(name: str, type_name: str, nullable: bool = False, default=None, values=None) -> T.StructField:
    """One field. ``values`` (ordered) makes it an enum kept as a string.

    A default is checked against the type here and kept in the field metadata.
    """
    if not name:
        raise ValueError("a field needs a name")
    meta: dict = {}
    if values is not None:
        if type_name != "enum":
            raise ValueError("only enum fields list values")
        values = list(values)
        _no_repeats(values)
        if default is not None and default not in values:
            raise ValueError(f"default {default!r} is not one of {values}")
        meta["enum"] = values
        kind: T.DataType = T.StringType()
    else:
        if type_name not in PRIMITIVES:
            raise ValueError(f"unknown type {type_name!r}")
        kind = PRIMITIVES[type_name]
        if default is not None:
            wrong = not isinstance(default, _PYTHON_KINDS[type_name])
            if wrong or (isinstance(default, bool) and type_name != "boolean"):
                raise ValueError(f"default {default!r} does not fit {type_name}")
    if default is not None:
        meta["default"] = default.hex() if isinstance(default, (bytes, bytearray)) else default
    return T.StructField(name, kind, nullable, meta or None)


def schema(fields: Iterable[T.StructField]) -> T.StructType:
    fields = list(fields)
    _no_repeats(f.name for f in fields)
    return T.StructType(fields)


def parse(text: str) -> T.StructType:
    """``"a:int, b:string?"`` → ``StructType``; ``?`` marks a nullable field."""
    out = []
    for part in text.split(","):
        match = re.fullmatch(r"\s*([^:\s]+)\s*:\s*([a-z]+)(\?)?\s*", part)
        if not match:
            raise ValueError(f"cannot read field {part.strip()!r}")
        out.append(field(match[1], match[2], nullable=match[3] is not None))
    return schema(out)


def to_json(struct: T.StructType) -> str:
    return struct.json()


def from_json(text: str) -> T.StructType:
    struct = T.StructType.fromJson(json.loads(text))
    _no_repeats(struct.names)
    return struct


def minus(struct: T.StructType, *names: str) -> T.StructType:
    _must_have(struct, names)
    return schema(f for f in struct if f.name not in names)


def subset(struct: T.StructType, *names: str) -> T.StructType:
    _must_have(struct, names)
    return schema(struct[n] for n in names)


def superset(struct: T.StructType, *extra: T.StructField) -> T.StructType:
    return schema([*struct, *extra])


def joint(left: T.StructType, right: T.StructType) -> T.StructType:
    """All fields of ``left``, then those of ``right`` under new names."""
    return schema([*left, *(f for f in right if f.name not in left.names)])


def clone_field(source: T.StructField, name: str, nullable: bool | None = None) -> T.StructField:
    keep = source.nullable if nullable is None else nullable
    return T.StructField(name, source.dataType, keep, source.metadata)


def _must_have(struct: T.StructType, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in struct.names]
    if missing:
        raise ValueError(f"no such fields: {missing}")


def joint_select(joined: DataFrame, left: DataFrame, right: DataFrame, *extra) -> DataFrame:
    """Project a join result to the joint schema; left wins on equal names."""
    keep = [left[c] for c in left.columns]
    keep += [right[c] for c in right.columns if c not in left.columns]
    return joined.select(*keep, *extra)


def alias_fields(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename so that differently named keys line up with another source."""
    _must_have(df.schema, names)
    return df.withColumnsRenamed(dict(names))


def _default_of(f: T.StructField):
    value = (f.metadata or {}).get("default")
    if value is None:
        return F.lit(None).cast(f.dataType)
    if isinstance(f.dataType, T.BinaryType):
        return F.unhex(F.lit(value))
    return F.lit(value).cast(f.dataType)


def conform(df: DataFrame, target: T.StructType) -> DataFrame:
    """Read ``df`` as ``target``: unknown columns go, absent ones get the default.

    A default fills only columns that do not exist; a stored null stays null.
    A missing field with neither a default nor nullability is an error.
    """
    have = set(df.columns)
    out = []
    for f in target:
        if f.name in have:
            if df.schema[f.name].dataType != f.dataType:
                raise ValueError(f"{f.name}: stored as {df.schema[f.name].dataType}, asked for {f.dataType}")
            out.append(F.col(f.name))
            continue
        if "default" not in (f.metadata or {}) and not f.nullable:
            raise ValueError(f"{f.name} is missing, not nullable and has no default")
        out.append(_default_of(f).alias(f.name))
    return df.select(*out)


def enum_ordinal(column: str, struct: T.StructType):
    """Position of an enum value in its declared list, for sorting."""
    values = (struct[column].metadata or {}).get("enum")
    if not values:
        raise ValueError(f"{column} is not an enum field")
    position = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column))
    return F.nullif(position, F.lit(0).cast("bigint"))
