"""Sort declarations: an order text, null placement, enum and natural order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat.functions import schema as S


#: In an order over several sources this name stands for the source itself, in declared order.
SOURCE = "source_ix"


class SortKey:
    """One sort field: name, direction and where nulls rank.

    ``null_smallest`` ranks nulls below every value, so they lead an ascending
    and trail a descending sort; ``null_biggest`` is the opposite.
    """

    def __init__(self, name: str, descending: bool = False, null_biggest: bool = False):
        self.name, self.descending, self.null_biggest = name, descending, null_biggest

    def __repr__(self) -> str:
        return f"SortKey({self.name!r}, desc={self.descending}, null_biggest={self.null_biggest})"

    def over(self, expr: Column) -> Column:
        nulls_first = self.descending == self.null_biggest
        if self.descending:
            return expr.desc_nulls_first() if nulls_first else expr.desc_nulls_last()
        return expr.asc_nulls_first() if nulls_first else expr.asc_nulls_last()

    def reversed(self) -> SortKey:
        """The key that sorts exactly the other way round, nulls too."""
        return SortKey(self.name, not self.descending, self.null_biggest)

    def column(self, struct: T.StructType | None = None) -> Column:
        if struct is not None and self.name in struct.names and (struct[self.name].metadata or {}).get("enum"):
            return self.over(S.enum_ordinal(self.name, struct))
        return self.over(F.col(self.name))


def parse_order(text: str) -> list[SortKey]:
    """``"a:desc|null_biggest, b"`` → sort keys; ascending, nulls smallest by default."""
    flags = {
        "asc": ("descending", False),
        "desc": ("descending", True),
        "null_smallest": ("null_biggest", False),
        "null_biggest": ("null_biggest", True),
    }
    keys: list[SortKey] = []
    for part in text.split(","):
        name, _, marks = (p.strip() for p in part.partition(":"))
        if not name:
            raise ValueError(f"empty field in order {text!r}")
        options = {}
        for mark in filter(None, (m.strip().lower() for m in marks.split("|"))):
            if mark not in flags:
                raise ValueError(f"unknown sort mark {mark!r}; use one of {sorted(flags)}")
            option, value = flags[mark]
            options[option] = value
        if any(k.name == name for k in keys):
            raise ValueError(f"field {name!r} repeated in order {text!r}")
        keys.append(SortKey(name, **options))
    return keys


def as_keys(order: str | Sequence[SortKey]) -> list[SortKey]:
    return parse_order(order) if isinstance(order, str) else list(order)


def default_order(group_fields: Sequence[str]) -> list[SortKey]:
    """Group fields ascending, nulls smallest."""
    return [SortKey(n) for n in group_fields]


def sort_columns(order: str | Sequence[SortKey], struct: T.StructType | None = None) -> list[Column]:
    return [k.column(struct) for k in as_keys(order)]


def _check_group_fields(sources: dict[str, DataFrame], fields: Sequence[str], what: str) -> None:
    S._no_repeats(fields)
    for name in fields:
        types = set()
        for label, df in sources.items():
            if name not in df.columns:
                raise ValueError(f"{what} field {name!r} is missing in source {label!r}")
            types.add(df.schema[name].dataType.simpleString())
        if len(types) > 1:
            raise ValueError(f"{what} field {name!r} has several types: {sorted(types)}")


def check_job(
    sources: dict[str, DataFrame],
    group_fields: Sequence[str],
    order: str | Sequence[SortKey] | None = None,
    rollup_from: str | None = None,
    specific: Mapping[str, str | Sequence[SortKey]] | None = None,
    partition_fields: Sequence[str] | None = None,
) -> list[SortKey]:
    """Reject an inconsistent grouping before anything runs; returns the order.

    Every source must hold every group field with one type, the order must be
    made of common fields and start with the group fields, and the rollup field
    must be one of the group fields. With several sources the order may name the source
    (``source_ix``) anywhere after the group fields. A specific order needs a source of
    that name, fields of that source that the common order does not sort by yet, and
    no source order of its own. Partition fields must be group fields, and in a rollup
    fields down to the one it rolls up from, so that groups stay whole.
    """
    if not sources:
        raise ValueError("at least one source is needed")
    if not group_fields:
        raise ValueError("group fields are needed")
    _check_group_fields(sources, group_fields, "group")
    keys = default_order(group_fields) if order is None else as_keys(order)
    names = [k.name for k in keys]
    S._no_repeats(names)
    if SOURCE in names and len(sources) < 2:
        raise ValueError("a source order needs several sources")
    if len(sources) > 1 and any(SOURCE in df.columns for df in sources.values()):
        raise ValueError(f"{SOURCE!r} names the source and cannot be a column")
    for name in names:
        if name != SOURCE and any(name not in df.columns for df in sources.values()):
            raise ValueError(f"order field {name!r} is not in every source")
    if set(names[: len(group_fields)]) != set(group_fields):
        raise ValueError("the order must start with the group fields")
    if rollup_from is not None and rollup_from not in group_fields:
        raise ValueError(f"rollup field {rollup_from!r} is not a group field")
    for label, own in (specific or {}).items():
        if label not in sources:
            raise ValueError(f"no source {label!r}")
        fields = [k.name for k in as_keys(own)]
        S._no_repeats(fields)
        if not fields:
            raise ValueError(f"the specific order of {label!r} is empty")
        for name in fields:
            if name == SOURCE:
                raise ValueError(f"the specific order of {label!r} cannot hold the source order")
            if name not in sources[label].columns:
                raise ValueError(f"{name!r} is not in source {label!r}")
            if name in names:
                raise ValueError(f"the common order sorts by {name!r} already")
    if partition_fields is not None:
        if not partition_fields:
            raise ValueError("partition fields are empty")
        _check_group_fields(sources, partition_fields, "partition")
        grouped = [n for n in names if n in group_fields]
        whole = grouped if rollup_from is None else grouped[: grouped.index(rollup_from) + 1]
        if not set(partition_fields) <= set(whole):
            raise ValueError(f"partition fields must be among {whole}, or groups would be cut")
    return keys


def natural_key(column: Column) -> list[Column]:
    """Sort keys for names with embedded numbers: every run of digits counts as its number.

    Runs are padded to 40 digits; of a longer run the last 40 decide. Names that
    are equal so far, as by leading zeros, go by their text.
    """
    padded = F.regexp_replace(column, r"(\d+)", "0" * 40 + "$1")
    return [F.regexp_replace(padded, r"\d*(\d{40})", "$1"), column]
