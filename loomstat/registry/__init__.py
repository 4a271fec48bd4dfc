"""Registered queries over the given tables, by subject."""

from loomstat.registry import base


def _load() -> None:
    from loomstat.registry import aggregates, checks, joins, models, rows, sources, windows  # noqa: F401


def all_queries():
    _load()
    return dict(base.QUERIES)


def all_sql():
    _load()
    return dict(base.SQL)
