"""Grouping, rollup levels, rollup event streams, co-groups and user hooks."""

from __future__ import annotations

import functools
import itertools
import math
import pickle
import sys
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomstat.functions.ordering import SOURCE, SortKey, as_keys, check_job, sort_columns
from loomstat.functions.schema import alias_fields
from loomstat.session import materialise, scratch_path


def group_sum(df: DataFrame, keys: Sequence[str], sums: Mapping[str, str], count: str | None = None) -> DataFrame:
    """Sums (and a row count) per key; null keys form one group.

    Partial sums are built before the shuffle, so a hot key costs one row per
    task, not all its rows.
    """
    check_job({"input": df}, keys)
    aggs = [F.sum(source).alias(name) for name, source in sums.items()]
    if count:
        aggs.append(F.count("*").alias(count))
    return df.groupBy(*keys).agg(*aggs)


def group_count(df: DataFrame, keys: Sequence[str], name: str = "count") -> DataFrame:
    """Rows per key; null keys form one group. Counted in part before the shuffle."""
    check_job({"input": df}, keys)
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def checked_square_sum(df: DataFrame, keys: Sequence[str], value: str, name: str = "square_sum") -> DataFrame:
    """Sum of squares of whole numbers that raises on overflow instead of wrapping.

    ``decimal(38, 0)`` holds every intermediate; the final cast to ``bigint``
    fails under ANSI rules when the total does not fit.
    """
    v = F.col(value).cast("decimal(19,0)")
    total = F.sum((v * v).cast("decimal(38,0)"))
    limit = F.lit(2**63 - 1)
    fits = F.when(total <= limit, total).otherwise(F.raise_error(F.lit("sum of squares overflows")).cast("decimal(38,0)"))
    return df.groupBy(*keys).agg(fits.cast("bigint").alias(name))


def prefixes(order: Sequence[str], group_fields: Sequence[str], rollup_from: str) -> list[list[str]]:
    """Rollup levels: prefixes of the sort order from ``rollup_from`` down."""
    fields = [name for name in order if name in group_fields]
    if rollup_from not in fields:
        raise ValueError(f"{rollup_from!r} is not a group field")
    first = fields.index(rollup_from)
    return [fields[: i + 1] for i in range(first, len(fields))]


def rollup_levels(
    df: DataFrame, order: str | Sequence[SortKey], group_fields: Sequence[str], rollup_from: str, aggs: Mapping[str, Column]
) -> DataFrame:
    """Aggregates for every rollup level in one pass (GROUPING SETS, no grand total).

    ``depth`` is the 0-based position of the level's last field in the order;
    fields below the level are null.
    """
    keys = check_job({"input": df}, group_fields, order, rollup_from)
    names = [k.name for k in keys if k.name in group_fields]
    levels = prefixes(names, group_fields, rollup_from)
    grouped = df.groupingSets([[F.col(c) for c in level] for level in levels], *[F.col(c) for c in names])
    # A level keeps its fields and masks the rest: depth = number of kept fields − 1.
    depth = F.lit(len(names) - 1)
    for name in names:
        depth = depth - F.grouping(name).cast("int")
    return grouped.agg(depth.cast("int").alias("depth"), *[c.alias(n) for n, c in aggs.items()])


def rollup_edges(
    df: DataFrame, order: str | Sequence[SortKey], group_fields: Sequence[str], rollup_from: str, columns: Sequence[str], struct: T.StructType | None = None
) -> DataFrame:
    """First and last row of every group of every rollup level: depth, group fields, ``first``, ``last``.

    Fields below a level are null; ``struct`` may declare enum fields. Any type sorts, both
    ways. The rows of the deepest level are limited to one per group and task before
    they shuffle; a higher level takes its rows from the level below, since its groups
    begin and end with one of theirs. Rows that tie under the whole order: any one.
    """
    keys = check_job({"input": df}, group_fields, order, rollup_from)
    names = [k.name for k in keys if k.name in group_fields]
    struct = struct or df.schema
    out = None
    for name, sort in (("first", keys), ("last", [k.reversed() for k in keys])):
        by = sort_columns(sort, struct)
        rows = df
        for depth in range(len(names) - 1, names.index(rollup_from) - 1, -1):
            window = Window.partitionBy(*names[: depth + 1]).orderBy(*by[depth + 1 :], F.xxhash64(*df.columns))
            rows = rows.withColumn("_place", F.row_number().over(window)).where("_place = 1").drop("_place")
            level = [F.col(n) if at <= depth else F.lit(None).cast(df.schema[n].dataType).alias(n) for at, n in enumerate(names)]
            edge = rows.select(F.lit(depth).alias("depth"), *level, F.lit(name).alias("_end"), F.struct(*columns).alias("_row"))
            out = edge if out is None else out.unionByName(edge)
    ends = [F.first(F.when(F.col("_end") == name, F.col("_row")), ignorenulls=True).alias(name) for name in ("first", "last")]
    return out.groupBy("depth", *names).agg(*ends)


def group_edges(
    df: DataFrame, keys: Sequence[str], order: str | Sequence[SortKey], columns: Sequence[str], struct: T.StructType | None = None
) -> DataFrame:
    """First and last row of each group under the order, as ``first`` / ``last`` (see ``rollup_edges``)."""
    whole = [*[SortKey(k) for k in keys], *[k for k in as_keys(order) if k.name not in keys]]
    return rollup_edges(df, whole, keys, keys[-1], columns, struct).drop("depth")


def _changed(columns: Sequence[pa.Array], first: int) -> np.ndarray:
    """For every row but the first the smallest depth, from ``first`` on, where it differs from the one before; past the last if none."""
    out = np.full(max(len(columns[0]) - 1, 0), len(columns))
    for depth in reversed(range(len(columns))):
        out[~_same_as_before(columns[depth])] = depth
    return np.maximum(out, first)


def _event_batches(names: Sequence[str], first: int, kept: Sequence[str]):
    """One sorted partition to its events, numbered from its first element on.

    What lies before and after the partition is unknown here, so the opens of its
    first row and the closes of its last row are emitted for every depth and marked
    by ``_edge`` (1 and 2); the caller keeps those that hold.
    """
    last = len(names) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, seq = TaskContext.get().partitionId(), None, first - last - 1

        def events(batch: pa.RecordBatch, opens: np.ndarray, elements: np.ndarray, closes: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
            nonlocal seq
            counts = opens + elements + closes
            row = np.repeat(np.arange(len(counts)), counts)
            step = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            kind = np.where(step < opens[row], 0, np.where(step < opens[row] + elements[row], 1, 2))
            depth = np.where(kind == 0, last + 1 - opens[row] + step, last - (step - opens[row] - elements[row]))
            mark = np.where(kind == 1, 0, np.where(kind == 0, edge[row] & 1, edge[row] & 2))
            event = pa.array(["OPEN", "ELEMENT", "CLOSE"]).take(pa.array(kind))
            out = [
                pa.repeat(pa.scalar(part, pa.int32()), len(row)), pa.array(seq + np.arange(len(row)), pa.int64()), pa.array(mark, pa.int32()),
                event, pa.array(depth, pa.int32(), mask=kind == 1), *[batch.column(batch.schema.get_field_index(c)).take(pa.array(row)) for c in kept],
            ]
            seq += len(row)
            return pa.RecordBatch.from_arrays(out, ["_part", "_local", "_edge", "event", "depth", *kept])

        for batch in batches:
            if not batch.num_rows:
                continue
            old = held is not None
            if old:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            n = batch.num_rows
            changed = last + 1 - _changed([batch.column(batch.schema.get_field_index(c)) for c in names], first)
            opens, closes, edge = np.append(last + 1 - first, changed), np.append(changed, 0), np.zeros(n, int)
            elements = np.ones(n, int)
            if old:  # all of this row but its closes is out already
                opens[0] = elements[0] = 0
            else:
                edge[0] = 1
            yield events(batch, opens, elements, closes, edge)
            held = batch.slice(n - 1)
        if held is not None:
            zero = np.zeros(1, int)
            yield events(held, zero, zero, zero + last + 1 - first, zero + 2)

    return run


def _range_sorted(df: DataFrame, columns: Sequence[Column]) -> DataFrame:
    """One global order over range partitions; a row hash spreads and orders equal keys."""
    order = [*columns, F.xxhash64(*df.columns)]
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def rollup_events(
    df: DataFrame, order: str | Sequence[SortKey], group_fields: Sequence[str], rollup_from: str
) -> DataFrame:
    """The open / element / close sequence of a hierarchical rollup, as rows.

    Output: ``seq`` (from 0, without gaps), ``event``, ``depth`` (null for elements) and
    the columns of the row concerned: a group opens with its first and closes
    with its last row. One global sort: each task turns its range of rows into events and
    numbers them, and one row per task is enough to settle what opens and closes at
    the edges and where each range's numbers begin. No group is gathered anywhere.
    """
    keys = check_job({"input": df}, group_fields, order, rollup_from)
    names = [k.name for k in keys if k.name in group_fields]
    first, depths = len(prefixes(names, group_fields, rollup_from)[0]) - 1, len(names)
    fields = [T.StructField(n, t) for n, t in (("_part", T.IntegerType()), ("_local", T.LongType()), ("_edge", T.IntegerType()), ("event", T.StringType()), ("depth", T.IntegerType()))]
    whole = T.StructType(fields + [T.StructField(f.name, f.dataType) for f in df.schema.fields])
    sorted_rows = _range_sorted(df, sort_columns(keys, df.schema))
    events = materialise(sorted_rows.mapInArrow(_event_batches(names, first, df.columns), whole), "rollup-events")

    def changed(other: str) -> Column:
        """How many depths differ from a neighbour's key; all without a neighbour."""
        out = F.lit(0)
        for depth in reversed(range(first, depths)):
            same = F.lit(True)
            for name in names[: depth + 1]:
                same = same & F.col("_key")[name].eqNullSafe(F.col(other)[name])
            out = F.when(~same, F.lit(depths - depth)).otherwise(out)
        return F.when(F.col(other).isNull(), F.lit(depths - first)).otherwise(out)

    # One row per partition from here on.
    key = F.struct(*[F.col(n) for n in names])
    parts = events.groupBy("_part").agg(F.min_by(key, "_local").alias("_first"), F.max_by(key, "_local").alias("_last"), F.count_if(F.col("_edge") == 0).alias("_inner"))
    line = Window.orderBy("_part")
    parts = parts.select("*", F.lag("_last").over(line).alias("_left"), F.lead("_first").over(line).alias("_right"))
    opens, closes = changed("_left"), changed("_right")
    parts = parts.withColumn("_key", F.col("_first")).withColumn("_opens", opens).withColumn("_key", F.col("_last")).withColumn("_closes", closes)
    size = F.col("_opens") + F.col("_inner") + F.col("_closes")
    before = F.coalesce(F.sum(size).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_part", "_opens", "_closes", (before + F.col("_opens")).alias("_shift"))
    joined = events.join(F.broadcast(parts), "_part")
    from_depth = lambda n: F.col("depth") >= F.lit(depths) - F.col(n)
    holds = (F.col("_edge") == 0) | ((F.col("_edge") == 1) & from_depth("_opens")) | ((F.col("_edge") == 2) & from_depth("_closes"))
    return joined.where(holds).select((F.col("_local") + F.col("_shift")).alias("seq"), "event", "depth", *df.columns)


def ordered_groups(
    df: DataFrame, keys: Sequence[str], columns: Sequence[Column] = (), partition_fields: Sequence[str] | None = None, partitions: int | None = None
) -> DataFrame:
    """Hash-partition by key and sort inside, the layout group hooks read.

    ``partition_fields`` partitions by fewer fields than the key; ``partitions`` fixes their
    number, which is otherwise the session's.
    """
    fields = [F.col(c) for c in partition_fields or keys]
    dealt = df.repartition(partitions, *fields) if partitions else df.repartition(*fields)
    return dealt.sortWithinPartitions(*[F.col(k).asc() for k in keys], *columns)


Reducer = Callable[[tuple, Iterator[pd.DataFrame]], Iterator[tuple]]


def shipped(hook: object) -> bytes:
    """A user's hook as bytes that workers can load even where its module is only on the driver's path.

    Outside this library the class or function travels by value, settings and all.
    """
    module = sys.modules.get(getattr(hook, "__module__", None) or type(hook).__module__)
    if module is None or module.__name__ == "__main__" or module.__name__.split(".")[0] == __name__.split(".")[0]:
        return cloudpickle.dumps(hook)
    known = module.__name__ in cloudpickle.list_registry_pickle_by_value()
    cloudpickle.register_pickle_by_value(module)
    try:
        return cloudpickle.dumps(hook)
    finally:
        if not known:
            cloudpickle.unregister_pickle_by_value(module)


def _struct(schema: T.StructType | str) -> T.StructType:
    return T.DataType.fromDDL(schema) if isinstance(schema, str) else schema


def _same_as_before(column: pa.Array) -> np.ndarray:
    """For every value but the first whether it equals the one before; nulls are equal, and so are NaNs."""
    now, before = column.slice(1), column.slice(0, max(len(column) - 1, 0))
    if pa.types.is_nested(column.type):
        return np.array([a == b for a, b in itertools.pairwise(column.to_pylist())], dtype=bool)
    same = pc.or_(pc.fill_null(pc.equal(now, before), False), pc.and_(pc.is_null(now), pc.is_null(before)))
    if pa.types.is_floating(column.type):
        same = pc.or_(same, pc.fill_null(pc.and_(pc.is_nan(now), pc.is_nan(before)), False))
    return same.to_numpy(zero_copy_only=False)


def _key_value(value: object) -> object:
    """A key as batches compare it: every NaN is one object, hence equal to itself inside a tuple."""
    return math.nan if isinstance(value, float) and math.isnan(value) else value


def _frame(batch: pa.RecordBatch) -> pd.DataFrame:
    """A batch as pandas; whole numbers beside nulls stay whole (nullable integers), not floats."""
    pdf = batch.to_pandas()
    for at, column in enumerate(batch.columns):
        if pa.types.is_integer(column.type) and column.null_count:
            pdf.isetitem(at, column.to_pandas(types_mapper={column.type: pd.Int64Dtype()}.get))
    return pdf


def _pieces(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Cut key-sorted batches where the key changes: (key, rows) pieces."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        changes = np.zeros(batch.num_rows - 1, dtype=bool)
        for column in columns:
            changes |= ~_same_as_before(column)
        cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
        pdf = _frame(batch)
        for first, last in itertools.pairwise(cuts):
            yield tuple(_key_value(c[first].as_py()) for c in columns), pdf.iloc[first:last]


def _as_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Collect output tuples into Arrow batches of the declared schema."""
    while chunk := list(itertools.islice(rows, size)):
        columns = [pa.array(list(c), type=f.type) for c, f in zip(zip(*chunk), schema)]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _reduce_sorted(rows: DataFrame, keys: Sequence[str], reducer: Reducer, schema: T.StructType | str) -> DataFrame:
    out, keys, hook = to_arrow_schema(_struct(schema)), list(keys), shipped(reducer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reducer = pickle.loads(hook)

        def produced() -> Iterator[tuple]:
            for key, group in itertools.groupby(_pieces(batches, keys), key=lambda piece: piece[0]):
                yield from reducer(key, (frame for _, frame in group))

        yield from _as_batches(produced(), out)

    return rows.mapInArrow(run, _struct(schema))


def reduce_groups(
    df: DataFrame,
    keys: Sequence[str],
    reducer: Reducer,
    schema: T.StructType | str,
    order: str | Sequence[SortKey] | None = None,
    combiner: Callable[[DataFrame], DataFrame] | None = None,
    partition_fields: Sequence[str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Run a user reducer over each ordered group; it yields output tuples.

    A task streams its key-sorted rows once, in Arrow batches shared by many
    small groups; a long group arrives as several frames, so memory stays flat.
    It is still one task per key: give a ``combiner`` (DataFrame → DataFrame
    pre-aggregation) when a key can be hot and the reducer allows it, or use the
    built-in aggregates instead.
    """
    rows = combiner(df) if combiner else df
    check_job({"input": rows}, keys, partition_fields=partition_fields)
    columns = sort_columns(order, df.schema) if order is not None else ()
    return _reduce_sorted(ordered_groups(rows, keys, columns, partition_fields, partitions), keys, reducer, schema)


class RowMapper:
    """A map hook with set-up and clean-up around the batches of a task."""

    def setup(self) -> None: ...

    def map(self, batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def cleanup(self) -> Iterator[pd.DataFrame]:
        return iter(())


def map_rows(df: DataFrame, mapper: RowMapper, schema: T.StructType | str) -> DataFrame:
    """Run a ``RowMapper`` over Arrow batches, without a shuffle.

    The instance travels to the workers with its settings; every task works on
    its own copy.
    """

    hook = shipped(mapper)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mapper = pickle.loads(hook)
        mapper.setup()
        for batch in batches:
            yield from mapper.map(batch)
        yield from mapper.cleanup()

    return df.mapInPandas(run, schema)


class RollupHooks:
    """Callbacks of a rollup; each yields output tuples. ``row`` is a dict."""

    def on_open(self, depth: int, field: str, row: dict) -> Iterator[tuple]:
        return iter(())

    def on_element(self, row: dict) -> Iterator[tuple]:
        return iter(())

    def on_close(self, depth: int, field: str, row: dict) -> Iterator[tuple]:
        return iter(())


def _packed_runs(batches: Iterator[pa.RecordBatch], rows: int = 65_536) -> Iterator[pa.RecordBatch]:
    """Events in the order of ``seq`` as runs for one target each: (_to, seq of the first, compressed Arrow stream)."""
    waiting, held = [], 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            waiting.append(batch)
            held += batch.num_rows
        if not held or (batch is not None and held < rows):
            continue
        table = pa.Table.from_batches(waiting)
        waiting, held = [], 0
        # A scan may put several ranges one behind the other: a run ends where the numbers jump, so no two runs overlap.
        places = table.column("seq").to_numpy()
        for first, last in itertools.pairwise([0, *(np.flatnonzero(np.diff(places) != 1) + 1).tolist(), table.num_rows]):
            part = table.slice(first, last - first)
            targets = part.column("_to").to_numpy()
            for target in np.unique(targets):
                run = part.filter(pa.array(targets == target)).drop_columns(["_to"]).combine_chunks()
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, run.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_table(run)
                start = pa.array([run.column("seq")[0].as_py()], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([target], pa.int32()), start, pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["_to", "seq", "_run"])


def _unpacked(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for run in batch.column("_run"):
            with pa.ipc.open_stream(run.as_buffer()) as stream:
                for piece in stream:
                    yield from (piece.slice(at, rows) for at in range(0, piece.num_rows, rows))


def rollup_hooks(
    df: DataFrame,
    order: str | Sequence[SortKey],
    group_fields: Sequence[str],
    rollup_from: str,
    hooks: RollupHooks,
    schema: T.StructType | str,
    partition_fields: Sequence[str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Drive user hooks through the events of ``rollup_events``.

    Rows are partitioned by the fields above and at ``rollup_from`` (or by fewer, as
    ``partition_fields``), so one hierarchy stays in one task and is streamed through it in
    order; it arrives there in compressed runs of the ranges that ``rollup_events`` wrote. Where the hooks only build up values, ``rollup_states`` does it on all cores.
    """
    keys = check_job({"input": df}, group_fields, order, rollup_from, partition_fields=partition_fields)
    names = [k.name for k in keys if k.name in group_fields]
    base = partition_fields or prefixes(names, group_fields, rollup_from)[0]
    events = rollup_events(df, keys, group_fields, rollup_from)
    tasks = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    to = F.pmod(F.hash(*base), F.lit(tasks)).alias("_to")
    # A task sorts compressed runs of events by where they begin, not the events one by one.
    packed = events.select(to, "seq", "event", "depth", *df.columns).mapInArrow(_packed_runs, "_to int, seq bigint, _run binary")
    layout = packed.repartitionById(tasks, "_to").sortWithinPartitions("seq")
    out, columns, hook = to_arrow_schema(_struct(schema)), df.columns, shipped(hooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hooks = pickle.loads(hook)

        def produced() -> Iterator[tuple]:
            for record in itertools.chain.from_iterable(batch.to_pylist() for batch in _unpacked(batches)):
                row = {c: record[c] for c in columns}
                if record["event"] == "ELEMENT":
                    yield from hooks.on_element(row)
                    continue
                call = hooks.on_open if record["event"] == "OPEN" else hooks.on_close
                yield from call(record["depth"], names[record["depth"]], row)

        yield from _as_batches(produced(), out)

    return layout.mapInArrow(run, _struct(schema))


class RollupState:
    """A value that is built up for every group of a rollup.

    ``add`` takes the rows of one deepest group, in order, a frame at a time; ``merge`` joins the
    states of two neighbours, the earlier one first, and must not depend on where
    the neighbours are cut. ``close`` yields output tuples for a group that is complete.
    """

    def zero(self) -> object:
        raise NotImplementedError

    def add(self, state: object, rows: pd.DataFrame) -> object:
        raise NotImplementedError

    def merge(self, state: object, later: object) -> object:
        raise NotImplementedError

    def close(self, depth: int, field: str, key: tuple, state: object) -> Iterator[tuple]:
        raise NotImplementedError


def rollup_states(
    df: DataFrame, order: str | Sequence[SortKey], group_fields: Sequence[str], rollup_from: str, states: RollupState, schema: T.StructType | str
) -> DataFrame:
    """Run a ``RollupState`` over every group of every rollup level; returns what its ``close`` yields.

    The rows are in one global order over range partitions, however few values the
    top field has, so all cores take part. A task closes the groups that begin and end
    inside it. Of those that its edges cut it emits the state, and the states of a
    group meet, in order, in a second small step: at most two per level and task.
    """
    keys = check_job({"input": df}, group_fields, order, rollup_from)
    names = [k.name for k in keys if k.name in group_fields]
    first, last = len(prefixes(names, group_fields, rollup_from)[0]) - 1, len(names) - 1
    result = _struct(schema)
    partial = T.StructType(
        [T.StructField("_depth", T.IntegerType()), *[T.StructField(f"_k{i}", df.schema[n].dataType) for i, n in enumerate(names)], T.StructField("_part", T.IntegerType()), T.StructField("_state", T.BinaryType())]
    )
    both = T.StructType([T.StructField("done", result), T.StructField("cut", partial)])
    arrow, hook = to_arrow_schema(both), shipped(states)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = pickle.loads(hook)
        part = TaskContext.get().partitionId()

        def produced() -> Iterator[tuple]:
            key, stack, begun = None, {}, set()  # open states by depth; depths open since the first row

            def end(depth: int, cut: bool) -> Iterator[tuple]:
                """Close the groups from the deepest up to ``depth``; each state goes on into the one above."""
                for d in range(last, depth - 1, -1):
                    state = stack.pop(d)
                    if d > first:
                        stack[d - 1] = states.merge(stack[d - 1], state)
                    if cut or d in begun:
                        values = [*key[: d + 1], *[None] * (last - d)]
                        row = dict(zip([f"_k{i}" for i in range(last + 1)], values))
                        yield None, {"_depth": d, **row, "_part": part, "_state": pickle.dumps(state)}
                    else:
                        for found in states.close(d, names[d], key[: d + 1], state):
                            yield dict(zip(result.names, found)), None
                    begun.discard(d)

            for now, rows in _pieces(batches, names):
                if key is not None and now != key:
                    yield from end(max(first, next(d for d in range(last + 1) if now[d] != key[d])), False)
                if key is None:
                    begun = set(range(first, last + 1))
                key = now
                for d in range(first, last + 1):
                    stack.setdefault(d, states.zero())
                stack[last] = states.add(stack[last], rows)
            if key is not None:
                yield from end(first, True)

        yield from _as_batches(produced(), arrow)

    sorted_rows = _range_sorted(df, sort_columns(keys, df.schema))
    found = materialise(sorted_rows.mapInArrow(run, both), "rollup-states")
    done = found.where("done is not null").select("done.*")
    cut = found.where("cut is not null").select("cut.*")
    out = to_arrow_schema(result)

    def finish(pieces: pa.Table) -> pa.Table:
        states = pickle.loads(hook)
        rows = sorted(pieces.to_pylist(), key=lambda r: r["_part"])
        depth = rows[0]["_depth"]
        state = functools.reduce(states.merge, (pickle.loads(r["_state"]) for r in rows))
        key = tuple(_key_value(rows[0][f"_k{i}"]) for i in range(depth + 1))
        return pa.Table.from_batches(_as_batches(iter(states.close(depth, names[depth], key, state)), out), schema=out)

    rest = cut.groupBy("_depth", *[f"_k{i}" for i in range(last + 1)]).applyInArrow(finish, result)
    return done.unionByName(rest)


def tagged_union(sources: Mapping[str, DataFrame], source_column: str = SOURCE) -> DataFrame:
    """All sources as one set of rows: a source index and the union of columns."""
    out = None
    for index, df in enumerate(sources.values()):
        tagged = df.withColumn(source_column, F.lit(index))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def cogroup_rows(
    sources: Mapping[str, DataFrame],
    group_fields: Sequence[str],
    order: str | Sequence[SortKey] | None = None,
    specific_order: Mapping[str, str] | None = None,
    source_descending: bool = False,
    aliases: Mapping[str, Mapping[str, str]] | None = None,
    partition_fields: Sequence[str] | None = None,
) -> tuple[DataFrame, list[Column]]:
    """N sources lined up by key: tagged rows plus the sort columns.

    Within a key rows come in declared source order (or reversed), and each
    source in its own specific order. The common order may put the source
    (``source_ix``) between its fields; else it stands at its end. Sort the rows
    globally with the columns, or hand both to ``reduce_cogroups``.
    """
    aliases, specific_order = aliases or {}, specific_order or {}
    ready = {n: alias_fields(df, {v: k for k, v in aliases.get(n, {}).items()}) for n, df in sources.items()}
    keys = check_job(ready, group_fields, order, specific=specific_order, partition_fields=partition_fields)
    if not any(k.name == SOURCE for k in keys):
        keys = [*keys, SortKey(SOURCE, descending=source_descending)]
    elif source_descending:
        raise ValueError("the order already says how sources are sorted")
    rows = tagged_union(ready)
    columns = sort_columns(keys, rows.schema)
    for index, name in enumerate(ready):
        for key in as_keys(specific_order[name]) if name in specific_order else ():
            # Rows of other sources tie on a null here, so each source sorts alone.
            columns.append(key.over(F.when(F.col(SOURCE) == index, F.col(key.name))))
    return rows, columns


def reduce_cogroups(
    sources: Mapping[str, DataFrame],
    group_fields: Sequence[str],
    reducer: Reducer,
    schema: T.StructType | str,
    combiners: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None,
    partition_fields: Sequence[str] | None = None,
    partitions: int | None = None,
    **layout,
) -> DataFrame:
    """User reducer over n co-grouped sources, streamed in the declared order.

    A ``combiner`` of a source (DataFrame → DataFrame with the same group fields) shrinks its rows
    before they shuffle. A reducer still needs one task per key; where it only builds
    up values, ``cogroup_states`` spreads a hot key.
    """
    for name in combiners or {}:
        if name not in sources:
            raise ValueError(f"no source {name!r}")
    sources = {n: combiners[n](df) if n in (combiners or {}) else df for n, df in sources.items()}
    rows, columns = cogroup_rows(sources, group_fields, partition_fields=partition_fields, **layout)
    return _reduce_sorted(ordered_groups(rows, group_fields, columns, partition_fields, partitions), group_fields, reducer, schema)


class CogroupState:
    """A value that is built up per key and source, in any order of the rows, and merged."""

    def zero(self, source: str) -> object:
        raise NotImplementedError

    def add(self, source: str, state: object, rows: pd.DataFrame) -> object:
        raise NotImplementedError

    def merge(self, source: str, state: object, other: object) -> object:
        raise NotImplementedError

    def close(self, key: tuple, states: dict[str, object]) -> Iterator[tuple]:
        """Output tuples of a key; sources without rows for it are not in ``states``."""
        raise NotImplementedError


def cogroup_states(
    sources: Mapping[str, DataFrame],
    group_fields: Sequence[str],
    states: CogroupState,
    schema: T.StructType | str,
    aliases: Mapping[str, Mapping[str, str]] | None = None,
    slices: int = 64,
) -> DataFrame:
    """Co-group n sources into states that merge: what ``close`` yields for every key.

    Rows are dealt by key, source and a row hash modulo ``slices``, so a key that holds most
    rows is spread over as many tasks; each slice becomes one state, and only
    these meet by key: at most ``slices`` per key and source.
    """
    ready = {n: alias_fields(df, {v: k for k, v in (aliases or {}).get(n, {}).items()}) for n, df in sources.items()}
    check_job(ready, group_fields)
    names, result = list(ready), _struct(schema)
    rows = tagged_union(ready)
    rows = rows.withColumn("_slice", F.pmod(F.xxhash64(*rows.columns), F.lit(slices)).cast("int"))
    parts = [*group_fields, SOURCE, "_slice"]
    kinds = [T.StructField(f"_k{i}", rows.schema[n].dataType) for i, n in enumerate(group_fields)]
    partial = T.StructType([*kinds, T.StructField(SOURCE, T.IntegerType()), T.StructField("_state", T.BinaryType())])

    hook = shipped(states)

    def build(key: tuple, pieces: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        states = pickle.loads(hook)
        *group, index, _ = key
        source = names[index]
        state = states.zero(source)
        for frame in pieces:
            state = states.add(source, state, frame.drop(columns="_slice"))
        yield *group, index, pickle.dumps(state)

    built = _reduce_sorted(ordered_groups(rows, parts), parts, build, partial)
    out = to_arrow_schema(result)

    def finish(pieces: pa.Table) -> pa.Table:
        states = pickle.loads(hook)
        found: dict[str, object] = {}
        for index, state in zip(pieces.column(SOURCE).to_pylist(), pieces.column("_state").to_pylist()):
            source, state = names[index], pickle.loads(state)
            found[source] = states.merge(source, found[source], state) if source in found else state
        key = tuple(_key_value(pieces.column(f"_k{i}")[0].as_py()) for i in range(len(group_fields)))
        return pa.Table.from_batches(_as_batches(iter(states.close(key, found)), out), schema=out)

    return built.groupBy(*[f"_k{i}" for i in range(len(group_fields))]).applyInArrow(finish, result)


class OutputMapper:
    """A map hook with settings of its own and several named outputs: it yields (output, frame)."""

    def setup(self) -> None: ...

    def map(self, batch: pd.DataFrame) -> Iterator[tuple[str, pd.DataFrame]]:
        raise NotImplementedError

    def cleanup(self) -> Iterator[tuple[str, pd.DataFrame]]:
        return iter(())


def map_outputs(inputs: Sequence[tuple[DataFrame, OutputMapper]], outputs: Mapping[str, T.StructType | str]) -> dict[str, DataFrame]:
    """Run each input through its own mapper instance, once, into several named outputs.

    The instances travel to the tasks with their settings, every task working on its
    own copy. Rows carry the name of their output and are written in one pass, a
    folder per output; each DataFrame of the answer reads its folder only.
    """
    kinds = {name: _struct(schema) for name, schema in outputs.items()}
    if not inputs or not kinds:
        raise ValueError("at least one input and one output are needed")
    tagged = T.StructType([T.StructField("output", T.StringType()), *[T.StructField(n, k) for n, k in kinds.items()]])
    arrow = to_arrow_schema(tagged)

    def running(mapper: OutputMapper):
        def tag(found: Iterator[tuple[str, pd.DataFrame]]) -> Iterator[pa.RecordBatch]:
            for name, frame in found:
                if name not in kinds:
                    raise ValueError(f"no output {name!r}; declared are {sorted(kinds)}")
                columns = [pa.repeat(name, len(frame))]
                for own in arrow.names[1:]:
                    kind = arrow.field(own).type
                    if own != name:
                        columns.append(pa.nulls(len(frame), kind))
                        continue
                    parts = [pa.array(frame[kind.field(i).name], kind.field(i).type, from_pandas=True) for i in range(kind.num_fields)]
                    columns.append(pa.StructArray.from_arrays(parts, fields=[kind.field(i) for i in range(kind.num_fields)]))
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

        hook = shipped(mapper)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mapper = pickle.loads(hook)
            mapper.setup()
            for batch in batches:
                yield from tag(mapper.map(_frame(batch)))
            yield from tag(mapper.cleanup())

        return run

    rows = None
    for df, mapper in inputs:
        mapped = df.mapInArrow(running(mapper), tagged)
        rows = mapped if rows is None else rows.unionByName(mapped)
    spark = rows.sparkSession
    path = scratch_path(spark, "outputs")
    rows.write.partitionBy("output").parquet(path)
    written = spark.read.schema(T.StructType([*tagged.fields[1:], tagged.fields[0]])).parquet(path)
    return {name: written.where(F.col("output") == name).select(f"{name}.*") for name in kinds}
