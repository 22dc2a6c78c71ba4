"""User functions per group as Arrow tables: whole groups, pairs of groups, and states that merge.

A function that needs its whole group (an ordered walk, a fit on a cell's days) gets it as one table; use it where groups
are bounded, as by a calendar.  A function whose state merges is called on parts of a group where they lie, so a group
that holds half of all rows is worked on by all tasks and only states travel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

HELD = 50_000  # groups whose states a task keeps before it sends them on
ROWS = 1 << 18  # rows that a task puts in groups at a time
MERGED = 16  # states of a group that are kept before they are merged


def _with_keys(found: pa.Table, keys: Sequence[str], values: Sequence[pa.Scalar]) -> pa.Table:
    columns = {k: pa.array([v.as_py()] * found.num_rows, v.type) for k, v in zip(keys, values)}
    return pa.table({**columns, **{c: found.column(c) for c in found.column_names if c not in columns}})


def _schema(df: DataFrame, keys: Sequence[str], out: str) -> StructType:
    return StructType([*[df.schema[k] for k in keys], *T._parse_datatype_string(out)]) if isinstance(out, str) else out


def map_groups(df: DataFrame, keys: Sequence[str], fn: Callable[[pa.Table], pa.Table], out: str, order: Sequence[str] = ()) -> DataFrame:
    """``fn`` of every group's rows in ``order``; ``out`` names the columns it returns, the keys are put before them."""
    keys = list(keys)

    def one(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order]) if order else table
        return _with_keys(fn(table), keys, key)

    return df.groupBy(*keys).applyInArrow(one, _schema(df, keys, out))


def map_cogroups(
    left: DataFrame, right: DataFrame, keys: Sequence[str], fn: Callable[[pa.Table, pa.Table], pa.Table], out: str
) -> DataFrame:
    """``fn`` of the rows of both sides for every key that occurs on either; a side without it is an empty table."""
    keys = list(keys)

    def one(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        return _with_keys(fn(a, b), keys, key)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(one, _schema(left, keys, out))


@dataclass(frozen=True)
class Mergeable:
    """An aggregate of which parts can be merged in any order.

    ``partial`` turns rows into one row of ``state`` columns, ``merge`` several state rows into one, ``finish`` one into
    one row of ``out`` columns.  All take and return tables.
    """

    state: str
    out: str
    partial: Callable[[pa.Table], pa.Table]
    merge: Callable[[pa.Table], pa.Table]
    finish: Callable[[pa.Table], pa.Table]


def group_states(df: DataFrame, keys: Sequence[str], aggregate: Mergeable) -> DataFrame:
    """One state a group and task (more where a task meets very many groups), without a shuffle."""
    keys = list(keys)
    schema = _schema(df, keys, aggregate.state)
    names = [f.name for f in schema]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[pa.Table]] = {}
        types = {f.name: f.type for f in to_arrow_schema(schema)}

        def merged(states: list[pa.Table]) -> pa.Table:
            return states[0] if len(states) == 1 else aggregate.merge(pa.concat_tables(states))

        def send() -> Iterator[pa.RecordBatch]:
            if held:
                states = [merged(s) for s in held.values()]
                rows = np.repeat(np.arange(len(states)), [s.num_rows for s in states])
                columns = {k: pa.array([name[i] for name in held], types[k]).take(pa.array(rows)) for i, k in enumerate(keys)}
                table = pa.concat_tables([s.drop_columns([c for c in s.column_names if c in keys]) for s in states])
                found = pa.table({**columns, **{c: table.column(c) for c in table.column_names}}).select(names)
                yield from found.combine_chunks().to_batches()
            held.clear()

        def take_in(batches: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(batches)
            groups = rows.append_column("_row", pa.array(np.arange(rows.num_rows))).group_by(keys).aggregate([("_row", "list")])
            lists = groups.column("_row_list").combine_chunks()
            rows = rows.combine_chunks().take(lists.values)  # each group's rows side by side, in their order
            edges = lists.offsets.to_numpy().tolist()
            columns = [groups.column(k).to_pylist() for k in keys]
            for g, (begin, end) in enumerate(zip(edges[:-1], edges[1:])):
                states = held.setdefault(tuple(c[g] for c in columns), [])
                states.append(aggregate.partial(rows.slice(begin, end - begin)))
                if len(states) >= MERGED:
                    states[:] = [merged(states)]

        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= ROWS:
                take_in(waiting)
                waiting = []
                if len(held) > HELD:
                    yield from send()
        if waiting:
            take_in(waiting)
        yield from send()

    return df.mapInArrow(task, schema)


def aggregate_groups(df: DataFrame, keys: Sequence[str], aggregate: Mergeable) -> DataFrame:
    """``keys`` and the ``out`` columns of every group; only states are shuffled, at most one a group and task."""
    keys = list(keys)

    def one(key: tuple, states: pa.Table) -> pa.Table:
        return _with_keys(aggregate.finish(aggregate.merge(states.drop_columns(keys))), keys, key)

    return group_states(df, keys, aggregate).groupBy(*keys).applyInArrow(one, _schema(df, keys, aggregate.out))


def summed(state: str, out: str, partial: Callable[[pa.Table], pa.Table], finish: Callable[[pa.Table], pa.Table]) -> Mergeable:
    """A :class:`Mergeable` whose states merge by adding up every column."""

    def merge(states: pa.Table) -> pa.Table:
        total = states.group_by([]).aggregate([(c, "sum") for c in states.column_names])
        return pa.table({c: total.column(f"{c}_sum") for c in states.column_names})

    return Mergeable(state, out, partial, merge, finish)



