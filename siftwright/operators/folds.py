"""Folds over the sorted rows of groups, with state carried from row to row.

What is admitted depends on what was admitted before, so a group's rows must be
seen one after another. They are sorted by Spark (which spills to disk) and
stream through the task in batches: a task holds a batch and the state of one
group, however many rows the group has. Groups run in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}


def fold(df: DataFrame, group: Sequence[str], order: Sequence[Column], inputs: dict[str, Column], start: Callable[[], list], step: Callable[[list, tuple], tuple | None], adds: dict[str, str]) -> DataFrame:
    """(group..., adds...) of the rows for which ``step(state, row)`` gives a
    tuple of ``adds``; None leaves a row out. ``row`` has the ``inputs`` in
    their order; ``start()`` makes a group's state, which ``step`` changes."""
    n = len(group)
    sort = [o.alias(f"order_{i}") for i, o in enumerate(order)]
    rows = df.select(*group, *[c.alias(f"in_{k}") for k, c in inputs.items()], *sort)
    rows = rows.repartition(*group) if n else rows.repartition(1)
    rows = rows.sortWithinPartitions(*group, *[f"order_{i}" for i in range(len(order))]).drop(*[f"order_{i}" for i in range(len(order))])
    names, kinds = [*group, *adds], [KINDS[k] for k in adds.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        state: list = []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            keys = zip(*columns[:n]) if n else [()] * batch.num_rows
            at, out = [], []
            for i, (key, row) in enumerate(zip(keys, zip(*columns[n:]))):
                if key != now:
                    now, state = key, start()
                if (add := step(state, row)) is not None:
                    at.append(i)
                    out.append(add)
            if at:
                kept = pa.array(at)
                yield pa.RecordBatch.from_arrays([*(c.take(kept) for c in batch.columns[:n]), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names)

    of = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {of.get(k) if k in group else adds[k]}" for k in names)
    return rows.mapInArrow(run, schema)
