"""Ordered folds: per-key recurrences whose every step depends on earlier outcomes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reelspark.session import ready


class Fold:
    """State of one key: ``step`` takes its rows in order, ``end`` closes it; both return rows."""

    def step(self, row: dict) -> list[dict]:
        raise NotImplementedError

    def end(self) -> list[dict]:
        return []


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], make: Callable[[], Fold], schema: str) -> DataFrame:
    """Run a fold over each key's rows in order.

    Rows are shuffled by key and sorted by Spark, which spills; the fold then streams over them. A
    task holds one batch and one key's state, however many rows the key has.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    ready(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if state is None or key != current:
                    out += state.end() if state else []
                    current, state = key, make()
                out += state.step(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if state and (out := state.end()):
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def run_fold(df: DataFrame, keys: Sequence[str], frame: str, value: Callable[[pa.RecordBatch], np.ndarray], step: Callable[[np.ndarray, np.ndarray, pa.RecordBatch], np.ndarray], out: Callable[[np.ndarray], pa.Array], schema: str) -> DataFrame:
    """A recurrence along runs of consecutive frames of each key, over columns.

    ``value(batch)`` gives the rows' values; the first row of a run keeps its own, and every later one
    becomes ``step(values before, own values, rows)``. The rows of one place in their runs are worked out
    together, so many short runs take few steps. A task holds one batch and the last row before it.
    Rows: keys, frame and ``out(values)``.
    """
    ready(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            now, at = value(batch), batch.column(frame).to_numpy().astype(np.int64)
            follows = np.zeros(n, bool)
            follows[1:] = at[1:] == at[:-1] + 1
            for key in keys:
                x = batch.column(key)
                follows[1:] &= pc.fill_null(pc.equal(x[1:], x[:-1]), False).to_numpy(zero_copy_only=False)
            here = tuple(batch.column(k)[0].as_py() for k in keys)
            follows[0] = last is not None and last == (here, int(at[0]) - 1) and None not in here
            place = np.arange(n)
            place -= np.maximum.accumulate(np.where(follows, 0, place))
            place += follows[0] & (np.cumsum(~follows) == 0)  # the run of the row before the batch goes on
            values = np.concatenate([now[:1] if state is None else state, now])
            order = np.argsort(place, kind="stable")
            bounds = np.searchsorted(place[order], np.arange(1, int(place.max()) + 2))
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                rows = order[low:high]
                values[rows + 1] = step(values[rows], now[rows], batch.take(pa.array(rows)))
            last, state = (tuple(batch.column(k)[n - 1].as_py() for k in keys), int(at[-1])), values[-1:]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), batch.column(frame), out(values[1:])], [*keys, frame, "value"])

    return df.repartition(*keys).sortWithinPartitions(*keys, frame).mapInArrow(run, schema)


def native_fold(value: Column, order: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """An aggregate of short groups: the rows in order, folded by expressions in the JVM."""
    return F.aggregate(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), start, lambda a, x: step(a, x["v"]))
