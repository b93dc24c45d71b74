"""Inserting through a sink that refuses whole batches: a batch that fails is halved where it fails, down to the rows at fault."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import io

#: Rows that are handed to the sink at a time.
BATCH = 1_000

Insert = Callable[[pa.RecordBatch], None]


def bisected(batch: pa.RecordBatch, insert: Insert) -> tuple[list[tuple[int, str]], int]:
    """Insert all rows of a batch that can be. Places and errors of the others, and calls made: about 2 k log2(n / k) for k of n."""
    failed, calls, todo = [], 0, [(0, batch.num_rows)]
    while todo:
        a, n = todo.pop()
        if n:
            calls += 1
            try:
                insert(batch.slice(a, n))
            except Exception as e:  # whatever a sink raises, its batch is at fault
                if n == 1:
                    failed.append((a, str(e)))
                else:
                    todo += [(a + n // 2, n - n // 2), (a, n // 2)]
    return failed, calls


def insert_rows(rows: DataFrame, sink: Callable[[int, int], AbstractContextManager[Insert]], batch: int = BATCH) -> tuple[int, int, DataFrame]:
    """Rows inserted, calls made, and the rejected rows with their error.

    In each task sink(partition, attempt) gives a context whose value inserts a batch, all of it or, if it raises, nothing; leaving it commits. A task may
    run more than once, so what one commits for a partition has to replace what another has. Rejects are written to the shared folder as the tasks' own output,
    of which Spark keeps one for each. Rows that equal a rejected one are rejected by themselves. No rows make no calls.
    """
    fields = ", ".join(f"`{n}`: {t}" for n, t in rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        inserted = calls = 0
        kind = None
        with sink(task.partitionId(), task.taskAttemptId()) as insert:
            for b in batches:
                whole = b.to_struct_array()
                kind = whole.type
                for a in range(0, b.num_rows, batch):
                    part = b.slice(a, batch)
                    failed, made = bisected(part, insert)
                    inserted, calls = inserted + part.num_rows - len(failed), calls + made
                    if failed:
                        places = pa.array([a + i for i, _ in failed])
                        none = pa.nulls(len(failed), pa.int64())
                        yield pa.RecordBatch.from_arrays([whole.take(places), pa.array([e for _, e in failed]), none, none], ["row", "error", "inserted", "calls"])
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.string()), pa.array([inserted]), pa.array([calls])], ["row", "error", "inserted", "calls"])

    done = io.written(rows.mapInArrow(run, f"row struct<{fields}>, error string, inserted long, calls long"), "outcome")
    inserted, calls = done.agg(F.coalesce(F.sum("inserted"), F.lit(0)), F.coalesce(F.sum("calls"), F.lit(0))).first()
    return inserted, calls, done.where("row IS NOT NULL").select("row.*", "error")
