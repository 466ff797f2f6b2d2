"""Reading cycles: running number, every n-th cycle, counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattfleet.operators.scan import PART, group_starts, in_order, same_value, with_columns
from wattfleet.session import stored

# What a row stands for: a row of the table, the size of a partition's first run, that of its last if another.
_ROW, _FIRST, _LAST = range(3)


def _number(keys: list[str]):
    """Numbers rows within their run and tells the sizes of the outer runs. Memory: one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        key, count, runs, first, end = None, 0, 0, None, None

        def told(rows: pa.RecordBatch, role: int, number: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
            n = rows.num_rows
            return with_columns(
                rows, cycle=pa.array(number, pa.int64()), _role=same_value(role, n, pa.int32()), _first=pa.array(first, pa.bool_()),
                **{PART: same_value(part, n, pa.int64())},
            )

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            starts, key = group_starts(batch, keys, key)
            at = np.arange(n)
            new = np.zeros(n, np.int64)
            new[starts] = 1
            since = np.maximum.accumulate(np.where(new > 0, at, -1))
            number = np.where(since >= 0, at - since, at + count) + 1
            run_of = runs + np.cumsum(new)
            yield told(batch, _ROW, number, run_of == 1)
            if first is None and runs <= 1 and run_of[-1] > 1:
                head = int(np.argmax(run_of > 1))
                size = number[head - 1] if head else count
                first = told(batch.slice(head - 1, 1) if head else end, _FIRST, np.array([size]), np.array([True]))
                yield first
            count, runs, end = int(number[-1]), int(run_of[-1]), batch.slice(n - 1)
        if end is not None:
            yield told(end, _FIRST if runs == 1 else _LAST, np.array([count]), np.array([runs == 1]))

    return run


def number_cycles(df: DataFrame, keys: list[str], ts: str = "Time", seq: str = "seq") -> DataFrame:
    """Add ``cycle``: the running number of a row within its key, by ``(ts, seq)``, rows without a time first.

    Rows are numbered inside their partition of the ordered rows and stored; the sizes of a
    key's earlier pieces, one for a partition at most, are added to those of first runs.
    """
    df = df.drop("cycle")
    more = {"cycle": T.LongType(), "_role": T.IntegerType(), "_first": T.BooleanType(), PART: T.LongType()}
    schema = T.StructType([*df.schema, *[T.StructField(name, kind) for name, kind in more.items()]])
    found = stored(in_order(df, keys, ts, seq).mapInArrow(_number(keys), schema), "cycles")
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    sizes = found.where(F.col("_role") != _ROW)
    offsets = (
        sizes.withColumn("_offset", F.sum("cycle").over(earlier))
        .where((F.col("_role") == _FIRST) & F.col("_offset").isNotNull())
        .select(F.col(PART).alias("_of"), "_offset")
    )
    # One row for a partition at most, whatever the size of the table.
    rows = found.where(F.col("_role") == _ROW)
    joined = rows.join(F.broadcast(offsets), F.col("_first") & (F.col(PART) == F.col("_of")), "left")
    return joined.withColumn("cycle", F.col("cycle") + F.coalesce("_offset", F.lit(0))).select(*df.columns, "cycle")


def cycle_every(df: DataFrame, n: int, keys: list[str], ts: str = "Time", seq: str = "seq") -> DataFrame:
    """Rows of every n-th cycle of their key."""
    return number_cycles(df, keys, ts, seq).where(F.col("cycle") % n == 0)


def cycle_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Total cycles per key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("cycles"))
