"""Changes of a status from false to true."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattfleet.operators.scan import PART, group_starts, in_order, same_value, with_columns

# What a row stands for: a change, the first row of a partition, the last row of a partition.
_CHANGE, _FIRST, _LAST = range(3)


def _scan(keys: list[str], up: str, before_first: bool):
    """Changes inside a partition, and its two ends. Memory: one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        key, status, end = None, before_first, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            starts, key = group_starts(batch, keys, key)
            now = batch.column(up).fill_null(False).to_numpy(zero_copy_only=False)
            before = np.append(status, now[:-1])
            before[starts] = before_first
            role = np.where(now & ~before, _CHANGE, -1)
            if end is None:
                role[0] = _FIRST
            status, end = now[-1], batch.slice(n - 1)
            rows = batch.filter(pa.array(role >= 0))
            yield with_columns(rows, _role=pa.array(role[role >= 0], pa.int32()), **{PART: same_value(part, rows.num_rows, pa.int64())})
        if end is not None:
            yield with_columns(end, _role=same_value(_LAST, 1, pa.int32()), **{PART: same_value(part, 1, pa.int64())})

    return run


def transitions(
    df: DataFrame, keys: list[str], up: str = "up", ts: str = "ts", seq: str = "seq", initial: bool | None = None
) -> DataFrame:
    """Rows where ``up`` is true and was false in the key's previous row, by ``(ts, seq)``, rows without a time first.

    ``initial`` is the status assumed before the first row; with ``None`` the
    first row is only the baseline. A null status counts as false.

    Each partition of the ordered rows keeps its changes and its first and last row. The
    ends, two rows for a partition, are looked up along their key; changes stay spread out.
    """
    before_first = True if initial is None else initial
    schema = T.StructType([*df.schema, T.StructField("_role", T.IntegerType()), T.StructField(PART, T.LongType())])
    found = in_order(df, keys, ts, seq).mapInArrow(_scan(keys, up, before_first), schema)
    is_end = F.col("_role") != _CHANGE
    status = F.coalesce(F.col(up), F.lit(False))
    along = Window.partitionBy(is_end, *[F.when(is_end, F.col(k)) for k in keys], F.when(~is_end, F.col(PART))).orderBy(PART, "_role")
    before = F.coalesce(F.lag(status).over(along), F.lit(before_first))
    change = (F.col("_role") == _CHANGE) | ((F.col("_role") == _FIRST) & status & ~F.col("_before"))
    return found.withColumn("_before", before).where(change).select(*df.columns)
