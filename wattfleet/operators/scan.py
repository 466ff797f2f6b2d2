"""Scans along the order of each key's rows.

Rows are range partitioned and sorted by ``(keys, ts, seq)``, so every task holds a
stretch of the whole order and a key of any size is spread over as many tasks as it
needs; even copies of one row are dealt evenly. In a partition only the first *run* (the
rows of the key it starts with) can continue another partition's rows. Operators finish
all other runs at once, carry a summary of the first and the last run from partition to
partition, and finish the first runs with what was carried to them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattfleet.session import ship_package

#: Number of the partition a row was sorted in.
PART = "_part"


def in_order(df: DataFrame, keys: list[str], ts: str, seq: str) -> DataFrame:
    """Rows by ``(keys, ts, seq)``, rows without a time first; rows equal in all of them by their place in the input.

    The number of partitions is ``spark.sql.shuffle.partitions``. Where the result is used
    more than once it must be stored first: another sampling may draw other bounds.
    """
    spark = df.sparkSession
    ship_package(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    order = [*keys, F.col(ts).asc_nulls_first(), F.col(seq).asc_nulls_first(), "_tie"]
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    return tied.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_tie")


def group_starts(batch: pa.RecordBatch, columns: list[str], previous: tuple | None) -> tuple[np.ndarray, tuple]:
    """Row numbers where a new group starts, and the group of the last row."""
    n = batch.num_rows
    changed = np.zeros(n, dtype=bool)
    for name in columns:
        values = batch.column(name)
        differs = pc.fill_null(pc.not_equal(values.slice(1), values.slice(0, n - 1)), False)
        null = values.is_null().to_numpy(zero_copy_only=False)
        changed[1:] |= differs.to_numpy(zero_copy_only=False) | (null[1:] != null[:-1])
    first = tuple(batch.column(name)[0].as_py() for name in columns)
    changed[0] = first != previous
    return np.flatnonzero(changed), tuple(batch.column(name)[n - 1].as_py() for name in columns)


def with_columns(batch: pa.RecordBatch, **values: pa.Array) -> pa.RecordBatch:
    """A batch with more columns behind its own."""
    return pa.RecordBatch.from_arrays([*batch.columns, *values.values()], [*batch.schema.names, *values])


def same_value(value, n: int, kind: pa.DataType) -> pa.Array:
    return pa.array(np.full(n, value), kind)
