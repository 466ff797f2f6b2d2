"""Rows as one value, so that operators cannot clash with the names of a table's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_rows(docs: DataFrame) -> DataFrame:
    """The table with each row as a struct in the one column ``row``; ``row.*`` gives the columns back."""
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    return docs.select(F.struct(*quoted).alias("row"))
