"""Run every registered query beside its SQL in DuckDB and compare whole results.

Usage: python tests/compare.py [sf_dir] [name ...]
"""

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES.split():
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if str(frame[c].dtype).startswith("datetime"):
            frame[c] = frame[c].astype("datetime64[us]")
        elif pd.api.types.is_float_dtype(frame[c]) or pd.api.types.is_integer_dtype(frame[c]):
            frame[c] = frame[c].astype("float64")
    text = frame.astype(object).where(frame.notna(), None).map(str)
    return text.sort_values(list(text.columns)).reset_index(drop=True)


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    a, b = canonical(spark_frame), canonical(sql_frame)
    if list(a.columns) != list(b.columns):
        return f"columns {list(a.columns)} <> {list(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} <> {len(b)}"
    unequal = (a != b).any(axis=1)
    if unequal.any():
        return f"{int(unequal.sum())} rows differ:\n{a[unequal].head(3).to_string()}\n{b[unequal].head(3).to_string()}"
    return None


def run(spark, sf_dir, name, fn, sql, con):
    start = time.time()
    got = fn(spark, sf_dir).toPandas()
    seconds = time.time() - start
    problem = difference(got, con.execute(sql).df()) if sql else None
    return len(got), seconds, problem


if __name__ == "__main__":
    import __spark_entry__ as entry
    from wattfleet.session import get_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name, fn in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        try:
            rows, seconds, problem = run(spark, sf_dir, name, fn, entry.oracle_sql().get(name), con)
        except Exception as error:  # show every query's outcome
            rows, seconds, problem = 0, 0, f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name:32s} {rows:8d} rows {seconds:6.2f} s {problem or ''}", flush=True)
    spark.stop()
    sys.exit(failed > 0)
