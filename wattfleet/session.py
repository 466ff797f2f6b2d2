"""Session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Meter clocks carry no zone, so every timestamp is handled as a UTC wall clock.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # The JVM does not compile methods past this size; decoding a register dump into
    # 27 columns is faster as several small methods than as one large one.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def get_session(app_name: str = "wattfleet", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session's executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="wattfleet-")) / "wattfleet.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for tables that several jobs, and all executors, share.

    It lies below ``spark.checkpoint.dir``. Where that is unset, a temporary folder
    serves a session whose tasks all run in this process; any other session raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return f"{root.rstrip('/')}/{name}-{os.urandom(8).hex()}"
    if spark.conf.get("spark.master", "").split("[")[0] == "local":
        return tempfile.mkdtemp(prefix=f"{name}-")
    raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once to a fresh shared folder and read from there.

    Cuts the lineage: a lost executor costs a read of the files, not the work before them.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt evenly to the tasks of a shuffle.

    For work that is much for each row: a file of few bytes is read by one task, however
    long the work on its rows takes.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _folder(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system that Spark reads; none where it is absent."""
    files, target = _folder(spark, path)
    return [f.getPath().getName() for f in files.listStatus(target)] if files.exists(target) else []


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this package has written."""
    files, target = _folder(spark, path)
    files.delete(target, True)
