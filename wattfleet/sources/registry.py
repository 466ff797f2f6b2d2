"""JSON with comments, and device registries written in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattfleet.operators.registry import normalize_registry
from wattfleet.sources.readings import site_of

# A string literal, or a comment. Strings are put back, so comment marks inside them survive.
# The quantifiers give nothing back, which keeps long strings off the matcher's stack.
_STRING_OR_COMMENT = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|//[^\n]*|/\*[\s\S]*?\*/'

LIST_KEYS = ["devices", "meters", "items"]


def strip_comments(text: Column) -> Column:
    """JSON text without comments of either form."""
    return F.regexp_replace(text, _STRING_OR_COMMENT, "$1")


def read_jsonc(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per file: ``file`` and its ``text`` without comments."""
    df = spark.read.text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("file"), strip_comments(F.col("value")).alias("text"))


def parse_registry(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per device: ``pos`` in its list, ``fields``, a map of its entries, and ``kinds``, the types of their values.

    The text is a list, or an object whose first list among ``devices``, ``meters`` and
    ``items`` counts. Items that are not objects are dropped; another shape has no devices.
    What a value is comes from its VARIANT form, so a string is never taken for an object
    or a list. An object with repeated keys has no such form and is told by its text.
    """
    others = [c for c in df.columns if c != text]
    # A column of its own, so that it is made once and not in each expression below.
    df = df.select(*others, F.trim(F.regexp_replace(F.col(text), r"^\s+", "")).alias(text))
    body = F.col(text)
    wrapped, typed = (F.from_json(body, ", ".join(f"{k} {kind}" for k in LIST_KEYS)) for kind in ("string", "variant"))
    lists = [F.when(body.startswith("["), body)]
    lists += [F.when(F.schema_of_variant(typed[k]).startswith("ARRAY"), wrapped[k]) for k in LIST_KEYS]
    listed = df.select(*others, F.coalesce(*lists).alias("_list"))
    items = F.from_json("_list", "array<string>")
    kinds = F.transform(F.from_json("_list", "array<variant>"), F.schema_of_variant)
    told = F.arrays_zip(items.alias("item"), F.coalesce(kinds, F.array().cast("array<string>")).alias("kind"))
    kept = F.filter(told, lambda x: x["item"].isNotNull() & F.coalesce(x["kind"].startswith("OBJECT"), x["item"].startswith("{")))
    return listed.select(*others, F.posexplode(kept).alias("pos", "_item")).select(
        *others, "pos", F.from_json("_item.item", "map<string,string>").alias("fields"),
        F.transform_values(F.from_json("_item.item", "map<string,variant>"), lambda _, v: F.schema_of_variant(v)).alias("kinds"),
    )


def read_registry(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Normalised devices of all registry files, with ``site`` from the file name."""
    parsed = parse_registry(read_jsonc(spark, path).withColumn("site", site_of("file")))
    return normalize_registry(parsed)
