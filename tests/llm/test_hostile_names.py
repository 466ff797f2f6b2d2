"""Operators that give back a table keep all its columns, whatever their names."""

import pytest

from wattfleet.llm import decontaminate, lines, quality, simhash

NAMES = ["_hash", "_id", "id", "text_hash", "row", "a.b", "numbers", "n_lines", "_kept_id", "_rows", "stats", "_stats", "kept", "line", "with `tick`"]
GOOD = " ".join(["The", "people", "of", "this", "town", "have", "been", "here", "for", "a", "long", "time,", "and", "they", "know", "it."] * 3) + "\n"


def table(spark):
    schema = "doc_id long, text string, " + ", ".join("`" + n.replace("`", "``") + "` string" for n in NAMES)
    texts = [f"{GOOD}It was number {i} of the year, said those who had seen {'x' * i} it.\n" for i in range(5)]
    rows = [(i, t, *[f"{n}{i}" for n in NAMES]) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], (None, None, *[None] * len(NAMES))], schema)


def keep_clean(docs):
    items = docs.sparkSession.createDataFrame([(1, "nothing of the kind " * 5)], "item_id long, text string")
    return decontaminate.keep_clean(docs, items)


@pytest.mark.parametrize("operator", [
    simhash.keep_one, quality.keep_good, keep_clean, lambda d: lines.dedup_lines(d, counts=("of lines", "taken out")).drop("of lines", "taken out"),
], ids=["keep_one", "keep_good", "keep_clean", "dedup_lines"])
def test_columns_are_kept(spark, operator):
    docs = table(spark)
    found = operator(docs)
    assert found.columns == docs.columns and found.schema["a.b"].dataType == docs.schema["a.b"].dataType
    before = {tuple(r[2:]) for r in docs.collect()}
    after = [tuple(r[2:]) for r in found.collect()]
    assert set(after) <= before
    assert operator(docs.limit(0)).count() == 0


def test_one_plan_for_repeated_rows(spark):
    docs = table(spark)
    kept = simhash.keep_one(docs, max_distance=0).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [*[(False, i) for i in range(5)], (True, 0)]


def test_a_document_of_many_lines(spark):
    text = "\n".join([f"line number {i} of the log" * 3 for i in range(150_000)] + ["line number 7 of the log" * 3])
    docs = spark.createDataFrame([(1, text), (2, "line number 9 of the log" * 3)], "doc_id long, text string")
    gone = spark.createDataFrame([(1, [150_000])], "doc_id long, numbers array<int>")
    found = docs.join(gone, "doc_id").select(lines._without(docs["text"], gone["numbers"]).alias("t")).first().t
    assert found == text.rpartition("\n")[0]
