"""Benchmark decontamination against a search of every window at every place."""

import re

from pyspark.sql import functions as F

from wattfleet.llm import decontaminate as D

SCHEMA = "doc_id long, text string, item string"


def words(text):
    lowered = (text or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def slow(docs, items, size=13):
    out = []
    for name, text in docs:
        w, hit, found = words(text), set(), set()
        for item, text_of in items:
            v = words(text_of)
            for s in range(max(len(v) - size, 0) + 1 if v else 0):
                window = v[s : s + size]
                for p in range(len(w) - len(window) + 1):
                    if w[p : p + len(window)] == window:
                        hit.update(range(p, p + len(window)))
                        found.add(item)
        out.append((name, len(w), len(hit), sorted(map(str, found)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def check(spark, docs, items):
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], SCHEMA)
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id long")
    got = [(r.doc_id, r.n_words, r.n_hit, sorted(r["items"]), r.contaminated) for r in D.contamination(d, b).collect()]
    assert sorted(got, key=str) == slow(docs, items)
    clean = D.keep_clean(d, b)
    assert clean.columns == d.columns
    assert clean.count() == sum(not r[4] for r in slow(docs, items))


def test_places_of_windows(spark):
    item = [f"w{i}" for i in range(30)]
    docs = [
        (1, " ".join(item)), (2, "x " * 300 + " ".join(item[:13])), (3, " ".join(item[:12])), (4, None), (5, ""), (6, "-- ,,"),
        (7, "Short ITEM"), (8, "short, item! short item"), (9, " ".join(item[5:20]) + " y " + " ".join(item[:14])),
        (10, "same " * 40), (11, "é😀 ß"), (None, " ".join(item)), (1, " ".join(item)), (12, "z " * 30_000 + "short item"),
    ]
    items = [(100, " ".join(item)), (101, "short item"), (102, None), (103, ""), (104, "same " * 15), (105, "é😀 ß"), (106, " ".join(item)),
             (20, "short item")]
    check(spark, docs, items)


def test_empty_tables(spark):
    check(spark, [], [(1, "a b c")])
    check(spark, [(1, "a b c")], [])


def test_test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").select("doc_id", "text").limit(60)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").select("item_id", "text").limit(20)
    part = items.limit(3).select((F.col("item_id") + 1_000_000).alias("doc_id"), "text")
    check(spark, [tuple(r) for r in docs.union(part).collect()], [tuple(r) for r in items.collect()])
