"""License scan: base phrases against plain loops, suppression, and edge cases."""

import re

from wattfleet.llm import licenses as L

BASE = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}


def slow(text):
    lowered = (text or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}))
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = [(i, label) for label, p in BASE.items() for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), sorted(i for i, _ in places), sorted({label for _, label in places})


def scan(spark, texts):
    rows = [(i, t, 1) for i, t in enumerate(texts)]
    return {r.doc_id: r for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string, places int")).collect()}


def test_base_phrases(spark, sf_dir):
    docs = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts = docs + [
        None, "", "MIT License", "mit license mit license mit mit license", "under the Apache-License, and the MIT\nlicense",
        "GNU General Public License version 3", "general public", "mitlicense", "mit licenseé", "mit license " * 20_000,
    ]
    got = scan(spark, texts)
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        r = got[i]
        assert (r.n_words, list(r.places), list(r.base_labels)) == slow(text)
        assert set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_longer_detections_cover_shorter_ones(spark):
    got = scan(spark, ["licensed under the Apache License, Version 2.0", "all about gardens and the weather"])
    spans = [(d.first, d.last) for d in got[0].detections]
    assert got[0].labels and got[1].labels == [] and got[1].score == 0
    assert not any(a != b and a[0] <= b[0] and b[1] <= a[1] for a in spans for b in spans)


def test_null_ids_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "mit license"), (1, "mit license"), (1, "mit license"), (1, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), list(r.places)) for r in L.scan(docs).collect())
    assert got == [("1", []), ("1", [0]), ("1", [0]), ("None", [0])]
    assert L.scan(docs.where("false")).count() == 0
