"""Personal data against plain regular expressions, and the bootstrap on planted contexts."""

import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from wattfleet.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed([int(x) for x in digits])):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def slow(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if valid(k, m[0])] for k, p in PLAIN.items()}


def check(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.personal_data(docs).collect():
        expected = slow(texts[r.doc_id])
        assert {k: [tuple(s) for s in r[k]] for k in pii.KINDS} == expected, texts[r.doc_id][:200]


def test_known_kinds_on_hostile_texts(spark):
    rng = random.Random(5)
    parts = ["a", "b@c", "@", ".", "x.y", "1", "22", "255", "256", "4111 1111 1111 1111", "5500-0000-0000-0004", "+", "(", ")", "-", " ",
             "é", "😀", "%", "_", "\n", "0", "+1 (555) 555-0199", "10.0.0.1", "9" * 13, "a@b.c"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(600)]
    check(spark, [*texts, None, "", "\t"])


def test_long_runs_take_linear_time(spark):
    none = {k: [] for k in pii.KINDS}
    # The plain patterns take the square of these lengths, so what they would find is written down.
    texts = [
        ("a" * 400_000 + "@", none), ("1" * 400_000, none), ("1 " * 40_000, none), ("1 " * 160_000, none), ("+1" + "-" * 200_000, none),
        ("a@b" + ".c" * 50_000, none | {"email": [(0, 100_003)]}),
        ("1.2.3." * 20_000 + "4", none | {"ip": [(8 * i, 8 * i + 7) for i in range(15_000)]}),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string").repartition(8)
    start = time.time()
    got = {r.doc_id: {k: [tuple(s) for s in r[k]] for k in pii.KINDS} for r in pii.personal_data(docs).collect()}
    assert got == {i: expected for i, (_, expected) in enumerate(texts)}
    assert time.time() - start < 120


def test_context_finds_tokens_no_rule_knows(spark):
    texts = [f"contact code a{i}b@mail.example.com now" for i in range(6)]
    texts += [f"my key user=x{i}@mail.example.com then user=zz9{i} and qq{i}" for i in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: {texts[r.doc_id][s.start : s.end] for s in r.found} for r in pii.personal_data(docs, support=3).collect()}
    assert all(f"user=zz9{i}" in found[6 + i] for i in range(8))
    assert not any("qq" in x for i in range(8) for x in found[6 + i])


def test_nulls_repeated_rows_other_columns(spark):
    rows = [(None, "m a@b.cd", "x"), (1, "10.0.0.1", "y"), (1, "10.0.0.1", "y"), (1, "10.0.0.1 and 10.0.0.2", "z"), (2, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, email string").withColumn("tokens", F.lit(1))
    got = pii.personal_data(docs)
    assert got.columns == ["doc_id", "email", "ip", "card", "phone", "found"]
    assert sorted((r.doc_id or 0, len(r.email), len(r.ip)) for r in got.collect()) == [(0, 1, 0), (1, 0, 1), (1, 0, 1), (1, 0, 2), (2, 0, 0)]
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_query_digests(spark, sf_dir):
    from wattfleet.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op8_personal_data"](spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        expected = slow(texts[r.doc_id])
        told = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in expected[k])
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert r.spans == told or r.spans.startswith(told + "," if told else "id:")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(expected[k]) for k in pii.KINDS]
