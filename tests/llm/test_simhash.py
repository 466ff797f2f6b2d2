"""SimHash against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wattfleet.llm import simhash

UNSIGNED = (1 << 64) - 1


def slow_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    if not words:
        return 0
    shingles = [words[i:i + 3] for i in range(len(words) - 2)] or [words]
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, distance):
    """The smallest index reachable over pairs within the distance."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(values):
        for j, b in enumerate(values[:i]):
            if bin((a ^ b) & UNSIGNED).count("1") <= distance:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_links_give_the_components_of_all_pairs(spark, distance):
    rng = random.Random(distance)
    values = {0, UNSIGNED, 1 << 63}
    for _ in range(40):
        v = rng.getrandbits(64)
        for _ in range(12):
            values.add(v)
            block = rng.choice([0, 16, 32, 48])
            spread = [block + i for i in range(16)] if rng.random() < 0.5 else range(64)
            v ^= sum(1 << b for b in rng.sample(list(spread), rng.randint(1, 4)))
    values = sorted(values)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), "fp", distance).collect()
    for a, b in links:
        assert 0 < bin((a ^ b) & UNSIGNED).count("1") <= distance
    place = {v: i for i, v in enumerate(signed)}
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((find(place[a]), find(place[b])))
        root[y] = x
    assert [find(i) for i in range(len(values))] == components(values, distance)


def texts():
    rng = random.Random(3)
    vocabulary = ["w%d" % i for i in range(300)] + ["É", "straße", "İ"]
    out = []
    for _ in range(30):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 40, 400]))]
        out.append(" ".join(words))
        for _ in range(3):
            words = list(words)
            if words:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append("\n".join(words).upper())
    return [None, "", " \t\n", "A B C", "a b c", *out, "x " * 100_000]


def test_documents_against_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    prints = [slow_fingerprint(t) for _, t in rows]
    expected = components(prints, 3)
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.fingerprint & UNSIGNED for r in found} == dict(enumerate(prints))
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(expected))


def test_null_ids_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "a b c d", "x"), (1, "a b c d", "y"), (1, "a b c d", "x"), (None, "a b c d", None),
            (2, "quite another text of words", "z"), (None, "nobody else has this line here", "n"),
            (None, None, "e"), (7, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("root", F.lit(0))
    found = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in found) == [
        (-1, -1), (-1, 1), (-1, 7), (1, 1), (1, 1), (1, 1), (2, 2), (7, 7)]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text, r.fp) for r in kept.collect()) == [
        (-1, "nobody else has this line here", "n"), (1, "a b c d", "x"), (2, "quite another text of words", "z"),
        (7, "", None)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0 and simhash.keep_one(docs).count() == 0


def test_one_hub_with_many_neighbours_is_one_component(spark):
    centre = 0x0123456789ABCDEF
    near = sorted({centre ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(64)})
    signed = np.array(near, np.uint64).view(np.int64).tolist()
    from wattfleet.llm.components import connected_components

    labels = connected_components(simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long")))
    assert labels.count() == len(near) and labels.select("component").distinct().count() == 1
