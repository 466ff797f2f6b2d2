"""Removal of repeated passages against brute force over all windows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from wattfleet.llm import substrings as S


def slow(rows, window=13):
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in texts:
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            value = float("inf") if i is None else i
            least[key] = min(least.get(key, value), value)
    out = []
    for i, w in texts:
        gone = set()
        for s in range(len(w) - window + 1):
            if least[tuple(w[s : s + window])] < (float("inf") if i is None else i):
                gone.update(range(s, s + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


def found(spark, rows, window=13):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in S.remove_repeats(docs, window=window).collect()), key=str)


@pytest.mark.parametrize("window", [2, 5, 13])
def test_random_documents(spark, window):
    rng = random.Random(window)
    passages = [[rng.choice("abcdefgh") for _ in range(rng.randint(1, 40))] for _ in range(12)]
    rows = []
    for i in range(80):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(passages) if rng.random() < 0.5 else [rng.choice("abcdefgh") for _ in range(rng.randint(1, 25))]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words)))
    rng.shuffle(rows)
    assert found(spark, rows, window) == slow(rows, window)


def test_edge_cases(spark):
    line = " ".join(f"w{i}" for i in range(30))
    rows = [(1, None), (2, ""), (3, line), (3, line), (None, line), (None, line), (4, "x " + line + " y"), (5, " ".join(line.split()[:12])),
            (6, "z " * 3000), (7, "z " * 40), (8, "é😀 " * 20), (9, line + "\n" + line)]
    assert found(spark, rows) == slow(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("start", F.lit(1))
    assert S.remove_repeats(docs).columns == ["doc_id", "n_words", "n_removed", "kept"]
    assert S.remove_repeats(docs.limit(0)).count() == 0


def test_long_texts_are_cut_and_joined(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"{rng.randrange(10**6)}" for _ in range(450_000)]
    rows = [(1, " ".join(words)), (2, "a b c " + " ".join(words[199_990:200_020]) + " d " + " ".join(words[440_000:]))]
    got, expected = found(spark, rows), slow(rows)
    assert [r[:3] for r in got] == [r[:3] for r in expected] and got == expected


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(S.Hasher, "__call__", lambda self, a, b: np.zeros(len(a), np.uint64))
    text = b"a b c\na b d\na b c\nx y"
    line, number = S.repeated_windows(text, np.array([1, 2, 3, 4]), 2)
    assert sorted(zip(line.tolist(), number.tolist(), strict=True)) == [(1, 0), (2, 0), (2, 1)]


def test_blocks_hold_a_bounded_stretch_of_text(monkeypatch):
    monkeypatch.setattr(S, "_BATCH", 10_000)
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(400)) for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(range(60)), pa.array(texts)], ["id", "text_hash", "text"])
    blocks = list(S._cut(13, 1)(iter([batch])))
    assert len(blocks) > 10 and max(b.column(1)[0].as_py() for b in blocks) < 2000
    windows = sum(len(t) - 12 for text in (zstandard.decompress(b.column(3)[0].as_py()) for b in blocks) for t in map(bytes.split, text.split(b"\n")))
    assert windows == 60 * (400 - 12)


def test_word_hashes_do_not_depend_on_their_stretch(monkeypatch):
    text = b" ".join(b"x" * (i % 40 + 1) + b"%d" % (i % 7) for i in range(500)) + b"\n" + b"y" * 9000
    start, end, _ = S._words(text)
    whole = S._word_hashes(text, start, end)
    monkeypatch.setattr(S, "_HASHED", 64)
    assert (S._word_hashes(text, start, end) == whole).all()
    words = [text[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    assert len(set(whole.tolist())) == len(set(words))


def test_query_over_test_documents(spark, sf_dir):
    from wattfleet.llm.queries import QUERIES

    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op10_substrings"](spark, sf_dir).collect()}
    assert got == {i: (n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in slow(docs)}
