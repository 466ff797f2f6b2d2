"""Token ids against the library itself; packing against its rules and brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wattfleet.llm import packing
from wattfleet.llm.tokens import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER, ENCODER = Tokenizer.from_file(PATH), Encoder(PATH)
PARTS = ["the", "The", "they're", "it's", "a.b", "ÉÉ", "é", "İ", "ß", "ŉ", "Σ", "σς", "ΑΣ", "ǅ", "中文", "12½³", "<|endoftext|>",
         "x<|startoftext|>y", "<|", "\x00", "\x1c", "\x85", "\xa0", " ", "ͅ", "́", "\t", "\r\n", " ", "\n", "😀", "'S", "'ll",
         "'", "##", "9", "﻿", "‍", "ﬁ", "K", "Å", "ẞ", "ªº", "­"]


def direct(text):
    return TOKENIZER.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(PARTS), max_size=12).map("".join)))
def test_ids_are_those_of_the_library(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == direct(text)


def test_ids_of_test_documents(spark, sf_dir):
    for row in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect():
        assert np.frombuffer(ENCODER.encode(row.text), "<u4").tolist() == direct(row.text)


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "Two words,  and  spaces\n kept"
    assert np.frombuffer(Encoder(path).encode(text), "<u4").tolist() == Tokenizer.from_file(path).encode(
        text, add_special_tokens=False).ids


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr("wattfleet.llm.tokens.REMEMBERED", 3)
    small, text = Encoder(PATH), "one two three four five one two six seven one"
    assert np.frombuffer(small.encode(text), "<u4").tolist() == direct(text)


def slow_first_fit(lengths, capacity):
    bins, out = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((b for b, used in enumerate(bins) if used + lengths[i] <= capacity), len(bins))
        if b == len(bins):
            bins.append(0)
        out[i] = (b, bins[b])
        bins[b] += lengths[i]
    return [out[i] for i in range(len(lengths))]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 300])
def test_tournament_tree_is_first_fit_decreasing(n):
    rng = random.Random(n)
    lengths = [rng.randint(1, 100) for _ in range(n)]
    assert packing.first_fit_decreasing(lengths, 100) == slow_first_fit(lengths, 100)


def check(docs, rows, capacity):
    """Every id once, pieces of a sequence without gaps, nothing beyond the capacity."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for name, text in docs:
        pieces = sorted(by_doc.pop(name), key=lambda r: r.start)
        ids = b"".join(r.ids for r in pieces)
        assert np.frombuffer(ids, "<u4").tolist() == [*direct(text or ""), 2]
        assert all(r.doc_tokens == len(ids) // 4 and r.length == len(r.ids) // 4 for r in pieces)
        assert [r.start for r in pieces] == np.cumsum([0, *[r.length for r in pieces]])[:-1].tolist()
    assert not by_doc
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0, *[r.length for r in pieces]])[:-1].tolist()
        assert sum(r.length for r in pieces) <= capacity
    return by_sequence


@pytest.mark.parametrize("group_chars", [500, 10_000_000])
def test_pieces(spark, group_chars):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["alpha", "of", "zig-zag", "Ünï"]) for _ in range(rng.choice([0, 3, 30, 400]))))
            for i in range(60)] + [(100, None), (101, ""), (102, " \n"), (103, "the " * 50_000)]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("group", F.lit("x")).withColumn("ids", F.lit(1))
    rows = packing.pack(table, PATH, 2, capacity=256, group_chars=group_chars).collect()
    sequences = check(docs, rows, 256)
    if group_chars > 500:
        tokens = sum(len(r.ids) // 4 for r in rows)
        assert len(sequences) <= 1.01 * -(-tokens // 256) + 1


def test_null_ids_repeated_rows_and_no_rows(spark):
    table = spark.createDataFrame([(None, "a b"), (None, "a b"), (5, None), (5, None)], "doc_id long, text string")
    rows = packing.pack(table, PATH, 2).collect()
    assert sorted((r.doc_id or -1, r.doc_tokens) for r in rows) == [(-1, 3), (-1, 3), (5, 1), (5, 1)]
    assert packing.pack(table.limit(0), PATH, 2).count() == 0


def test_padding(spark):
    got = spark.createDataFrame([(1,), (2,), (3,), (2048,), (4095,), (4096,)], "n long").select(packing.padded_length(F.col("n")))
    assert [r[0] for r in got.collect()] == [1, 2, 4096, 2048, 4096, 4096]


def test_query_digests(spark, sf_dir):
    from wattfleet.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op9_packing"](spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ids = [*direct(texts[r.doc_id]), 2]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
