"""Token files: exact round trips, random access, and the grammar itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wattfleet.llm import token_files as T
from wattfleet.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def shard_of(ids, frequent):
    return T.Shard.read(T.write_shard([1], [np.array(ids, "<u4").tobytes()], frequent))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=300), st.integers(2, 5))
def test_round_trip_and_random_access(ids, frequent):
    shard = shard_of(ids, frequent)
    assert shard.ids().tolist() == ids and shard.n_ids == len(ids)
    for a, b in ((0, len(ids)), (1, 2), (len(ids) // 2, len(ids)), (5, 3), (-4, 10**6)):
        assert shard.slice(a, b).tolist() == ids[max(a, 0) : max(b, 0)]


def test_frequent_pairs_are_replaced_until_none_is_left():
    rng = random.Random(1)
    words = [[rng.randrange(50) for _ in range(rng.randint(2, 6))] for _ in range(20)]
    ids = [x for _ in range(4000) for x in rng.choice(words)]
    shard = shard_of(ids, 40)
    assert shard.ids().tolist() == ids and len(shard.sequence) < 0.5 * len(ids)
    assert all(len(shard._expand(np.array([shard.first + i]))) == n for i, n in enumerate(shard.lengths))
    for _ in range(200):
        a = rng.randrange(len(ids))
        b = a + rng.randrange(300)
        assert shard.slice(a, b).tolist() == ids[a:b]
    assert len(shard_of([7] * 10_000, 4).sequence) < 20


def expected(rows):
    out, at = [], 0
    for name, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((name, at, len(ids), np.array(ids, "<u4").tobytes()))
        at += len(ids)
    return out


@pytest.mark.parametrize("shard_ids", [1, 50, 1 << 20])
def test_files(spark, tmp_path, shard_ids):
    rng = random.Random(shard_ids)
    rows = [(i, " ".join(rng.choice(["alpha", "of", "Ünï-zig"]) for _ in range(rng.choice([0, 3, 60])))) for i in range(-20, 60)]
    rows += [(None, "no id"), (100, None), (101, ""), (101, "again"), (101, "again"), (200, "long " * 30_000)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("x")).withColumn("ids", F.lit(1))
    path = T.write_tokens(docs, PATH, 2, str(tmp_path / "t"), shard_ids=shard_ids, frequent=8)
    got = sorted((tuple(r) for r in T.read_tokens(spark, path).collect()), key=lambda r: r[1])
    assert [(a, b, c, bytes(d)) for a, b, c, d in got] == expected(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert T.read_tokens(spark, T.write_tokens(docs, PATH, 2)).count() == 0


def test_the_grammar_pays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    files = spark.read.parquet(T.write_tokens(docs, PATH, 2, shard_ids=1 << 20))
    ids, size = files.agg(F.sum("n_ids"), F.sum(F.length("shard"))).first()
    assert ids > 500_000 and size < 0.7 * 4 * ids


def test_plain_pattern_equals_the_full_one():
    encoder = T.encoder(PATH)
    rng = random.Random(3)
    letters = [chr(c) for c in range(0x21, 0x220) if not chr(c).isspace()]
    for _ in range(5000):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(0, 8)))
        ids = np.array(TOKENIZER.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        assert encoder.encode(word) == ids
        if not word.lower() or max(word.lower()) < "\u0220":
            assert encoder.plain.findall(word.lower()) == encoder.pattern.findall(word.lower())


def test_query_digests(spark, sf_dir):
    from wattfleet.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op5_token_files"](spark, sf_dir).collect()), key=lambda r: r[1])
    assert got == [(a, b, c, zlib.crc32(d)) for a, b, c, d in expected(rows)]


@pytest.mark.parametrize("top", [3, 1 << 16, 1 << 31])
def test_pairs_are_grouped_in_one_sort(top):
    rng = np.random.default_rng(top)
    values = rng.integers(0, top, 12)
    left, right = values[rng.integers(0, 12, 500)], values[rng.integers(0, 12, 500)]
    pairs, counts, order = T._grouped(left, right, top)
    codes = (left << 32) | right
    expected, n = np.unique(codes, return_counts=True)
    assert (pairs == expected).all() and (counts == n).all()
    assert (order == np.argsort(codes, kind="stable")).all()
    assert [len(x) for x in T._grouped(left[:0], right[:0], top)] == [0, 0, 0]


def test_a_forgotten_word_is_encoded_again(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, text = tokens.Encoder(path), "one two\nthree, four one two #five-6 seven é x\t "
    assert encoder.encode(text) == np.array(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert len(encoder.words) <= 3 and encoder.encode("two one") == tokens.Encoder(path).encode("two one")


def test_texts_of_a_batch_are_encoded_together(monkeypatch):
    words = ["meter", "Meter,", "don't", "é", "ﬀ", "ſ", "Ɓ", "İ", "中文", "é", "<|endoftext|>", "a\tb", "", "\n", "\x00", "99.5", "kWh​"]
    rng = random.Random(5)
    texts = ["", " ", "\n\n", *(rng.choice([" ", "\n", "  "]).join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(300))]
    expected = [np.array([*TOKENIZER.encode(t, add_special_tokens=False).ids, 7], "<u4").tobytes() for t in texts]
    for remembered, stretch in ((400_000, 1 << 22), (5, 40), (2, 1)):
        monkeypatch.setattr(tokens, "REMEMBERED", remembered)
        monkeypatch.setattr(tokens, "STRETCH", stretch)
        encoder = tokens.Encoder(PATH)
        for kind in (pa.string(), pa.large_string()):
            assert list(encoder.encode_all(pa.array(texts, kind), 7)) == expected
            assert list(encoder.encode_all(pa.array(texts, kind).slice(100, 50), 7)) == expected[100:150]
        assert list(encoder.encode_all(pa.array([], pa.string()), 7)) == []


def test_the_library_gets_each_distinct_piece_once():
    encoder = tokens.Encoder(PATH)
    asked, make = [], encoder.pieces.make
    encoder.pieces.make = lambda pieces: (asked.extend(pieces), make(pieces))[1]
    texts = pa.array([f"load load, Load; (LOAD) {i % 7}" for i in range(500)])
    for _ in range(2):
        assert len(list(encoder.encode_all(texts, 2))) == 500
    assert sorted(asked) == sorted({"load", ",", ";", "(", ")", *"0123456"})


def test_a_worker_keeps_few_words():
    letters = "abcdefghijklmnop"
    words = ["".join(letters[i >> 4 * k & 15] for k in range(5)) for i in range(300_000)]
    encoder = tokens.Encoder(PATH)
    texts = [" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
    assert len(list(encoder.encode_all(pa.array(texts), 2))) == 300
    assert len(encoder.words) <= 200_000 and len(encoder.pieces) <= 200_000
    assert encoder.encode(texts[7]) == np.array(TOKENIZER.encode(texts[7], add_special_tokens=False).ids, "<u4").tobytes()


def test_a_grammar_counts_few_pairs_twice(monkeypatch):
    rng = np.random.default_rng(8)
    words = [rng.integers(0, 3000, rng.integers(2, 7)) for _ in range(4000)]
    ids = np.concatenate([words[min(int(i), 3999)] for i in rng.zipf(1.2, 30_000)])
    counted, grouped = [], T._grouped
    monkeypatch.setattr(T, "_grouped", lambda left, right, n: (counted.append(len(left)), grouped(left, right, n))[1])
    rules, lengths, seq = T.re_pair(ids, 3000, 4)
    assert sum(counted) < 3 * len(ids)
    _, counts, _ = grouped(seq[:-1], seq[1:], 3000 + len(rules))
    assert counts.max() < 2 * 4  # a pair left beside itself only counts twice what can be replaced
    shard = shard_of(ids, 4)
    assert (shard.ids() == ids).all() and len(shard.sequence) == len(seq) and shard.lengths.tolist() == lengths.tolist()


@pytest.mark.parametrize("frequent", [2, 4])
def test_runs_and_short_sequences(frequent):
    for ids in ([], [5], [5, 5], [0] * 9, [0] * 1000, [0, 1] * 500, [0, 0, 1] * 300, [1, 0, 0, 0, 0] * 40 + [1], [3, 1, 3, 1, 3]):
        shard = shard_of(ids, frequent)
        assert shard.ids().tolist() == ids == shard._expand(shard.sequence).tolist()
        assert len(shard.sequence) <= max(12, len(ids) // 20) if len(ids) > 100 else True


def test_ids_expand_each_rule_once(monkeypatch):
    shard = shard_of([1, 2, 3, 4, 5, 6, 7] * 500 + list(range(8, 5000)), 4)
    asked, expand = [], T.Shard._expand
    monkeypatch.setattr(T.Shard, "_expand", lambda self, symbols: (asked.extend(symbols.tolist()), expand(self, symbols))[1])
    assert shard.ids().tolist() == [1, 2, 3, 4, 5, 6, 7] * 500 + list(range(8, 5000))
    assert len(asked) == len(set(asked)) <= len(shard.rules)


class Hashed(str):
    """A string that counts its hashes."""

    hashes = 0

    def __hash__(self):
        Hashed.hashes += 1
        return super().__hash__()


def test_a_new_word_is_looked_up_once():
    known = tokens._Known(lambda words: (np.arange(len(words), dtype=np.uint32), np.ones(len(words), np.int64)))
    Hashed.hashes = 0
    place, ids, starts, sizes = known.find([Hashed(f"w{i}") for i in range(100)])
    assert Hashed.hashes <= 200 and place.tolist() == list(range(1, 101)) and ids.tolist() == list(range(100))
    place, *_ = known.find(["w7", "new", "w8", "new"])
    assert place.tolist() == [8, 101, 9, 101]


def test_words_that_failed_are_not_known():
    def make(words):
        if "bad" in words:
            raise ValueError("bad")
        return np.arange(len(words), dtype=np.uint32), np.ones(len(words), np.int64)

    known = tokens._Known(make)
    known.find(["a"])
    with pytest.raises(ValueError):
        known.find(["b", "bad", "b"])
    place, ids, starts, sizes = known.find(["c", "a", "b"])
    assert place.tolist() == [2, 1, 3] and len(known) == len(sizes) == 4
