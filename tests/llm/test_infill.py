"""Fill-in-the-middle: ranks and cuts against plain counts, exact round trips, edge cases."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattfleet.llm import infill

PATTERNS = {"token": r"[A-Za-z]+|[^A-Za-z]", "line": r"[^\n]*\n|[^\n]+", "character": r"(?s:.)"}
PARTS = ["abc", "Zq", " ", "\n", "é", "😀", "<", "P>", "<S", "7", "K", "[`", "{@", "\r", " ", "ſ", "\x00"]


def test_ranks():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        codes = rng.integers(0, 6, n).astype(np.uint8)
        matrix, at = infill.WaveletMatrix(codes), np.arange(n + 1)
        for code in range(8):
            assert matrix.rank(code, at).tolist() == [int((codes[:p] == code).sum()) for p in at]


@pytest.mark.parametrize("unit", list(PATTERNS))
def test_cuts(unit):
    rng = random.Random(2)
    texts = ["", *["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(200)]]
    split = [re.findall(PATTERNS[unit], t) for t in texts]
    units = infill.Units(texts, unit)
    assert units.n.tolist() == [len(s) for s in split] and ["".join(s) for s in split] == texts
    for share in (0, 0.3, 0.5, 1):
        wanted = np.array([int(share * len(s)) for s in split])
        assert units.cut(wanted).tolist() == [len("".join(s[:k])) for s, k in zip(split, wanted.tolist())]


def rows(spark, table, schema="doc_id long, text string", **options):
    made = infill.fill_in_middle(spark.createDataFrame(table, schema), **options)
    return made.withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect()


@pytest.mark.parametrize("unit", list(PATTERNS))
def test_round_trip(spark, unit):
    rng = random.Random(3)
    table = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40)))) for i in range(800)]
    table += [(1000 + i, t) for i, t in enumerate(["<P>", "a<S>b", "x<M>", "<P", "a>", "<"])]
    got = {r.doc_id: r for r in rows(spark, table, unit=unit)}
    assert {i: r.back for i, r in got.items()} == dict(table)
    for i, text in table:
        r = got[i]
        if r.form == "plain":
            assert r.output == text and r.prefix_chars is r.middle_chars is None
            continue
        assert text and not re.search("<[PSM]>", text)
        p, m, s = text[: r.prefix_chars], text[r.prefix_chars : r.prefix_chars + r.middle_chars], text[r.prefix_chars + r.middle_chars :]
        assert r.output == (f"<P>{p}<S>{s}<M>{m}" if r.form == "psm" else f"<S>{s}<P>{p}<M>{m}")
    forms = [r.form for r in got.values()]
    assert forms.count("psm") > forms.count("spm") > 50 and forms.count("plain") > 50


def test_long_texts_and_chunks(spark, monkeypatch):
    table = [(1, "a b\n" * 1_000_000), (2, "x" * 3_000_000), (3, "<" * 500_000), (4, "end")]
    got = {r.doc_id: r for r in rows(spark, table, plain_percent=0)}
    assert {i: r.back for i, r in got.items()} == dict(table)
    assert [got[i].n for i in (1, 2, 3, 4)] == [4_000_000, 1, 500_000, 1]


def test_nulls_repeated_rows_empty_table_other_columns(spark):
    table = [(None, "a b c d", 1, "x"), (None, None, 2, "y"), (5, None, 3, "z"), (5, "q r s", 4, "w"), (5, "q r s", 4, "w")]
    schema = "doc_id long, text string, h0 long, `a.b` string"
    got = rows(spark, table, schema)
    assert len(got) == 5 and sorted(r.back for r in got) == ["", "", "a b c d", "q r s", "q r s"]
    assert all(r.form == "plain" and r.n == 0 for r in got if r.back == "")
    assert len({(r.form, r.output) for r in got if r.doc_id == 5 and r.back}) == 1
    empty = infill.fill_in_middle(spark.createDataFrame(table, schema).limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def test_query_equals_sql(spark, sf_dir):
    from compare import connect, run

    from wattfleet.llm.queries import ORACLES, QUERIES

    rows, _, problem = run(spark, sf_dir, "op12_infill", QUERIES["op12_infill"], ORACLES["op12_infill"], connect(sf_dir))
    assert problem is None and rows > 0
