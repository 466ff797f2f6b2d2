"""Quality counts against plain loops, the fit on votes of a known process, and what is kept."""

import random
import re

import numpy as np
import pytest

from wattfleet.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    places = {}
    for s in range(len(w) - 7):
        places.setdefault(tuple(w[s : s + 8]), []).append(s)
    covered = {p for found in places.values() if len(found) > 1 for s in found for p in range(s, s + 8)}
    dup = sum(line in lines[:i] for i, line in enumerate(lines))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def texts():
    rng = random.Random(4)
    made = [None, "", " \n\t", "a", "a a a a a a a a a", "x " * 30, "é😀 \x1c \x85 \xa0 b", "l\nl\n\nl\r\nl", "#*$%&|<> <b>"]
    for _ in range(60):
        made.append("".join(rng.choice(["a", "b", "the", " ", " ", "\n", "#", "."]) for _ in range(rng.randrange(400))))
    return made


def test_counts():
    for text in texts():
        got = dict(zip(Q.FIELDS, Q.text_stats(text), strict=True))
        assert tuple(got[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == slow(text), text


def test_a_very_long_text():
    text = "one two three four five six seven eight nine " * 40_000
    assert Q.text_stats(text)[0] == 360_000 and Q.text_stats(text)[5] == 360_000


def test_fit_finds_the_accuracies():
    rng = np.random.default_rng(1)
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.7, 0.9])
    good = rng.random(40_000) < 0.7
    votes = np.where(rng.random((len(good), 6)) < right, good[:, None], ~good[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.3] = -1
    rows, counts = np.unique(votes, axis=0, return_counts=True)
    model = Q.fit(rows, counts.astype(float))
    assert abs(model.prior - 0.7) < 0.03
    assert np.abs(np.array(model.right_if_good) - right).max() < 0.04
    assert np.abs(np.array(model.right_if_bad) - right).max() < 0.04


def test_rows_and_verdicts(spark, sf_dir):
    prose = "The report of the year was read by the members of the board, and they agreed with most of what it said about the town. " * 1
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, prose, "x"), (1, prose, "x"), (1, prose, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = Q.quality(docs.drop("kept")).collect()
    assert len(got) == len(rows)
    for r in got:
        failed = r.stats.n_words < 20 or 100 * r.stats.n_repeat_words > 30 * r.stats.n_words
        assert r.base_failed == failed and 0 <= r.probability <= 1 and r.kept == (not failed and r.probability >= 0.5)
    stay = Q.keep_good(docs)
    assert stay.columns == docs.columns and stay.count() == sum(r.kept for r in got)
    empty = docs.where("false")
    assert Q.quality(empty).count() == 0 and Q.keep_good(empty).count() == 0


def test_combinations_give_the_model_of_single_documents():
    rng = np.random.default_rng(3)
    good = rng.random(3000) < 0.7
    votes = np.where(rng.random((3000, 6)) < 0.2, -1, (rng.random((3000, 6)) < 0.85) == good[:, None]).astype(np.int64)
    combinations, counts = np.unique(votes, axis=0, return_counts=True)
    together = Q.fit(combinations, counts.astype(float))
    single = Q.fit(votes, np.ones(len(votes)))
    assert together.prior == pytest.approx(single.prior, abs=1e-6)
    assert together.right_if_good == pytest.approx(single.right_if_good, abs=1e-6) and together.right_if_bad == pytest.approx(single.right_if_bad, abs=1e-6)
    assert abs(together.prior - 0.7) < 0.05 and all(abs(x - 0.85) < 0.05 for x in together.right_if_good)
