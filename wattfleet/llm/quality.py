"""Quality filtering by weak supervision.

Rules look at a document and vote good, bad, or abstain. No document has to pass all
of them: expectation-maximisation over the votes of the whole table estimates how
often each rule is right about good and about bad documents, and a document is kept
by the posterior probability that it is good.

Votes are all the model needs, so the table is reduced to the number of documents
per combination of votes: at most 3 ** len(RULES) rows, whatever the table's size.
Expectation-maximisation runs on those exact counts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattfleet.llm.rows import as_rows
from wattfleet.session import stored

WINDOW = 8
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
_LETTERS = re.compile(r"[^\W\d_]")
_ENDS = (".", "!", "?", '"', "”", "…", "。")
#: Common short words of the four languages of the corpus.
FUNCTION_WORDS = frozenset(
    "the be to of and that have with is in it for was on are as this by an "
    "der die und das nicht mit den von zu ist dem im sich auf "
    "le la les des et en un une du que est pour dans par au "
    "el los las de y con por una no se lo como para".encode().split(b" ")
)

FIELDS = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
    "n_function_words", "n_stutters", "n_upper_words", "n_marked_words", "n_ended_lines",
)
STATS = T.StructType([T.StructField(name, T.LongType()) for name in FIELDS])


def _repeated(words: list[bytes]) -> int:
    """Words inside windows of WINDOW words that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    hashes = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        hashes = hashes * np.uint64(0xD6E8FEB86659FD93) + mixed[i : i + n]
    ordered = np.sort(hashes)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0  # no two windows have one hash, so no two are equal
    for step in (1, 2, 4):  # ranks of two, four, then eight words, exact
        pairs = ids[:-step] * np.int64(len(words) + 1) + ids[step:]
        ids = np.unique(pairs, return_inverse=True)[1]
    often = np.bincount(ids)[ids] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(often)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int((np.cumsum(edges) > 0).sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """The counts of STATS for one text; a null text has none of anything."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()
    lines = [line for line in text.split("\n") if line.strip(_SPACES)]
    upper = sum(1 for w in words if len(w) > 1 and w.isupper())
    marked = sum(1 for w in words if not (w[-1:].isalnum() or w[-1] > 127 or w[-1:] in b".,;:!?)\"'") or b"!!" in w)
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        _repeated(words),
        sum(1 for w in words if w.rstrip(b".,").lower() in FUNCTION_WORDS),
        sum(map(bytes.__eq__, words, words[1:])),
        upper,
        marked,
        sum(1 for line in lines if line.rstrip(_SPACES).endswith(_ENDS)),
    )


@F.pandas_udf(STATS)
def stats(texts: pd.Series) -> pd.DataFrame:
    """`text_stats` of a text column, as a struct."""
    return pd.DataFrame([text_stats(t) for t in texts], columns=list(FIELDS), dtype="int64")


@dataclass(frozen=True)
class Rule:
    """Votes good or bad where the conditions hold, and abstains elsewhere; ``bad`` wins over ``good``."""

    name: str
    good: Column
    bad: Column

    def vote(self) -> Column:
        return F.when(self.bad, 0).when(self.good, 1).otherwise(-1)


def rules(stats: str = "stats") -> list[Rule]:
    def c(name: str) -> Column:
        return F.col(f"{stats}.{name}")

    words, lines = c("n_words"), c("n_lines")
    enough = words >= 20
    mean = c("word_chars") / F.greatest(words, F.lit(1))
    return [
        Rule("length", words >= 50, words < 10),
        Rule("word_length", enough & mean.between(3, 10), mean > 14),
        Rule("symbols", 50 * c("n_symbols") <= words, 10 * c("n_symbols") > words),
        Rule("repeated_lines", (lines >= 3) & (c("n_dup_lines") == 0), (lines >= 3) & (3 * c("n_dup_lines") > lines)),
        Rule("repeated_words", enough & (20 * c("n_repeat_words") <= words), 5 * c("n_repeat_words") > words),
        Rule("function_words", 8 * c("n_function_words") >= words, enough & (50 * c("n_function_words") < words)),
        Rule("stutters", enough & (20 * c("n_stutters") <= words), 5 * c("n_stutters") > words),
        Rule("capitals", enough & (20 * c("n_upper_words") <= words), 3 * c("n_upper_words") > words),
        Rule("odd_endings", enough & (20 * c("n_marked_words") <= words), 3 * c("n_marked_words") > words),
        Rule("line_ends", 2 * c("n_ended_lines") >= lines, (words >= 10) & (c("n_ended_lines") == 0)),
    ]


@dataclass(frozen=True)
class Model:
    """The share of good documents, and per rule the chance that its vote is right, given that it votes."""

    prior: float
    right_if_good: tuple[float, ...]
    right_if_bad: tuple[float, ...]

    def log_odds(self, votes: list[Column]) -> Column:
        """Of a document being good, from votes of 1, 0, or -1 for abstaining."""
        total = F.lit(float(np.log(self.prior / (1 - self.prior))))
        for vote, g, b in zip(votes, self.right_if_good, self.right_if_bad, strict=True):
            total = total + F.when(vote == 1, float(np.log(g / (1 - b)))).when(
                vote == 0, float(np.log((1 - g) / b))
            ).otherwise(0.0)
        return total

    def posterior(self, votes: list[Column]) -> Column:
        return 1 / (1 + F.exp(-self.log_odds(votes)))


def fit(votes: np.ndarray, counts: np.ndarray, rounds: int = 200, tolerance: float = 1e-9) -> Model:
    """Expectation-maximisation over combinations of votes and how often each occurs.

    Begins with rules right in 8 of 10 cases and 8 of 10 documents good; pseudo-counts of the same
    kind, one in a thousand of the documents, keep a rule that never votes at its start. Ends when
    no estimate moves by ``tolerance``. No documents give the starting model.
    """
    n_rules = votes.shape[1]
    prior, good, bad = 0.8, np.full(n_rules, 0.8), np.full(n_rules, 0.8)
    weight = max(float(counts.sum()) / 1000, 1e-6)
    yes, no = (votes == 1).astype(float), (votes == 0).astype(float)
    for _ in range(rounds if len(votes) else 0):
        odds = np.log(prior / (1 - prior)) + yes @ np.log(good / (1 - bad)) + no @ np.log((1 - good) / bad)
        p = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        of_good, of_bad = counts * p, counts * (1 - p)
        new_good = (of_good @ yes + 0.8 * weight) / (of_good @ (yes + no) + weight)
        new_bad = (of_bad @ no + 0.8 * weight) / (of_bad @ (yes + no) + weight)
        # A rule stays better than chance on both sides, so the classes cannot change places.
        new_good, new_bad = np.clip(new_good, 0.55, 0.9999), np.clip(new_bad, 0.55, 0.9999)
        new_prior = float(np.clip((of_good.sum() + 0.8 * weight) / (counts.sum() + weight), 0.01, 0.99))
        moved = max(abs(new_prior - prior), np.abs(new_good - good).max(), np.abs(new_bad - bad).max())
        prior, good, bad = new_prior, new_good, new_bad
        if moved < tolerance:
            break
    return Model(prior, tuple(map(float, good)), tuple(map(float, bad)))


def base_failed(stats: str = "stats") -> Column:
    """Fewer than 20 words, or over 30 % of the words in windows that repeat."""
    words = F.col(f"{stats}.n_words")
    return (words < 20) | (100 * F.col(f"{stats}.n_repeat_words") > 30 * words)


def fit_table(measured: DataFrame, stats: str = "stats") -> Model:
    """The model of a table with a column of STATS, from the votes on all its rows."""
    named = [r.vote().alias(f"v{i}") for i, r in enumerate(rules(stats))]
    # One row per combination of votes: at most 3 ** rules, not growing with the table.
    seen = measured.select(*named).groupBy(*[f"v{i}" for i in range(len(named))]).count().toPandas()
    seen = seen.sort_values(list(seen.columns))
    return fit(seen.iloc[:, :-1].to_numpy(np.int64), seen["count"].to_numpy(float))


def judged(measured: DataFrame, model: Model, stats: str = "stats") -> DataFrame:
    """Adds ``base_failed``, ``probability`` and ``kept`` to a table with a column of STATS."""
    probability = model.posterior([r.vote() for r in rules(stats)])
    failed = base_failed(stats)
    return measured.withColumns({
        "base_failed": failed, "probability": probability, "kept": ~failed & (probability >= 0.5),
    })


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, stats)``, one for each row of ``docs``, stored in the shared folder."""
    return stored(docs.select(F.col(id_col), stats(F.col(text_col)).alias("stats")), "stats")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, stats, base_failed, probability, kept)``, one for each row of ``docs``.

    A null text counts as empty and fails the base rule. A null id stays, repeated rows
    stay repeated, other columns play no part. An empty table gives no rows.
    """
    measured = measure(docs, id_col, text_col)
    return judged(measured, fit_table(measured))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that `quality` keeps, with all their columns."""
    measured = as_rows(docs).select("row", stats(F.col("row")[text_col]).alias("stats"))
    measured = stored(measured, "stats")  # the model needs all votes before the first verdict
    return judged(measured, fit_table(measured)).where("kept").select("row.*")
