"""Repair of conversations against a search over all cheap edits, in pieces of a few rows, and edge cases."""

import hashlib
import heapq
import random
import re

import pytest
from pyspark.sql import functions as F

from wattfleet.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
TEXTS = ["Hello there.", "no end", "Why?", "", " \t", "Stop!\n", "half a ", "Ünïcode。", "😀.", "\n\n", "done.  "]


def least_edits(rows):
    """Cheapest edits by Dijkstra over (cost, audit), and the rows that remain."""
    follow = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    names = {"u": "user", "a": "assistant"}
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            return cost, audit, list(out)
        if (i, state) in done:
            continue
        done.add((i, state))
        for r, to in follow[state].items():
            if r in names:
                heapq.heappush(heap, (cost + 2, audit + "I", i, to, (*out, (names[r], ""))))
        if i < len(rows):
            role, text, must, cut = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if not must:
                if role[:1] in follow[state]:
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, follow[state][role[:1]], (*out, (role, text))))
                for r, to in follow[state].items():
                    if r in names:
                        heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, to, (*out, (names[r], text))))


def expected(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).digest()))
        seen, told, faults = set(), [], []
        for _, role, text in turns:
            blank = not re.search(r"[^\x20\x09-\x0D]", text)
            again = (role, text) in seen
            seen.add((role, text))
            cut = not blank and text.rstrip(" \t\n\v\f\r")[-1] not in ".!?"
            faults.append("blank" if blank else "duplicate" if again else "truncated" if cut else None)
            told.append((role, text, blank or again, int(faults[-1] == "truncated")))
        cost, audit, left = least_edits(told)
        numbers = [t for t, *_ in turns if t is not None]
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:])), cost, audit,
            "\n".join(f"{r}:{t}" for r, t in left),
        )
    return out


def found(spark, rows, schema=SCHEMA):
    turns, pieces = repair.repair(spark.createDataFrame(rows, schema))
    faults = {}
    for r in turns.groupBy("conversation").agg(repair.gaps("turn").alias("gaps"), F.collect_list(F.struct("fault", "copies")).alias("f")).collect():
        n = {"blank": 0, "duplicate": 0, "truncated": 0}
        for f in r.f:
            if f.fault in ("blank", "duplicate"):
                n[f.fault] += f.copies
            else:
                n["duplicate"] += f.copies - 1
                n["truncated"] += f.fault == "truncated"
        faults[r.conversation] = (r.gaps, *n.values())
    solved = {}
    for r in sorted(pieces.collect(), key=lambda r: (r.part, r.no)):
        illegal, cost, audit = solved.get(r.conversation, (0, 0, ""))
        solved[r.conversation] = (illegal + r.illegal, cost + r.cost, audit + r.audit)
    rows_left = repair.repaired(turns, pieces)
    left = {}
    for r in sorted(rows_left.collect(), key=lambda r: (r.part, r.no, r.step)):
        left.setdefault(r.conversation, []).append(f"{r.role}:{r.text}")
    hashes = {r.conversation: r.sha256 for r in repair.digests(rows_left).collect()}
    texts = {c: "\n".join(lines) for c, lines in left.items()}
    assert hashes == {c: hashlib.sha256(t.encode()).hexdigest() for c, t in texts.items()}
    return {c: (*faults[c], *solved[c], texts.get(c, "")) for c in faults}


def random_rows(rng, conversations, most, roles):
    rows = []
    for c in range(conversations):
        for t in range(rng.randint(1, most)):
            row = (c, t if rng.random() < 0.9 else rng.choice([None, 0, t + 5]), rng.choice(roles), rng.choice(TEXTS) + rng.choice(["", str(t)]))
            rows += [row] * rng.choice([1, 1, 1, 1, 2, 4])
    return rows


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_equals_search(spark, batch):
    rng = random.Random(int(batch))
    rows = random_rows(rng, 120, 9, ["user", "assistant", "user", "assistant", "system", "tool", "", None])
    rows += [(-1, t, rng.choice(["user", "assistant", "system"]), f"row {t}" + rng.choice([".", ""])) for t in range(150)]
    rng.shuffle(rows)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, batch)
    try:
        assert found(spark, rows) == expected(rows)
    finally:
        spark.conf.set(setting, before)


def test_one_conversation_with_most_rows(spark):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant"]), f"t{t % 900}.") for t in range(3000)] + [(8, 0, "user", "a.")]
    got = found(spark, rows)
    assert got == expected(rows) and got[8][5:] == (2, "KI", "user:a.\nassistant:")
    pieces = repair.repair(spark.createDataFrame(rows, SCHEMA))[1]
    assert pieces.where("conversation = 7").select("part").distinct().count() > 4


def test_nulls_ties_copies(spark):
    rows = [(None, None, None, None), (None, 1, "user", "x."), (1, None, "user", "b."), (1, None, "assistant", "a."), (1, 0, "user", "b."),
            (2, 0, "system", "s."), (2, 0, "system", "s."), (3, 0, "assistant", ""), (4, -(2**63), "user", "q"), (4, 2**63 - 1, "assistant", "é.")]
    rows += [(5, 1, "user", "same.")] * 300 + [(5, 2, "assistant", " ")] * 40
    want = expected(rows)
    got = found(spark, rows)
    assert got.pop(4)[0] is None and want.pop(4)[0] > 2**63  # the gap does not fit a long
    assert got == want


def test_long_texts(spark):
    rows = [(1, 0, "user", "word " * 200_000 + "."), (1, 1, "assistant", "x" * 400_000 + " " * 300_000), (1, 2, "user", " " * 500_000)]
    assert found(spark, rows) == expected(rows)


def test_empty_table_and_other_columns(spark):
    schema = SCHEMA + ", conversation string, part int, kind string, digest string, copies int, `a.b` string"
    table = spark.createDataFrame([(1, 0, "user", "a.", "x", 1, "k", "d", 9, "y")], schema)
    turns, pieces = repair.repair(table)
    assert turns.count() == 1 and pieces.first().audit == "KI"
    turns, pieces = repair.repair(table.limit(0))
    assert turns.count() == pieces.count() == repair.repaired(turns, pieces).count() == repair.digests(repair.repaired(turns, pieces)).count() == 0


def test_query_equals_sql(spark, sf_dir):
    from compare import connect, run

    from wattfleet.llm.queries import ORACLES, QUERIES

    rows, _, problem = run(spark, sf_dir, "op11_repair", QUERIES["op11_repair"], ORACLES["op11_repair"], connect(sf_dir))
    assert problem is None and rows > 0
