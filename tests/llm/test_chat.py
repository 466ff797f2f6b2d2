"""Chat formatting: round trips, the loss mask, and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from wattfleet.llm import chat

PARTS = ["<s>", "</s>", "<turn>", "[INST]", "[/INST]", "\\", "<\\s>", "<\\\\/s>", "[\\INST]", "<", "[", "s>", "/s>", "]", "ok", " ", "\n",
         "é", "😀", "$1", "turn>", "INST]"]
SCHEMA = "conv_id long, turn long, role string, text string"


def back(spark, rows, schema=SCHEMA):
    out = chat.format_chats(spark.createDataFrame(rows, schema)).select(
        "conv_id", "formatted", "loss_spans", chat.turns(F.col("formatted")).alias("turns"),
        chat.loss_texts(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert len({r.conv_id for r in out}) == len(out)
    return {r.conv_id: r for r in out}


def check(rows, found):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    assert set(by) == set(found)
    for name, turns in by.items():
        turns = [t[2:] for t in sorted(turns)]
        r = found[name]
        assert [tuple(t) for t in r.turns] == turns
        assert r.loss == [t for role, t in turns if role == "assistant"]
        blocks = [i for i, t in enumerate(turns) if i == 0 or turns[i - 1][0] != t[0]]
        assert r.formatted.count("<s>") == r.formatted.count("</s>") == r.formatted.count("[INST]") == len(blocks)
        assert r.formatted.count("<turn>") == len(turns) - len(blocks)
        for s in r.loss_spans:
            assert not any(m in r.formatted[s.start : s.end] for m in ("<s>", "</s>", "<turn>", "[INST]", "[/INST]"))


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(4)
    def text():
        return "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 9)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", text()]), text()) for c in range(150) for t in range(rng.randint(1, 9))]
    check(rows, back(spark, rows))


def test_nulls_ties_repeated_rows(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 0, None, None), (1, 1, "user", "b"), (1, 1, "user", "a"),
            (1, 1, "assistant", None), (1, 2, "assistant", ""), (None, 0, "assistant", "alone"), (None, 1, "assistant", "<s>")]
    found = back(spark, rows)
    check(rows, found)
    assert found[None].formatted == "<s>[INST]assistant[/INST]alone<turn><\\s></s>"


def test_long_texts_and_conversations(spark):
    rows = [(1, 0, "user", "x" * 500_000), (1, 1, "assistant", "[INST]" * 60_000), *[(2, i, "assistant", f"t{i}") for i in range(2000)]]
    check(rows, back(spark, rows))


def test_empty_table_and_other_columns(spark):
    table = spark.createDataFrame([(1, 0, "user", "a", "x", 1)], SCHEMA + ", formatted string, turns int")
    assert chat.format_chats(table).columns == ["conv_id", "formatted", "loss_spans"]
    assert chat.format_chats(table).count() == 1 and chat.format_chats(table.limit(0)).count() == 0


def test_no_python_in_the_plan(spark, sf_dir):
    from wattfleet.llm.queries import QUERIES

    plan = QUERIES["op3_chat"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("name", ["op3_chat", "op4_decontaminate"])
def test_query_equals_sql(spark, sf_dir, name):
    from compare import connect, run

    from wattfleet.llm.queries import ORACLES, QUERIES

    rows, _, problem = run(spark, sf_dir, name, QUERIES[name], ORACLES[name], connect(sf_dir))
    assert problem is None and rows > 0
