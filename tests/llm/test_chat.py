"""Formatted conversations: SQL, round trips of hostile texts, turn order, edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from lexweave.llm.chat import BRACKETS, Template, Turn, formatted, read_back, segments, under_loss

SCHEMA = "conv_id long, turn long, role string, text string"


def test_query(spark, same_as_sql):
    assert same_as_sql(spark, "op3_chat_formatting", "/root/testdata/sf0.01") == 101
    assert same_as_sql(spark, "op3_chat_formatting", "/root/testdata/sf0.001") > 1


def test_query_marks_conversations_out_of_order(spark, same_as_sql, tmp_path):
    from lexweave.plans.registry import TABLES

    sf = "/root/testdata/sf0.001"
    for t in TABLES:
        if t != "conversations":
            (tmp_path / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
    talks = {1: "system user assistant", 2: "user assistant", 3: "user", 4: "assistant user", 5: "user user assistant", 6: "system assistant", 7: "user assistant tool assistant", 8: "user assistant"}
    rows = [(c, t if c < 8 else None, role, f"x{t}") for c, roles in talks.items() for t, role in enumerate(roles.split())]
    rows += [(9, 0, None, "x"), (9, 1, "user", None)]
    spark.createDataFrame(rows, SCHEMA).toPandas().astype({"turn": "Int64"}).to_parquet(f"{tmp_path}/conversations.parquet")
    assert same_as_sql(spark, "op3_chat_formatting", str(tmp_path)) == 10
    from lexweave.llm.queries import op3_chat_formatting

    got = {r.conv_id: (r.valid, r.first_bad) for r in op3_chat_formatting(spark, str(tmp_path)).collect()}
    assert got == {-1: (True, None), 1: (True, None), 2: (True, None), 3: (False, None), 4: (False, 0), 5: (False, 1), 6: (False, 1), 7: (False, 2), 8: (False, 0), 9: (False, 0)}


def back(df, template=BRACKETS):
    return {
        r.conv_id: r
        for r in df.select(
            "*", read_back(F.col("formatted"), template).alias("turns"), under_loss(F.col("formatted"), F.col("loss_spans"), template).alias("under")
        ).collect()
    }


def test_hostile_texts_come_back(spark):
    rng = random.Random(3)
    bits = [*BRACKETS.controls, "[", "<", "/", "\\", "\\\\", " ", "\n", "SYS]", "[\\SYS]", "s>", "<\\\\/s>", "é", "🎉", "$1", "[IN", "ST]"]
    rows = []
    for c in range(150):
        for t in range(rng.randrange(1, 5)):
            role = rng.choice(["system", "user", "assistant", "tool", "", "[ROLE]x\\", "[/ROLE]"])
            rows.append((c, t, role, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 9)))))
    got = back(formatted(spark.createDataFrame(rows, SCHEMA)))
    for c, r in got.items():
        own = [x for x in rows if x[0] == c]
        assert [(t.role, t.text) for t in r.turns] == [(x[2], x[3]) for x in own]
        assert r.under == "".join(x[3] for x in own if x[2] == "assistant")
    assert len(got) == 150


def test_order_of_turns(spark):
    talks = {
        1: "system user assistant", 2: "user assistant user assistant", 3: "user", 4: "assistant", 5: "user user assistant",
        6: "system assistant", 7: "user assistant tool assistant", 8: "user system assistant",
    }
    rows = [(c, t, role, "x") for c, roles in talks.items() for t, role in enumerate(roles.split())]
    got = back(formatted(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    assert {c for c, r in got.items() if r.valid} == {1, 2}
    assert got[1].formatted == "[SYS] x [/SYS][INST] x [/INST][OUT] x </s>"


def test_own_template(spark):
    mine = Template({"a": Turn("<<a>>".replace("<<", "<|").replace(">>", "|>"), "<|end|>"), "b": Turn("<|b|>\n", "<|end|>", True)}, ("a",), {"a": ("b",)}, ("b",), "<|r|>", "<|/r|>", "<|/t|>")
    rows = [(1, 0, "a", "hi <|end|>"), (1, 1, "b", "<|a|>")]
    got = back(formatted(spark.createDataFrame(rows, SCHEMA), mine), mine)[1]
    assert got.valid and got.formatted == "<|a|>hi <\\|end|><|end|><|b|>\n<\\|a|><|end|>" and got.under == "<|a|>"
    assert [(t.role, t.text) for t in got.turns] == [("a", "hi <|end|>"), ("b", "<|a|>")]
    with pytest.raises(ValueError):
        Template({"a": Turn("[A]", "[/A[")}, (), {}, ())
    with pytest.raises(ValueError):
        Template({"a": Turn("[A]", " ")}, (), {}, ())


def test_edge_cases(spark):
    rows = [
        (1, 0, "user", None), (1, 1, "assistant", ""), (None, 0, None, "x"), (2, None, "user", "first"), (2, 0, "assistant", "b"), (2, 0, "assistant", "a"),
        (3, 0, "user", "y " * 100_000), (3, 1, "assistant", "<" * 1000), (4, 0, "user", "r"), (4, 0, "user", "r"),
    ]
    wide = spark.createDataFrame([(*r, "x", 1, True) for r in rows], SCHEMA + ", body string, n int, loss boolean")
    got = back(formatted(wide))
    assert [(t.role, t.text) for t in got[1].turns] == [("user", ""), ("assistant", "")] and got[1].valid and got[1].under == ""
    assert [(t.role, t.text) for t in got[None].turns] == [("", "x")] and not got[None].valid
    assert [t.text for t in got[2].turns] == ["first", "a", "b"] and got[2].under == "ab"
    assert got[3].valid and got[3].under == "<" * 1000 and len(got[4].turns) == 2
    assert segments(wide).count() == len(rows)
    assert formatted(wide.limit(0)).count() == 0
