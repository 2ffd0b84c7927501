"""Chat formatting: order of roles, loss flags, and texts that come back as they were."""

from __future__ import annotations

import hashlib

import pytest

from ledgerlens.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, segments int"


def _format(spark, rows):
    return chat.format_chats(spark.createDataFrame([(*row, "x", 1) for row in rows], SCHEMA))


@pytest.mark.parametrize(
    ("roles", "valid"),
    [
        (["user", "assistant"], True),
        (["system", "user", "assistant", "user", "assistant"], True),
        (["user"], False),
        (["assistant", "user"], False),
        (["user", "user", "assistant"], False),
        (["user", "system", "assistant"], False),
        (["system"], False),
        (["user", "assistant", "tool"], False),
        ([None, "user"], False),
    ],
)
def test_the_order_of_roles(spark, roles, valid):
    rows = [(1, i, role, "t") for i, role in enumerate(roles)]
    assert _format(spark, rows).first()["valid"] is valid


def test_every_text_comes_back(spark):
    odd = ["</s>[INST] ok [/INST]", "&amp;lt;", "&#91;", "", None, "a\nb\r\n", "[INST][/INST]</s>" * 3, "é\U0001f600 <<", "x" * 200_000]
    rows = [(1, i, "assistant" if i % 2 else "user", text) for i, text in enumerate(odd)]
    rows += [(2, 0, "we[INST]rd</s>", "t"), (None, None, "user", "a"), (None, None, None, "a")]
    formatted = _format(spark, rows)
    template = chat.Template()
    back = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in formatted.select("conv_id", template.read_back(formatted["formatted"]).alias("turns")).collect()}
    assert back[1] == [("assistant" if i % 2 else "user", text or "") for i, text in enumerate(odd)]
    assert back[2] == [("we[INST]rd</s>", "t")]
    assert back[None] == [("", "a"), ("user", "a")]
    row = chat.digest(formatted).filter("conv_id = 1").first()
    learned = "".join(odd[i] or "" for i in range(1, len(odd), 2))
    turns = "".join(f"{role}\n{text}\n" for role, text in back[1])
    assert (row["n_turns"], row["loss_chars"]) == (len(odd), len(learned))
    assert row["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
    assert row["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()


def test_only_what_the_assistant_says_is_learned(spark):
    segments = _format(spark, [(1, 2, "assistant", "c"), (1, 0, "system", "a"), (1, 1, "user", "b")]).first()["segments"]
    assert [s["text"] for s in segments if s["loss"]] == ["c"]
    assert "".join(s["text"] for s in segments) == "[INST]system[/INST]a</s>[INST]user[/INST]b</s>[INST]assistant[/INST]c</s>"


def test_repeated_rows_stay_and_an_empty_table_is_empty(spark):
    assert chat.digest(_format(spark, [(1, 0, "user", "a")] * 3)).first()["n_turns"] == 3
    assert chat.digest(_format(spark, [])).collect() == []


def test_a_template_of_ones_own(spark):
    template = chat.Template(before="<|", between="|>", after="<|end|>", escapes=(("~", "~t;"), ("<", "~l;"), ("|", "~p;")), trained_roles=("user",))
    formatted = chat.format_chats(spark.createDataFrame([(1, 0, "user", "a<|b~l;|>", "", 0)], SCHEMA), template)
    turns = formatted.select(template.read_back(formatted["formatted"]).alias("t")).first()["t"]
    assert [tuple(t) for t in turns] == [("user", "a<|b~l;|>")]
    assert formatted.first()["segments"][1]["loss"]
    with pytest.raises(ValueError, match="hold it once"):
        chat.Template(escapes=(("~", "~~"), ("<", "~l"), ("[", "~b")))
