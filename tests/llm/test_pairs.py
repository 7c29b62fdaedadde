import datetime as dt
import re
import time

import pandas as pd
import pytest

from passagework.llm.pairs import _observe, context, contexts, defects, is_copy, is_other_language, is_refusal, is_truncated, main_language

Q = "Why was the contract changed in version 17?"


@pytest.mark.parametrize("reply", [Q, Q.upper(), f"“{Q}”", f"You asked: {Q}", "Why was the contract changed in version 17.", f"{Q} {Q}", "  Why  was the contract  changed in version 17 ?\n"])
def test_copies(reply):
    assert is_copy(Q, reply)


@pytest.mark.parametrize("reply", [f"{Q}\nThe budget was late.", "Why was the contract changed in version 17: mentor, audit, by Friday.", "The contract was changed.", "No.", ""])
def test_no_copies(reply):
    assert not is_copy(Q, reply)


@pytest.mark.parametrize(
    "reply",
    ["I'm sorry, but I would rather not comment on that.", "Sorry. I can't help with that request. Is there anything else you need?", "Leider darf ich dazu keine Auskunft geben.", "Désolé, rien dans cette base ne me permet de répondre.", "No puedo ayudar con esa petición. Consulte con la persona responsable.", "There is not enough evidence here for me to reply."],
)
def test_refusals(reply):
    assert is_refusal(reply)


@pytest.mark.parametrize("reply", ["A dose cannot be changed after the audit; I am told this is not permitted by section 37. The bench stays open.", "Sorry for the delay. The contract ends in May.", "No.", "The pump must not be started."])
def test_answers_are_no_refusals(reply):
    assert not is_refusal(reply)


def test_languages():
    assert main_language("Der Vertrag hängt mit Punkt 8 zusammen.")[0] == "de"
    assert is_other_language(Q, "Sure! Der Vertrag hängt mit Punkt 8 zusammen, ebenso die Frist.")
    assert is_other_language(Q, "本页说明每周检查的步骤。")
    assert not is_other_language("How do I write the following in German: the pump is new.", "Die Pumpe ist neu.")
    assert not is_other_language(Q, "No.") and not is_other_language("hi", "Der Vertrag ist neu.")


MODEL = {("prose", "."): 0.9, ("prose", "a"): 0.01, ("prose", ","): 0.0, ("item", "a"): 0.7, ("mark", "."): 0.0, ("fence", "`"): 1.0, ("field", "9"): 0.8}


@pytest.mark.parametrize(("reply", "cut"), [("It is new.", False), ("It is", True), ("Before each gasket, check,", True), ("List:\n- one\n- two", False), ("1. First.\n2.", True), ("Run\n```\ntool\n```", False), ("Run\n```\ntool --set \"x", True), ("Move the (", True), ("a: 1\nb: 24", False)])
def test_truncation(reply, cut):
    assert is_truncated(reply, MODEL) == cut


def test_contexts():
    assert context("x [1") == ("open", "") and context("- one") == ("item", "a") and context("One.") == ("prose", ".")


def test_contexts_of_many_cuts_are_those_of_each():
    text = "- “One (two” [x]) a | b. c: d ``` 1. e. f"
    cuts = [m.end() for m in re.finditer(r"\S(?=\s|$)", text)]
    assert list(contexts(text, cuts, 0)) == [context(text[:c]) for c in cuts]


def test_long_replies_take_linear_time():
    reply = "word other (one) and, more. " * 20_000  # 100,000 words
    start = time.monotonic()
    seen = next(_observe(iter([pd.DataFrame({"reply": [reply]})])))
    assert is_truncated(reply, MODEL) in (True, False) and not is_refusal(reply) and not is_copy(Q, reply) and not is_other_language(Q, reply)
    assert time.monotonic() - start < 2 and seen["n"].sum() == 99_999


def test_defects_of_a_table(spark):
    t = dt.datetime(2024, 1, 1)
    good = [(f"g{i}", f"c{i}", f"Is the valve {w} open?", "u", f"The valve {w} is open every week. Keep it dry.\n- {w}\n- valve", None, t) for i, w in enumerate("one two three four five six".split() * 5)]
    rows = [
        *good,
        ("e1", "a", "Is it open?", "u", None, None, t),
        ("e2", "b", "Is it open?", "u", "```\n```", None, t),
        ("r", "d", "Is it open?", "u", "I am not able to answer this.", None, t),
        ("c", "e", "Is the long valve open now?", "u", "is the long valve open now", None, t),
        ("x", None, "Is the valve open today?", "u", "The valve is open and the", None, t),
        ("o", "f", "When is the valve open?", "u", "La válvula está abierta cada semana y no hay más.", None, None),
        ("q", "h", "Is it so?", "u", None, None, t),
        ("a", "h", None, "u", "It is so.", None, t + dt.timedelta(minutes=1)),
        ("z", "i", " ", "u", "It is so.", None, t),
    ]
    df = spark.createDataFrame(rows, "id string, chat_id string, user_query string, user_id string, bot_response string, citations_json string, timestamp timestamp_ntz")
    assert {(r.id, r.defect) for r in defects(df).collect()} == {("e1", "empty"), ("e2", "empty"), ("r", "refusal"), ("c", "copy"), ("x", "truncated"), ("o", "other_language")}
    assert defects(df.limit(0)).count() == 0
