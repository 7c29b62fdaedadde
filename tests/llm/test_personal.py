import random

import pytest

from passagework.llm.personal import _candidates_of, _owner, _street, find_mentions, fold, redact, shape_of

GIVEN = "Odette Marcus Priya Callum Nadia Jürgen Élodie Begoña".split()
SURNAME = "Quillmarsh Hollowford Tarnbeck Wickstow Oberkamp Lacrelin Zaldeño Draylock".split()
FILLER = ["The report is due on Friday.", "Order no. 12946-129 is shown.", "Harbour Ledger and Quarry Desk are product names.", "Version 13.35 replaces all copies.", "Lane 230 on Dock 27 stays shut.", "Ask @ops-desk85 in the channel.", "Buy 15 units @ 4.24 each."]


def corpus():
    """Texts with mentions that are known by construction: (row_id, start, type)."""
    rnd = random.Random(8)
    texts, truth = [], set()
    for i in range(400):
        parts, at = [], 0

        def add(text, kind=None, skip=0):
            nonlocal at
            if kind:
                truth.add((str(i), at + skip, kind))
            parts.append(text)
            at += len(text)

        g, s = rnd.choice(GIVEN), rnd.choice(SURNAME)
        add(rnd.choice(FILLER) + " ")
        form = i % 6
        if form == 0:
            add("Signed, ")
            add(f"{g} {s}", "name")
            add(", ")
            add(f"{rnd.randrange(1, 90)} Old Mill Lane", "address")
        elif form == 1:
            add("Write to ")
            add(f"{fold(g)}.{fold(s)}@kontor.example", "email")
            add(" or call ")
            add(f"+44 7700 900 {rnd.randrange(100, 999)}", "phone", 1)
        elif form == 2:
            add("Passport ")
            add(f"{rnd.randrange(100, 999)}-{rnd.randrange(10, 99)}-{rnd.randrange(1000, 9999)}", "id_number")
            add(" was issued to ")
            add(f"{s}, {g}", "name")
        elif form == 3:
            add("Passport ")
            add(f"K{rnd.randrange(10**6, 10**7)}", "id_number")  # a shape no seed knows
            add(" was issued to ")
            add(f"{g.upper()} {s.upper()}", "name")
        elif form == 4:
            add("Please call ")
            add(*((f"303555{rnd.randrange(1000, 9999)}", "phone") if i % 4 else (f"(303) 555-{rnd.randrange(1000, 9999)}", "phone", 1)))
        else:
            add("The key went to ")
            add(f"{g[0]}. {s}", "name")
        add(". " + rnd.choice(FILLER))
        texts.append(("t", str(i), "".join(parts)))
    return texts, truth


def test_recall_and_precision_on_known_mentions(spark):
    texts, truth = corpus()
    got = {(r.row_id, r.start, r.pii_type) for r in find_mentions(spark.createDataFrame(texts, "source string, row_id string, text string")).collect()}
    assert len(got & truth) / len(truth) > 0.95, sorted(truth - got)[:8]
    assert len(got & truth) / len(got) > 0.95, sorted(got - truth)[:8]
    assert {k for _, _, k in got} == {"name", "address", "email", "phone", "id_number"}


def test_redaction_changes_nothing_else(spark):
    texts, _ = corpus()
    df = spark.createDataFrame([*texts[:60], ("t", "none", "nothing here"), ("t", "none", "nothing here")], "source string, row_id string, text string")
    found = find_mentions(df)
    spans = {}
    for r in found.collect():
        spans.setdefault(r.row_id, []).append((r.start, r.end, r.pii_type))
    rows = redact(df, found).collect()
    assert len(rows) == 62
    original = {rid: t for _, rid, t in texts}
    for r in rows:
        text, at = "", 0
        for a, b, kind in sorted(spans.get(r.row_id, [])):
            text += original[r.row_id][at:a] + f"[{kind.upper()}]"
            at = b
        assert r.redacted == text + original.get(r.row_id, "nothing here")[at:]


def test_edge_texts(spark):
    rows = [("t", "1", "x" * 200_000), ("t", "2", "a@b.example " * 3), ("t", "2", "a@b.example " * 3), ("t", "3", "😀 a@b.example")]
    got = sorted((r.row_id, r.start, r.pii_type) for r in find_mentions(spark.createDataFrame(rows, "source string, row_id string, text string")).collect())
    assert got == [("2", 0, "email"), ("2", 12, "email"), ("2", 24, "email"), ("3", 2, "email")]
    assert find_mentions(spark.createDataFrame([], "source string, row_id string, text string")).count() == 0


@pytest.mark.parametrize(
    ("text", "kind"),
    [("Mail: ann_lee+kb (at) fern (dot) example.", "email"), ("write to ann @ lab7.invalid now", "email"), ("x ann AT post DOT example DOT org y", "email"), ("call five five five zero one nine six", "number"), ("au (0)1 99 00 66 21", "number"), ("DNI 66.473.540-T", "number"), ("ID QQ 20 17 24 B", "number")],
)
def test_surface_forms(text, kind):
    assert kind in {c[2] for c in _candidates_of(text)}


@pytest.mark.parametrize("text", ["Build kb@2.90.112 is live.", "Ask @ops-desk85 now", "Buy 3 units @ 4.44 each."])
def test_no_addresses_of_mail(text):
    assert "email" not in {c[2] for c in _candidates_of(text)}


def test_helpers():
    assert fold("Strömmüller-Tann") == "strommullertann" and fold("de la Torqueño") == "delatorqueno"
    assert shape_of("0034 900 550 480") == "0099 999 999 999" and shape_of("Y7704204W") == "A9999999A"
    assert _owner("owen.tarn") == ("sure", "owen", "tarn") and _owner("quillby78") == ("likely", "", "quillby")
    assert _street("last", "Old Mill Row") == "row" and _street("either", "Lindenweg") == "weg" and _street("either", "Row") == "bare row"


def test_rare_names_in_lower_case_of_a_large_corpus(spark):
    """Names that a large corpus has once or only in an address are looked for like any others."""
    rows = [("t", f"n{i}", "Harbour Ledger " * 700) for i in range(150)]
    rows += [("t", "e", "Write to zelda.fernwick@kontor.example, anna.delacroix@kontor.example"), ("t", "c", "Signed, Zelda Fernwick")]
    rows += [("t", "ab", "ask zelda fernwick today"), ("t", "ba", "ask fernwick, zelda today"), ("t", "lead", "ask anna zelda fernwick today"), ("t", "part", "ask anna de la croix today"), ("t", "not", "ask zelda today")]
    found = find_mentions(spark.createDataFrame(rows, "source string, row_id string, text string")).where("pii_type = 'name' and row_id in ('ab', 'ba', 'lead', 'part', 'not')")
    assert {(r.row_id, r.start, r.end) for r in found.collect()} == {("ab", 4, 18), ("ba", 4, 19), ("lead", 4, 23), ("part", 4, 20)}
