import random

from hypothesis import given, settings
from hypothesis import strategies as st

from passagework.operators.chunking import by_characters, cut, page_spans, pages_of, passages, sentence_units, units_between


def test_short_text_is_one_passage():
    assert by_characters("abc", 10, 2) == [(0, 3)]
    assert passages("", "sentence", 200, 20) == []


def test_windows_end_at_full_stops_of_the_second_half():
    text = "a" * 70 + ". " + "b" * 60
    assert by_characters(text, 100, 10)[0] == (0, 71)
    assert by_characters("a" * 30 + ". " + "b" * 100, 100, 10)[0] == (0, 100)


def formula(text, size, overlap):
    """The rule as the description states it, written from the end of each window."""
    out, start = [], 0
    if len(text) <= size:
        return [(0, len(text))]
    while True:
        end = min(start + size, len(text))
        if end != len(text):
            stops = [i for i in range(start, end - 1) if text[i : i + 2] == ". "]
            if stops and stops[-1] > start + size // 2:
                end = stops[-1] + 1
        body = text[start:end].strip()
        if body:
            at = start + text[start:end].index(body)
            out.append((at, at + len(body)))
        if end == len(text):
            return out
        start = max(0, end - overlap)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. ", max_size=600), st.integers(20, 90), st.integers(0, 40))
def test_characters_agree_with_the_formula(text, size, overlap):
    overlap = min(overlap, size // 2)
    assert by_characters(text, size, overlap) == formula(text, size, overlap)


def test_units():
    assert sentence_units("One. Two!  Three") == [(0, 4), (5, 9), (11, 16)]
    assert units_between("abcdef", [2, 4, 9, 0]) == [(0, 2), (2, 4), (4, 6)]
    assert units_between("abc", []) == []


def test_packing_covers_the_text_in_bounds():
    rnd = random.Random(3)
    for _ in range(60):
        text = " ".join("word " * rnd.randrange(1, 30) + "end." for _ in range(rnd.randrange(1, 60))).replace("  ", " ")
        spans = passages(text, "sentence", 300, 60)
        assert all(0 < b - a <= 300 for a, b in spans) and spans[0][0] == 0 and spans[-1][1] == len(text)
        assert all(y[0] > x[0] for x, y in zip(spans, spans[1:]))
        assert all(not text[x[1] : y[0]].strip() for x, y in zip(spans, spans[1:]) if y[0] > x[1])


def test_frame_and_edge_texts(spark):
    rows = [(1, "Para one.\n\nPara two.", 5), (2, None, 5), (3, "", 5), (4, " \n ", 5), (5, "x" * 50_000, 5)]
    out = cut(spark.createDataFrame(rows, "doc_id long, text string, start int"), "paragraph", 200, 20).collect()
    assert {r.doc_id for r in out} == {"1", "5"}
    assert [r.content for r in out if r.doc_id == "1"] == ["Para one. Para two."]
    assert all(len(r.content) == r.end - r.start for r in out)
    assert cut(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pages(spark):
    from pyspark.sql import functions as F

    rows = [("d", 2, " second\tpage "), ("d", 1, "first"), ("d", 3, ""), ("d", 4, None), ("d", 5, "last")]
    out = page_spans(spark.createDataFrame(rows, "doc_id string, page int, text string"))
    r = out.first()
    assert r.text == "first second page last" and [tuple(s) for s in r.spans] == [(1, 0, 5), (2, 6, 17), (5, 18, 22)]
    a, b = pages_of(F.col("spans"), F.lit(4), F.lit(19))
    assert tuple(out.select(a, b).first()) == (1, 5)
    a, b = pages_of(F.col("spans"), F.lit(5), F.lit(6))
    assert tuple(out.select(a, b).first()) == (None, None)
