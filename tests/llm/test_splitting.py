import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st

from passagework.llm.splitting import split_oversized, split_text

T = dt.datetime


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n#中", max_size=900), st.integers(20, 120), st.integers(0, 60))
def test_round_trip_limit_and_overlap(text, size, overlap):
    overlap = min(overlap, size // 2)
    spans = split_text(text, size, overlap)
    assert all(b - a <= size for a, b in spans)
    assert all(y[0] == x[1] - overlap and y[1] > x[1] for x, y in zip(spans, spans[1:]))
    at, back = 0, ""
    for a, b in spans:
        back += text[at:b]
        at = b
    assert back == text


def test_prefers_coarse_boundaries():
    text = "One two three.\n\nFour five six seven. Eight nine ten eleven twelve."
    assert [text[a:b] for a, b in split_text(text, 40, 0)] == ["One two three.\n\nFour five six seven. ", "Eight nine ten eleven twelve."]
    assert split_text("x" * 100, 30, 10)[0] == (0, 20)


def test_limits_of_files(spark):
    files = [("F1", 300, 50, T(2024, 1, 1)), ("f1 ", 500, 50, T(2024, 2, 1)), ("small", 1, None, T(2024, 1, 1)), ("large", 9999, 9999, T(2024, 1, 1)), ("null", None, None, T(2024, 1, 1)), (None, 200, 0, T(2024, 1, 1))]
    f = spark.createDataFrame(files, "id string, chunk_size int, chunk_overlap int, updated_at timestamp_ntz")
    words = "word " * 3000
    chunks = [("a", " F1", words[:500], 1), ("b", "f1", words[:501], 1), ("b", "f1", words[:501], 1), ("c", "small", words[:201], 1), ("d", "large", words[:4000], 1), ("e", "LARGE", words[:4001], 1), ("f", "null", words[:1201], 1), ("g", None, words[:1200], 1), ("h", "no such", words[:1201], 1), ("i", "", None, 1), ("j", "", "", 1), ("k", "f1", words * 20, 1)]
    c = spark.createDataFrame(chunks, "id string, file_id string, content string, size int")
    rows = split_oversized(c, f).collect()
    assert {r.chunk_id for r in rows} == set("bcefhk")
    by = {k: sorted((r.piece_no, r.start_pos, r.end_pos, r.n_pieces) for r in rows if r.chunk_id == k) for k in "bcefhk"}
    assert [x[0] for x in by["b"]] == list(range(len(by["b"]))) and by["b"][0][3] == len(by["b"])
    assert by["c"][1][1] == by["c"][0][2] - 100  # the default overlap, at most half the size
    assert by["k"][-1][2] == 300_000
    assert split_oversized(c.limit(0), f).count() == 0 and split_oversized(c, f.limit(0)).count() > 0


def test_null_size_is_the_default_not_the_smallest(spark):
    files = [("n", None, 10, T(2024, 2, 1)), ("n", 300, 10, T(2024, 1, 1)), ("z", 0, 0, T(2024, 1, 1))]
    f = spark.createDataFrame(files, "id string, chunk_size int, chunk_overlap int, updated_at timestamp_ntz")
    chunks = [(f"n{n}", "N ", "x" * n) for n in (200, 201, 1199, 1200, 1201)] + [("z200", "z", "x" * 200), ("z201", "z", "x" * 201)]
    c = spark.createDataFrame(chunks, "id string, file_id string, content string")
    assert {r.chunk_id for r in split_oversized(c, f).collect()} == {"n1201", "z201"}
