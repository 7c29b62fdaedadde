import random

import pytest

from passagework.llm.encoding import TOKENIZERS, encode_texts, halves, join_pieces, put_together, stretches, tokenizer


@pytest.fixture(scope="module")
def enc():
    return tokenizer()


def texts():
    rnd = random.Random(3)
    alphabet = ["the ", "Mark", " ", "  ", "\n", "\n\n", "é", "中文", "1234", "!!", "'s", "ab", "😀", "​", "<|endoftext|>", "\t", "aaaa"]
    for n in (0, 1, 5, 50, 400, 1500):
        for _ in range(8):
            yield "".join(rnd.choice(alphabet) for _ in range(n))
    yield "a" * 5000
    yield "".join(rnd.choice("abcdefgh") for _ in range(6000))
    yield " " * 3000 + "x"
    yield "word\n\n" + "y" * 2000 + "\n\nend"
    yield "中" * 1500


def test_parts_put_together_are_the_whole_encoding(enc):
    for text in texts():
        parts = list(stretches(text, TOKENIZERS, 100))
        assert "".join(p for p, _, _ in parts) == text
        ids = [(j, enc._encode_single_piece(p.encode()) if u else enc.encode_ordinary(p)) for p, j, u in parts]
        assert put_together(ids, enc) == enc.encode_ordinary(text)


def test_joins_of_random_halves(enc):
    rnd = random.Random(5)
    for _ in range(300):
        piece = "".join(rnd.choice("abcdeéß") for _ in range(rnd.randrange(2, 200)))
        cut = rnd.randrange(1, len(piece))
        got = join_pieces(enc._encode_single_piece(piece[:cut].encode()), enc._encode_single_piece(piece[cut:].encode()), enc)
        assert got == enc._encode_single_piece(piece.encode())
    assert [p for p, *_ in halves("x" * 10, 3)] == ["xx", "xxx", "xx", "xxx"]


def test_agrees_with_the_other_library(spark, enc):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(1000, None, "x"), (7, "again", "x")]
    out = encode_texts(spark.createDataFrame(rows, "doc_id long, text string, ids string"), limit=64).collect()
    assert len(out) == len(rows)
    want = sorted((i, other.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows)
    assert sorted((r.doc_id, list(r.ids)) for r in out) == want


def test_no_rows_and_string_keys(spark):
    df = spark.createDataFrame([("a", "b"), (None, "hello world " * 40)], "doc_id string, text string")
    assert {r.doc_id: len(r.ids) for r in encode_texts(df, limit=50).collect()} == {"a": 1, None: 81}
    assert encode_texts(df.limit(0)).count() == 0
