import datetime as dt
import random
import time

import pytest

from passagework.llm.conversations import conversations, merge_fragments, pair_rows

T = dt.datetime
CHAT = "id string, chat_id string, user_query string, user_id string, bot_response string, citations_json string, timestamp timestamp_ntz, speaker string, fragment long, pos int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "extra", 1, 2) for r in rows], CHAT)


def at(minute):
    return T(2024, 1, 1) + dt.timedelta(minutes=minute)


def kept(spark, rows, **kw):
    return sorted(tuple(r) for r in conversations(frame(spark, rows), **kw).collect())


def test_definitions(spark):
    rows = [
        ("1", " c1", "q", "u", None, None, at(0)),
        ("2", "c1 ", " ", "u", "a", None, at(0)),  # equal time: the row with the user message first
        ("3", "c1", "q", None, "a", None, at(3)),
        ("3", "c1", "q", None, "a", None, at(3)),  # repeated
        ("4", "c1", "q", "u", "", None, at(4)),  # two states of a row: the answered one holds
        ("4", "c1", "q", "u", "a", None, at(4)),
        ("5", "c2", "q", "u", None, None, at(1)),  # lacks a reply
        ("6", "c3", "q", "u", "a", None, at(1)),
        ("7", "c3", "q", "v", "a", None, at(2)),  # two users
        ("8", "c4", "q", "u", "a", None, None),  # no time
        ("9", "c5", "​", "u", "...", None, at(1)),  # blank: no messages
        ("10", None, "q", "u", "a", None, at(1)),
        ("11", "  ", "q", "u", "a", None, at(1)),
        ("12", "c6", None, "u", "a", None, at(1)),  # begins with the assistant
        ("13", "c7", "long " * 50_000, "u", "a", None, at(1)),
        (None, "c8", "q", "u", "a", None, at(1)),
    ]
    assert kept(spark, [r for r in rows if r[0]]) == [
        ("c1", 0, "user", "1"), ("c1", 1, "assistant", "2"), ("c1", 2, "user", "3"), ("c1", 3, "assistant", "3"), ("c1", 4, "user", "4"), ("c1", 5, "assistant", "4"),
        ("c7", 0, "user", "13"), ("c7", 1, "assistant", "13"),
    ]
    assert {r[0] for r in (tuple(x) for x in conversations(frame(spark, rows)).collect())} == {"c1", "c7", "c8"}
    pairs = {r.id: r.reply_id for r in pair_rows(frame(spark, rows)).collect()}
    assert pairs["1"] == "2" and pairs["3"] == "3" and pairs["5"] is None and pairs["8"] == "8" and pairs["10"] == "10" and "9" not in pairs


def test_empty(spark):
    assert kept(spark, []) == []


def test_long_and_hot_chats_are_cut_into_fragments(spark):
    rnd = random.Random(1)
    rows = []
    for chat, n in (("hot", 400), ("b", 37), ("c", 1), ("broken", 90)):
        for i in range(n):
            rows.append((f"{chat}-{i:04d}", chat, "q", "u", None if chat == "broken" and i == 50 else "a", None, at(i)))
    rnd.shuffle(rows)
    got = kept(spark, rows, length=8)
    want = sorted((chat, 2 * i + k, s, f"{chat}-{i:04d}") for chat, n in (("hot", 400), ("b", 37), ("c", 1)) for i in range(n) for k, s in enumerate(("user", "assistant")))
    assert got == want


def merged(spark, fragments, **kw):
    rows = [("x", f, i, h) for f, hashes in fragments.items() for i, h in enumerate(hashes)]
    out = merge_fragments(spark.createDataFrame(rows, "conversation string, fragment long, pos int, hash long"), **kw)
    return {r.fragment: (r.path, r.offset, r.paths) for r in out.collect()}


def test_overlapping_exports_merge(spark):
    got = merged(spark, {1: [10, 11, 12, 13], 2: [12, 13, 14, 15], 3: [15, 16]})
    assert got == {1: (1, 0, 1), 2: (1, 2, 1), 3: (1, 5, 1)}


def test_gaps_and_ambiguous_overlaps_stay_apart(spark):
    assert {v[2] for v in merged(spark, {1: [1, 2], 2: [3, 4]}).values()} == {2}
    assert {v[2] for v in merged(spark, {1: [1, 2], 2: [2, 3], 3: [2, 4]}).values()} == {3}


@pytest.mark.parametrize("n", [2, 3, 5, 6])
def test_rings_have_no_beginning_and_end_soon(spark, n):
    ring = {i: [10 * i, 10 * ((i + 1) % n)] for i in range(n)}
    start = time.monotonic()
    got = merged(spark, {**ring, 100: [7000, 7001], 101: [7001, 7002]})
    assert all(got[i][:2] == (i, 0) for i in range(n)) and got[101][:2] == (100, 1) and got[0][2] == n + 1
    assert time.monotonic() - start < 60


def test_overlaps_of_any_length(spark):
    long = list(range(1000, 1300))
    got = merged(spark, {1: [1, 2, 3, 4, 5, 6], 2: [2, 3, 4, 5, 6, 7], 3: [6, 7, *long], 4: [*long[5:], 9]})
    assert got == {1: (1, 0, 1), 2: (1, 1, 1), 3: (1, 5, 1), 4: (1, 12, 1)}


def test_repeated_messages_are_no_ambiguity(spark):
    assert merged(spark, {1: [9, 5, 5, 6, 5], 2: [6, 5, 7], 3: [7, 5, 5]}) == {1: (1, 0, 1), 2: (1, 3, 1), 3: (1, 5, 1)}


def test_random_windows_of_a_sequence(spark):
    rnd = random.Random(7)
    sequence = [rnd.getrandbits(60) for _ in range(300)]
    starts, i = [], 0
    while i < 290:
        starts.append(i)
        i += rnd.randrange(5, 9)
    fragments = {n: sequence[s : s + 11] for n, s in enumerate(starts)}
    got = merged(spark, fragments)
    assert all(got[n] == (0, s, 1) for n, s in enumerate(starts))
