import json
import struct

import numpy as np

from passagework.llm.neighbours import Forest, decode_vectors, most_similar, mutual_pairs

ROWS = "id string, embedding_vector binary, embedding_json string, embedding_model string, embedding_dim int, sim double, other string"


def pack(v):
    return struct.pack(f"<{len(v)}f", *v)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0.0, "x") for r in rows], ROWS)


def test_decoding(spark):
    rows = [
        ("packed", pack([3, 4]), json.dumps([1, 0]), "m", 2),  # the packed form goes first
        ("json", None, "[0, 2]", "m", 2),
        ("broken", b"\x00" * 7, "[0, 2]", "m", 2),
        ("short", pack([1]), None, "m", 2),
        ("nan", pack([float("nan"), 1]), None, "m", 2),
        ("inf", None, "[1e999, 1]", "m", 2),
        ("zero", pack([0, 0]), None, "m", 2),
        ("text", None, '{"error": 1}', "m", 2),
        ("cut", None, "[0.1, 0.", "m", 2),
        ("words", None, '["a", "b"]', "m", 2),
        ("none", None, None, "m", 2),
        ("nodim", pack([1, 0]), None, "m", None),
        ("nomodel", pack([1, 0]), None, None, 2),
        ("tiny", None, "[1e-200, 0]", "m", 2),
    ]
    got = {r.id: np.frombuffer(r.v, "<f4").round(3).tolist() for r in decode_vectors(frame(spark, rows)).collect()}
    assert got.keys() == {"packed", "json", "broken", "tiny"}
    assert got["packed"] == [np.float32(0.6).round(3), np.float32(0.8).round(3)] and got["json"] == [0, 1] and got["tiny"] == [1, 0]


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 4, dim))
    x = np.concatenate([base + 0.15 * rng.standard_normal(base.shape) for _ in range(4)])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_recall_against_brute_force(spark):
    rows, want = [], set()
    for model, dim in (("a", 16), ("b", 24)):
        x = clustered(2400, dim, dim).astype("float32")
        ids = [f"{model}{i:05d}" for i in range(len(x))]
        rows += [(i, pack(v), None, model, dim) for i, v in zip(ids, x)]
        sims = x.astype("float64") @ x.T.astype("float64")
        np.fill_diagonal(sims, -2)
        want |= {(ids[q], ids[o]) for q in range(len(x)) for o in np.argsort(-sims[q])[:5]}
    got = most_similar(decode_vectors(frame(spark, rows)), 5, forest=Forest(leaf_rows=128)).collect()
    found = {(r.id, r.other) for r in got}
    assert len(found) == len(got) == 5 * 4800
    assert len(found & want) / len(want) >= 0.9
    exact = {(r.id, r.other) for r in most_similar(decode_vectors(frame(spark, rows)), 5, forest=Forest(leaf_rows=10**6, max_leaf=500)).collect()}
    assert len(exact & want) / len(want) > 0.999  # one leaf, split among tasks: nothing is missed


def test_copies_ties_and_lonely_vectors(spark):
    rows = [(f"c{i:02d}", pack([1, 2]), None, "m", 2) for i in range(9)] + [("c00", pack([1, 2]), None, "m", 2), ("near", pack([1, 2.1]), None, "m", 2), ("far", pack([-1, 0]), None, "m", 2), ("alone", pack([1, 2]), None, "n", 2)]
    similar = most_similar(decode_vectors(frame(spark, rows)), 3, at_least=0.9).collect()
    by = {}
    for r in sorted(similar, key=lambda r: r.place):
        by.setdefault(r.id, []).append(r.other)
    assert by["c00"] == ["c01", "c02", "c03"] and by["near"] == ["c00", "c01", "c02"] and "far" not in by and "alone" not in by
    pairs = mutual_pairs(most_similar(decode_vectors(frame(spark, rows)), 3, at_least=0.9)).collect()
    assert {(r.id_a, r.id_b) for r in pairs} == {("c00", "c01"), ("c00", "c02"), ("c00", "c03"), ("c01", "c02"), ("c01", "c03"), ("c02", "c03")}


def test_every_copy_has_neighbours(spark):
    rows = [(f"c{i:02d}", pack([1, 2]), None, "m", 2) for i in range(30)] + [("c29", pack([1, 2]), None, "m", 2), ("near", pack([1, 2.1]), None, "m", 2)]
    got = most_similar(decode_vectors(frame(spark, rows)), 3, at_least=0.9).collect()
    by = {i: [(r.other, r.similarity) for r in sorted((r for r in got if r.id == i), key=lambda r: r.place)] for i in {r.id for r in got}}
    assert len(got) == 31 * 3 and all(by[f"c{i:02d}"] == [("c00", 1.0), ("c01", 1.0), ("c02", 1.0)] for i in range(3, 30))


def test_no_vectors(spark):
    assert most_similar(decode_vectors(frame(spark, []))).count() == 0


def test_more_near_copies_than_half_precision_can_tell_apart(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal(64)
    near = base + rng.standard_normal((40, 64)) * 2e-4
    rows = [(f"n{i:02d}", v.astype("<f4").tobytes(), None, "m", 64) for i, v in enumerate([*near, *rng.standard_normal((20, 64))])]
    df = spark.createDataFrame(rows, "id string, embedding_vector binary, embedding_json string, embedding_model string, embedding_dim int")
    got = {}
    for r in most_similar(decode_vectors(df), k=5).collect():
        got.setdefault(r.id, []).append((r.place, r.other))
    x = np.stack([np.frombuffer(r[1], "<f4").astype("float64") for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    same = sum(len({o for _, o in got[f"n{i:02d}"]} & {f"n{j:02d}" for j in np.argsort(-sims[i])[:5]}) for i in range(40))
    assert same >= 195  # products that agree to double precision of the rounded vectors may differ
