import datetime as dt
import random

from pyspark.sql import functions as F

from passagework.operators import orphans
from passagework.operators.orphans import orphan_references, orphan_report, parent_keys, references

T = dt.datetime
REF = "id string, ref string, created_at timestamp_ntz, range int, `split` int, h string"
PAR = "id string, created_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz, key string"


def run(spark, refs, parents, **kw):
    r = references(spark.createDataFrame(refs, REF), "t", "ref", "p")
    p = parent_keys(spark.createDataFrame(parents, PAR), "p", deleted="deleted_at", version="updated_at")
    return {(x.record_id, x.reason, x.ref_month) for x in orphan_references(r, p, **kw).collect()}


def test_reasons_spellings_versions_and_blanks(spark):
    parents = [
        ("A", T(2024, 1, 1), T(2024, 1, 2), None, "x"),
        ("a ", T(2024, 1, 1), T(2024, 6, 1), T(2024, 5, 1), "x"),  # the newer version holds: deleted in May
        ("B", T(2024, 3, 1), T(2024, 3, 1), None, "x"),
        (None, T(2024, 3, 1), T(2024, 3, 1), None, "x"),
    ]
    refs = [
        ("1", " A", T(2024, 4, 1), 1, 1, "x"),
        ("2", "a\t", T(2024, 7, 1), 1, 1, "x"),
        ("3", "b", T(2024, 2, 1), 1, 1, "x"),
        ("4", "nobody", T(2024, 2, 1), 1, 1, "x"),
        ("4", "nobody", T(2024, 2, 1), 1, 1, "x"),  # repeated row
        ("5", None, T(2024, 2, 1), 1, 1, "x"),
        ("6", "  ", T(2024, 2, 1), 1, 1, "x"),
        ("7", "b", None, 1, 1, "x"),  # without a time it is neither late nor deleted
        ("8", "gone", None, 1, 1, "x"),
        ("9", "x" * 100_000, T(2024, 2, 1), 1, 1, "x"),
    ]
    assert run(spark, refs, parents) == {("2", "deleted", "2024-07"), ("3", "late", "2024-02"), ("4", "missing", "2024-02"), ("8", "missing", None), ("9", "missing", "2024-02")}


def test_empty_tables(spark):
    refs = [("1", "a", T(2024, 4, 1), 1, 1, "x")]
    assert run(spark, refs, []) == {("1", "missing", "2024-04")}
    assert run(spark, [], [("a", T(2024, 1, 1), T(2024, 1, 1), None, "x")]) == set()


def test_hot_key_is_split_and_agrees_with_brute_force(spark):
    rnd = random.Random(4)
    parents = [(f"k{i}", T(2024, 1, 1 + i % 28), T(2024, 2, 1), T(2024, 3, 1) if i % 3 == 0 else None, "x") for i in range(300)]
    refs = [(str(i), "k6" if i % 3 == 0 else f"K{rnd.randrange(400)} ", T(2024, rnd.randrange(1, 6), 14), 1, 1, "x") for i in range(4000)]
    held = {p[0]: p for p in parents}
    want = set()
    for rid, key, at, *_ in refs:
        p = held.get(key.strip().lower())
        reason = "missing" if p is None else "late" if p[1] > at else "deleted" if p[3] and p[3] < at else None
        if reason:
            want.add((rid, reason, at.strftime("%Y-%m")))
    assert run(spark, refs, parents, ranges=8, batch_rows=100) == want


def test_report_counts(spark):
    misses = spark.createDataFrame([("t", "f", "1", "late", "2024-01"), ("t", "f", "2", "late", "2024-01")], "table_name string, field_name string, record_id string, reason string, ref_month string")
    assert [r.n_orphans for r in orphan_report(misses).collect()] == [2]


def test_ranges_follow_the_number_of_rows():
    assert orphans.range_bits(None, 32, 10, 400_000) == 5
    assert orphans.range_bits(None, 32, 400_000 * 1000, 400_000) == 10
    assert orphans.range_bits(None, 32, 10**15, 400_000) == orphans.MOST_BITS
    assert orphans.range_bits(1, 32, 10**9, 400_000) == 1


def test_small_batches_give_the_same_misses(spark):
    refs = spark.range(3000).select(F.lit("t").alias("table_name"), F.lit("f").alias("field_name"), F.lit("p").alias("parent"), F.concat(F.lit("k"), F.col("id") % 700).alias("key"), F.col("id").cast("string").alias("record_id"), F.lit(5).cast("long").alias("created"))
    parents = spark.range(600).select(F.lit("p").alias("parent"), F.concat(F.lit("k"), F.col("id")).alias("key"), (F.col("id") % 10).alias("born"), F.lit(None).cast("long").alias("gone"))
    found = [sorted(map(tuple, orphans.orphan_references(refs, parents, batch_rows=n).collect())) for n in (7, 400_000)]
    assert found[0] == found[1] and {r[3] for r in found[0]} == {"missing", "late"} and sum(r[3] == "missing" for r in found[0]) == sum(i % 700 >= 600 for i in range(3000))
