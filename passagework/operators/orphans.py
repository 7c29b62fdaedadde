"""References to records that do not exist.

Keys live in a 64-bit hash space that is cut into equal ranges. The parents of a range
become one sorted array; the references of a range are probed against it in vectorised
batches by binary search, and only the misses leave the task. Ranges that hold too many
references (a hot key) are split: each split gets its own copy of the range's array, which
is small, so no task ever holds an unbounded group.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.functions.keys import micros, norm_key
from passagework.session import parallelism

#: Stand for an unknown time and for a deletion that never happened.
NONE, NEVER = -(2**63), 2**63 - 1

#: Bound of the table of ranges that is broadcast (some 16 bytes a row). With the default batch its ranges stay within
#: the batch up to 4e11 keys; beyond that arrays grow, and nothing is lost.
MOST_BITS = 20

MISSES = "table_name string, field_name string, record_id string, reason string, ref_micros long"


def references(df: DataFrame, table: str, field: str, parent: str, record_id: str = "id", created: str = "created_at") -> DataFrame:
    """The non-blank references of one column, in the form ``orphan_references`` takes."""
    key = norm_key(F.col(field))
    return df.select(
        F.lit(table).alias("table_name"),
        F.lit(field).alias("field_name"),
        F.lit(parent).alias("parent"),
        key.alias("key"),
        F.col(record_id).cast("string").alias("record_id"),
        micros(F.col(created)).alias("created"),
    ).where(F.col("key").isNotNull() & (F.col("key") != ""))


def parent_keys(df: DataFrame, parent: str, key: str = "id", created: str = "created_at", deleted: str | None = None, version: str | None = None) -> DataFrame:
    """One row per key; of several versions of a key the one with the latest ``version`` holds
    (ties: the later deletion, so the result is the same in every run)."""
    gone: Column = micros(F.col(deleted)) if deleted else F.lit(None).cast("long")
    rows = df.select(
        F.lit(parent).alias("parent"),
        norm_key(F.col(key)).alias("key"),
        F.struct(
            (micros(F.col(version)) if version else -micros(F.col(created))).alias("v"),
            gone.alias("deleted"),
            micros(F.col(created)).alias("created"),
        ).alias("state"),
    ).where(F.col("key").isNotNull() & (F.col("key") != ""))
    held = rows.groupBy("parent", "key").agg(F.max("state").alias("state"))
    return held.select("parent", "key", F.col("state.created").alias("born"), F.col("state.deleted").alias("gone"))


def _placed(df: DataFrame, bits: int) -> DataFrame:
    """Adds the two hashes of the key and the number of its range."""
    return (
        df.withColumn("h", F.xxhash64("parent", "key"))
        .withColumn("check", F.xxhash64("key", "parent", F.lit(7)))
        .withColumn("range", F.shiftrightunsigned("h", 64 - bits).cast("int"))
        .drop("parent", "key")
        # sentinels instead of nulls: pandas would turn nullable longs into floats
        .withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in (("created", NONE), ("born", NONE), ("gone", NEVER)) if c in df.columns})
    )


def _probe(refs: pd.DataFrame, parents: pd.DataFrame) -> pd.DataFrame:
    keys = parents["h"].to_numpy()
    order = np.argsort(keys, kind="stable")
    keys, check = keys[order], parents["check"].to_numpy()[order]
    born, gone = parents["born"].to_numpy()[order], parents["gone"].to_numpy()[order]
    h, wanted = refs["h"].to_numpy(), refs["check"].to_numpy()
    at = np.searchsorted(keys, h)
    found = np.zeros(len(h), dtype=bool)
    while True:  # steps over other keys with the same hash; in practice one round
        inside = at < len(keys)
        spot = np.where(inside, at, 0)
        same = inside & (keys[spot] == h) if len(keys) else np.zeros(len(h), dtype=bool)
        found = same & (check[spot] == wanted) if len(keys) else same
        if not (same & ~found).any():
            break
        at = at + (same & ~found)
    created = refs["created"].to_numpy()
    known = created != NONE
    spot = np.where(found, at, 0)
    late = found & known & (born[spot] > created) if len(keys) else found
    deleted = found & known & ~late & (gone[spot] < created) if len(keys) else found
    reason = np.select([~found, late, deleted], ["missing", "late", "deleted"], "")
    miss = reason != ""
    out = refs.loc[miss, ["table_name", "field_name", "record_id"]].copy()
    out["reason"] = reason[miss]
    out["ref_micros"] = refs.loc[miss, "created"]
    return out


def range_bits(ranges: int | None, least: int, rows: int, batch_rows: int) -> int:
    """Bits of the range number: for ``ranges`` if given, else enough ranges for ``rows``, and not more than ``MOST_BITS``."""
    wanted = ranges or max(least, -(-rows // batch_rows))
    return min(max(1, (wanted - 1).bit_length()), MOST_BITS)


def orphan_references(refs: DataFrame, parents: DataFrame, ranges: int | None = None, batch_rows: int = 400_000) -> DataFrame:
    """Misses of ``refs`` (from ``references``) against ``parents`` (from ``parent_keys``).

    Columns: table_name, field_name, record_id, reason, ref_month. reason is ``missing`` (no such
    key), ``late`` (the target was created after the record) or ``deleted`` (the target was deleted
    before the record was created). Repeated rows count once. Null, empty and blank keys are no
    references; a record without created_at can only be ``missing`` and has a null month. Empty
    tables: no references give no rows, no parents make every reference ``missing``.

    ranges: number of key ranges (a power of two is taken); by default four per shuffle partition, and more where
    parents or references are so many that a range would hold more than ``batch_rows`` of them on average.
    batch_rows: most references that are probed at once; hot ranges are split to keep to it. Parents have one row per
    key, so their ranges are even and the number of ranges bounds the array of a task.
    """
    bits = range_bits(ranges, 4 * parallelism(refs.sparkSession), 0 if ranges else max(refs.count(), parents.count()), batch_rows)
    placed = _placed(refs, bits)
    # one row per range, so at most 2^bits rows: this bound is what allows the broadcasts
    sizes = placed.groupBy("range").count().select("range", F.greatest(F.ceil(F.col("count") / batch_rows), F.lit(1)).cast("int").alias("splits"))
    spread = placed.join(F.broadcast(sizes), "range").withColumn("split", F.pmod(F.xxhash64("record_id"), F.col("splits")).cast("int")).drop("splits")
    arrays = _placed(parents, bits).join(F.broadcast(sizes), "range").withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1))).drop("splits")
    misses = spread.groupBy("range", "split").cogroup(arrays.groupBy("range", "split")).applyInPandas(_probe, MISSES)
    month = F.date_format(F.timestamp_add("MICROSECOND", F.nullif(F.col("ref_micros"), F.lit(NONE)), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")), "yyyy-MM")
    return misses.select("table_name", "field_name", "record_id", "reason", month.alias("ref_month")).distinct()


def orphan_report(misses: DataFrame) -> DataFrame:
    """Orphans per table, field, month and reason."""
    return misses.groupBy("table_name", "field_name", "ref_month", "reason").agg(F.count("*").alias("n_orphans"))


