"""Listings over the relational tables: filters, paging, groupwise newest rows, merges and permissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.operators.lexical import small


def live(df: DataFrame, deleted: str = "deleted_at") -> DataFrame:
    return df.where(F.col(deleted).isNull())


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row per key: the first in ``order``. Pre-aggregated as a limit within each task before the shuffle."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def has_vector(packed: str = "embedding_vector", text: str = "embedding_json") -> Column:
    return F.col(packed).isNotNull() | F.col(text).isNotNull()


def paged(df: DataFrame, *order: Column, offset: int = 0, limit: int = 0, allowed: tuple[str, ...] = (), sort_by: str | None = None) -> DataFrame:
    """A page in a total order; limit 0 means all rows. ``sort_by`` must be one of ``allowed``."""
    if sort_by is not None:
        if sort_by not in allowed:
            raise ValueError(f"can't sort by {sort_by!r}; one of {', '.join(allowed)} is expected")
        order = (F.col(sort_by), *order)
    page = df.orderBy(*order)
    page = page.offset(max(0, offset)) if offset > 0 else page
    return page.limit(limit) if limit > 0 else page


def missing(asked: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Keys that are asked for and aren't known, each once; null keys are not asked for."""
    return asked.where(F.col(key).isNotNull()).select(key).distinct().join(known.select(key), key, "left_anti")


def with_children(parents: DataFrame, children: DataFrame, key: str, *order: str) -> DataFrame:
    """Parents that have children, with these as an array of structs sorted by ``order``. The array of a parent is one value, so
    this is for listings of bounded parents; counts and pages of large ones come from ``paged``."""
    listed = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("children"))
    return parents.join(listed, key)


def clamped_limit(limit: int, most: int = 100) -> int:
    return max(1, min(limit, most))


def search_people(df: DataFrame, words: str, first: str, last: str, others: tuple[str, ...] = ()) -> DataFrame:
    """One word: in any column. Two: the first in the first name and the second in the last name. More: the first
    two together in the first name, the last in the last name. Case doesn't count; % and _ are wildcards."""
    parts = words.split()
    if not parts:
        return df
    if len(parts) == 1:
        hit = F.lit(False)
        for c in (first, last, *others):
            hit = hit | F.coalesce(F.col(c).ilike(f"%{words}%"), F.lit(False))
        return df.where(hit)
    lead = parts[0] if len(parts) == 2 else " ".join(parts[:2])
    return df.where(F.col(first).ilike(f"%{lead}%") & F.col(last).ilike(f"%{parts[-1]}%"))


def merged(current: DataFrame, incoming: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Snapshot after an upsert: rows of ``incoming`` are inserted or replace those of the same key; rows it doesn't
    have stay but become inactive. Result: keys, values, active, change (inserted, updated, kept, deactivated)."""
    old = current.select(*keys, F.struct(*values).alias("old"), F.lit(True).alias("__a"))
    new = incoming.select(*keys, F.struct(*values).alias("new"), F.lit(True).alias("__b"))
    both = old.join(new, keys, "full")
    change = F.when(F.col("__a").isNull(), "inserted").when(F.col("__b").isNull(), "deactivated").when(F.col("old").eqNullSafe(F.col("new")), "kept").otherwise("updated")
    return both.select(*keys, F.when(F.col("__b").isNotNull(), F.col("new")).otherwise(F.col("old")).alias("v"), F.col("__b").isNotNull().alias("active"), change.alias("change")).select(*keys, "v.*", "active", "change")


def effective_permissions(user_roles: DataFrame, role_permissions: DataFrame, implies: DataFrame) -> DataFrame:
    """user, permission: granted by a role, implied by one that is (permission, implied), or made up of parts that are
    all held (relational division)."""
    direct = user_roles.join(role_permissions, "role").select("user", "permission").distinct()
    implied = direct.join(small(implies), "permission").select("user", F.col("implied").alias("permission"))
    held = direct.unionByName(implied).distinct()
    parts = implies.groupBy("permission").agg(F.collect_set("implied").alias("parts"), F.count("*").alias("n"))
    whole = held.withColumnRenamed("permission", "implied").join(small(implies), "implied").groupBy("user", "permission").agg(F.countDistinct("implied").alias("m"))
    complete = whole.join(small(parts), "permission").where("m = n").select("user", "permission")
    return held.unionByName(complete).distinct()


def progress(done: Column, total: Column, status: Column) -> Column:
    """Percent of a job: 100 only once it has succeeded, at most 95 before."""
    part = F.floor(F.coalesce(F.try_divide(done * 95, total), F.lit(0.0))).cast("int")
    return F.when(status == "succeeded", 100).otherwise(F.least(F.lit(95), F.greatest(F.lit(0), part)))


def purge(tables: dict[str, DataFrame], resource: DataFrame, column: str = "resource_id") -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without the rows of the given resources (column ``resource_id``), and the number of rows removed from each."""
    kept, counts = {}, None
    for name, df in tables.items():
        gone = resource.select(F.col("resource_id").alias(column)).distinct()
        kept[name] = df.join(gone, column, "left_anti")
        n = df.join(gone, column, "left_semi").agg(F.count("*").alias("removed")).select(F.lit(name).alias("table_name"), "removed")
        counts = n if counts is None else counts.unionByName(n)
    return kept, counts
