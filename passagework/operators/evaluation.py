"""Retrieval metrics over ranked results and judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.session import cut_lineage, parallelism

CUTS = (1, 5, 10)


def per_query(results: DataFrame, qrels: DataFrame, cuts: tuple[int, ...] = CUTS, renumber: bool = True) -> DataFrame:
    """Metrics of every judged question: recall_k, precision_k, hit_k, ndcg_k for each cut-off, and mrr.

    results: query_id, item, rank (from 1). qrels: query_id, item. Repeated items keep their best rank and the list is
    ranked anew (unless ``renumber`` is off); the denominator of precision is k, however short the list. Questions
    without results have zeros.
    """
    once = results.groupBy("query_id", "item").agg(F.min("rank").alias("rank"))
    again = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "item"))) if renumber else once
    relevant = qrels.select("query_id", "item").distinct()
    return _metrics(relevant.groupBy("query_id").agg(F.count("*").alias("n")), again.join(relevant, ["query_id", "item"]), cuts)


def per_query_labelled(results: DataFrame, items: DataFrame, questions: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """The metrics of ``per_query`` where an item is relevant if it has the label of the question, and isn't the question itself.

    items: item, label. questions: query_id, label. Relevant items are counted per label and labels compared for the results
    only, so the pairs of a label are never listed. Items without a label are relevant to nothing.
    """
    known = items.where(F.col("label").isNotNull()).select("item", "label").distinct()
    counts = known.groupBy("label").agg(F.count("*").alias("m"))
    own = questions.select("query_id", "label").join(known.select(F.col("item").alias("query_id"), "label", F.lit(1).alias("self")), ["query_id", "label"], "left")
    n = own.join(counts, "label").select("query_id", (F.col("m") - F.coalesce("self", F.lit(0))).alias("n")).where("n > 0")
    once = results.where("query_id != item").groupBy("query_id", "item").agg(F.min("rank").alias("rank"))
    again = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "item")))
    return _metrics(n, again.join(questions.select("query_id", "label"), "query_id").join(known, ["item", "label"]), cuts)


def _metrics(n: DataFrame, found: DataFrame, cuts: tuple[int, ...]) -> DataFrame:
    """Metrics from the number of relevant items (query_id, n) and the ranks of those found (query_id, rank)."""
    hits = found.groupBy("query_id")
    sums = []
    for k in cuts:
        inside = F.col("rank") <= k
        sums += [F.count_if(inside).alias(f"h{k}"), F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"g{k}")]
    rows = n.join(hits.agg(F.min("rank").alias("first"), *sums), "query_id", "left")
    out = [F.col("query_id"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr")]
    for k in cuts:
        h, g = F.coalesce(f"h{k}", F.lit(0)), F.coalesce(f"g{k}", F.lit(0.0))
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
        out += [(h / F.col("n")).alias(f"recall_{k}"), (h / k).alias(f"precision_{k}"), (h > 0).cast("int").alias(f"hit_{k}"), (g / ideal).alias(f"ndcg_{k}")]
    return rows.select(*out)


def averaged(metrics: DataFrame, *by: str) -> DataFrame:
    """Macro-averages over the judged questions."""
    names = [c for c in metrics.columns if c not in ("query_id", *by)]
    return metrics.groupBy(*by).agg(F.count("*").alias("n_queries"), *(F.round(F.avg(c), 6).alias(c) for c in names))


def group_hits(results: DataFrame, groups: DataFrame) -> DataFrame:
    """query_id, group_id, rank: rank of the first hit of every group of interchangeable items. The groups of a
    question are taken to be disjoint, so every rank hits at most one."""
    return results.join(groups, ["query_id", "item"]).groupBy("query_id", "group_id").agg(F.min("rank").alias("rank"))


def per_query_groups(results: DataFrame, groups: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """The metrics of ``per_query`` with groups of interchangeable items in the place of items: a group counts once, at its first hit."""
    hits = group_hits(results, groups).select("query_id", F.col("group_id").alias("item"), "rank")
    return per_query(hits, groups.select("query_id", F.col("group_id").alias("item")), cuts, renumber=False)


def nearest_rank(values: DataFrame, column: str, fraction: float, *by: str) -> DataFrame:
    """by, value: the value at position round-half-even(fraction * (n - 1)) of the sorted values of a group; nulls don't count.

    Values are range-partitioned; counts per partition tell which partition holds a group's position, and only inside it
    rows are numbered. So a group that holds most rows is spread over all tasks.
    """
    n = parallelism(values.sparkSession)
    rows = values.where(F.col(column).isNotNull()).select(*by, F.col(column).alias("value")).groupBy(*by, "value").agg(F.count("*").alias("n"))
    placed = cut_lineage(rows.repartitionByRange(n, *by, "value").withColumn("__part", F.spark_partition_id()))
    parts = placed.groupBy(*by, "__part").agg(F.sum("n").alias("m"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))  # at most one row per partition and group
    ahead = F.coalesce(F.sum("m").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spot = F.bround(F.lit(fraction) * (F.sum("m").over(w) - 1)).cast("long")
    where = parts.select(*by, "__part", "m", ahead.alias("__ahead"), spot.alias("__spot")).where("__spot >= __ahead and __spot < __ahead + m").drop("m")
    inner = Window.partitionBy(*by, "__part").orderBy("value")
    found = placed.join(where, [*by, "__part"]).withColumn("__to", F.col("__ahead") + F.sum("n").over(inner))
    return found.where("__spot < __to and __spot >= __to - n").select(*by, "value")
