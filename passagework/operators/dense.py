"""Cosine ranking of stored vectors for a set of question vectors, in blocks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Question vectors that are compared in one pass over the stored vectors; bounds what is broadcast.
BLOCK = 4096


def dense_topk(vectors: DataFrame, asked: DataFrame, k: int = 8, dim: int | None = None, positive: bool = True) -> DataFrame:
    """query_id, item, score, rank: the k stored vectors (item, v array<float>) most similar to each question vector
    (query_id, v), itself left out (query_id = item). Vectors of another dimension, with a zero norm or values that aren't finite,
    score nothing. Each pass compares one block of questions with all vectors and keeps k per question and task."""
    spark = vectors.sparkSession
    blocks = [b for b, in asked.select(F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-asked.count() // BLOCK)))).alias("b")).distinct().collect()]
    out = []
    n = max(1, len(blocks))
    for b in blocks:
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b).toPandas() if n > 1 else asked.toPandas()
        q = [np.asarray(v, dtype="float64") for v in part["v"]]
        size = dim or (len(q[0]) if q else 0)
        good = [i for i, v in enumerate(q) if v.shape == (size,) and np.isfinite(v).all() and v.any()]
        if not good:
            continue
        matrix = np.stack([q[i] / np.linalg.norm(q[i]) for i in good])
        shared = spark.sparkContext.broadcast((part["query_id"].to_numpy()[good], matrix))

        def compare(batches: Iterator[pd.DataFrame], shared=shared, size=size) -> Iterator[pd.DataFrame]:
            names, matrix = shared.value
            for batch in batches:
                v = [np.asarray(x, dtype="float64") if x is not None else np.zeros(0) for x in batch["v"]]
                ok = [i for i, x in enumerate(v) if x.shape == (size,) and np.isfinite(x).all() and x.any()]
                if not ok:
                    continue
                x = np.stack([v[i] / np.linalg.norm(v[i]) for i in ok])
                items = batch["item"].to_numpy()[ok]
                sims = matrix @ x.T
                keep = min(k + 1, sims.shape[1])
                best = np.argpartition(-sims, keep - 1, axis=1)[:, :keep]
                rows = np.repeat(np.arange(len(names)), keep)
                yield pd.DataFrame({"query_id": names[rows], "item": items[best.ravel()], "score": sims[rows, best.ravel()]})

        kind = vectors.schema["item"].dataType.simpleString()
        out.append(vectors.select("item", "v").mapInPandas(compare, f"query_id {asked.schema['query_id'].dataType.simpleString()}, item {kind}, score double"))
    if not out:
        return spark.createDataFrame([], f"query_id {asked.schema['query_id'].dataType.simpleString()}, item {vectors.schema['item'].dataType.simpleString()}, score double, rank int")
    rows = reduce(DataFrame.unionByName, out).where("query_id != item")
    rows = rows.where("score > 0") if positive else rows
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "item")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Least similarity that counts as evidence, by model family; and where no family is known.
FLOORS, FLOOR = {"embeddinggemma": 0.20}, 0.62


def floor_of(model: Column) -> Column:
    """Least similarity of a model's vectors that counts as evidence; a tag behind a colon doesn't matter."""
    known = F.create_map(*(x for pair in FLOORS.items() for x in map(F.lit, pair)))
    return F.coalesce(F.try_element_at(known, F.lower(F.substring_index(model, ":", 1))), F.lit(FLOOR))


def blended(lexical: DataFrame, dense: DataFrame, k: int = 5, rrf_k: int = 60) -> DataFrame:
    """query_id, chunk_id, score, rank: both ranked lists fused by reciprocal rank, ties in the lexical order. Questions
    without dense results keep their lexical list as it is."""
    lists = lexical.select("query_id", "chunk_id", "rank", "score", F.lit(0).alias("side")).unionByName(dense.select("query_id", "chunk_id", "rank", "score", F.lit(1).alias("side")))
    both = F.max("side").over(Window.partitionBy("query_id")) == 1
    rows = lists.withColumn("both", both).groupBy("query_id", "chunk_id").agg(
        F.sum(1.0 / (rrf_k + F.col("rank"))).alias("fused"), F.max(F.when(F.col("side") == 0, F.col("score"))).alias("own"), F.coalesce(F.min(F.when(F.col("side") == 0, F.col("rank"))), F.lit(10**9)).alias("first"), F.first("both").alias("both")
    )
    scored = rows.select("query_id", "chunk_id", "first", F.when(F.col("both"), F.col("fused")).otherwise(F.col("own")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "first", "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("first")
