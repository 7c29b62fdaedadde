"""The most similar vectors of every vector.

A forest of random-projection trees is fitted on a bounded sample. Every vector walks all
trees at once with one priority queue: first to the leaf it belongs to in each tree, then to
the leaves behind the cuts it passed most closely, whichever tree they are in. Vectors meet
in leaves, where half-precision products pick candidates; the candidates are reranked with
the full vectors in double precision.

Equal vectors are collapsed first: each distinct vector goes through the forest once with
its smallest ids, which are the only copies that can be among anybody's k most similar.
Further copies get the finished list of their class by a salted join.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.session import cut_lineage, salted_lookup


@dataclass(frozen=True)
class Forest:
    """Parameters of the index. ``sample`` bounds the vectors per model that trees are fitted on (all are
    indexed); ``leaf_rows`` is the aimed size of a leaf, ``max_leaf`` the most members one task compares."""

    trees: int = 6
    extra_leaves: int = 6
    leaf_rows: int = 512
    max_leaf: int = 8192
    sample: int = 40_000
    seed: int = 5


def _numbers(blob: bytes | None, text: str | None, dim: int) -> np.ndarray | None:
    """The vector of a row as doubles, or None: the packed form if it is sound, else the JSON form."""
    for form, value in (("packed", blob), ("json", text)):
        if value is None:
            continue
        try:
            v = np.frombuffer(value, "<f4").astype("float64") if form == "packed" else np.array(json.loads(value), dtype="float64")
        except (ValueError, TypeError):
            continue
        if v.shape == (dim,) and np.isfinite(v).all() and v.any():
            return v
    return None


def decode_vectors(df: DataFrame, id_col: str = "id", packed: str = "embedding_vector", text: str = "embedding_json", model: str = "embedding_model", dim: str = "embedding_dim") -> DataFrame:
    """id, model, v (float32 little-endian, scaled to length 1) of every row whose vector can be decoded, has ``dim``
    finite values and isn't all zero. Rows without id, model or dim have none."""
    schema = pa.schema([("id", pa.string()), ("model", pa.string()), ("v", pa.binary())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for rid, kind, blob, js, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                v = _numbers(blob, js, n)
                if v is not None:
                    v = v / np.abs(v).max()  # so that squares neither vanish nor overflow
                    rows.append((rid, kind, (v / np.sqrt(v @ v)).astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 3, schema, strict=True)], schema=schema)

    named = df.select(F.col(id_col).cast("string").alias("id"), F.col(model).alias("model"), F.col(packed).alias("p"), F.col(text).alias("t"), F.col(dim).cast("int").alias("d"))
    return named.where("id is not null and model is not null and d > 0").select("id", "model", "p", "t", "d").mapInArrow(decode, "id string, model string, v binary")


def _distinct(vectors: DataFrame, copies: int) -> DataFrame:
    """model, key, v, ids: distinct vectors with their ``copies`` smallest ids. The limit acts before the shuffle,
    so a vector that a third of all rows share brings a handful of rows."""
    keyed = vectors.distinct().withColumn("key", F.xxhash64("model", "v"))
    few = keyed.withColumn("n", F.row_number().over(Window.partitionBy("model", "key").orderBy("id"))).where(F.col("n") <= copies)
    return few.groupBy("model", "key").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("id")).alias("ids"))


def _grow(x: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A tree of 2^depth leaves in heap order: normals and offsets of its cuts. A cut lies between two random
    points of its cell, moved to the cell's median, so leaves are of equal size."""
    normals = np.zeros((2**depth - 1, x.shape[1]), dtype="float32")
    offsets = np.zeros(2**depth - 1, dtype="float32")
    cells = [np.arange(len(x))]
    for node in range(2**depth - 1):
        cell = cells[node]
        if len(cell) > 1:
            a, b = x[rng.choice(cell, 2, replace=False)]
            normal = a - b
        else:
            normal = rng.standard_normal(x.shape[1])
        size = np.linalg.norm(normal)
        normals[node] = normal / size if size else rng.standard_normal(x.shape[1])
        along = x[cell] @ normals[node]
        offsets[node] = np.median(along) if len(cell) else 0
        cells += [cell[along <= offsets[node]], cell[along > offsets[node]]]
    return normals, offsets


def _visit(x: np.ndarray, trees: list[tuple[np.ndarray, np.ndarray]], depth: int, extra: int) -> np.ndarray:
    """Leaves (tree * 2^depth + leaf) that each row of x visits: its own one of every tree, then ``extra`` more in
    the order of one priority queue over all trees, whose key is the widest margin of a cut crossed on the way."""
    n, last = len(x), 2**depth - 1
    visited = np.zeros((n, len(trees) + extra), dtype="int64")
    width = (len(trees) + extra) * max(depth, 1)
    queue = np.full((n, width), np.inf, dtype="float32")
    where = np.zeros((n, width), dtype="int64")
    normals, offsets = np.stack([t[0] for t in trees]), np.stack([t[1] for t in trees])
    rows, fill = np.arange(n), 0

    def descend(tree: np.ndarray, node: np.ndarray, cost: np.ndarray) -> np.ndarray:
        nonlocal fill
        for _ in range(depth):
            inner = node < last
            at = np.where(inner, node, 0)
            margin = np.einsum("nd,nd->n", x, normals[tree, at]) - offsets[tree, at]
            right = margin > 0
            queue[:, fill] = np.where(inner, np.maximum(cost, np.abs(margin)), np.inf)
            where[:, fill] = tree * (2 * last + 1) + 2 * at + np.where(right, 1, 2)
            fill += 1
            node = np.where(inner, 2 * at + np.where(right, 2, 1), node)
        return tree * (last + 1) + node - last

    for t in range(len(trees)):
        visited[:, t] = descend(np.full(n, t), np.zeros(n, dtype="int64"), np.zeros(n, dtype="float32"))
    for e in range(extra):
        if not depth:
            visited[:, len(trees) + e] = -1
            continue
        best = queue.argmin(axis=1)
        cost = queue[rows, best].copy()
        queue[rows, best] = np.inf
        entry = where[rows, best]
        leaf = descend(entry // (2 * last + 1), entry % (2 * last + 1), cost)
        visited[:, len(trees) + e] = np.where(np.isfinite(cost), leaf, -1)
    return visited


def slack(dim: int) -> float:
    """How far two half-precision products of vectors of length 1 may be off together: each component is rounded by at most
    2^-11 of itself (2^-25 near zero), and the sum is taken in single precision."""
    return 2 * (2.0**-10 + 2.0**-22 + dim**0.5 * 2.0**-24 + dim * 2.0**-23)


def _compare(k: int, floor: float):
    """Partners of every query within one leaf that may be among its k best: all within ``slack`` of the k-th."""

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys = rows["key"].to_numpy()
        x = np.frombuffer(b"".join(rows["v"]), "<f2").reshape(len(rows), -1).astype("float32")
        at = np.flatnonzero(rows["member"].to_numpy())
        members, names, out, off = x[at], keys[at], [], slack(x.shape[1])
        for start in range(0, len(x) if len(at) else 0, 2048):
            sims = x[start : start + 2048] @ members.T
            sims[keys[start : start + 2048, None] == names[None, :]] = -2
            if floor <= -1 and sims.shape[1] > k:
                edge = np.partition(sims, -k, axis=1)[:, -k]
                q, m = np.nonzero((sims >= edge[:, None] - off) & (sims > -2))
            else:
                q, m = np.nonzero(sims >= max(floor, -1.5))
            out.append(pd.DataFrame({"key": keys[start + q], "other": names[m], "sim": sims[q, m]}))
        if not out:
            return pd.DataFrame({"key": np.array([], "int64"), "other": np.array([], "int64"), "sim": np.array([], "float32")})
        found = pd.concat(out)
        if len(found) > k:
            found = found.sort_values(["key", "sim"], ascending=[True, False], kind="stable")
            last = found[found.groupby("key").cumcount() == k - 1].set_index("key")["sim"]
            found = found[found["sim"] >= found["key"].map(last).fillna(-9.0) - off]
        return found

    return compare


def _rerank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sims = []
        for a, b in zip(batch["v"], batch["w"], strict=True):
            p, q = np.frombuffer(a, "<f4").astype("float64"), np.frombuffer(b, "<f4").astype("float64")
            sims.append(float(p @ q) / float(np.sqrt((p @ p) * (q @ q))))
        yield batch[["key", "other", "ids", "others"]].assign(sim=np.array(sims, dtype="float64"))


def most_similar(vectors: DataFrame, k: int = 5, at_least: float | None = None, forest: Forest = Forest()) -> DataFrame:
    """id, other, similarity, place (1..k): the k most similar vectors of the same model of every vector of
    ``decode_vectors``; with ``at_least``, only those at least so similar.

    Approximate: neighbours that share no visited leaf are missed. Similarities are exact; equal ones are ordered
    by id. Repeated rows count once. A vector alone in its model has no neighbours; no vectors give no rows.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "id string, other string, similarity double, place int")
    points = cut_lineage(_distinct(vectors, k + 1))
    counts = {r["model"]: (r["n"], r["d"]) for r in points.groupBy("model").agg(F.count("*").alias("n"), F.max(F.octet_length("v") / 4).cast("int").alias("d")).collect()}
    if not counts:
        return empty
    grown: dict[str, tuple[list, int, int, int]] = {}
    for number, (model, (n, _)) in enumerate(sorted(counts.items())):
        every = max(1, -(-n // forest.sample))
        near = points.where((F.col("model") == model) & (F.pmod("key", F.lit(every)) == 0)).select("v").limit(forest.sample).toPandas()["v"]
        x = np.frombuffer(b"".join(near), "<f4").reshape(len(near), -1)
        depth = max(0, min(int(np.ceil(np.log2(max(1, n / forest.leaf_rows)))), int(np.log2(max(1, len(x) / 8)))))
        rng = np.random.default_rng(forest.seed)
        splits = max(1, -(-n // (2**depth * forest.max_leaf)))
        grown[model] = ([_grow(x, depth, rng) for _ in range(forest.trees)], depth, splits, number)
    # 4 bytes per dimension and leaf; leaves are bounded by the sample, whatever the number of rows
    shared = spark.sparkContext.broadcast(grown)
    extra = forest.extra_leaves

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for big in batches:
            for model, batch in big.groupby("model"):
                trees, depth, splits, number = shared.value[model]
                for start in range(0, len(batch), 4096):
                    some = batch.iloc[start : start + 4096]
                    x = np.frombuffer(b"".join(some["v"]), "<f4").reshape(len(some), -1)
                    leaves = _visit(x, trees, depth, extra)
                    half = [r.tobytes() for r in x.astype("<f2")]
                    keys = some["key"].to_numpy()
                    for s in range(splits):
                        row, col = np.nonzero(leaves >= 0)
                        member = (col < len(trees)) & (keys[row] % splits == s)
                        yield pd.DataFrame({"leaf": (number * 2**40 + leaves[row, col]) * splits + s, "key": keys[row], "member": member, "v": [half[i] for i in row]})

    floor = -1.0 if at_least is None else at_least - 0.01  # half precision errs by less
    met = points.select("model", "key", "v").mapInPandas(place, "leaf long, key long, member boolean, v binary")
    pairs = met.groupBy("leaf").applyInPandas(_compare(k, floor), "key long, other long, sim float")
    numbered = pairs.groupBy("key", "other").agg(F.max("sim").alias("sim")).withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("sim"), "other")))
    # what half precision can't tell from the k-th best is left to the exact products
    off = slack(max(d for _, d in counts.values()))
    best = numbered.withColumn("last", F.min(F.when(F.col("n") <= k, F.col("sim"))).over(Window.partitionBy("key"))).where(F.col("sim") >= F.col("last") - F.lit(off))
    a = points.select("key", "v", "ids")
    b = points.select(F.col("key").alias("other"), F.col("v").alias("w"), F.col("ids").alias("others"))
    reranked = best.select("key", "other").join(a, "key").join(b, "other").select("key", "other", "v", "w", "ids", "others").mapInPandas(_rerank, "key long, other long, ids array<string>, others array<string>, sim double")
    between = reranked.select("key", "ids", F.explode("others").alias("other"), "sim")
    copies = points.where(F.size("ids") > 1).select("key", "ids", F.explode("ids").alias("other"), F.lit(1.0).alias("sim"))
    listed = between.unionByName(copies).select(F.explode("ids").alias("id"), "other", "sim").where("id != other")
    if at_least is not None:
        listed = listed.where(F.col("sim") >= at_least)
    ranked = listed.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "other"))).where(F.col("place") <= k)
    ranked = ranked.select("id", "other", F.col("sim").alias("similarity"), "place")
    crowds = points.where(F.size("ids") > k).select("key", "ids", F.element_at("ids", -1).alias("id"))
    if crowds.isEmpty():
        return ranked
    # the last of a class's k + 1 ids has k copies before it, so its list is that of every further copy
    ranked = cut_lineage(ranked)
    lists = ranked.join(crowds, "id").groupBy("key").agg(F.first("ids").alias("ids"), F.collect_list(F.struct("other", "similarity", "place")).alias("list"))
    members = vectors.select("id", F.xxhash64("model", "v").alias("key")).distinct()
    further = salted_lookup(members, lists, "key", "id").where(~F.array_contains("ids", F.col("id")))
    return ranked.unionByName(further.select("id", F.inline("list")))


def mutual_pairs(similar: DataFrame) -> DataFrame:
    """id_a < id_b where each is in the other's list."""
    ways = similar.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b"), (F.col("id") < F.col("other")).alias("way"))
    return ways.groupBy("id_a", "id_b").agg(F.countDistinct("way").alias("ways")).where("ways = 2").select("id_a", "id_b")
