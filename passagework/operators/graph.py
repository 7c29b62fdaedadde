"""Entities and their graph: nodes, co-occurrence edges, and ranking by matched entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions.text import entities, tokens
from passagework.operators.lexical import ranked, small

#: A key is paired with so many following keys of its chunk; share and saturation of the boost.
NEXT_KEYS, CEILING, SATURATION = 3, 0.35, 3.0


def chunk_entities(chunks: DataFrame, named: Callable[[Column], Column] = entities) -> DataFrame:
    """chunk_id, ord, name, key: entities of every passage, as ``named`` finds them; key is the name in lower case."""
    return chunks.select("chunk_id", F.posexplode(named(F.col("content"))).alias("ord", "name")).withColumn("key", F.lower("name"))


def nodes(found: DataFrame) -> DataFrame:
    """key, name, weight: entities with the number of passages they occur in; the name as last spelled (by passage and place)."""
    return found.groupBy("key").agg(F.max_by("name", F.struct("chunk_id", "ord")).alias("name"), F.countDistinct("chunk_id").alias("weight"))


def edges(found: DataFrame) -> DataFrame:
    """source, target, weight: passages in which two keys are at most three apart in the sorted keys of the passage.
    A passage has a bounded number of entities, so the pairs of one stay few."""
    keys = found.groupBy("chunk_id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    near = F.flatten(F.transform("keys", lambda k, i: F.transform(F.slice("keys", i + 2, F.lit(NEXT_KEYS)), lambda t: F.struct(k.alias("source"), t.alias("target")))))
    return keys.select("chunk_id", F.explode(near).alias("e")).groupBy("e.source", "e.target").agg(F.count("*").alias("weight"))


def graph_boost(base: DataFrame, questions: DataFrame, graph: DataFrame, k: int = 5) -> DataFrame:
    """Adds to the first results a boost for the entities of the question.

    base: query_id, chunk_id, score. graph: name, weight, chunk_id (a row per passage an entity refers to). An entity
    matches if one of its words is a term of the question. The boost saturates, and never exceeds a share of the best score.
    """
    terms = questions.select("query_id", F.explode(F.array_distinct(tokens(F.col("question")))).alias("term"))
    named = graph.select("entity", "weight", "chunk_id", F.explode(F.array_distinct(tokens(F.col("name")))).alias("term"))
    matched = named.join(small(terms), "term").select("query_id", "entity", "weight", "chunk_id").distinct()
    affinity = matched.groupBy("query_id", "chunk_id").agg(F.sum(1 + 0.1 * F.least(F.col("weight"), F.lit(5))).alias("a"))
    best = base.groupBy("query_id").agg(F.max("score").alias("best"))
    ceiling = F.when(F.coalesce("best", F.lit(0.0)) > 0, CEILING * F.col("best")).otherwise(CEILING)
    boost = affinity.join(small(best), "query_id", "left").select("query_id", "chunk_id", (ceiling * F.col("a") / (F.col("a") + SATURATION)).alias("boost"))
    both = base.select("query_id", "chunk_id", "score").join(boost, ["query_id", "chunk_id"], "full")
    return ranked(both.select("query_id", "chunk_id", (F.coalesce("score", F.lit(0.0)) + F.coalesce("boost", F.lit(0.0))).alias("score")), k)


def references_of(entities_: DataFrame) -> DataFrame:
    """entity, name, weight, chunk_id: the passages that stored entities refer to; lists that can't be read have none."""
    refs = F.from_json("chunk_refs_json", "array<string>")
    return entities_.dropDuplicates(["id"]).select(F.col("id").alias("entity"), "name", "weight", F.explode(F.array_distinct(F.filter(refs, lambda r: r.isNotNull()))).alias("chunk_id"))


def degrees(edges_: DataFrame) -> DataFrame:
    """entity, out_degree, in_degree, weight of every entity in distinct edges (source, target, weight)."""
    out = edges_.groupBy(F.col("source").alias("entity")).agg(F.count("*").alias("out_degree"), F.sum("weight").alias("w1"))
    into = edges_.groupBy(F.col("target").alias("entity")).agg(F.count("*").alias("in_degree"), F.sum("weight").alias("w2"))
    zero = F.lit(0)
    both = out.join(into, "entity", "full")
    return both.select("entity", F.coalesce("out_degree", zero).alias("out_degree"), F.coalesce("in_degree", zero).alias("in_degree"), (F.coalesce("w1", zero) + F.coalesce("w2", zero)).alias("weight"))


def top_edges(edges_: DataFrame, k: int = 5) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("weight"), "target"))
    return edges_.withColumn("place", n).where(F.col("place") <= k)


def aliases(found: DataFrame, most: int = 6) -> DataFrame:
    """word, alias, place: other words of entities of several words that a word is part of, in order of appearance; the first ``most``."""
    words = found.select(F.struct("chunk_id", "ord").alias("at"), F.array_distinct(tokens(F.col("name"))).alias("ws")).where(F.size("ws") > 1)
    pairs = words.select("at", F.posexplode("ws").alias("i", "word"), "ws").select("at", "word", F.posexplode("ws").alias("j", "alias")).where("word != alias")
    first = pairs.groupBy("word", "alias").agg(F.min(F.struct("at", "j")).alias("at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("word").orderBy("at", "alias"))).where(F.col("place") <= most).select("word", "alias", "place")


def question_aliases(chunks: DataFrame) -> DataFrame:
    """word, alias, place: what questions are widened with, of the first twelve entities of every passage."""
    return aliases(chunk_entities(chunks, lambda content: entities(content, 12)))
