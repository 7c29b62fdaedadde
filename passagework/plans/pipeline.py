"""Queries of the many-stage retrieval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.operators import evaluation, precision
from passagework.operators import lexical as lex
from passagework.operators.graph import question_aliases
from passagework.operators.questions import expanded
from passagework.plans.retrieval import chat_questions, chunks, judged, questions, scanned
from passagework.queries import query
from passagework.session import cut_lineage


@query("precision_pipeline")
def precision_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = precision.retrieve(chunks(spark, sf_dir), questions(spark))
    return rows.select("query_id", "place", "chunk_id", F.round("score", 6).alias("score"), F.round("rerank", 6).alias("rerank"), F.round("fused", 6).alias("fused"), F.char_length("context").alias("context_chars"))


@query("precision_trace")
def precision_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return precision.trace(precision.retrieve(chunks(spark, sf_dir), questions(spark)))


@query("ir_metrics_ablation")
def ir_metrics_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each group of stages adds; a passage with at least three terms of the question is relevant."""
    rows = scanned(spark, sf_dir)
    relevant = cut_lineage(judged(spark, rows))
    corpus = precision.corpus_of(rows)
    found = [evaluation.per_query(precision.retrieve(corpus, questions(spark), settings=s).select("query_id", F.col("chunk_id").alias("item"), F.col("place").alias("rank")), relevant).withColumn("variant", F.lit(name)) for name, s in precision.ABLATION.items()]
    return evaluation.averaged(reduce(DataFrame.unionByName, found), "variant")


@query("expanded_questions")
def expanded_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of every chat question, and what is added to them."""
    return expanded(chat_questions(spark, sf_dir), aliases=question_aliases(chunks(spark, sf_dir))).select("query_id", "term", F.round("weight", 6).alias("weight"), "origin", "place")


@query("bm25_expanded")
def bm25_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 with widened questions, the additions capped."""
    rows = chunks(spark, sf_dir)
    stats = lex.term_stats(rows)
    terms = expanded(questions(spark), vocabulary=stats, aliases=question_aliases(rows)).withColumn("typed", F.col("origin") == "typed")
    return lex.ranked(lex.capped(lex.bm25(rows, terms)), 10).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("guarded_filters")
def guarded_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that remain for each question after the filters it states."""
    marked = precision.with_metadata(chunks(spark, sf_dir), 3)
    categories = [r["category"] for r in marked.where("category is not null").select("category").distinct().collect()]
    asked = precision.inferred_filters(questions(spark), categories)
    terms = lex.question_terms(questions(spark))
    pool = lex.postings(chunks(spark, sf_dir), terms).join(lex.small(terms), "term").select("query_id", "chunk_id").distinct()
    pool = pool.join(lex.small(asked), "query_id").join(marked.select("chunk_id", "version", "doc_type", "category"), "chunk_id")
    return precision.guarded(pool, 12).groupBy("query_id", "applied").agg(F.count("*").alias("n"))
