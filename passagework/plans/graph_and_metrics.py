"""Queries on entities, stored vectors, metadata of passages and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions.text import CATEGORIES, category_of, document_type, parent_key, version_of
from passagework.operators import dense, evaluation, graph
from passagework.plans.retrieval import _BASE, _HYBRID, _STOP, GRAPH_SQL, _tok, chunks, graph_ranked, hybrid, judged
from passagework.queries import query
from passagework.session import read_table
from passagework.sources import vectors



#: White space as ``functions.text.SPACE`` has it, for the oracle's engine.
SPACE_SQL = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _first(xs: str) -> str:
    """The distinct values of a list in order of first appearance."""
    return f"list_filter(list_transform(range(len({xs})), lambda i: CASE WHEN list_position({xs}, {xs}[i + 1]) = i + 1 THEN {xs}[i + 1] END), lambda v: v IS NOT NULL)"


def found_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.chunk_entities(chunks(spark, sf_dir))


_WORD = "[A-Z][A-Za-z0-9&.-]*"
#: Letters beyond ASCII join words for the engine, so they become an underscore here.
_ENTITIES = (
    _BASE
    + r""", runs AS (SELECT chunk_id, content, list_filter(regexp_extract_all(regexp_replace(content, '[^\x00-\x7F\p{Z}\p{P}\p{S}\p{C}\p{M}]', '_', 'g'), '\b"""
    + f"{_WORD}(?:{SPACE_SQL}{_WORD}){{0,3}}"
    + r"""\b'), lambda r: length(r) BETWEEN 3 AND 80 AND NOT list_contains("""
    + _STOP
    + f""", lower(r))) AS raw FROM c),
named AS (SELECT chunk_id, {_first('raw')}[1:20] AS xs FROM runs),
often AS (SELECT chunk_id, term, row_number() OVER (PARTITION BY chunk_id ORDER BY count(*) DESC, min(i)) - 1 AS ord
  FROM (SELECT chunk_id, unnest(ts) AS term, unnest(range(len(ts))) AS i FROM (SELECT chunk_id, {_tok("content")} AS ts FROM runs WHERE content IS NOT NULL AND len(raw) = 0)) GROUP BY chunk_id, term QUALIFY ord < 8),
ent AS (SELECT chunk_id, unnest(xs) AS name, unnest(range(len(xs))) AS ord FROM named
  UNION ALL SELECT chunk_id, array_to_string(list_transform(regexp_extract_all(term, '[a-z]+|[^a-z]+'), lambda w: upper(w[1]) || w[2:]), '') AS name, ord FROM often)"""
)


@query("entity_nodes", _ENTITIES + " SELECT lower(name) AS key, arg_max(name, {'c': chunk_id, 'o': ord}) AS name, count(DISTINCT chunk_id) AS weight FROM ent GROUP BY lower(name)")
def entity_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nodes(found_entities(spark, sf_dir))


@query(
    "entity_edges",
    _ENTITIES
    + """, ks AS (SELECT DISTINCT chunk_id, lower(name) AS key FROM ent), n AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY key) AS i FROM ks)
SELECT a.key AS source, b.key AS target, count(*) AS weight FROM n a JOIN n b ON a.chunk_id = b.chunk_id AND b.i - a.i BETWEEN 1 AND 3 GROUP BY ALL""",
)
def entity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(found_entities(spark, sf_dir))


_NAMES = "(SELECT DISTINCT id, name, weight, chunk_refs_json, created_at, resource_id, entity_type FROM rag_graph_entities)"


@query("entity_names", f"SELECT lower(name) AS key, count(*) AS n_rows, count(DISTINCT resource_id) AS n_resources, CAST(sum(weight) AS BIGINT) AS weight, CAST(sum(len(from_json(chunk_refs_json, '[\"VARCHAR\"]'))) AS BIGINT) AS n_refs FROM {_NAMES} GROUP BY ALL")
def entity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored entities by name, with the passages they refer to."""
    rows = read_table(spark, sf_dir, "rag_graph_entities").dropDuplicates(["id"])
    refs = F.size(F.from_json("chunk_refs_json", "array<string>"))
    return rows.groupBy(F.lower("name").alias("key")).agg(F.count("*").alias("n_rows"), F.countDistinct("resource_id").alias("n_resources"), F.sum("weight").cast("long").alias("weight"), F.sum(refs).cast("long").alias("n_refs"))


_EDGES = "e AS (SELECT DISTINCT id, lower(trim(source_entity_id)) AS source, lower(trim(target_entity_id)) AS target, weight FROM rag_graph_edges)"


def stored_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "rag_graph_edges").select("id", F.lower(F.trim("source_entity_id")).alias("source"), F.lower(F.trim("target_entity_id")).alias("target"), "weight")
    return rows.distinct()


@query(
    "entity_degrees",
    f"WITH {_EDGES}, o AS (SELECT source AS entity, count(*) AS od, sum(weight) AS w FROM e GROUP BY ALL), i AS (SELECT target AS entity, count(*) AS id, sum(weight) AS w FROM e GROUP BY ALL) SELECT entity, coalesce(od, 0) AS out_degree, coalesce(i.id, 0) AS in_degree, CAST(coalesce(o.w, 0) + coalesce(i.w, 0) AS BIGINT) AS weight FROM o FULL JOIN i USING (entity)",
)
def entity_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(stored_edges(spark, sf_dir))


@query("strongest_edges", f"WITH {_EDGES} SELECT id, source, target, weight, CAST(row_number() OVER (PARTITION BY source ORDER BY weight DESC, target, id) AS INT) AS place FROM e QUALIFY place <= 5")
def strongest_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("weight"), "target", "id"))
    return stored_edges(spark, sf_dir).withColumn("place", n).where("place <= 5")


@query(
    "graph_topk",
    _BASE + "," + _HYBRID
    + GRAPH_SQL + """
SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS INT) AS rank, round(score, 6) AS score FROM boosted QUALIFY rank <= 5""",
)
def graph_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_ranked(spark, sf_dir).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


_DOC_TYPE = r"""CASE lower(regexp_extract(source_name, '\.([^.]+)$', 1)) WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'document' WHEN 'doc' THEN 'document' WHEN 'txt' THEN 'text' WHEN 'md' THEN 'markdown' WHEN 'csv' THEN 'spreadsheet' WHEN 'xlsx' THEN 'spreadsheet' WHEN 'html' THEN 'web' ELSE modality END"""


@query(
    "chunk_metadata",
    r"""WITH c AS (SELECT id, any_value(content) AS content, any_value(source_name) AS source_name, any_value(modality) AS modality, any_value(file_id) AS file_id, any_value(chunk_index) AS chunk_index FROM document_chunks GROUP BY id),
h AS (SELECT *, substring(regexp_replace(content, '^\s*\d+(\.\d+){0,3}[.)]?\s+([A-Z])', '\2'), 1, 400) AS head FROM c)
SELECT id AS chunk_id, CASE lower(regexp_extract(source_name, '\.([^.]+)$', 1)) WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'document' WHEN 'doc' THEN 'document' WHEN 'txt' THEN 'text' WHEN 'md' THEN 'markdown' WHEN 'csv' THEN 'spreadsheet' WHEN 'xlsx' THEN 'spreadsheet' WHEN 'html' THEN 'web' ELSE modality END AS doc_type,
  coalesce(nullif(file_id, ''), source_name) || ':' || CAST(greatest(coalesce(chunk_index, 0), 0) // 3 AS VARCHAR) AS parent FROM h""",
)
def chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir)
    return rows.select("chunk_id", document_type(F.col("source_name"), F.col("modality")).alias("doc_type"), parent_key(F.col("file_id"), F.col("source_name"), F.col("chunk_index")).alias("parent"))


_CATEGORY = "CASE " + " ".join(f"WHEN list_has_any(words, {list(hints)}) THEN '{name}'" for name, hints in CATEGORIES.items()) + " END"


@query(
    "metadata_profile",
    r"""WITH c AS (SELECT id, any_value(content) AS content, any_value(source_name) AS source_name, any_value(modality) AS modality FROM document_chunks GROUP BY id),
h AS (SELECT *, regexp_extract_all(lower(coalesce(source_name, '')), '[a-z0-9]+') AS words, substring(regexp_replace(coalesce(content, ''), '^\s*\d+(\.\d+){0,3}[.)]?\s+([A-Z])', '\2'), 1, 400) AS head FROM c),
k AS (SELECT """
    + _DOC_TYPE + " AS doc_type, " + _CATEGORY
    + r""" AS category, regexp_matches(head, '(?i)\bv(?:ersion)?[\s.]?(\d+(?:\.\d+){0,3})\b|\b(\d+\.\d+(?:\.\d+){0,2})\b') AS versioned FROM h)
SELECT doc_type, category, versioned, count(*) AS n FROM k GROUP BY ALL""",
)
def metadata_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages by document type, category and whether they name a version."""
    rows = chunks(spark, sf_dir)
    kinds = rows.select(document_type(F.col("source_name"), F.col("modality")).alias("doc_type"), category_of(F.col("source_name"), F.lit(None).cast("string")).alias("category"), version_of(F.col("content")).isNotNull().alias("versioned"))
    return kinds.groupBy("doc_type", "category", "versioned").agg(F.count("*").alias("n"))


_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
_DENSE = f"d AS (SELECT a.vec_id AS query_id, b.vec_id AS item, {_COS} AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item) AS rank FROM d WHERE score > 0)"


def dense_results(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Every vector whose id is divisible by 20 asks all vectors."""
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("v"))
    return dense.dense_topk(rows, rows.where("item % 20 = 0").withColumnRenamed("item", "query_id"), k)


@query("dense_topk", f"WITH {_DENSE} SELECT query_id, item, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM dr WHERE rank <= 8")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_results(spark, sf_dir, 8).select("query_id", "item", "rank", F.round("score", 6).alias("score"))


def label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the same label are relevant to one another."""
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), "label")
    return evaluation.per_query_labelled(dense_results(spark, sf_dir, 10), rows, rows.where("item % 20 = 0").withColumnRenamed("item", "query_id"))


def _metric_sql(k: int) -> str:
    return f"""coalesce(h{k}, 0) / n AS recall_{k}, coalesce(h{k}, 0) / {k} AS precision_{k}, CAST(coalesce(h{k}, 0) > 0 AS INT) AS hit_{k}, coalesce(g{k}, 0) / list_sum(list_transform(range(1, least(n, {k}) + 1), lambda i: 1 / log2(i + 1))) AS ndcg_{k}"""


_COUNTED = ", ".join(f"count_if(rank <= {k}) AS h{k}, sum(CASE WHEN rank <= {k} THEN 1 / log2(rank + 1) ELSE 0 END) AS g{k}" for k in evaluation.CUTS)
_METRICS = f"""WITH {_DENSE}, rel AS (SELECT a.vec_id AS query_id, b.vec_id AS item FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY ALL),
h AS (SELECT query_id, min(rank) AS first, {_COUNTED} FROM dr JOIN rel USING (query_id, item) WHERE rank <= 10 GROUP BY ALL),
m AS (SELECT query_id, coalesce(1.0 / first, 0) AS mrr, {', '.join(map(_metric_sql, evaluation.CUTS))} FROM n LEFT JOIN h USING (query_id))"""


@query("ir_metrics", _METRICS + " SELECT query_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in ["mrr", *(f"{m}_{k}" for k in evaluation.CUTS for m in ("recall", "precision", "ndcg"))]) + ", " + ", ".join(f"hit_{k}" for k in evaluation.CUTS) + " FROM m")
def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = label_metrics(spark, sf_dir)
    return rows.select("query_id", *(F.round(c, 6).alias(c) if not c.startswith("hit") else F.col(c) for c in rows.columns if c != "query_id"))


@query("ir_metrics_average", _METRICS + " SELECT count(*) AS n_queries, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ["mrr", *(f"{m}_{k}" for k in evaluation.CUTS for m in ("recall", "precision", "hit", "ndcg"))]) + " FROM m")
def ir_metrics_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.averaged(label_metrics(spark, sf_dir))


_AVERAGES = ", ".join(f"round(avg({c}), 6) AS {c}" for c in ["mrr", *(f"{m}_{k}" for k in evaluation.CUTS for m in ("recall", "precision", "hit", "ndcg"))])


@query(
    "ir_metrics_by_variant",
    _BASE + "," + _HYBRID
    + f""", rel AS (SELECT query_id, chunk_id FROM (SELECT DISTINCT chunk_id, unnest({_tok("content")}) AS term FROM c) JOIN qt USING (term) GROUP BY ALL HAVING count(*) >= 3),
n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY ALL),
lists AS (SELECT 'lexical' AS variant, query_id, chunk_id, rank FROM hy_r UNION ALL SELECT 'bm25', query_id, chunk_id, rank FROM bmr),
h AS (SELECT variant, query_id, min(rank) AS first, {_COUNTED} FROM lists JOIN rel USING (query_id, chunk_id) WHERE rank <= 10 GROUP BY ALL),
m AS (SELECT variant, query_id, coalesce(1.0 / first, 0) AS mrr, {', '.join(map(_metric_sql, evaluation.CUTS))} FROM (SELECT * FROM n, (VALUES ('lexical'), ('bm25')) v(variant)) LEFT JOIN h USING (variant, query_id))
SELECT variant, count(*) AS n_queries, {_AVERAGES} FROM m GROUP BY variant""",
)
def ir_metrics_by_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical and BM25 rankings against judgements: a passage with at least three terms of the question is relevant."""
    from passagework.plans.retrieval import bm25_ranked

    rel = judged(spark, chunks(spark, sf_dir))
    variants = {"lexical": hybrid(spark, sf_dir, 10), "bm25": bm25_ranked(spark, sf_dir, 10)}
    rows = None
    for name, found in variants.items():
        m = evaluation.per_query(found.withColumnRenamed("chunk_id", "item"), rel).withColumn("variant", F.lit(name))
        rows = m if rows is None else rows.unionByName(m)
    return evaluation.averaged(rows, "variant")


@query(
    "entity_aliases",
    _ENTITIES
    + f""", w AS (SELECT chunk_id, ord, {_first('ts')} AS ws FROM (SELECT chunk_id, ord, {_tok("name")} AS ts FROM ent)),
l AS (SELECT chunk_id, ord, ws, unnest(ws) AS word FROM w WHERE len(ws) > 1), p AS (SELECT chunk_id, ord, word, unnest(ws) AS alias, unnest(range(len(ws))) AS j FROM l),
f AS (SELECT word, alias, min({{'c': chunk_id, 'o': ord, 'j': j}}) AS spot FROM p WHERE word <> alias GROUP BY ALL)
SELECT word, alias, CAST(row_number() OVER (PARTITION BY word ORDER BY spot, alias) AS INT) AS place FROM f QUALIFY place <= 6""",
)
def entity_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.aliases(found_entities(spark, sf_dir))


@query(
    "rank_blend",
    _BASE + "," + _HYBRID
    + """, l AS (SELECT query_id, chunk_id, rank FROM hy_r WHERE rank <= 8), b AS (SELECT query_id, chunk_id, rank FROM bmr WHERE rank <= 8),
u AS (SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) AS score, min(CASE WHEN side = 0 THEN rank END) AS first FROM (SELECT *, 0 AS side FROM l UNION ALL SELECT *, 1 FROM b) GROUP BY ALL)
SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, coalesce(first, 1000000000), chunk_id) AS INT) AS rank, round(score, 6) AS score FROM u QUALIFY rank <= 5""",
)
def rank_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical list blended with a second ranked list, here that of BM25."""
    from passagework.plans.retrieval import bm25_ranked

    rows = dense.blended(hybrid(spark, sf_dir, 8), bm25_ranked(spark, sf_dir, 8))
    return rows.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


_GROUPS = _METRICS.replace("SELECT a.vec_id AS query_id, b.vec_id AS item FROM embeddings a JOIN", "SELECT a.vec_id AS query_id, b.vec_id % 5 AS item, b.vec_id FROM embeddings a JOIN").replace(
    "n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY ALL)", "n AS (SELECT query_id, count(DISTINCT item) AS n FROM rel GROUP BY ALL), gh AS (SELECT dr.query_id, rel.item, min(rank) AS rank FROM dr JOIN rel ON dr.query_id = rel.query_id AND dr.item = rel.vec_id WHERE rank <= 10 GROUP BY ALL)"
).replace("FROM dr JOIN rel USING (query_id, item) WHERE rank <= 10", "FROM gh")


@query("group_metrics", _GROUPS + " SELECT query_id, round(mrr, 6) AS mrr, round(recall_10, 6) AS recall_10, round(precision_10, 6) AS precision_10, round(ndcg_10, 6) AS ndcg_10, hit_1 FROM m")
def group_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics with the relevant vectors in five groups of interchangeable ones."""
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("vec_id") % 5).alias("group_id"))
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label")
    # groups of a question's label, which are few, and the groups of its results, instead of all pairs of a label
    others = rows.groupBy("label", "group_id").agg(F.count("*").alias("m"))
    own = asked.join(others, "label").withColumn("m", F.col("m") - (F.col("query_id") % 5 == F.col("group_id")).cast("int")).where("m > 0")
    found = dense_results(spark, sf_dir, 10).join(rows.withColumnRenamed("vec_id", "item"), "item").join(asked, ["query_id", "label"])
    hits = found.groupBy("query_id", "group_id").agg(F.min("rank").alias("rank"))
    rows = evaluation.per_query(hits.withColumnRenamed("group_id", "item"), own.select("query_id", F.col("group_id").alias("item")), renumber=False)
    return rows.select("query_id", *(F.round(c, 6).alias(c) for c in ("mrr", "recall_10", "precision_10", "ndcg_10")), "hit_1")


@query(
    "job_latency",
    """WITH j AS (SELECT DISTINCT id, status, epoch_us(finished_at) - epoch_us(started_at) AS us FROM ingestion_jobs WHERE finished_at IS NOT NULL AND started_at IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY us) - 1 AS i, count(*) OVER (PARTITION BY status) AS n FROM j)
SELECT DISTINCT status, f AS fraction, us FROM r, (VALUES (0.5::DOUBLE), (0.95::DOUBLE)) t(f) WHERE i = CAST(round_even(f * (n - 1), 0) AS BIGINT)""",
)
def job_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles of the time jobs took, per status."""
    jobs = read_table(spark, sf_dir, "ingestion_jobs").select("id", "status", F.timestamp_diff("MICROSECOND", F.col("started_at"), F.col("finished_at")).alias("us")).distinct().where("us is not null")
    rows = None
    for f in (0.5, 0.95):
        part = evaluation.nearest_rank(jobs, "us", f, "status").select("status", F.lit(f).alias("fraction"), F.col("value").alias("us"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query(
    "vector_backfill",
    """WITH v AS (SELECT id, any_value(embedding_model) AS model, any_value(embedding_dim) AS dim, any_value(embedding_vector) AS blob, any_value(embedding_json) AS js FROM document_chunks WHERE embedding_model IS NOT NULL GROUP BY id),
k AS (SELECT model, CASE WHEN blob IS NOT NULL THEN CASE WHEN octet_length(blob) = 4 * dim THEN 'packed' ELSE 'broken' END WHEN js IS NULL THEN 'none' WHEN json_valid(js) AND json_type(js) = 'ARRAY' AND json_array_length(js) = dim AND NOT contains(js, 'null') THEN 'converted' ELSE 'broken' END AS state FROM v)
SELECT model, state, count(*) AS n FROM k GROUP BY ALL""",
)
def vector_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a conversion of all stored vectors to the packed form finds: vectors that are packed, converted from JSON, or broken."""
    rows = read_table(spark, sf_dir, "document_chunks").where("embedding_model is not null").dropDuplicates(["id"])
    converted = rows.withColumn("made", vectors.pack(vectors.from_text(F.col("embedding_json"))))
    size = 4 * F.col("embedding_dim")
    state = (
        F.when(F.col("embedding_vector").isNotNull(), F.when(F.octet_length("embedding_vector") == size, "packed").otherwise("broken"))
        .when(F.col("embedding_json").isNull(), "none")
        .when(F.octet_length("made") == size, "converted")
        .otherwise("broken")
    )
    return converted.groupBy(F.col("embedding_model").alias("model"), state.alias("state")).agg(F.count("*").alias("n"))
