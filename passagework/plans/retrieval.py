"""Queries that rank passages for questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagework.functions.keys import norm_key
from passagework.functions.text import STOPWORDS, best_sentence, mode_of, tokens
from passagework.operators import graph
from passagework.operators import lexical as lex
from passagework.queries import query
from passagework.session import cut_lineage, read_table

#: The questions the ranking queries are run with; each is scored against all passages.
QUESTIONS = (
    (1, "Which vacation request needs approval before the notice period ends?"),
    (2, "How does the scheduler restart the retry loop after a rollback?"),
    (3, "table of contents and row count of the spreadsheet"),
    (4, "invoice and payment run at the end of the quarter"),
    (5, "Does the catalyst change the sediment?"),
    (6, "zebra quantum bicycle"),
)


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "query_id int, question string")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lex.chunks_of(read_table(spark, sf_dir, "document_chunks"))


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages as they are stored, repeated rows too; for operators that drop these after the scan."""
    return lex.chunks_of(read_table(spark, sf_dir, "document_chunks"), distinct=False)


def judged(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """query_id, item: a passage with at least three terms of the question in its content is relevant."""
    terms = lex.question_terms(questions(spark)).select("query_id", "term")
    inside = rows.select(F.col("chunk_id").alias("item"), F.explode(F.array_distinct(tokens(F.col("content")))).alias("term"))
    return inside.join(lex.small(terms), "term").distinct().groupBy("query_id", "item").count().where("count >= 3").select("query_id", "item")


_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def _tok(col: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({col}, '[A-Za-z0-9][A-Za-z0-9_-]{{1,}}'), lambda t: lower(t)), lambda t: NOT list_contains({_STOP}, t))"


_Q = "q AS (SELECT * FROM (VALUES " + ", ".join("({}, '{}')".format(i, t.replace("'", "''")) for i, t in QUESTIONS) + ") t(query_id, question))"
_BASE = f"""WITH {_Q},
c AS (SELECT id AS chunk_id, any_value(contextual_content) AS contextual, any_value(content) AS content, any_value(title) AS title, any_value(modality) AS modality,
  any_value(source_name) AS source_name, any_value(file_id) AS file_id, any_value(chunk_index) AS chunk_index, any_value(page_start) AS page_start FROM document_chunks GROUP BY id),
toks AS (SELECT chunk_id, {_tok("contextual")} AS ts FROM c),
len AS (SELECT chunk_id, len(ts) AS length FROM toks),
post AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(ts) AS term FROM toks) GROUP BY ALL),
stats AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, greatest(0.0, ln(1 + ((SELECT count(*) FROM c) - count(*) + 0.5) / (count(*) + 0.5))) AS idf FROM post GROUP BY term),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_tok("question")}) AS term FROM q) GROUP BY ALL),
wanted AS (SELECT query_id, count(*) AS wanted FROM qt GROUP BY ALL),
bm AS (SELECT query_id, chunk_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / (SELECT avg(length) FROM len)))) AS score
  FROM qt JOIN post USING (term) JOIN stats USING (term) JOIN len USING (chunk_id) GROUP BY ALL),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bm WHERE score > 0)"""


def _lexical_sql(name: str, q: str, weight: str, boost: str = "1.0") -> str:
    """Two CTEs: ``name``, the scores for a table q(query_id, question), and ``name_r`` with ranks."""
    return f"""
{name}_t AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_tok("question")}) AS term FROM {q}) GROUP BY ALL),
{name}_h AS (SELECT query_id, chunk_id, sum(tf * {weight}) AS product, count(*) AS overlap, list(term) AS common FROM {name}_t JOIN post USING (term) GROUP BY ALL),
{name} AS (SELECT h.query_id, chunk_id, chunk_index, overlap,
  (product / sqrt(greatest(length, 1)) + 3.0 * overlap / (SELECT count(*) FROM {name}_t w WHERE w.query_id = h.query_id)
   + CASE WHEN contains(lower(contextual), lower(question)) THEN 2.0 ELSE 0 END
   + CASE WHEN len(list_filter(common, lambda t: contains(lower(coalesce(title, '')), t))) > 0 THEN 0.5 ELSE 0 END) * {boost} AS score
  FROM {name}_h h JOIN c USING (chunk_id) JOIN len USING (chunk_id) JOIN {q} USING (query_id)),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_index, chunk_id) AS rank FROM {name})"""


_HYBRID = _lexical_sql("hy", "q", "qtf")


@query("bm25_topk", _BASE + " SELECT query_id, chunk_id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM bmr WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_ranked(spark, sf_dir, 10).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def bm25_ranked(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    terms = lex.question_terms(questions(spark)).select("query_id", "term", F.lit(1.0).alias("weight"), F.lit(True).alias("typed"))
    scores = lex.bm25(scanned(spark, sf_dir), terms).select("query_id", "chunk_id", F.col("typed").alias("score")).where("score > 0")
    return lex.ranked(scores, k)


_KEYED = "lower(trim({0}, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(8203) || chr(65279)))"
_SCOPED = f"""WITH s AS (SELECT DISTINCT id AS query_id, {_KEYED.format('brain')} AS scope, user_query AS question FROM chat_history WHERE id IS NOT NULL AND user_query IS NOT NULL AND brain IS NOT NULL),
t AS (SELECT DISTINCT query_id, scope, term FROM (SELECT query_id, scope, unnest({_tok("question")}) AS term FROM s)),
c AS (SELECT id AS chunk_id, any_value({_KEYED.format('resource_id')}) AS scope, {_tok("any_value(contextual_content)")} AS ts FROM document_chunks GROUP BY id),
z AS (SELECT scope, count(*) AS n, avg(len(ts)) AS mean FROM c GROUP BY ALL),
p AS (SELECT scope, chunk_id, length, term, count(*) AS tf FROM (SELECT scope, chunk_id, len(ts) AS length, unnest(ts) AS term FROM c) GROUP BY ALL),
d AS (SELECT scope, term, count(*) AS df FROM p GROUP BY ALL),
b AS (SELECT query_id, chunk_id, sum(greatest(0.0, ln(1 + (n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM t JOIN p USING (scope, term) JOIN d USING (scope, term) JOIN z USING (scope) GROUP BY ALL)
SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS INT) AS rank, round(score, 6) AS score FROM b WHERE score > 0 QUALIFY rank <= 5"""


@query("bm25_scoped", _SCOPED)
def bm25_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chat question asked of the resource it was put to."""
    named = read_table(spark, sf_dir, "chat_history").where("id is not null and user_query is not null and brain is not null")
    asked = named.select(F.col("id").alias("query_id"), norm_key(F.col("brain")).alias("scope"), F.col("user_query").alias("question")).distinct()
    rows = scanned(spark, sf_dir).withColumn("scope", norm_key(F.col("resource_id")))
    return lex.scoped_bm25(rows, asked, 5).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("term_stats", _BASE + " SELECT term, df, cf, round(idf, 6) AS idf FROM stats")
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lex.term_stats(scanned(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


@query("corpus_stats", _BASE + " SELECT count(*) AS n_chunks, round(avg(length), 6) AS mean_length, max(length) AS longest, CAST(count_if(length = 0) AS BIGINT) AS empty FROM len")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = lex.lengths(scanned(spark, sf_dir))
    return length.agg(F.count("*").alias("n_chunks"), F.round(F.avg("length"), 6).alias("mean_length"), F.max("length").cast("long").alias("longest"), F.count_if(F.col("length") == 0).alias("empty"))


def hybrid(spark: SparkSession, sf_dir: str, k: int, qs: DataFrame | None = None, **kw: bool) -> DataFrame:
    return lex.ranked(lex.lexical(scanned(spark, sf_dir), qs if qs is not None else questions(spark), **kw), k, "chunk_index", "chunk_id")


@query("lexical_hybrid", _BASE + "," + _HYBRID + " SELECT query_id, chunk_id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM hy_r WHERE rank <= 5")
def lexical_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid(spark, sf_dir, 5).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


_MULTI = """CASE WHEN (modality = 'table' AND len(list_intersect({asked}, ['table','row','column','csv','data','dataset','spreadsheet','total','average','count'])) > 0)
  OR (modality = 'image' AND len(list_intersect({asked}, ['image','photo','picture','screenshot','diagram','chart','figure'])) > 0)
  OR (modality = 'audio' AND len(list_intersect({asked}, ['audio','voice','recording','transcript','timestamp','video'])) > 0) THEN 1.8
  WHEN modality IN ('pdf', 'text') THEN 1.1 ELSE 1.0 END""".format(asked="(SELECT list(term) FROM qt WHERE qt.query_id = h.query_id)")
_MM = _lexical_sql("mm", "q", "1", _MULTI)


@query("multimodal_topk", _BASE + "," + _MM + " SELECT query_id, chunk_id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM mm_r WHERE rank <= 5")
def multimodal_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid(spark, sf_dir, 5, counted=False, boost=True).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


_VARIANTS = f"""SELECT query_id, unnest(range(len(vs))) AS variant_no, unnest(vs) AS variant FROM (
  SELECT query_id, list_filter(list_transform(range(len(raw)), lambda i: CASE WHEN list_position(raw, raw[i + 1]) = i + 1 THEN raw[i + 1] END), lambda v: v IS NOT NULL) AS vs FROM (
    SELECT query_id, list_filter([question, array_to_string(ts, ' ')] || CASE WHEN len(ts) > 2 THEN [array_to_string(list_reverse(ts), ' '), array_to_string(ts[1:3], ' ')] ELSE [] END, lambda v: v <> '') AS raw FROM (
      SELECT query_id, question, list_filter(list_transform(range(len(t)), lambda i: CASE WHEN list_position(t, t[i + 1]) = i + 1 THEN t[i + 1] END), lambda v: v IS NOT NULL) AS ts
      FROM (SELECT query_id, question, {_tok("question")} AS t FROM %s))))"""


@query("query_variants", "WITH qs AS (SELECT DISTINCT id AS query_id, user_query AS question FROM chat_history WHERE user_query IS NOT NULL AND id IS NOT NULL) " + _VARIANTS % "qs")
def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = read_table(spark, sf_dir, "chat_history").where("user_query is not null and id is not null").select(F.col("id").alias("query_id"), F.col("user_query").alias("question")).distinct()
    return lex.query_variants(asked).withColumn("variant_no", F.col("variant_no").cast("long"))


def fusion(spark: SparkSession, sf_dir: str, k: int, qs: DataFrame | None = None) -> DataFrame:
    """Every variant of a question brings its first eight passages; they are fused by rank."""
    variants = lex.query_variants(questions(spark) if qs is None else qs).withColumn("query_id", F.struct("query_id", "variant_no")).withColumnRenamed("variant", "question")
    numbered = variants.select((F.col("query_id.query_id") * 10 + F.col("query_id.variant_no")).alias("query_id"), "question")
    lists = hybrid(spark, sf_dir, 8, numbered).withColumn("query_id", F.floor(F.col("query_id") / 10).cast("int"))
    return lex.ranked(lex.rrf(lists), k)


_FUSION = f""",
v AS (SELECT query_id * 10 + variant_no AS query_id, variant AS question FROM ({_VARIANTS % "q"})),{_lexical_sql("fv", "v", "qtf")},
fu AS (SELECT query_id // 10 AS query_id, chunk_id, sum(1.0 / (60 + rank)) AS score FROM fv_r WHERE rank <= 8 GROUP BY ALL),
fu_r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM fu)"""


@query("rrf_fusion", _BASE + _FUSION + " SELECT CAST(query_id AS INT) AS query_id, chunk_id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM fu_r WHERE rank <= 5")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion(spark, sf_dir, 5).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def _cover_sql(top: int) -> str:
    return f"""cov AS (SELECT query_id, coalesce((SELECT max(score) FROM hy_r r WHERE r.query_id = q.query_id AND rank <= 5), 0) AS best,
  coalesce((SELECT count(DISTINCT qt.term) FROM qt JOIN post USING (term) JOIN hy_r r USING (chunk_id) WHERE qt.query_id = q.query_id AND r.query_id = q.query_id AND rank <= {top}) / (SELECT wanted FROM wanted w WHERE w.query_id = q.query_id), 0) AS covered FROM q)"""


@query("evidence_gate", _BASE + "," + _HYBRID + "," + _cover_sql(3) + " SELECT query_id, round(best, 6) AS best, round(covered, 6) AS covered, covered >= 0.35 AND best > 0 AS sufficient FROM cov")
def evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cover = lex.sufficient(lex.coverage(scanned(spark, sf_dir), questions(spark), hybrid(spark, sf_dir, 5), 3))
    return cover.select("query_id", F.round("best", 6).alias("best"), F.round("covered", 6).alias("covered"), "sufficient")


@query(
    "evidence_grade",
    _BASE + "," + _HYBRID + "," + _cover_sql(5) + " SELECT query_id, round(covered, 6) AS covered, CASE WHEN covered >= 0.65 AND best >= 1 THEN 'strong' WHEN covered >= 0.35 THEN 'moderate' ELSE 'weak' END AS grade FROM cov",
)
def evidence_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    cover = lex.graded(lex.coverage(scanned(spark, sf_dir), questions(spark), hybrid(spark, sf_dir, 5), 5))
    return cover.select("query_id", F.round("covered", 6).alias("covered"), "grade")


def corrective(spark: SparkSession, sf_dir: str, first: DataFrame | None = None, fused: DataFrame | None = None, qs: DataFrame | None = None) -> DataFrame:
    """The lexical list where it covers the question, the fused one elsewhere; both are given or made here."""
    qs = questions(spark) if qs is None else qs
    first = hybrid(spark, sf_dir, 5, qs) if first is None else first
    fused = fusion(spark, sf_dir, 5, qs) if fused is None else fused
    gate = lex.sufficient(lex.coverage(scanned(spark, sf_dir), qs, first, 3)).select("query_id", "sufficient")
    cols = ["query_id", "chunk_id", "rank", "score"]
    good = first.join(gate.where("sufficient"), "query_id").select(*cols, F.lit("lexical").alias("path"))
    return good.unionByName(fused.join(gate.where("not sufficient"), "query_id").select(*cols, F.lit("fusion").alias("path")))


@query(
    "corrective_select",
    _BASE + "," + _HYBRID + "," + _cover_sql(3) + _FUSION
    + " SELECT query_id, chunk_id, CAST(rank AS INT) AS rank, round(score, 6) AS score, 'lexical' AS path FROM hy_r WHERE rank <= 5 AND query_id IN (SELECT query_id FROM cov WHERE covered >= 0.35 AND best > 0)"
    + " UNION ALL SELECT CAST(query_id AS INT), chunk_id, CAST(rank AS INT), round(score, 6), 'fusion' FROM fu_r WHERE rank <= 5 AND query_id IN (SELECT query_id FROM cov WHERE NOT (covered >= 0.35 AND best > 0))",
)
def corrective_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrective(spark, sf_dir).withColumn("score", F.round("score", 6))


_CHATQ = "(SELECT DISTINCT id AS query_id, user_query AS question FROM chat_history WHERE user_query IS NOT NULL AND id IS NOT NULL)"
_GAP = f""", asked AS (SELECT DISTINCT query_id, term, min(pos) OVER (PARTITION BY query_id, term) AS pos FROM (SELECT query_id, unnest(ts) AS term, unnest(range(len(ts))) AS pos FROM (SELECT query_id, {_tok("question")} AS ts FROM {_CHATQ})))"""


def chat_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "chat_history").where("user_query is not null and id is not null").select(F.col("id").alias("query_id"), F.col("user_query").alias("question")).distinct()


@query("vocabulary_gap", _BASE + _GAP + " SELECT query_id, term, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos) AS INT) AS place FROM asked ANTI JOIN stats USING (term) QUALIFY place <= 6")
def vocabulary_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lex.vocabulary_gap(chat_questions(spark, sf_dir), scanned(spark, sf_dir))


@query(
    "spelling",
    _BASE + _GAP
    + ", unknown AS (SELECT DISTINCT term FROM asked ANTI JOIN stats USING (term) WHERE length(term) >= 5), near AS (SELECT u.term, s.term AS correction FROM unknown u JOIN stats s ON abs(length(u.term) - length(s.term)) <= 1 AND s.cf >= 2 AND levenshtein(u.term, s.term) <= 1)"
    + " SELECT term, min(correction) AS correction FROM near GROUP BY term HAVING count(*) = 1",
)
def spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = chat_questions(spark, sf_dir).select(F.explode(tokens(F.col("question"))).alias("term"))
    return lex.spelling(asked, lex.term_stats(scanned(spark, sf_dir)))


@query(
    "prf_terms",
    _BASE
    + """, fb AS (SELECT query_id, p.term, sum(tf / length * idf) AS weight FROM bmr JOIN post p USING (chunk_id) JOIN len USING (chunk_id) JOIN stats s ON s.term = p.term
  WHERE rank <= 5 AND length(p.term) >= 3 AND NOT EXISTS (SELECT 1 FROM qt WHERE qt.query_id = bmr.query_id AND qt.term = p.term) GROUP BY ALL)
SELECT query_id, term, round(weight, 6) AS weight, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(weight, 9) DESC, term) AS INT) AS place FROM fb WHERE weight > 0 QUALIFY place <= 6""",
)
def prf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lex.feedback_terms(scanned(spark, sf_dir), bm25_ranked(spark, sf_dir, 5), questions(spark))
    return found.withColumn("weight", F.round("weight", 6))


@query(
    "citations",
    _BASE + "," + _HYBRID
    + " SELECT query_id, CAST(rank AS INT) AS rank, chunk_id, source_name, page_start, round(score, 4) AS score, substring(content, 1, 300) AS snippet FROM hy_r JOIN c USING (chunk_id) WHERE rank <= 5",
)
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = hybrid(spark, sf_dir, 5).select("query_id", "chunk_id", "rank", "score")
    texts = chunks(spark, sf_dir).select("chunk_id", "source_name", "page_start", F.substring("content", 1, 300).alias("snippet"))
    return texts.join(lex.small(first), "chunk_id").select("query_id", "rank", "chunk_id", "source_name", "page_start", F.round("score", 4).alias("score"), "snippet")


@query("extractive_answer")
def extractive_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, answer: the best sentence of each of the first results, as a list."""
    first = hybrid(spark, sf_dir, 5).select("query_id", "chunk_id", "rank")
    asked = questions(spark).select("query_id", F.array_distinct(tokens(F.col("question"))).alias("terms"))
    rows = chunks(spark, sf_dir).join(lex.small(first), "chunk_id").join(lex.small(asked), "query_id")
    lines = rows.select("query_id", F.struct("rank", best_sentence(F.col("content"), F.col("terms")).alias("s"), F.substring("content", 1, 260).alias("more")).alias("line"))
    listed = lines.groupBy("query_id").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    again = F.transform("lines", lambda x, i: F.when(F.exists(F.slice("lines", F.lit(1), i), lambda y: y["s"] == x["s"]), x["more"]).otherwise(x["s"]))
    return listed.select("query_id", F.array_join(F.transform(again, lambda s: F.concat(F.lit("- "), s)), "\n").alias("answer"))


#: Tables up to ``boosted``: the first eight lexical results and what entities of the question add.
GRAPH_SQL = r""", ent AS (SELECT DISTINCT id AS entity, name, weight, chunk_refs_json FROM rag_graph_entities),
refs AS (SELECT DISTINCT entity, name, weight, unnest(from_json(chunk_refs_json, '["VARCHAR"]')) AS chunk_id FROM ent),
words AS (SELECT DISTINCT entity, lower(unnest(regexp_extract_all(name, '[A-Za-z0-9][A-Za-z0-9_-]{1,}'))) AS term FROM ent),
matched AS (SELECT DISTINCT query_id, entity, weight, chunk_id FROM words JOIN qt USING (term) JOIN refs USING (entity)),
aff AS (SELECT query_id, chunk_id, sum(1 + 0.1 * least(weight, 5)) AS a FROM matched GROUP BY ALL),
base AS (SELECT query_id, chunk_id, score FROM hy_r WHERE rank <= 8),
boosted AS (SELECT coalesce(b.query_id, a.query_id) AS query_id, coalesce(b.chunk_id, a.chunk_id) AS chunk_id,
  coalesce(score, 0) + coalesce((CASE WHEN coalesce((SELECT max(score) FROM base x WHERE x.query_id = a.query_id), 0) > 0 THEN 0.35 * (SELECT max(score) FROM base x WHERE x.query_id = a.query_id) ELSE 0.35 END) * a / (a + 3.0), 0) AS score
  FROM base b FULL JOIN aff a ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id)"""


def graph_ranked(spark: SparkSession, sf_dir: str, k: int = 5, base: DataFrame | None = None, qs: DataFrame | None = None) -> DataFrame:
    """The lexical results with a boost for passages that entities of the question refer to."""
    refs = graph.references_of(read_table(spark, sf_dir, "rag_graph_entities"))
    qs = questions(spark) if qs is None else qs
    return graph.graph_boost(hybrid(spark, sf_dir, 8, qs) if base is None else base, qs, refs, k)


def agentic(spark: SparkSession, sf_dir: str, k: int = 7, qs: DataFrame | None = None) -> DataFrame:
    """Several rankings as weighted tools, merged by share of the tool's best score and rank; then a penalty for
    sources that were already picked. Within a source the results come in descending order, so the
    greedy choice is a sort by score less 0.15 per better result of the source."""
    graph = F.lower("question").rlike(r"\b(relat|connect|between|depend|link)")
    kinds = F.lower("question").rlike(r"\b(table|row|column|spreadsheet|image|figure|diagram|chart|audio|recording)\b")
    qs = questions(spark) if qs is None else qs
    weights = qs.select("query_id", F.when(kinds, 1.35).otherwise(0.75).alias("multi"), F.when(graph, 1.35).otherwise(0.85).alias("graph"))
    cols = ["query_id", "chunk_id", "rank", "score"]
    # at most 13 rows per question, used by several tools
    first, fused = cut_lineage(hybrid(spark, sf_dir, 8, qs).select(*cols)), cut_lineage(fusion(spark, sf_dir, 5, qs).select(*cols))
    tools = [
        (first, F.lit(1.0)),
        (fused, F.lit(1.25)),
        (corrective(spark, sf_dir, first.where("rank <= 5"), fused, qs).select(*cols), F.lit(1.15)),
        (hybrid(spark, sf_dir, 5, qs, counted=False, boost=True).select(*cols), F.col("multi")),
        (graph_ranked(spark, sf_dir, base=first, qs=qs).select(*cols), F.col("graph")),
    ]
    rows = reduce(DataFrame.unionByName, [t.join(lex.small(weights), "query_id").select(*cols, w.alias("weight"), F.lit(i).alias("tool")) for i, (t, w) in enumerate(tools)])
    share = F.col("score") / F.max("score").over(Window.partitionBy("query_id", "tool")) * F.col("weight") + 1.0 / (F.col("rank") + 4)
    merged = rows.withColumn("score", share).groupBy("query_id", "chunk_id").agg(F.sum("score").alias("score"))
    sourced = merged.join(chunks(spark, sf_dir).select("chunk_id", "source_name"), "chunk_id")
    place = F.row_number().over(Window.partitionBy("query_id", "source_name").orderBy(F.desc(F.round("score", 9)), "chunk_id"))
    return lex.ranked(sourced.withColumn("score", F.col("score") - 0.15 * (place - 1)), k)


_AGENTIC = (
    _BASE + "," + _HYBRID + "," + _MM + "," + _cover_sql(3) + _FUSION
    + GRAPH_SQL
    + r""", gr AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank, score FROM boosted),
w AS (SELECT query_id, CASE WHEN regexp_matches(lower(question), '\b(relat|connect|between|depend|link)') THEN 1.35 ELSE 0.85 END AS graph, CASE WHEN regexp_matches(lower(question), '\b(table|row|column|spreadsheet|image|figure|diagram|chart|audio|recording)\b') THEN 1.35 ELSE 0.75 END AS multi FROM q),
tools AS (SELECT query_id, chunk_id, rank, score, 1.0 AS weight, 0 AS tool FROM hy_r WHERE rank <= 8
  UNION ALL SELECT query_id, chunk_id, rank, score, 1.25, 1 FROM fu_r WHERE rank <= 5
  UNION ALL SELECT query_id, chunk_id, rank, score, 1.15, 2 FROM hy_r WHERE rank <= 5 AND query_id IN (SELECT query_id FROM cov WHERE covered >= 0.35 AND best > 0)
  UNION ALL SELECT query_id, chunk_id, rank, score, 1.15, 2 FROM fu_r WHERE rank <= 5 AND query_id IN (SELECT query_id FROM cov WHERE NOT (covered >= 0.35 AND best > 0))
  UNION ALL SELECT query_id, chunk_id, rank, score, multi, 3 FROM mm_r JOIN w USING (query_id) WHERE rank <= 5
  UNION ALL SELECT query_id, chunk_id, rank, score, graph, 4 FROM gr JOIN w USING (query_id) WHERE rank <= 5),
shared AS (SELECT query_id, chunk_id, score / max(score) OVER (PARTITION BY query_id, tool) * weight + 1.0 / (rank + 4) AS score FROM tools),
merged AS (SELECT query_id, chunk_id, source_name, sum(score) AS score FROM shared JOIN c USING (chunk_id) GROUP BY ALL),
pen AS (SELECT query_id, chunk_id, score - 0.15 * (row_number() OVER (PARTITION BY query_id, source_name ORDER BY round(score, 9) DESC, chunk_id) - 1) AS score FROM merged)"""
)


@query(
    "agentic_merge",
    _AGENTIC + " SELECT CAST(query_id AS INT) AS query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS INT) AS rank, round(score, 6) AS score FROM pen QUALIFY rank <= 7",
)
def agentic_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agentic(spark, sf_dir).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query(
    "vocabulary_hint",
    _BASE + _GAP
    + """, missing AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS place FROM asked ANTI JOIN stats USING (term) QUALIFY place <= 6)
SELECT query_id, ' ' || string_agg('**' || term || '**', ', ' ORDER BY place) || CASE count(*) WHEN 1 THEN ' does not appear' ELSE ' do not appear' END || ' anywhere in this document.' AS hint FROM missing GROUP BY query_id""",
)
def vocabulary_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said to a chat question with words that no passage has."""
    return lex.vocabulary_hint(vocabulary_gap(spark, sf_dir))


#: How each question wants to be ranked, as a user writes it.
ASKED_MODES = ((1, "agentic-rag"), (2, " RAG-Fusion "), (3, "multi_modal"), (4, "Graph-RAG"), (5, "CORRECTIVE"), (6, "by hand"))


def rankers(spark: SparkSession, sf_dir: str) -> dict:
    from passagework.operators import precision

    return {
        "contextual_hybrid": lambda qs: hybrid(spark, sf_dir, 5, qs),
        "rag_fusion": lambda qs: fusion(spark, sf_dir, 5, qs),
        "graph_rag": lambda qs: graph_ranked(spark, sf_dir, qs=qs),
        "corrective": lambda qs: corrective(spark, sf_dir, qs=qs),
        "multi_modal": lambda qs: hybrid(spark, sf_dir, 5, qs, counted=False, boost=True),
        "agentic_rag": lambda qs: agentic(spark, sf_dir, qs=qs),
        "high_precision": lambda qs: precision.retrieve(chunks(spark, sf_dir), qs).withColumnRenamed("place", "rank"),
    }


@query(
    "mode_dispatch",
    _AGENTIC
    + """, ranks AS (SELECT query_id, 'agentic_rag' AS mode, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank, score FROM pen WHERE query_id = 1 QUALIFY rank <= 7
  UNION ALL SELECT query_id, 'rag_fusion', chunk_id, rank, score FROM fu_r WHERE query_id = 2 AND rank <= 5
  UNION ALL SELECT query_id, 'multi_modal', chunk_id, rank, score FROM mm_r WHERE query_id = 3 AND rank <= 5
  UNION ALL SELECT query_id, 'graph_rag', chunk_id, rank, score FROM gr WHERE query_id = 4 AND rank <= 5
  UNION ALL SELECT query_id, 'corrective', chunk_id, rank, score FROM hy_r WHERE query_id = 5 AND rank <= 5 AND EXISTS (SELECT 1 FROM cov WHERE cov.query_id = 5 AND covered >= 0.35 AND best > 0)
  UNION ALL SELECT query_id, 'corrective', chunk_id, rank, score FROM fu_r WHERE query_id = 5 AND rank <= 5 AND EXISTS (SELECT 1 FROM cov WHERE cov.query_id = 5 AND NOT (covered >= 0.35 AND best > 0))
  UNION ALL SELECT query_id, 'contextual_hybrid', chunk_id, rank, score FROM hy_r WHERE query_id = 6 AND rank <= 5)
SELECT CAST(query_id AS INT) AS query_id, mode, chunk_id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM ranks""",
)
def mode_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question ranked in the mode it asks for; an unknown mode is the first one."""
    modes = spark.createDataFrame(ASKED_MODES, "query_id int, asked string").withColumn("mode", mode_of(F.col("asked")))
    wanted = {r["mode"] for r in modes.select("mode").distinct().collect()}  # at most as many as there are modes
    ranked = lex.by_mode(questions(spark).join(modes, "query_id"), {m: r for m, r in rankers(spark, sf_dir).items() if m in wanted})
    return ranked.withColumn("score", F.round("score", 6))
