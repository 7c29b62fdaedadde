"""Queries that cut documents into passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions.text import contextual, title_of
from passagework.operators import chunking
from passagework.queries import query
from passagework.session import read_table

_SPACE = r"[\s\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_NORMAL = f"d AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, trim(regexp_replace(text, '{_SPACE}', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL)"


def _characters(d: str) -> str:
    """CTEs up to ``cut`` for normalised texts d(doc_id, t): windows of 1200 with an overlap of 180, one after another;
    p is the place of the last full stop, from the window's end."""
    return f"""WITH RECURSIVE {d},
w AS (
  SELECT doc_id, t, n, 0 AS s, CASE WHEN n <= 1200 THEN n WHEN p > 0 AND 1199 - p > 600 THEN 1200 - p ELSE 1200 END AS e
  FROM (SELECT doc_id, t, length(t) AS n, strpos(reverse(substring(t, 1, 1200)), ' .') AS p FROM d WHERE t <> '')
  UNION ALL
  SELECT doc_id, t, n, s2, CASE WHEN n - s2 <= 1200 THEN n WHEN p > 0 AND 1199 - p > 600 THEN s2 + 1200 - p ELSE s2 + 1200 END
  FROM (SELECT doc_id, t, n, greatest(0, e - 180) AS s2, strpos(reverse(substring(t, greatest(0, e - 180) + 1, 1200)), ' .') AS p FROM w WHERE e < n)),
piece AS (SELECT doc_id, s, substring(t, s + 1, e - s) AS raw FROM w),
cut AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INT) AS chunk_index, CAST(s + length(raw) - length(ltrim(raw)) AS INT) AS "start",
  CAST(s + length(rtrim(raw)) AS INT) AS "end", trim(raw) AS content FROM piece WHERE trim(raw) <> '')"""


_CHARACTER = _characters(_NORMAL) + " SELECT * FROM cut"
#: Lines of the documents as pages, ``ps``: page, its text and its place in the joined text.
_PAGES = f"""p AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(range(len(ls))) AS page, unnest(ls) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
n AS (SELECT doc_id, page, trim(regexp_replace(t, '{_SPACE}', ' ', 'g')) AS t FROM p),
ps AS (SELECT doc_id, t, CAST(page AS INT) AS page, CAST(coalesce(sum(length(t) + 1) OVER w, 0) AS INT) AS "start", CAST(coalesce(sum(length(t) + 1) OVER w, 0) + length(t) AS INT) AS "end" FROM n WHERE t <> ''
  WINDOW w AS (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _cut(strategy: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return chunking.cut(read_table(spark, sf_dir, "documents"), strategy)

    return run


for _s in chunking.STRATEGIES[:3]:
    query(f"chunk_{_s}", _CHARACTER if _s == "character" else None)(_cut(_s))


def _line_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").where("text is not null")
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("page", "text"))


@query("page_spans", "WITH " + _PAGES + ' SELECT doc_id, page, "start", "end" FROM ps')
def page_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents, taken as pages, and their places in the joined text."""
    return chunking.page_spans(_line_pages(spark, sf_dir)).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")


@query(
    "pages_of_passages",
    _characters(_PAGES + ", d AS (SELECT doc_id, string_agg(t, ' ' ORDER BY page) AS t FROM ps GROUP BY doc_id)")
    + """ SELECT c.doc_id, chunk_index, min(page) AS page_start, max(page) AS page_end FROM cut c LEFT JOIN ps ON c.doc_id = ps.doc_id AND ps."start" < c."end" AND ps."end" > c."start" GROUP BY ALL""",
)
def pages_of_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last page of every passage of the joined texts."""
    joined = chunking.page_spans(_line_pages(spark, sf_dir))
    cut = chunking.cut(joined, "character")
    first, last = chunking.pages_of(F.col("spans"), F.col("start"), F.col("end"))
    return cut.join(joined.select("doc_id", "spans"), "doc_id").select("doc_id", "chunk_index", first.alias("page_start"), last.alias("page_end"))


@query("titled_passages")
def titled_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages with the header that their terms are counted with."""
    docs = read_table(spark, sf_dir, "documents").where("text is not null")
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "source", "file_name", "modality", title_of(F.col("text"), F.col("file_name")).alias("title"))
    cut = chunking.cut(docs, "sentence")
    return cut.join(named, "doc_id").select("doc_id", "chunk_index", "title", contextual(F.col("source"), F.col("file_name"), F.col("title"), F.col("modality"), F.col("chunk_index"), F.col("content")).alias("contextual"))


@query("indexing_settings", """WITH f AS (SELECT DISTINCT id, updated_at, chunk_size, chunk_overlap, chunk_strategy FROM files),
s AS (SELECT id, updated_at, greatest(200, least(4000, coalesce(chunk_size, 1200))) AS size, chunk_overlap, chunk_strategy FROM f)
SELECT id AS file_id, updated_at, size, greatest(0, least(coalesce(chunk_overlap, 180), size // 2)) AS overlap, CASE WHEN lower(trim(chunk_strategy)) IN ('character', 'sentence', 'paragraph', 'page') THEN lower(trim(chunk_strategy)) ELSE 'character' END AS strategy FROM s""")
def indexing_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of every version of a file, within their bounds."""
    size, overlap, strategy = chunking.settings(F.col("chunk_size"), F.col("chunk_overlap"), F.col("chunk_strategy"))
    rows = read_table(spark, sf_dir, "files").select("id", "updated_at", "chunk_size", "chunk_overlap", "chunk_strategy").distinct()
    return rows.select(F.col("id").alias("file_id"), "updated_at", size.alias("size"), overlap.alias("overlap"), strategy.alias("strategy"))


@query(
    "chunk_page",
    _characters(_PAGES + ", d AS (SELECT doc_id || '/' || page AS doc_id, t FROM ps)")
    + """ SELECT ps.doc_id, CAST(row_number() OVER (PARTITION BY ps.doc_id ORDER BY page, chunk_index) - 1 AS INT) AS chunk_index, CAST(ps."start" + c."start" AS INT) AS "start",
  CAST(ps."start" + c."end" AS INT) AS "end", content FROM cut c JOIN ps ON c.doc_id = ps.doc_id || '/' || page""",
)
def chunk_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One passage per page (here per line), longer pages cut by characters."""
    return chunking.cut(chunking.page_spans(_line_pages(spark, sf_dir)), "page", spans_col="spans")
