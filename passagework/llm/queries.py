"""Queries of the subpackage, and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm import conversations as conv
from passagework.llm import encoding, mixing, neighbours, pairs, personal, splitting, subjects
from passagework.session import cut_lineage, read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_BLANK = "({0} IS NULL OR NOT regexp_matches({0}, '[\\p{{L}}\\p{{N}}]'))"
_SPACES = "' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(8203) || chr(65279)"

_CONVERSATIONS = f"""
WITH states AS (
  SELECT DISTINCT id, user_id, user_query, bot_response, timestamp,
    CASE WHEN NOT {_BLANK.format('chat_id')} THEN trim(chat_id, {_SPACES}) END AS chat_id,
    NOT {_BLANK.format('bot_response')} AS answered FROM chat_history),
rows AS (SELECT * FROM states QUALIFY row_number() OVER (PARTITION BY id ORDER BY answered DESC, bot_response DESC) = 1),
messages AS (
  SELECT chat_id, id, timestamp, 0 AS part, 'user' AS speaker, 0 AS late FROM rows WHERE NOT {_BLANK.format('user_query')}
  UNION ALL
  SELECT chat_id, id, timestamp, 1, 'assistant', CASE WHEN {_BLANK.format('user_query')} THEN 1 ELSE 0 END FROM rows WHERE answered),
ordered AS (
  SELECT chat_id, id, speaker, row_number() OVER w - 1 AS msg_no, lead(speaker) OVER w AS next_speaker
  FROM messages WHERE chat_id IS NOT NULL AND timestamp IS NOT NULL
  WINDOW w AS (PARTITION BY chat_id ORDER BY timestamp, late, id, part)),
kept AS (
  SELECT chat_id FROM ordered GROUP BY chat_id
  HAVING bool_and(speaker = CASE WHEN msg_no % 2 = 0 THEN 'user' ELSE 'assistant' END) AND count(*) % 2 = 0
  INTERSECT SELECT chat_id FROM rows WHERE chat_id IS NOT NULL GROUP BY chat_id HAVING count(*) = count(timestamp) AND count(DISTINCT user_id) <= 1)
"""


@query("p1_found", _CONVERSATIONS + "SELECT chat_id, CAST(msg_no AS INT) AS msg_no, speaker, id FROM ordered SEMI JOIN kept USING (chat_id)")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.conversations(read_table(spark, sf_dir, "chat_history"))


@query(
    "p1_pairs",
    _CONVERSATIONS
    + """, next AS (SELECT id, CASE WHEN lead(speaker) OVER w = 'assistant' THEN lead(id) OVER w END AS reply_id, speaker FROM messages
  WHERE chat_id IS NOT NULL AND timestamp IS NOT NULL WINDOW w AS (PARTITION BY chat_id ORDER BY timestamp, late, id, part))
SELECT id, reply_id FROM next WHERE speaker = 'user'
UNION ALL SELECT id, CASE WHEN answered THEN id END FROM rows WHERE (chat_id IS NULL OR timestamp IS NULL) AND NOT """
    + _BLANK.format("user_query"),
)
def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.pair_rows(read_table(spark, sf_dir, "chat_history"))


@query("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = neighbours.decode_vectors(read_table(spark, sf_dir, "document_chunks"))
    return neighbours.mutual_pairs(neighbours.most_similar(vectors, k=5, at_least=0.90))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = personal.texts_of(read_table(spark, sf_dir, "document_chunks"), "document_chunks", "content")
    return chunks.unionByName(personal.texts_of(read_table(spark, sf_dir, "chat_history"), "chat_history", "user_query"))


@query("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.find_mentions(_texts(spark, sf_dir))
    return found.select(F.col("source").alias("source_table"), "row_id", F.col("start").alias("start_pos"), "pii_type")


@query("p3_redacted")
def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir)
    return personal.redact(texts, personal.find_mentions(texts))


_LIMITS = f"""
WITH held AS (SELECT lower(trim(id, {_SPACES})) AS file, arg_max({{'s': chunk_size}}, updated_at).s AS size FROM files GROUP BY ALL),
limits AS (SELECT file, CASE WHEN size IS NULL THEN 1200 WHEN size < 200 THEN 200 WHEN size > 4000 THEN 4000 ELSE size END AS size FROM held WHERE file <> '')
"""


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(read_table(spark, sf_dir, "document_chunks"), read_table(spark, sf_dir, "files"))


@query(
    "p5_found",
    _LIMITS + f"SELECT DISTINCT id AS chunk_id FROM document_chunks LEFT JOIN limits ON file = lower(trim(file_id, {_SPACES})) WHERE length(content) > coalesce(size, 1200)",
)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).where("piece_no = 0").select("chunk_id")


@query("p5_pieces")
def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir)


@query("p7_ids")
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode_texts(read_table(spark, sf_dir, "documents"))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.count_tokens(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


@query("p8_mix")
def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.draw_mix(_sized(spark, sf_dir), read_table(spark, sf_dir, "mix_targets"))


@query("p8_shares")
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, targets = cut_lineage(_sized(spark, sf_dir)), read_table(spark, sf_dir, "mix_targets")
    return mixing.mix_report(mixing.draw_mix(docs, targets), docs, targets)


@query("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defects(read_table(spark, sf_dir, "chat_history"))


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subjects_of(*(read_table(spark, sf_dir, t) for t in ("documents", "subject_labels", "subject_areas")))


@query("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).select("doc_id", "subject")


@query("p9_composition")
def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and sentences of every subject."""
    return _subjects(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("n_docs"), F.sum("n_about").alias("n_sentences"))
