"""Queries on references between the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from passagework.operators.orphans import orphan_references, orphan_report, parent_keys, references
from passagework.queries import query
from passagework.session import read_table

_KEY = "lower(trim({0}, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(8203) || chr(65279)))"


def _sql_refs(table: str, field: str, parent: str) -> str:
    return f"SELECT DISTINCT '{table}' AS table_name, '{field}' AS field_name, '{parent}' AS parent, {_KEY.format(field)} AS key, id AS record_id, created_at FROM {table} WHERE {_KEY.format(field)} <> ''"


_FOUND = f"""
WITH refs AS ({' UNION ALL '.join(_sql_refs(*x) for x in (
    ("document_chunks", "resource_id", "resources"), ("document_chunks", "file_id", "files"),
    ("ingestion_jobs", "resource_id", "resources"), ("rag_graph_edges", "source_entity_id", "entities")))}),
parents AS (
  SELECT 'resources' AS parent, {_KEY.format('id')} AS key, arg_max(created_at, updated_at) AS born, arg_max({{'d': deleted_at}}, updated_at).d AS gone FROM resources GROUP BY ALL
  UNION ALL SELECT 'files', {_KEY.format('id')}, arg_max(created_at, updated_at), arg_max({{'d': deleted_at}}, updated_at).d FROM files GROUP BY ALL
  UNION ALL SELECT 'entities', {_KEY.format('id')}, min(created_at), NULL FROM rag_graph_entities GROUP BY ALL),
judged AS (
  SELECT DISTINCT table_name, field_name, record_id, strftime(created_at, '%Y-%m') AS ref_month,
    CASE WHEN p.key IS NULL THEN 'missing' WHEN born > created_at THEN 'late' WHEN gone < created_at THEN 'deleted' END AS reason
  FROM refs LEFT JOIN parents p USING (parent, key))
"""


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    def t(name: str) -> DataFrame:
        return read_table(spark, sf_dir, name)

    chunks = t("document_chunks")
    refs = [
        references(chunks, "document_chunks", "resource_id", "resources"),
        references(chunks, "document_chunks", "file_id", "files"),
        references(t("ingestion_jobs"), "ingestion_jobs", "resource_id", "resources"),
        references(t("rag_graph_edges"), "rag_graph_edges", "source_entity_id", "entities"),
    ]
    parents = [
        parent_keys(t("resources"), "resources", deleted="deleted_at", version="updated_at"),
        parent_keys(t("files"), "files", deleted="deleted_at", version="updated_at"),
        parent_keys(t("rag_graph_entities"), "entities"),
    ]
    return orphan_references(reduce(DataFrame.unionByName, refs), reduce(DataFrame.unionByName, parents))


@query("p4_found", _FOUND + "SELECT table_name, field_name, record_id, reason, ref_month FROM judged WHERE reason IS NOT NULL")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans(spark, sf_dir)


@query("p4_report", _FOUND + "SELECT table_name, field_name, ref_month, reason, count(*) AS n_orphans FROM judged WHERE reason IS NOT NULL GROUP BY ALL")
def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(orphans(spark, sf_dir))
