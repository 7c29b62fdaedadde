"""Queries on the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagework.functions.keys import norm_key
from passagework.functions.text import CLOCK, FILLERS, SMALL_TALK, STOPWORDS, WORLD, document_type, message_kind, modality_of, safe_name, snake_case
from passagework.operators import catalog as cat
from passagework.queries import query
from passagework.session import read_table

_R = "r AS (SELECT * FROM resources QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, deleted_at DESC NULLS FIRST) = 1)"
_F = "f AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, deleted_at DESC NULLS FIRST) = 1)"
_C = "c AS (SELECT id, any_value(resource_id) AS resource_id, any_value(file_id) AS file_id, bool_or(embedding_vector IS NOT NULL OR embedding_json IS NOT NULL) AS embedded FROM document_chunks GROUP BY id)"


def current(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Resources or files in the version that holds."""
    return cat.latest(read_table(spark, sf_dir, table), "id", F.desc("updated_at"), F.desc_nulls_first("deleted_at"))


def chunk_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "document_chunks").select("id", "resource_id", "file_id", cat.has_vector().alias("embedded"))
    return rows.groupBy("id").agg(F.first("resource_id").alias("resource_id"), F.first("file_id").alias("file_id"), F.bool_or("embedded").alias("embedded"))


@query("live_resources", f"WITH {_R} SELECT user_id, id AS resource_id, resource_name, resource_type FROM r WHERE deleted_at IS NULL AND upload_status")
def live_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.live(current(spark, sf_dir, "resources")).where("upload_status").select("user_id", F.col("id").alias("resource_id"), "resource_name", "resource_type")


@query("deleted_per_month", f"WITH {_R} SELECT strftime(deleted_at, '%Y-%m') AS month, count(*) AS n FROM r WHERE deleted_at IS NOT NULL GROUP BY ALL")
def deleted_per_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current(spark, sf_dir, "resources").where("deleted_at is not null").groupBy(F.date_format("deleted_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query(
    "resource_counts",
    f"WITH {_R}, {_F}, {_C} SELECT r.id AS resource_id, coalesce(nf, 0) AS n_files, coalesce(nc, 0) AS n_chunks, coalesce(ne, 0) AS n_embedded FROM r LEFT JOIN (SELECT resource_id, count(*) AS nf FROM f WHERE deleted_at IS NULL GROUP BY ALL) x ON x.resource_id = r.id LEFT JOIN (SELECT resource_id, count(*) AS nc, CAST(count_if(embedded) AS BIGINT) AS ne FROM c GROUP BY ALL) y ON y.resource_id = r.id",
)
def resource_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and passages of every resource, zero where there are none."""
    files = cat.live(current(spark, sf_dir, "files")).groupBy("resource_id").agg(F.count("*").alias("nf"))
    chunks = chunk_keys(spark, sf_dir).groupBy("resource_id").agg(F.count("*").alias("nc"), F.count_if("embedded").alias("ne"))
    rows = current(spark, sf_dir, "resources").select(F.col("id").alias("resource_id")).join(files, "resource_id", "left").join(chunks, "resource_id", "left")
    return rows.select("resource_id", *(F.coalesce(c, F.lit(0)).alias(n) for c, n in (("nf", "n_files"), ("nc", "n_chunks"), ("ne", "n_embedded"))))


@query(
    "file_listing",
    f"WITH {_R}, {_F}, {_C} SELECT f.id AS file_id, f.file_name, r.resource_name, coalesce(n, 0) AS n_chunks, coalesce(ne, 0) AS n_embedded FROM f JOIN r ON f.resource_id = r.id LEFT JOIN (SELECT file_id, count(*) AS n, CAST(count_if(embedded) AS BIGINT) AS ne FROM c GROUP BY ALL) x ON x.file_id = f.id WHERE f.deleted_at IS NULL AND r.deleted_at IS NULL",
)
def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live files of live resources with their numbers of passages; the passages are counted before the join."""
    counts = chunk_keys(spark, sf_dir).groupBy(F.col("file_id").alias("fid")).agg(F.count("*").alias("n"), F.count_if("embedded").alias("ne"))
    resources = cat.live(current(spark, sf_dir, "resources")).select(F.col("id").alias("resource_id"), "resource_name")
    rows = cat.live(current(spark, sf_dir, "files")).join(resources, "resource_id").join(counts, F.col("id") == F.col("fid"), "left")
    return rows.select(F.col("id").alias("file_id"), "file_name", "resource_name", F.coalesce("n", F.lit(0)).alias("n_chunks"), F.coalesce("ne", F.lit(0)).alias("n_embedded"))


@query(
    "dominant_model",
    f"WITH {_F}, {_C} SELECT f.resource_id, embedding_provider, embedding_model, count(*) AS n_chunks FROM f JOIN c ON c.file_id = f.id WHERE embedding_model IS NOT NULL GROUP BY f.resource_id, embedding_provider, embedding_model QUALIFY row_number() OVER (PARTITION BY f.resource_id ORDER BY count(*) DESC, embedding_provider, embedding_model) = 1",
)
def dominant_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model with most passages of every resource; ties by name."""
    per_file = chunk_keys(spark, sf_dir).groupBy(F.col("file_id").alias("fid")).agg(F.count("*").alias("n"))
    files = current(spark, sf_dir, "files").where("embedding_model is not null")
    counted = files.join(per_file, F.col("id") == F.col("fid")).groupBy("resource_id", "embedding_provider", "embedding_model").agg(F.sum("n").alias("n_chunks"))
    return cat.latest(counted, "resource_id", F.desc("n_chunks"), F.col("embedding_provider"), F.col("embedding_model"))


_JOBS = "jobs AS (SELECT DISTINCT * FROM ingestion_jobs)"


@query("latest_jobs", f"WITH {_JOBS} SELECT resource_id, id AS job_id, status, stage FROM jobs WHERE resource_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY resource_id ORDER BY created_at DESC, id DESC) = 1")
def latest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = read_table(spark, sf_dir, "ingestion_jobs").select("id", "resource_id", "status", "stage", "created_at").where("resource_id is not null")
    return cat.latest(jobs, "resource_id", F.desc("created_at"), F.desc("id")).select("resource_id", F.col("id").alias("job_id"), "status", "stage")


@query(
    "job_progress",
    f"WITH {_JOBS} SELECT id AS job_id, status, CASE WHEN status = 'succeeded' THEN 100 ELSE CAST(least(95, greatest(0, floor(coalesce(processed_documents * 95.0 / nullif(total_documents, 0), 0)))) AS INT) END AS percent, CAST(epoch(finished_at) - epoch(started_at) AS BIGINT) AS seconds FROM jobs",
)
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = read_table(spark, sf_dir, "ingestion_jobs").distinct()
    seconds = F.timestamp_diff("MICROSECOND", F.col("started_at"), F.col("finished_at")) / 1e6
    return jobs.select(F.col("id").alias("job_id"), "status", cat.progress(F.col("processed_documents"), F.col("total_documents"), F.col("status")).alias("percent"), F.round(seconds, 0).cast("long").alias("seconds"))


@query("job_summary", f"WITH {_JOBS} SELECT user_id, count(*) AS n_jobs, CAST(count_if(status = 'failed') AS BIGINT) AS n_failed, CAST(count_if(processed_documents < total_documents) AS BIGINT) AS n_partial, CAST(sum(indexed_chunks) AS BIGINT) AS n_chunks FROM jobs GROUP BY ALL")
def job_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = read_table(spark, sf_dir, "ingestion_jobs").distinct()
    return jobs.groupBy("user_id").agg(F.count("*").alias("n_jobs"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.count_if(F.col("processed_documents") < F.col("total_documents")).alias("n_partial"), F.sum("indexed_chunks").cast("long").alias("n_chunks"))


@query(
    "claim_order",
    f"WITH {_JOBS} SELECT status, id AS job_id, row_number() OVER (PARTITION BY status ORDER BY created_at, id) AS place FROM jobs QUALIFY place <= 10",
)
def claim_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten oldest jobs of every status, in the order a worker claims them."""
    jobs = read_table(spark, sf_dir, "ingestion_jobs").select("status", F.col("id").alias("job_id"), "created_at").distinct()
    place = F.row_number().over(Window.partitionBy("status").orderBy("created_at", "job_id"))
    return jobs.withColumn("place", place.cast("long")).where("place <= 10").select("status", "job_id", "place")


@query("user_search", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_name ILIKE '%00001%' OR c_mktsegment ILIKE '%00001%'")
def user_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.search_people(read_table(spark, sf_dir, "customer"), "00001", "c_name", "c_mktsegment").select("c_custkey", "c_name", "c_mktsegment")


@query("user_search_two_words", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_name ILIKE '%customer%' AND c_mktsegment ILIKE '%build%'")
def user_search_two_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.search_people(read_table(spark, sf_dir, "customer"), "customer build", "c_name", "c_mktsegment").select("c_custkey", "c_name", "c_mktsegment")


@query("activity_page", "SELECT event_id, user_id, event_type, (SELECT count(*) FROM events WHERE event_type = 'error') AS total FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100")
def activity_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the log, newest first, with the number of all rows that match."""
    rows = read_table(spark, sf_dir, "events").where(F.upper("event_type") == "ERROR")
    page = cat.paged(rows, F.desc("ts"), F.desc("event_id"), offset=100, limit=50)
    return page.select("event_id", "user_id", "event_type", F.lit(rows.count()).cast("long").alias("total"))


@query("activity_by_day", "SELECT CAST(ts AS DATE) AS day, upper(event_type) AS action, count(*) AS n, count(DISTINCT user_id) AS n_users, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL")
def activity_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events")
    return rows.groupBy(F.to_date("ts").alias("day"), F.upper("event_type").alias("action")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"), F.round(F.avg("value"), 6).alias("mean_value"))


@query(
    "chat_history_listing",
    "WITH h AS (SELECT DISTINCT id, chat_id, user_id, timestamp, citations_json FROM chat_history) SELECT id, chat_id, user_id, CAST(coalesce(CASE WHEN json_valid(citations_json) AND json_type(citations_json) = 'ARRAY' THEN json_array_length(citations_json) END, 0) AS BIGINT) AS n_citations, row_number() OVER (PARTITION BY chat_id, user_id ORDER BY timestamp, id, citations_json NULLS FIRST) AS place FROM h WHERE chat_id IS NOT NULL AND timestamp IS NOT NULL",
)
def chat_history_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a chat and user in time order; citations that can't be read count as none."""
    rows = read_table(spark, sf_dir, "chat_history").select("id", "chat_id", "user_id", "timestamp", "citations_json").distinct().where("chat_id is not null and timestamp is not null")
    place = F.row_number().over(Window.partitionBy("chat_id", "user_id").orderBy("timestamp", "id", "citations_json"))
    return rows.select("id", "chat_id", "user_id", F.coalesce(F.json_array_length("citations_json"), F.lit(0)).cast("long").alias("n_citations"), place.cast("long").alias("place"))


@query(
    "rbac_effective",
    "WITH ur AS (SELECT DISTINCT o_custkey AS u, o_orderpriority AS role FROM orders), rp AS (SELECT DISTINCT o_orderpriority AS role, o_orderstatus AS p FROM orders), d AS (SELECT DISTINCT u, p FROM ur JOIN rp USING (role)) SELECT u AS user, CAST(count(*) AS BIGINT) AS n_permissions FROM d GROUP BY ALL",
)
def rbac_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users, roles and permissions, played by customers, priorities and states of orders."""
    orders = read_table(spark, sf_dir, "orders")
    ur = orders.select(F.col("o_custkey").alias("user"), F.col("o_orderpriority").alias("role")).distinct()
    rp = orders.select(F.col("o_orderpriority").alias("role"), F.col("o_orderstatus").alias("permission")).distinct()
    none = spark.createDataFrame([], "permission string, implied string")
    return cat.effective_permissions(ur, rp, none).groupBy("user").agg(F.count("*").alias("n_permissions"))


@query(
    "roles_of_users",
    "SELECT c_custkey, c_name, list_sort(list(DISTINCT o_orderpriority)) AS roles FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL",
)
def roles_of_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority").distinct().groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderpriority")).alias("roles"))
    return read_table(spark, sf_dir, "customer").join(pairs, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "roles")


@query(
    "catalog_merge",
    "WITH o AS (SELECT p_partkey, p_retailprice FROM part WHERE p_partkey % 3 <> 0), n AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_retailprice + 1 ELSE p_retailprice END AS p_retailprice FROM part WHERE p_partkey % 4 <> 0) SELECT p_partkey, coalesce(n.p_retailprice, o.p_retailprice) AS p_retailprice, n.p_partkey IS NOT NULL AS active, CASE WHEN o.p_retailprice IS NULL THEN 'inserted' WHEN n.p_retailprice IS NULL THEN 'deactivated' WHEN o.p_retailprice = n.p_retailprice THEN 'kept' ELSE 'updated' END AS change FROM o FULL JOIN n USING (p_partkey)",
)
def catalog_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    price = F.when(F.col("p_partkey") % 5 == 0, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice"))
    return cat.merged(part.where("p_partkey % 3 != 0"), part.where("p_partkey % 4 != 0").withColumn("p_retailprice", price), ["p_partkey"], ["p_retailprice"])


_PURGED = "WITH gone AS (SELECT DISTINCT id FROM resources WHERE deleted_at IS NOT NULL) "


@query("purge_counts", _PURGED + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS removed FROM {t} WHERE resource_id IN (SELECT id FROM gone)" for t in ("rag_graph_edges", "rag_graph_entities", "document_chunks", "files")))
def purge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a purge of the deleted resources removes from each table."""
    gone = read_table(spark, sf_dir, "resources").where("deleted_at is not null").select(F.col("id").alias("resource_id"))
    tables = {t: read_table(spark, sf_dir, t).select("resource_id") for t in ("rag_graph_edges", "rag_graph_entities", "document_chunks", "files")}
    return cat.purge(tables, gone)[1]


@query(
    "file_names",
    f"WITH {_F} SELECT id AS file_id, CASE lower(regexp_extract(file_name, '\\.([^.]+)$', 1)) WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'document' WHEN 'doc' THEN 'document' WHEN 'txt' THEN 'text' WHEN 'md' THEN 'markdown' WHEN 'csv' THEN 'spreadsheet' WHEN 'xlsx' THEN 'spreadsheet' WHEN 'html' THEN 'web' ELSE 'text' END AS doc_type, lower(regexp_replace(regexp_replace(regexp_replace(file_name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS machine_name FROM f",
)
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = current(spark, sf_dir, "files")
    return files.select(F.col("id").alias("file_id"), document_type(F.col("file_name"), F.lit("text")).alias("doc_type"), snake_case(F.col("file_name")).alias("machine_name"))


_END = "lower(CASE WHEN contains(file_name, '.') THEN regexp_extract(file_name, '[^.]*$') ELSE '' END)"
_SAFE = "substring(CASE WHEN regexp_replace(regexp_replace(regexp_replace(coalesce(file_name, ''), '^.*[/\\\\]', ''), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') = '' THEN 'upload' ELSE regexp_replace(regexp_replace(regexp_replace(coalesce(file_name, ''), '^.*[/\\\\]', ''), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') END, 1, 255)"


@query(
    "file_modalities",
    f"""WITH {_F}, k AS (SELECT file_name, lower(coalesce(file_type, '')) AS kind, coalesce({_END}, '') AS e FROM f)
SELECT CASE WHEN kind LIKE 'image/%' OR e IN ('png', 'jpg', 'jpeg', 'gif', 'webp', 'bmp', 'svg') THEN 'image'
  WHEN kind LIKE 'audio/%' OR kind LIKE 'video/%' OR e IN ('mp3', 'wav', 'm4a', 'ogg', 'mp4') THEN 'audio'
  WHEN e IN ('csv', 'tsv', 'xlsx', 'xls') THEN 'table' WHEN kind = 'application/pdf' OR e = 'pdf' THEN 'pdf' ELSE 'text' END AS modality,
  count(*) AS n, CAST(count_if({_SAFE} = file_name) AS BIGINT) AS n_safe FROM k GROUP BY ALL""",
)
def file_modalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = current(spark, sf_dir, "files")
    return files.groupBy(modality_of(F.col("file_name"), F.col("file_type")).alias("modality")).agg(F.count("*").alias("n"), F.count_if(safe_name(F.col("file_name")) == F.col("file_name")).alias("n_safe"))


_KIND = " ".join(f"WHEN NOT regexp_matches(q, '[0-9]') AND length(p) <= 40 AND p IN ({', '.join(repr(x) for x in texts)}) THEN '{name}'" for name, texts in SMALL_TALK.items())
_LEFT = "list_filter(string_split(p, ' '), lambda w: w <> '' AND NOT list_contains([{}], w))".format(", ".join(f"'{w}'" for w in [*STOPWORDS, *FILLERS]))


@query(
    "message_kinds",
    f"WITH h AS (SELECT DISTINCT id, user_query AS q, trim(regexp_replace(regexp_replace(lower(user_query), '[^a-z\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS p FROM chat_history WHERE user_query IS NOT NULL), k AS (SELECT id, CASE {_KIND} "
    + " ".join(f"WHEN len({_LEFT}) > 0 AND len(list_filter({_LEFT}, lambda w: NOT list_contains([{', '.join(repr(w) for w in words)}], w))) = 0 THEN '{name}'" for name, words in (("clock", CLOCK), ("world", WORLD)))
    + " ELSE 'document' END AS kind FROM h) SELECT kind, count(*) AS n FROM k GROUP BY ALL",
)
def message_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages by whether they ask the documents anything."""
    rows = read_table(spark, sf_dir, "chat_history").where("user_query is not null").select("id", "user_query").distinct()
    return rows.groupBy(message_kind(F.col("user_query")).alias("kind")).agg(F.count("*").alias("n"))


_KEY = "lower(trim({0}, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(8203) || chr(65279)))"


@query(
    "missing_entities",
    f"SELECT DISTINCT {_KEY.format('source_entity_id')} AS entity_key FROM rag_graph_edges WHERE {_KEY.format('source_entity_id')} <> '' AND {_KEY.format('source_entity_id')} NOT IN (SELECT {_KEY.format('id')} FROM rag_graph_entities WHERE id IS NOT NULL)",
)
def missing_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that edges begin at and that don't exist."""
    named = read_table(spark, sf_dir, "rag_graph_edges").select(norm_key(F.col("source_entity_id")).alias("entity_key")).where("entity_key != ''")
    return cat.missing(named, read_table(spark, sf_dir, "rag_graph_entities").select(norm_key(F.col("id")).alias("entity_key")), "entity_key")


@query(
    "owned_chunks",
    f"WITH {_R}, {_C} SELECT user_id, count(*) AS n_chunks, CAST(count_if(embedded) AS BIGINT) AS n_embedded FROM c JOIN r ON r.id = c.resource_id WHERE r.deleted_at IS NULL GROUP BY ALL",
)
def owned_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of the live resources of every user."""
    owners = cat.live(current(spark, sf_dir, "resources")).select(F.col("id").alias("resource_id"), "user_id")
    return chunk_keys(spark, sf_dir).join(owners, "resource_id").groupBy("user_id").agg(F.count("*").alias("n_chunks"), F.count_if("embedded").alias("n_embedded"))


@query(
    "resource_files",
    f"WITH {_R}, {_F} SELECT r.id AS resource_id, count(f.id) AS n_files, array_to_string(list(f.id ORDER BY f.created_at, f.id), ',') AS files FROM r JOIN f ON f.resource_id = r.id WHERE r.deleted_at IS NULL AND f.deleted_at IS NULL GROUP BY ALL",
)
def resource_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live files of every live resource, oldest first."""
    parents = cat.live(current(spark, sf_dir, "resources")).select(F.col("id").alias("resource_id"))
    children = cat.live(current(spark, sf_dir, "files")).select("resource_id", "created_at", "id")
    rows = cat.with_children(parents, children, "resource_id", "created_at", "id")
    return rows.select("resource_id", F.size("children").cast("long").alias("n_files"), F.array_join(F.transform("children", lambda c: c["id"]), ",").alias("files"))
