"""File manifests and transfer planning over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.adapters import EVENTS, project
from fleetlens.operators import files as op
from fleetlens.plans.registry import query

ENTRIES = project(
    "documents", "source AS manifest_id", "doc_id AS ord",
    "CASE doc_id % 11 WHEN 0 THEN 'a' || CAST(doc_id AS STRING) WHEN 1 THEN 'd/../x' WHEN 2 THEN 'b' || chr(92) || 'c' WHEN 3 THEN 'p' || CAST(1000000 + doc_id - 20 AS STRING) || '/child' ELSE 'p' || CAST(1000000 + doc_id AS STRING) END AS path",
    "CASE WHEN doc_id % 13 = 0 THEN 'directory' WHEN doc_id % 17 = 0 THEN 'link' ELSE 'file' END AS type", "n_chars AS size",
    "CASE WHEN doc_id % 31 = 0 THEN 512 ELSE 420 END AS mode", "doc_id AS mtime", "CASE WHEN doc_id % 19 = 0 THEN 'sha256:x' ELSE 'sha256:' || sha2(text, 256) END AS digest",
)
ENTRIES_SQL = ENTRIES.sql.replace("sha2(text, 256)", "sha256(text)")


@query(
    "validate_manifest",
    f"""WITH e AS (SELECT *, lag(path) OVER (PARTITION BY manifest_id ORDER BY ord) AS previous FROM {ENTRIES_SQL})
    SELECT manifest_id, path, problem FROM (SELECT manifest_id, path, CASE WHEN contains(path, chr(92)) OR mode > 511 THEN 'metadata' WHEN path <= previous THEN 'order' WHEN contains(path, '..') THEN 'unsafe path'
      WHEN type = 'directory' THEN CASE WHEN size <> 0 OR digest <> '' THEN 'directory' END WHEN type = 'file' THEN CASE WHEN digest = 'sha256:x' THEN 'digest' END ELSE 'entry type' END AS problem FROM e) WHERE problem IS NOT NULL
    UNION ALL SELECT DISTINCT c.manifest_id, c.path, 'below a file' FROM e c JOIN e f ON f.manifest_id = c.manifest_id AND f.type = 'file' AND starts_with(c.path, f.path || '/')
    UNION ALL SELECT manifest_id, '', 'too many bytes' FROM e GROUP BY manifest_id HAVING sum(size) FILTER (type = 'file') > 60000""",
)
def validate_manifest(spark, sf):
    return op.validate_manifest(ENTRIES.frame(spark, sf), max_bytes=60_000, segment_width=128)


FILES = project("documents", "source || '/' || CAST(doc_id AS STRING) AS path", "CAST(octet_length(encode(text, 'UTF-8')) AS BIGINT) AS size", "md5(text) AS digest")
PRESENT = project(FILES, "CASE WHEN size % 13 = 0 THEN path || '.old' ELSE path END AS path", "size", "CASE WHEN size % 11 = 0 THEN 'edited' ELSE digest END AS digest", where="size % 7 <> 0")


def files_sql(text: str) -> str:
    return text.replace("encode(text, 'UTF-8')", "encode(text)")


@query(
    "manifest_diff",
    files_sql(f"""SELECT coalesce(w.path, p.path) AS path, CASE WHEN p.path IS NULL THEN 'fetch' WHEN w.path IS NULL THEN 'extra' WHEN w.size = p.size AND w.digest = p.digest THEN 'skip' ELSE 'replace' END AS action,
      coalesce(w.size, 0) AS size FROM {FILES.sql} w FULL JOIN {PRESENT.sql} p ON p.path = w.path"""),
)
def manifest_diff(spark, sf):
    return op.manifest_diff(FILES.frame(spark, sf), PRESENT.frame(spark, sf))


CHUNK = 4096


@query(
    "chunk_plan",
    files_sql(f"""SELECT path, chunk, chunk * {CHUNK} AS offset, least({CHUNK}, size - chunk * {CHUNK}) AS length FROM (
      SELECT path, size, unnest(generate_series(0, (size + {CHUNK - 1}) // {CHUNK} - 1)) AS chunk FROM {FILES.sql} WHERE size > 0)"""),
)
def chunk_plan(spark, sf):
    return op.chunk_plan(FILES.frame(spark, sf), CHUNK)


DOCS = project("documents", "doc_id", "text")
CHUNKS_SQL = f"""SELECT doc_id, CAST(chunk AS INT) AS chunk, sha256(unhex(substr(h, chunk * {2 * CHUNK} + 1, {2 * CHUNK}))) AS digest FROM (
    SELECT doc_id, h, unnest(generate_series(0, (length(h) // 2 + {CHUNK - 1}) // {CHUNK} - 1)) AS chunk FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents) WHERE length(h) > 0)"""


@query("chunk_digests", CHUNKS_SQL)
def chunk_digests(spark, sf):
    return op.chunk_digests(DOCS.frame(spark, sf), "doc_id", F.encode("text", "UTF-8"), CHUNK)


@query(
    "bad_chunks",
    f"""WITH c AS ({CHUNKS_SQL}) SELECT doc_id, chunk FROM c WHERE (doc_id + chunk) % 9 = 0 OR (doc_id * 3 + chunk) % 14 = 0""",
)
def bad_chunks(spark, sf):
    wanted = chunk_digests(spark, sf)
    cached = wanted.filter("(doc_id + chunk) % 9 <> 0").withColumn(
        "digest", F.when((F.col("doc_id") * 3 + F.col("chunk")) % 14 == 0, "torn").otherwise(F.col("digest"))
    )
    return op.bad_chunks(wanted, cached, "doc_id")


VOLUMES = project(
    EVENTS, "event_id", "CASE WHEN k = 0 THEN -1 ELSE cents * 100003 END AS available", "CASE WHEN k = 1 THEN 0 ELSE cents * 200017 + k END AS total",
    "CASE WHEN k = 2 THEN 9223372036854775807 ELSE k * 1000003 END AS required",
)


@query(
    "has_capacity",
    f"""SELECT event_id, available >= 0 AND total > 0 AND required >= 0 AND CAST(available AS HUGEINT) >= CAST(required AS HUGEINT) + greatest(total // 100 * 15 + total % 100 * 15 // 100, 16777216) AS fits FROM {VOLUMES.sql}""",
)
def has_capacity(spark, sf):
    return VOLUMES.frame(spark, sf).select("event_id", op.has_capacity(F.col("available"), F.col("total"), F.col("required")).alias("fits"))


MIGRATIONS = project(
    EVENTS, "event_id AS migration_id", "cents * 1000003 AS db_bytes", "CASE WHEN k = 0 THEN 0 ELSE k * 5000011 END AS file_bytes",
    "CASE WHEN k % 3 = 0 THEN CASE WHEN k = 0 THEN 0 ELSE cents * 90001 END END AS wal_bytes", "k * 9000000 AS wal_ceiling", "1 + k % 20 AS mib_per_second",
)


@query(
    "cutover_estimate",
    f"""SELECT migration_id, payload_bytes, CASE WHEN payload_bytes > 0 THEN greatest(CAST(ceil(payload_bytes / (mib_per_second * 1048576)) AS BIGINT), 1) ELSE 0 END AS seconds,
      CASE WHEN wal_bytes IS NULL THEN NULL WHEN wal_bytes > wal_ceiling THEN 'log over its ceiling' WHEN wal_ceiling - wal_bytes < greatest(CAST(ceil(wal_ceiling * CAST(0.2 AS DOUBLE)) AS BIGINT), 67108864) THEN 'log near its ceiling' END AS refusal
    FROM (SELECT *, coalesce(wal_bytes, db_bytes) + file_bytes AS payload_bytes FROM {MIGRATIONS.sql})""",
)
def cutover_estimate(spark, sf):
    return op.cutover_estimate(MIGRATIONS.frame(spark, sf))


URLS = project(
    "pages", "page_id % 5 AS scope_id", "page_id AS url_id",
    "CASE page_id % 9 WHEN 0 THEN 'http://user:pw@' || split_part(url, '/', 3) || '/x' WHEN 1 THEN 'ftp://' || split_part(url, '/', 3) WHEN 2 THEN 'http://10.1.2.3:8080/x' WHEN 3 THEN 'https://' || upper(split_part(url, '/', 3)) || ':8443/' WHEN 4 THEN 'http://192.0.2.7/' ELSE url END AS url",
)
HOSTS = project("pages", "page_id % 5 AS scope_id", "CASE page_id % 9 WHEN 2 THEN '10.1.2.3' WHEN 4 THEN '192.0.2.7' ELSE upper(split_part(url, '/', 3)) END AS host", where="page_id % 2 = 0")


@query(
    "url_scope",
    f"""WITH p AS (SELECT *, lower(regexp_extract(url, '^[a-z]+://(?:[^/@]*@)?([^/:?#]+)', 1)) AS host, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, TRY_CAST(regexp_extract(url, '^[a-z]+://(?:[^/@]*@)?[^/:?#]+:([0-9]+)', 1) AS INT) AS given FROM {URLS.sql}),
    j AS (SELECT *, EXISTS (SELECT 1 FROM {HOSTS.sql} h WHERE h.scope_id = p.scope_id AND lower(h.host) = p.host) AS listed FROM p)
    SELECT scope_id, url_id, host, CAST(coalesce(given, CASE scheme WHEN 'http' THEN 80 WHEN 'https' THEN 443 END) AS INT) AS port, refusal, refusal IS NULL AS allowed FROM (SELECT *, CASE WHEN scheme = 'ftp' OR contains(url, '@') THEN 'invalid URL'
      WHEN NOT listed THEN 'host outside the scope' WHEN host = '10.1.2.3' THEN 'denied address' END AS refusal FROM j)""",
)
def url_scope(spark, sf):
    return op.url_scope(URLS.frame(spark, sf), HOSTS.frame(spark, sf))
