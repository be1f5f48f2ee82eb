"""File manifests, transfer plans, capacity and URL scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.ordered import number_segment, ordered_scan

# Transfer limits.
CHUNK_BYTES = 4 * 1024 * 1024
MAX_ENTRIES = 250_000  # of one manifest, where a receiver asks for a limit
MAX_BYTES = 500 * 1024**3
RESERVE_PERCENT = 15
MIN_RESERVE_BYTES = 16 * 1024 * 1024
MIN_WAL_HEADROOM = 64 * 1024 * 1024
FILE_DIGEST = r"^sha256:[a-f0-9]{64}\z"


def validate_manifest(
    entries: DataFrame, max_bytes: int | None = None, segment_width: int = 65_536, max_entries: int | None = None
) -> DataFrame:
    """Problems of file manifests, entry by entry, and of whole manifests.

    Input: ``manifest_id, ord, path, type, size, mode, mtime, digest``.  The
    limits of a whole manifest are those that the caller sets.
    """
    work = entries.withColumn("segment", number_segment("ord", segment_width))
    seen = ordered_scan(work, ["manifest_id"], ["ord"], "segment", lag={"previous": "path"})
    path, kind = F.col("path"), F.col("type")
    unsafe = path.startswith("/") | path.rlike(r"(^|/)(\.|\.\.)?(/|$)")
    problem = (
        F.when((path == "") | path.contains("\\") | (F.col("mode") > 0o777) | (F.col("mtime") < 0), "metadata")
        .when(F.coalesce(path <= F.col("previous"), F.lit(False)), "order")
        .when(unsafe, "unsafe path")
        .when(kind == "directory", F.when((F.col("size") != 0) | (F.col("digest") != ""), "directory"))
        .when(kind == "file", F.when((F.col("size") < 0) | ~F.col("digest").rlike(FILE_DIGEST), "digest"))
        .otherwise("entry type")
    )
    of_entries = seen.withColumn("problem", problem).filter("problem IS NOT NULL").select("manifest_id", "path", "problem")
    parts = F.split(path, "/")
    ancestors = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/")
    )
    nested = entries.filter(F.size(parts) > 1).select("manifest_id", "path", F.explode(ancestors).alias("parent"))
    files = entries.filter("type = 'file'").select("manifest_id", F.col("path").alias("parent"))
    below = nested.join(files, ["manifest_id", "parent"], "left_semi").select(
        "manifest_id", "path", F.lit("below a file").alias("problem")
    ).distinct()
    totals = entries.groupBy("manifest_id").agg(
        F.count("*").alias("n"), F.sum(F.when(kind == "file", F.col("size"))).alias("bytes")
    )
    whole = totals.select(
        "manifest_id", F.lit("").alias("path"),
        F.when(F.lit(max_entries is not None) & (F.col("n") > (max_entries or 0)), "too many entries")
        .when(F.lit(max_bytes is not None) & (F.col("bytes") > (max_bytes or 0)), "too many bytes").alias("problem"),
    ).filter("problem IS NOT NULL")
    return of_entries.unionByName(below).unionByName(whole)


def manifest_diff(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """What has to be fetched, kept or removed so that ``present`` becomes ``wanted`` (``path, size, digest``)."""
    w = wanted.select("path", F.col("size").alias("w_size"), F.col("digest").alias("w_digest"))
    p = present.select("path", F.col("size").alias("p_size"), F.col("digest").alias("p_digest"))
    same = (F.col("w_size") == F.col("p_size")) & (F.col("w_digest") == F.col("p_digest"))
    action = (
        F.when(F.col("p_digest").isNull(), "fetch").when(F.col("w_digest").isNull(), "extra").when(same, "skip").otherwise("replace")
    )
    return w.join(p, "path", "full_outer").select("path", action.alias("action"), F.coalesce("w_size", F.lit(0)).alias("size"))


def chunk_plan(files: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """Chunks of each file (``path, size``): number, offset and length; none for empty files."""
    chunks = F.ceil(F.col("size") / F.lit(size)).cast("long")
    return (
        files.filter("size > 0")
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
        .select(
            "path", "chunk", (F.col("chunk") * size).alias("offset"),
            F.least(F.lit(size).cast("long"), F.col("size") - F.col("chunk") * size).alias("length"),
        )
    )


def chunk_digests(df: DataFrame, key: str, content: Column, size: int = CHUNK_BYTES) -> DataFrame:
    """sha256 of every chunk of a binary column.

    The content is hashed in place; only digests leave the row.
    """
    length = F.octet_length(content)
    chunks = F.ceil(length / F.lit(size)).cast("int")
    digests = F.transform(
        F.sequence(F.lit(0), chunks - 1),
        lambda n: F.struct(n.alias("chunk"), F.sha2(F.substring(content, n * size + 1, F.lit(size)), 256).alias("digest")),
    )
    return df.filter(length > 0).select(key, F.inline(digests))


def bad_chunks(wanted: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Chunks that are not cached, or cached with another digest."""
    return wanted.join(cached, [key, "chunk", "digest"], "left_anti").select(key, "chunk")


def capacity_reserve(total: Column) -> Column:
    whole = F.floor(total / 100)
    rest = total - whole * 100
    return F.greatest(whole * RESERVE_PERCENT + F.floor(rest * RESERVE_PERCENT / 100), F.lit(MIN_RESERVE_BYTES).cast("long"))


def has_capacity(available: Column, total: Column, required: Column) -> Column:
    """Whether required bytes fit and leave the reserve; false for negative input or overflow."""
    needed = F.try_add(required, capacity_reserve(total))
    valid = (available >= 0) & (total > 0) & (required >= 0)
    return valid & F.coalesce(available >= needed, F.lit(False))


def cutover_estimate(databases: DataFrame) -> DataFrame:
    """Transfer time of each migration and whether its write-ahead log leaves headroom.

    Input: ``migration_id, db_bytes, file_bytes, wal_bytes`` (null without a
    slot)``, wal_ceiling, mib_per_second``.
    """
    payload = F.coalesce("wal_bytes", "db_bytes") + F.col("file_bytes")
    seconds = F.greatest(
        F.ceil(payload / (F.col("mib_per_second") * 1024 * 1024)).cast("long"), F.when(payload > 0, 1).otherwise(0).cast("long")
    )
    headroom = F.greatest(F.ceil(F.col("wal_ceiling") * 0.2).cast("long"), F.lit(MIN_WAL_HEADROOM).cast("long"))
    refusal = F.when(
        F.col("wal_bytes").isNotNull(),
        F.when(F.col("wal_bytes") > F.col("wal_ceiling"), "log over its ceiling").when(
            F.col("wal_ceiling") - F.col("wal_bytes") < headroom, "log near its ceiling"
        ),
    )
    return databases.select("migration_id", payload.alias("payload_bytes"), seconds.alias("seconds"), refusal.alias("refusal"))


# Addresses that are never validated over HTTP.
DENIED_ADDRESS = (
    r"^(127\.|10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|169\.254\.|2(2[4-9]|3[0-9])\.|0\.0\.0\.0$"
    r"|100\.100\.100\.200$|192\.0\.0\.192$)"
)


def url_scope(urls: DataFrame, hosts: DataFrame, scope: str = "scope_id") -> DataFrame:
    """Whether each URL may be fetched in its scope, with host and port.

    ``urls``: ``scope_id, url_id, url``; ``hosts``: ``scope_id, host``.
    """
    url = F.col("url")
    raw_host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    port = F.regexp_extract(F.try_parse_url(url, F.lit("AUTHORITY")), ":([0-9]+)$", 1).try_cast("int")
    parsed = urls.select(
        scope, "url_id", raw_host.alias("host"), scheme.alias("scheme"),
        F.coalesce(port, F.when(scheme == "http", 80).when(scheme == "https", 443)).alias("port"),
        F.try_parse_url(url, F.lit("USERINFO")).isNotNull().alias("has_user"),
    )
    listed = hosts.select(scope, F.lower("host").alias("host")).distinct().withColumn("listed", F.lit(True))
    refusal = (
        F.when(F.col("host").isNull() | ~F.coalesce(F.col("scheme").isin("http", "https"), F.lit(False)) | F.col("has_user"), "invalid URL")
        .when(~F.col("port").between(1, 65_535), "invalid port")
        .when(F.col("listed").isNull(), "host outside the scope")
        .when(F.col("host").rlike(DENIED_ADDRESS) & F.col("host").rlike(r"^[0-9.]+$"), "denied address")
    )
    return parsed.join(listed, [scope, "host"], "left").select(
        scope, "url_id", "host", "port", refusal.alias("refusal"), refusal.isNull().alias("allowed")
    )
