"""Package inventory and provenance over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.adapters import EVENTS, project
from fleetlens.operators import packages as op
from fleetlens.plans.registry import emit, query

_VERSION_TEXT = (
    "CASE p_size % 9 WHEN 0 THEN CAST(p_size AS STRING) || ':1.' || CAST(p_partkey AS STRING) || '-1ubuntu2' WHEN 1 THEN '2147483648:1.0' WHEN 2 THEN '1.0-' WHEN 3 THEN 'v1' WHEN 4 THEN '1:2:3' WHEN 5 THEN '1.2.3~rc1+dfsg-2-3' WHEN 6 THEN '2147483647:9' WHEN 7 THEN '-1' ELSE '1.' || CAST(p_partkey AS STRING) END"
)
VERSIONS = project("part", "p_partkey", f"{_VERSION_TEXT} AS version")
VALID_SQL = "(regexp_full_match({0}, '([0-9]+:)?[0-9]([A-Za-z0-9.+~-]*[A-Za-z0-9.+~])?') AND length({0}) <= 512 AND coalesce(TRY_CAST(CASE WHEN contains({0}, ':') THEN split_part({0}, ':', 1) ELSE '0' END AS BIGINT) <= 2147483647, false))"


@query("valid_version", f"SELECT p_partkey, {VALID_SQL.format('version')} AS valid FROM {VERSIONS.sql}")
def valid_version(spark, sf):
    return VERSIONS.frame(spark, sf).select("p_partkey", op.valid_version(F.col("version")).alias("valid"))


STATES = project("part", "p_partkey", "CASE p_size % 9 WHEN 0 THEN 'ii ' WHEN 1 THEN 'rc ' WHEN 2 THEN 'iU ' WHEN 3 THEN 'iF ' WHEN 4 THEN 'un ' WHEN 5 THEN 'xi ' WHEN 6 THEN 'ix ' WHEN 7 THEN 'iiR' ELSE 'ii' END AS code")


@query(
    "package_state",
    f"SELECT p_partkey, CASE code WHEN 'ii ' THEN 'installed' WHEN 'rc ' THEN 'config-files' WHEN 'iU ' THEN 'unpacked' WHEN 'iF ' THEN 'half-configured' WHEN 'un ' THEN 'not-installed' END AS state FROM {STATES.sql}",
)
def package_state(spark, sf):
    return STATES.frame(spark, sf).select("p_partkey", op.package_state(F.col("code")).alias("state"))


LINES = project(
    "part", "p_partkey DIV 5 AS capture_id", "p_partkey % 5 AS line_no", "p_partkey",
    "CASE WHEN p_size % 25 = 0 THEN 'pkg:arm64' WHEN p_size % 3 = 0 THEN 'pkg-' || CAST(p_partkey % 60 AS STRING) || ':amd64' WHEN p_partkey % 19 = 0 THEN 'pkg-same' ELSE 'pkg-' || CAST(p_partkey AS STRING) END"
    " || chr(9) || 'amd64' || chr(9) || CASE WHEN p_size % 23 = 0 THEN 'bad version' ELSE '1.' || CAST(p_size AS STRING) END || chr(9) || CASE WHEN p_size % 2 = 0 THEN 'src' || chr(9) || '1.0' WHEN p_size % 31 = 0 THEN 'src' || chr(9) ELSE chr(9) END"
    " || chr(9) || CASE WHEN p_size % 29 = 0 THEN 'iX ' ELSE 'ii ' END || CASE WHEN p_size % 37 = 0 THEN chr(9) ELSE '' END AS line",
)
PACKAGES_SQL = f"""WITH f AS (SELECT capture_id, line_no, string_split(line, chr(9)) AS f FROM {LINES.sql}),
    r AS (SELECT capture_id, line_no, split_part(f[1], ':', 1) AS name, f[2] AS architecture, f[3] AS version, nullif(f[4], '') AS source_name, nullif(f[5], '') AS source_version,
        CASE WHEN len(f) <> 6 THEN 'columns' WHEN contains(f[1], ':') AND split_part(f[1], ':', 2) <> f[2] THEN 'architecture mismatch' WHEN f[3] = 'bad version' THEN 'identity' WHEN f[6] <> 'ii ' THEN 'state'
          WHEN f[4] <> '' AND f[5] = '' THEN 'source identity' END AS problem FROM f),
    d AS (SELECT DISTINCT capture_id FROM r WHERE problem IS NULL GROUP BY capture_id, name, architecture HAVING count(*) > 1),
    rej AS (SELECT capture_id, coalesce(arg_min(problem, line_no) FILTER (problem IS NOT NULL), CASE WHEN capture_id IN (SELECT capture_id FROM d) THEN 'duplicate package' END) AS reason FROM r GROUP BY capture_id)"""


@query("parse_packages", f"{PACKAGES_SQL} SELECT capture_id, line_no, name, architecture, version, source_name, source_version, 'installed' AS installation_state FROM r WHERE capture_id NOT IN (SELECT capture_id FROM rej WHERE reason IS NOT NULL)")
def parse_packages(spark, sf):
    return op.parse_packages(LINES.frame(spark, sf))[0]


@query("rejected_captures", f"{PACKAGES_SQL} SELECT * FROM rej WHERE reason IS NOT NULL")
def rejected_captures(spark, sf):
    return op.parse_packages(LINES.frame(spark, sf))[1]


SOURCES = project(
    "part", "p_partkey", "'pkg-' || CAST(p_partkey AS STRING) AS name", "'1.' || CAST(p_size AS STRING) AS version",
    "CASE p_size % 7 WHEN 0 THEN '' WHEN 1 THEN 'nginx' WHEN 2 THEN 'nginx (1.24.0-2)' WHEN 3 THEN 'nginx 1.24' WHEN 4 THEN 'nginx (bad version)' WHEN 5 THEN 'N!' ELSE 'php8.3  (1:8.3)' END AS value",
)


@query(
    "source_identity",
    f"""SELECT p_partkey, CASE WHEN value = '' THEN name WHEN error IS NULL THEN split_part(value, ' ', 1) END AS source_name,
      CASE WHEN value = '' OR value = 'nginx' THEN version WHEN error IS NULL THEN regexp_extract(value, '\\((.*)\\)', 1) END AS source_version, error
    FROM (SELECT *, CASE WHEN value IN ('nginx 1.24', 'nginx (bad version)', 'N!') THEN 'invalid_source_identity' END AS error FROM {SOURCES.sql})""",
)
def source_identity(spark, sf):
    s = op.source_identity(F.col("value"), F.col("name"), F.col("version"))
    out = SOURCES.frame(spark, sf).withColumn("s", s)
    return out.select("p_partkey", F.col("s.name").alias("source_name"), F.col("s.version").alias("source_version"), "s.error")


CAPTURES = project(
    EVENTS, "event_id AS capture_id", "CASE k % 20 WHEN 0 THEN 'unavailable' WHEN 1 THEN 'invalid' WHEN 2 THEN 'unsupported' ELSE 'ok' END AS platform",
    "CASE WHEN k % 17 <> 3 THEN event_type END AS state_before", "CASE WHEN k % 13 = 5 THEN NULL WHEN k % 5 = 0 THEN 'other' ELSE event_type END AS state_after",
    "CAST(CASE WHEN k % 11 = 0 THEN NULL WHEN k % 7 = 0 THEN 2 ELSE 0 END AS INT) AS exit_code", "k % 19 = 0 AS query_error", "k % 9 = 0 AS truncated", "user_id % 10 = 0 AS parse_error", "user_id % 14 = 0 AS timed_out",
)
CAPTURE_SQL = f"""SELECT capture_id, CASE WHEN early IS NOT NULL THEN 'unsupported' WHEN exit_code <> 0 THEN 'failed' WHEN errors = '' THEN 'complete' ELSE 'partial' END AS status, coalesce(early, errors) AS errors,
    early IS NULL AND stable AND NOT timed_out AS stable FROM (SELECT *, concat_ws(',', CASE WHEN exit_code <> 0 OR query_error THEN 'query_failed' END, CASE WHEN truncated THEN 'query_output_truncated' END,
      CASE WHEN parse_error THEN 'malformed_package_rows' END, CASE WHEN NOT stable THEN 'capture_state_changed' END, CASE WHEN timed_out THEN 'capture_timeout' END) AS errors FROM (SELECT *,
      CASE WHEN platform = 'unavailable' THEN 'platform_unavailable' WHEN platform = 'invalid' THEN 'invalid_platform' WHEN platform = 'unsupported' THEN 'unsupported_platform' WHEN state_before IS NULL THEN 'package_state_unavailable'
        WHEN exit_code IS NULL THEN 'query_unavailable' END AS early, coalesce(state_before = state_after, false) AS stable FROM {CAPTURES.sql}))"""


@query("capture_status", CAPTURE_SQL)
def capture_status(spark, sf):
    return op.capture_status(CAPTURES.frame(spark, sf)).withColumn("errors", F.array_join("errors", ","))


# one capture holds a third of all packages
INVENTORY = project(
    "part", "CASE WHEN p_partkey % 3 = 0 THEN 'every third' ELSE p_brand END AS capture_id", "'pkg-' || p_name || CAST(p_partkey AS STRING) AS name", "CASE WHEN p_size % 2 = 0 THEN 'amd64' ELSE 'i386' END AS architecture",
    "CAST(60 + p_size * 3 AS BIGINT) AS row_bytes", "CAST(200 AS BIGINT) AS overhead",
)
# brand 11 holds packages that fit no page
LARGE = project(
    "part", "CASE WHEN p_partkey % 3 = 0 THEN 'every third' ELSE p_brand END AS capture_id", "'pkg-' || p_name || CAST(p_partkey AS STRING) AS name", "CASE WHEN p_size % 2 = 0 THEN 'amd64' ELSE 'i386' END AS architecture",
    "CAST(CASE WHEN p_brand = 'Brand#11' AND p_size % 7 = 0 THEN 5000 ELSE 60 + p_size * 3 END AS BIGINT) AS row_bytes", "CAST(200 AS BIGINT) AS overhead",
)


def _pages_sql(rows, max_rows, max_bytes):
    """n: numbered packages with running bytes; p: one row for each page, found from the one before."""
    room = max_bytes - 199
    return f"""WITH RECURSIVE n AS (SELECT *, row_number() OVER w AS rn, CAST(sum(row_bytes + 1) OVER w AS BIGINT) AS upto FROM {rows} WINDOW w AS (PARTITION BY capture_id ORDER BY name, architecture)),
    p AS (SELECT capture_id, CAST(0 AS BIGINT) AS start, 0 AS page, CAST(0 AS BIGINT) AS used FROM n WHERE rn = 1
      UNION ALL SELECT p.capture_id, e.last, p.page + 1, e.upto FROM p JOIN LATERAL (SELECT max(rn) AS last, max(upto) AS upto FROM n
        WHERE n.capture_id = p.capture_id AND n.rn > p.start AND n.rn <= p.start + {max_rows} AND (n.upto - p.used <= {room} OR n.rn = p.start + 1)) e ON true
        WHERE EXISTS (SELECT 1 FROM n WHERE n.capture_id = p.capture_id AND n.rn > e.last)),
    g AS (SELECT n.capture_id, n.name, n.architecture, n.row_bytes, CAST(max(p.page) AS INT) AS page FROM n JOIN p ON p.capture_id = n.capture_id AND p.start < n.rn GROUP BY ALL)"""


@query("paginate", f"{_pages_sql(INVENTORY.sql, 20, 2200)} SELECT capture_id, name, architecture, page FROM g")
def paginate(spark, sf):
    pages, _ = op.paginate(INVENTORY.frame(spark, sf), max_rows=20, max_bytes=2200, max_packages=None)
    return pages.select("capture_id", "name", "architecture", "page")


@query(
    "page_counts",
    f"""{_pages_sql(LARGE.sql, 11, 1000)}, c AS (SELECT capture_id FROM {LARGE.sql} UNION SELECT 'Brand#' || p_size FROM part),
    r AS (SELECT *, CASE WHEN packages > 600 THEN 'package budget exceeded' WHEN large <= 10 THEN 'package exceeds page budget' WHEN last >= 10 THEN 'page budget exceeded' END AS reason
      FROM (SELECT capture_id, count(*) AS packages, max(page) AS last, min(CASE WHEN row_bytes + 200 > 1000 THEN page END) AS large FROM g GROUP BY 1))
    SELECT c.capture_id, CASE WHEN reason IS NULL THEN CAST(coalesce(last + 1, 1) AS INT) END AS pages, CASE WHEN reason IS NULL THEN coalesce(packages, 0) END AS packages, reason
    FROM c LEFT JOIN r ON r.capture_id = c.capture_id""",
)
def page_counts(spark, sf):
    inventory = LARGE.frame(spark, sf)
    empty = project("part", "'Brand#' || CAST(p_size AS STRING) AS capture_id").frame(spark, sf)
    captures = inventory.select("capture_id").union(empty).distinct()
    pages, refused = op.paginate(inventory, max_rows=11, max_bytes=1000, max_pages=10, max_packages=600)
    return op.page_counts(captures, pages, refused)


PAGES = project(
    EVENTS, "user_id AS snapshot_id", "CAST(k % 4 AS INT) AS page_no", "CASE WHEN user_id % 7 = 0 AND cents % 5 = 0 THEN 'conflict' ELSE 'd' || CAST(user_id AS STRING) || '-' || CAST(k % 4 AS STRING) END AS page_digest",
    "CAST(100 AS BIGINT) AS packages", where="user_id % 11 <> 4 OR k % 4 <> 3",
)
COMPLETIONS = project(
    EVENTS, "user_id AS snapshot_id", "CAST(4 AS INT) AS page_count", "CAST(CASE WHEN user_id % 9 = 0 THEN 399 ELSE 400 END AS BIGINT) AS package_count",
    "ARR('d' || CAST(user_id AS STRING) || '-0', 'd' || CAST(user_id AS STRING) || '-1', CASE WHEN user_id % 13 = 0 THEN 'x' ELSE 'd' || CAST(user_id AS STRING) || '-2' END, 'd' || CAST(user_id AS STRING) || '-3') AS page_digests",
)


@query(
    "reassemble_snapshot",
    f"""WITH p AS (SELECT snapshot_id, page_no, count(DISTINCT page_digest) AS d, min(page_digest) AS page_digest, max(packages) AS packages FROM {PAGES.sql} GROUP BY ALL),
    s AS (SELECT snapshot_id, max(d) AS d, count(*) AS n, sum(packages) AS packages, list(page_digest ORDER BY page_no) AS digests FROM p GROUP BY 1), c AS (SELECT DISTINCT * FROM {COMPLETIONS.sql})
    SELECT snapshot_id, refusal, refusal IS NULL AS complete FROM (SELECT c.snapshot_id, CASE WHEN d > 1 THEN 'conflicting page digest' WHEN coalesce(n, 0) <> page_count THEN 'page count' WHEN packages <> package_count THEN 'package count'
      WHEN digests <> page_digests THEN 'page digest' END AS refusal FROM c LEFT JOIN s ON s.snapshot_id = c.snapshot_id)""",
)
def reassemble_snapshot(spark, sf):
    return op.reassemble_snapshot(PAGES.frame(spark, sf), COMPLETIONS.frame(spark, sf).distinct())


REQUESTS = project(
    EVENTS, "event_id", "ARR('0f8fad5b-d9cb-469f-a165-70867728950e', CASE WHEN k % 12 = 0 THEN '0F8FAD5B-d9cb-469f-a165-70867728950e' ELSE '7c9e6679-7425-40de-944b-e07fc1f90ae7' END) AS ids",
    "TSUS(at_us) AS issued_at", "TSUS(at_us + (k - 5) * 60000000) AS expires_at", "CAST(CASE WHEN user_id % 8 = 0 THEN 10001 ELSE 10000 END AS INT) AS max_packages", "CAST(250 AS INT) AS max_page_packages", "CAST(40 AS INT) AS max_pages",
    "CAST(CASE WHEN user_id % 9 = 0 THEN 1000 ELSE 262144 END AS INT) AS max_page_bytes", "CAST(1900000 AS INT) AS max_capture_bytes", "CAST(120000 AS INT) AS max_capture_ms", "at_us",
)
NOW_US = 1_704_900_000_000_000


@query(
    "request_window_valid",
    f"""SELECT event_id, refusal, refusal IS NULL AS valid FROM (SELECT *, CASE WHEN contains(ids[2], 'F8') THEN 'identity' WHEN NOT (e > {NOW_US} AND at_us <= {NOW_US} + 30000000 AND e > at_us AND e - at_us <= 1800000000) THEN 'clock'
      WHEN max_packages > 10000 OR max_page_bytes < 1024 THEN 'limits' END AS refusal FROM (SELECT *, epoch_us(expires_at) AS e FROM {REQUESTS.sql}))""",
)
def request_window_valid(spark, sf):
    now = F.timestamp_micros(F.lit(NOW_US))
    return op.request_window_valid(REQUESTS.frame(spark, sf), now).select("event_id", "refusal", "valid")


_SHA = "sha2(p_name, 256)"
STANZAS = project(
    "part", "p_brand AS index_id", "p_partkey AS stanza_no",
    "'Package: ' || CASE p_size % 6 WHEN 0 THEN 'nginx-core' WHEN 1 THEN 'vim' WHEN 2 THEN 'apache2-bin' WHEN 3 THEN 'php8.3-cli' WHEN 4 THEN 'Bad_Name' ELSE 'libnginx-mod-x' END || chr(10) || 'Version: 1.' || CAST(p_size AS STRING) || chr(10) || 'Architecture: amd64' || chr(10)"
    " || CASE p_size % 5 WHEN 0 THEN 'Source: nginx (1.0)' || chr(10) WHEN 1 THEN 'Source: bad one two' || chr(10) WHEN 2 THEN 'no colon here' || chr(10) ELSE '' END || 'Description: x' || chr(10) || ' continued: y' || chr(10)"
    f" || CASE p_size % 7 WHEN 0 THEN 'Size: 0' WHEN 1 THEN 'Size: abc' ELSE 'Size: ' || CAST(p_partkey + 1 AS STRING) END || chr(10) || CASE WHEN p_size % 13 = 0 THEN 'Size: 9' || chr(10) ELSE '' END || 'SHA256: ' || {_SHA} || chr(10) AS stanza",
)
STANZAS_SQL = STANZAS.sql.replace(_SHA, "sha256(p_name)")


@query(
    "parse_stanzas",
    f"""WITH v AS (SELECT index_id, stanza_no, contains(stanza, 'no colon') OR len(string_split(stanza, chr(10) || 'Size:')) > 2 AS broken, regexp_extract(stanza, 'Package: ([^\\n]*)', 1) AS name, regexp_extract(stanza, 'Version: ([^\\n]*)', 1) AS version,
        regexp_extract(stanza, 'Source: ([^\\n]*)', 1) AS source, TRY_CAST(regexp_extract(stanza, 'Size: ([^\\n]*)', 1) AS BIGINT) AS size, regexp_extract(stanza, 'SHA256: ([^\\n]*)', 1) AS archive_sha FROM {STANZAS_SQL}),
    e AS (SELECT *, name <> 'vim' AS approved, CASE WHEN broken THEN 'invalid_control_metadata' WHEN name = 'Bad_Name' THEN 'invalid_index_identity' WHEN name <> 'vim' AND source = 'bad one two' THEN 'invalid_source_identity' END AS error FROM v)
    SELECT index_id, stanza_no, error, name, 'amd64' AS architecture, version, CASE WHEN source = '' THEN name WHEN source LIKE 'nginx%' THEN 'nginx' END AS source_name, CASE WHEN source = '' THEN version WHEN source LIKE 'nginx%' THEN '1.0' END AS source_version, archive_sha, size
    FROM e WHERE error IS NOT NULL OR (approved AND size >= 1)""",
)
def parse_stanzas(spark, sf):
    return op.parse_stanzas(STANZAS.frame(spark, sf))


_DIGEST = "repeat('ab', 32)"
RELEASE_TEXTS = project(
    EVENTS, "event_id AS release_id", "CASE WHEN k % 2 = 0 THEN 'ubuntu' ELSE 'debian' END AS os_id",
    "'Origin: ' || CASE WHEN k % 2 = 0 THEN 'Ubuntu' WHEN k % 10 = 1 THEN 'Mint' ELSE 'Debian' END || chr(10) || 'Suite: ' || CASE WHEN k % 2 = 0 THEN 'noble-updates' ELSE 'stable-security' END || chr(10) || 'Codename: ' || CASE WHEN k % 2 = 0 THEN 'noble'"
    " WHEN k % 7 = 0 THEN 'trixie' ELSE 'trixie-security' END || chr(10) || CASE WHEN k % 13 = 0 THEN 'Codename: again' || chr(10) ELSE '' END || 'Date: Thu, ' || CASE WHEN k % 9 = 0 THEN '10 Feb 2031' ELSE '11 Jan 2024' END || ' 10:00:00 UTC' || chr(10)"
    " || CASE k % 3 WHEN 0 THEN 'Valid-Until: Thu, 18 Jan 2024 10:00:00 +0000' || chr(10) WHEN 1 THEN CASE WHEN k % 5 = 0 THEN 'Valid-Until: soon' || chr(10) ELSE '' END ELSE '' END || 'MD5Sum:' || chr(10) || ' x 1 main/binary-amd64/Packages' || chr(10) || 'SHA256:' || chr(10)"
    f" || ' ' || {_DIGEST} || '   ' || CAST(k AS STRING) || ' main/binary-amd64/Packages' || chr(10) || ' ' || {_DIGEST} || ' 7 other/file' || chr(10) || CASE WHEN k % 17 = 0 THEN ' zz 7 main/x' || chr(10) ELSE '' END || 'Description: done' || chr(10) AS text",
)
RELEASE_SQL = f"""SELECT release_id, os_id, k, CASE WHEN k % 17 = 0 THEN 'invalid_release_checksum' WHEN k % 13 = 0 THEN 'duplicate_release_field' WHEN k % 2 = 1 AND k % 10 = 1 THEN 'unapproved_release' WHEN k % 9 = 0 THEN 'invalid_release_date'
    WHEN k % 2 = 1 AND k % 7 = 0 THEN 'unapproved_release_pocket' WHEN k % 3 = 1 AND k % 5 = 0 THEN 'invalid_release_expiry' END AS error FROM (SELECT event_id AS release_id, CASE WHEN k % 2 = 0 THEN 'ubuntu' ELSE 'debian' END AS os_id, k FROM {EVENTS.sql})"""


def _releases(spark, sf):
    return op.parse_release(RELEASE_TEXTS.frame(spark, sf), F.timestamp_micros(F.lit(NOW_US + 86_400_000_000)))


@query(
    "parse_release",
    f"""SELECT release_id, os_id, CASE WHEN k % 2 = 0 THEN 'noble' WHEN k % 7 = 0 THEN 'trixie' ELSE 'trixie-security' END AS codename,
      CASE WHEN k % 9 = 0 THEN 1928484000000000 ELSE 1704967200000000 END AS date, CASE WHEN k % 3 = 0 THEN 1705572000000000 END AS valid_until, error FROM ({RELEASE_SQL})""",
)
def parse_release(spark, sf):
    return emit(_releases(spark, sf)[0])


@query("release_indexes", f"SELECT release_id, 'main/binary-amd64/Packages' AS path, repeat('ab', 32) AS digest, k AS size FROM ({RELEASE_SQL}) WHERE error IS NULL AND k > 0")
def release_indexes(spark, sf):
    return _releases(spark, sf)[1]


_NAME = "CASE k % 6 WHEN 0 THEN 'nginx-core' WHEN 1 THEN 'apache2' WHEN 2 THEN 'php8.3-cli' WHEN 3 THEN 'libapache2-mod-php8.4' WHEN 4 THEN 'vim' ELSE 'libnginx-mod-x' END"
_SOURCE = "CASE k % 6 WHEN 0 THEN 'nginx' WHEN 1 THEN 'apache2' WHEN 2 THEN 'php8.3' WHEN 3 THEN 'php8.4' WHEN 4 THEN 'vim' ELSE 'nginx-mods' END"
INSTALLED = project(
    EVENTS, "user_id AS capture_id", "CASE WHEN user_id % 2 = 0 THEN 'ubuntu' ELSE 'debian' END AS os_id", f"{_NAME} AS name", "'amd64' AS architecture", "'1.' || CAST(k % 30 AS STRING) AS version",
    f"{_SOURCE} AS source_name", "'1.' || CAST(k % 30 AS STRING) AS source_version", "CASE WHEN cents % 9 = 0 THEN 'config-files' ELSE 'installed' END AS installation_state", "event_id",
)
INDEX = project(
    EVENTS, "'src' || CAST(user_id % 9 AS STRING) AS source_id", "CASE WHEN cents % 2 = 0 THEN 'ubuntu' ELSE 'debian' END AS os_id", f"{_NAME} AS name", "'amd64' AS architecture", "'1.' || CAST(k % 30 AS STRING) AS version",
    f"{_SOURCE} AS source_name", "'1.' || CAST(k % 30 AS STRING) AS source_version", "CASE WHEN k % 30 = 4 AND user_id % 20 = 0 THEN 'other' ELSE md5(CAST(k % 30 AS STRING)) END AS archive_sha",
    where="k % 30 < 20 AND k % 3 <> 1",
)
MATCH_SQL = f"""WITH x AS (SELECT os_id, name, version, source_name, count(DISTINCT archive_sha) AS n, min(source_id) AS source_id, min(archive_sha) AS archive_sha FROM {INDEX.sql} GROUP BY ALL),
    c AS (SELECT * FROM {INSTALLED.sql} WHERE installation_state = 'installed' AND (name IN ('nginx-core', 'apache2') OR (name = 'php8.3-cli' AND os_id = 'ubuntu') OR (name LIKE '%8.4' AND os_id = 'debian')))
    SELECT c.event_id, c.capture_id, c.name, c.version, CASE WHEN x.n IS NULL THEN 'exact_authenticated_package_missing' WHEN x.n > 1 THEN 'conflicting_published_artifacts' END AS reason,
      CASE WHEN x.n = 1 THEN x.source_id END AS source_id, CASE WHEN x.n = 1 THEN x.archive_sha END AS archive_sha
    FROM c LEFT JOIN x ON x.os_id = c.os_id AND x.name = c.name AND x.version = c.version AND x.source_name = c.source_name"""


@query("provenance_match", f"SELECT capture_id, name, version, reason, source_id, archive_sha FROM ({MATCH_SQL})")
def provenance_match(spark, sf):
    return op.provenance_match(INSTALLED.frame(spark, sf), INDEX.frame(spark, sf)).drop("architecture")


@query(
    "receipt_budget",
    f"SELECT capture_id, count(*) AS receipts, CASE WHEN count(*) > 25 THEN 'receipt_budget_exceeded' END AS error FROM ({MATCH_SQL}) GROUP BY capture_id",
)
def receipt_budget(spark, sf):
    receipts = op.provenance_match(INSTALLED.frame(spark, sf), INDEX.frame(spark, sf))
    return op.within_receipt_budget(receipts, 25)


PUBLISHED = project(
    "documents", "source AS package_id", "CASE WHEN doc_id % 301 = 5 THEN 'p0' ELSE 'p' || CAST(doc_id AS STRING) END AS path",
    "CASE doc_id % 10 WHEN 0 THEN 'symlink' WHEN 1 THEN 'directory' ELSE CASE WHEN doc_id % 397 = 6 THEN 'device' ELSE 'regular' END END AS kind", "md5(text) AS digest", "CASE WHEN doc_id % 10 = 0 THEN 't' || CAST(doc_id AS STRING) END AS target",
    "doc_id % 6 = 0 AS is_conffile", where="source <> 'src3' OR doc_id % 6 = 0",
)
HAVE = project(
    "documents", "source AS package_id", "'p' || CAST(doc_id AS STRING) AS path", "CASE WHEN doc_id % 211 = 3 THEN 'edited' ELSE md5(text) END AS digest",
    "CASE WHEN doc_id % 10 = 0 THEN CASE WHEN doc_id % 190 = 20 THEN 'elsewhere' ELSE 't' || CAST(doc_id AS STRING) END END AS target", where="doc_id % 419 <> 7",
)


@query(
    "verify_files",
    f"""WITH p AS (SELECT * FROM {PUBLISHED.sql} WHERE kind <> 'directory'),
    r AS (SELECT p.package_id, p.path, p.is_conffile, CASE WHEN p.is_conffile THEN NULL WHEN p.kind = 'symlink' THEN CASE WHEN p.target IS DISTINCT FROM h.target THEN 'installed_symlink_mismatch' END WHEN p.kind = 'device' THEN 'unsupported_payload_entry'
        WHEN p.digest IS DISTINCT FROM h.digest THEN 'installed_file_mismatch' END AS reason FROM p LEFT JOIN {HAVE.sql} h ON h.package_id = p.package_id AND h.path = p.path
      UNION ALL SELECT package_id, path, true, 'duplicate_payload_path' FROM p GROUP BY package_id, path HAVING count(*) > 1),
    g AS (SELECT package_id, arg_min(reason, (path, reason)) FILTER (reason IS NOT NULL) AS reason, count(*) FILTER (NOT is_conffile) AS checked FROM r GROUP BY 1),
    f AS (SELECT a.package_id, coalesce(reason, CASE WHEN coalesce(checked, 0) = 0 THEN 'empty_payload_manifest' END) AS reason FROM (SELECT DISTINCT package_id FROM {PUBLISHED.sql}) a LEFT JOIN g ON g.package_id = a.package_id)
    SELECT package_id, reason, CASE WHEN reason IS NULL THEN 'verified' ELSE 'unknown' END AS status FROM f""",
)
def verify_files(spark, sf):
    return op.verify_files(PUBLISHED.frame(spark, sf), HAVE.frame(spark, sf))


RECEIPTS = project(EVENTS, "user_id AS capture_id", "CASE WHEN user_id % 3 = 0 OR (user_id % 3 = 1 AND k % 4 = 0) THEN 'verified' ELSE 'unknown' END AS status")
# the last five captures have no receipt
REPORTS = project(EVENTS, "user_id + 5 AS capture_id", "user_id % 5 <> 0 AS stable", "CAST(user_id % 4 AS INT) DIV 3 AS errors")


@query(
    "provenance_status",
    f"""WITH t AS (SELECT capture_id, count(*) AS receipts, count(*) FILTER (status = 'verified') AS verified FROM {RECEIPTS.sql} GROUP BY 1), c AS (SELECT DISTINCT * FROM {REPORTS.sql}),
    j AS (SELECT c.*, coalesce(receipts, 0) AS receipts, coalesce(verified, 0) AS v FROM c LEFT JOIN t ON t.capture_id = c.capture_id)
    SELECT capture_id, CASE WHEN NOT stable OR v = 0 THEN 'unknown' WHEN v = receipts AND errors = 0 THEN 'verified' ELSE 'partial' END AS status, receipts, CASE WHEN stable THEN v ELSE 0 END AS verified FROM j""",
)
def provenance_status(spark, sf):
    return op.provenance_status(RECEIPTS.frame(spark, sf), REPORTS.frame(spark, sf).distinct())


_P = ("p_brand AS capture_id", "'pkg' || CAST(p_partkey AS STRING) AS name", "'amd64' AS architecture")
CLAIMED = project(
    "part", *_P, "'1.' || CAST(p_size AS STRING) AS version", "'src' AS source_name", "'1' AS source_version", "CASE WHEN p_partkey % 4 = 0 OR p_partkey % 1501 = 1 THEN 'official' ELSE 'unknown' END AS origin",
    "CASE WHEN p_partkey % 4 = 0 THEN 'provenance:' || CASE WHEN p_partkey % 1000 = 12 THEN 'x' ELSE md5(p_name) END ELSE '' END AS evidence",
)
CLAIM_RECEIPTS = project(
    "part", *_P, "CASE WHEN p_partkey % 700 = 8 THEN '9' ELSE '1.' || CAST(p_size AS STRING) END AS version", "'src' AS source_name", "'1' AS source_version", "CASE WHEN p_partkey % 4 = 0 THEN 'verified' ELSE 'unknown' END AS status",
    "CAST(CASE WHEN p_partkey % 4 = 0 THEN CASE WHEN p_partkey % 900 = 16 THEN 1 ELSE 0 END ELSE 1 END AS INT) AS reasons", "md5(p_name) AS receipt_digest", where="p_partkey % 8 < 6",
)
CLAIM_REPORTS = project("part", "p_brand AS capture_id", "CASE WHEN p_brand LIKE '%7' THEN 'verified' ELSE 'partial' END AS status", "CAST(0 AS INT) AS errors", "p_brand NOT LIKE '%3' AS complete")


@query(
    "provenance_consistency",
    f"""WITH r AS {CLAIM_RECEIPTS.sql}, p AS {CLAIMED.sql}, q AS (SELECT DISTINCT * FROM {CLAIM_REPORTS.sql}), t AS (SELECT capture_id, count(*) AS n, count(*) FILTER (status = 'verified') AS v FROM r GROUP BY 1),
    j AS (SELECT p.*, v.version AS rv, v.receipt_digest, q.status AS rs, q.complete FROM p LEFT JOIN (SELECT * FROM r WHERE status = 'verified') v ON v.capture_id = p.capture_id AND v.name = p.name LEFT JOIN q ON q.capture_id = p.capture_id)
    SELECT DISTINCT capture_id, 'invalid_provenance_reasons' AS error FROM r WHERE status = 'verified' AND reasons > 0
    UNION ALL SELECT q.capture_id, 'invalid_provenance_summary' FROM q LEFT JOIN t ON t.capture_id = q.capture_id WHERE q.status <> CASE WHEN coalesce(v, 0) = 0 THEN 'unknown' WHEN v = n THEN 'verified' ELSE 'partial' END
    UNION ALL SELECT DISTINCT capture_id, 'provenance_summary_origin_mismatch' FROM j WHERE receipt_digest IS NOT NULL AND origin <> 'official'
    UNION ALL SELECT DISTINCT capture_id, 'unqualified_provenance_origin' FROM j WHERE origin = 'official' AND NOT (complete AND rs IN ('verified', 'partial'))
    UNION ALL SELECT DISTINCT capture_id, 'provenance_package_identity_mismatch' FROM j WHERE origin = 'official' AND version IS DISTINCT FROM rv
    UNION ALL SELECT DISTINCT capture_id, 'provenance_receipt_digest_mismatch' FROM j WHERE origin = 'official' AND evidence <> 'provenance:' || receipt_digest""",
)
def provenance_consistency(spark, sf):
    return op.provenance_consistency(CLAIMED.frame(spark, sf), CLAIM_RECEIPTS.frame(spark, sf), CLAIM_REPORTS.frame(spark, sf).distinct())
