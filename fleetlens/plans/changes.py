"""Change logs, fences and signed tasks over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.adapters import EVENTS, project
from fleetlens.operators import changes as op
from fleetlens.plans.intake import greedy_sql
from fleetlens.plans.registry import emit, query

LOG = project(
    EVENTS, "'db' || CAST(user_id % 3 AS STRING) AS db", "CASE WHEN k = 50 AND user_id = 9 THEN '$cmd' ELSE event_type END AS collection",
    "CASE WHEN k = 77 THEN 'n' WHEN k % 3 = 0 THEN 'i' WHEN k % 3 = 1 THEN 'u' ELSE 'd' END AS op", "user_id AS doc_id", "'v' || CAST(event_id AS STRING) AS document",
    "at_us DIV 1000000 AS seconds", "event_id AS increment", "event_id",
)
START, END = 1_704_500_000, 1_706_000_000


def _log(spark, sf):
    log = LOG.frame(spark, sf).withColumn("position", F.struct("seconds", "increment"))
    bounds = log.select("db").distinct().select(
        "db", F.struct(F.lit(START).cast("long").alias("seconds"), F.lit(7).cast("long").alias("increment")).alias("start"),
        F.struct(F.when(F.col("db") == "db2", 1_800_000_000).otherwise(END).cast("long").alias("seconds"), F.lit(0).cast("long").alias("increment")).alias("end"),
    )
    return log, bounds


_IN = f"(seconds, increment) > ({START}, 7) AND (seconds, increment) <= (CASE WHEN db = 'db2' THEN 1800000000 ELSE {END} END, 0)"
_SUPPORTED = "op IN ('i', 'u', 'd') AND collection <> '$cmd'"
MUTATIONS_SQL = f"""SELECT db, collection, doc_id, CASE WHEN arg_max(op, event_id) <> 'd' THEN arg_max(document, event_id) END AS document, max(event_id) AS increment FROM {LOG.sql} WHERE {_IN} AND {_SUPPORTED} GROUP BY ALL"""


@query("compact_changes", MUTATIONS_SQL)
def compact_changes(spark, sf):
    return op.compact_changes(*_log(spark, sf))[0].select("db", "collection", "doc_id", "document", "position.increment")


@query("unsupported_changes", f"SELECT db, collection, op, count(*) AS operations FROM {LOG.sql} WHERE {_IN} AND NOT ({_SUPPORTED}) GROUP BY ALL")
def unsupported_changes(spark, sf):
    return op.compact_changes(*_log(spark, sf))[1]


BASE = project(EVENTS, "'db' || CAST(user_id % 3 AS STRING) AS db", "event_type AS collection", "user_id AS doc_id", "'base' || CAST(user_id AS STRING) AS document", where="user_id % 4 <> 0")


@query(
    "apply_delta",
    f"""WITH b AS (SELECT DISTINCT * FROM {BASE.sql}), m AS ({MUTATIONS_SQL})
    SELECT * FROM (SELECT coalesce(b.db, m.db) AS db, coalesce(b.collection, m.collection) AS collection, coalesce(b.doc_id, m.doc_id) AS doc_id, CASE WHEN m.db IS NULL THEN b.document ELSE m.document END AS document
      FROM b FULL JOIN m ON b.db = m.db AND b.collection = m.collection AND b.doc_id = m.doc_id) WHERE document IS NOT NULL""",
)
def apply_delta(spark, sf):
    return op.apply_delta(BASE.frame(spark, sf).distinct(), op.compact_changes(*_log(spark, sf))[0])


@query("changed_after", f"SELECT db, max((seconds, increment)) > (CASE WHEN db = 'db2' THEN 1800000000 ELSE {END} END, 0) AS unstable FROM {LOG.sql} GROUP BY db")
def changed_after(spark, sf):
    return op.changed_after(*_log(spark, sf))


DELTA = project(
    EVENTS, "user_id % 10 AS delta_id", "CASE WHEN k = 3 THEN '1bad' ELSE event_type END AS collection", "event_id",
    """CASE k % 8 WHEN 0 THEN '[1]' WHEN 1 THEN '{broken' WHEN 2 THEN '"a' || CAST(event_id % 4000 AS STRING) || '"' ELSE CAST(event_id % 4000 AS STRING) END AS doc_id""",
    """CASE k % 7 WHEN 0 THEN 'null' WHEN 1 THEN '{"_id":-5,"x":1}' WHEN 2 THEN '{"x":1}' ELSE CASE k % 8 WHEN 2 THEN '{"x":2,"_id":"a' || CAST(event_id % 4000 AS STRING) || '"}' ELSE '{"_id": ' || CAST(event_id % 4000 AS STRING) || ' }' END END AS document""", "k",
)


@query(
    "validate_delta",
    f"""WITH e AS (SELECT *, CASE WHEN collection = '1bad' THEN 'collection' WHEN k % 8 < 2 THEN 'identity is invalid' WHEN k % 7 IN (1, 2) THEN 'identity changed' END AS error FROM {DELTA.sql})
    SELECT delta_id, collection, doc_id, error FROM e WHERE error IS NOT NULL UNION ALL SELECT delta_id, collection, doc_id, 'duplicate identity' FROM e GROUP BY ALL HAVING count(*) > 1""",
)
def validate_delta(spark, sf):
    return op.validate_delta(DELTA.frame(spark, sf))


SLOTS = project(
    EVENTS, "user_id AS slot_id", "seen_at", "event_id AS poll_id",
    "CASE WHEN k % 9 = 0 THEN NULL ELSE '1/' || upper(substr(md5(CAST(event_id AS STRING)), 1, 6)) END AS remote_lsn", "CASE WHEN k % 4 = 0 THEN '0/FFFFFF' WHEN k = 11 THEN '2/0' END AS latest_end_lsn",
    "'1/' || upper(substr(md5(CAST(user_id AS STRING)), 1, 6)) AS source_lsn", "cents AS wal_bytes", "CASE WHEN user_id % 5 = 0 THEN 1000000 ELSE 30000 END AS max_wal_bytes", "user_id % 3 > 0 OR k % 2 = 0 AS active", "k > 96 AS ready", "user_id % 7 > 0 OR k <> 50 AS present",
    "TSUS(1705000000000000 + user_id * 5000000000) AS deadline",
)
_LSN = "CAST(CAST('0x' || split_part({0}, '/', 1) AS UBIGINT) AS HUGEINT) * 4294967296 + CAST('0x' || split_part({0}, '/', 2) AS UBIGINT)"


@query(
    "catchup_status",
    f"""WITH s AS (SELECT *, greatest(coalesce({_LSN.format('remote_lsn')}, 0), coalesce({_LSN.format('latest_end_lsn')}, 0)) >= {_LSN.format('source_lsn')} AS applied, lag(active) OVER w AS was FROM {SLOTS.sql} WINDOW w AS (PARTITION BY slot_id ORDER BY seen_at, poll_id)),
    i AS (SELECT *, max(CASE WHEN NOT active AND coalesce(was, true) THEN seen_at END) OVER (PARTITION BY slot_id ORDER BY seen_at, poll_id) AS since FROM s),
    d AS (SELECT *, CASE WHEN NOT present THEN 'slot vanished' WHEN NOT active AND epoch_us(seen_at) - epoch_us(since) > 10000000 THEN 'slot inactive' WHEN wal_bytes > max_wal_bytes THEN 'log over its ceiling' WHEN ready AND applied THEN 'caught up' WHEN seen_at > deadline THEN 'deadline' END AS decision FROM i)
    SELECT slot_id, coalesce(arg_min(decision, (seen_at, poll_id)) FILTER (decision IS NOT NULL), 'running') AS status, epoch_us(min(seen_at) FILTER (decision IS NOT NULL)) AS decided_at, count(*) AS polls FROM d GROUP BY slot_id""",
)
def catchup_status(spark, sf):
    return emit(op.catchup_status(SLOTS.frame(spark, sf).withColumnRenamed("seen_at", "at")))


SNAPSHOTS = project(EVENTS, "event_id DIV 2 AS run_id", "CASE WHEN event_id % 2 = 0 THEN 'before' ELSE 'after' END AS phase", "CASE WHEN k < 15 THEN 'other' ELSE 'd' || CAST(event_id DIV 2 AS STRING) END AS db_digest", "CASE WHEN k > 90 THEN 'f2' ELSE 'f' END AS file_digest")
RUN_FENCES = project(
    EVENTS, "event_id DIV 2 AS run_id", "CASE WHEN k % 3 = 0 THEN 'd' || CAST(event_id DIV 2 AS STRING) WHEN k % 12 = 1 THEN 'stale' END AS expected_db", "CASE WHEN k % 5 = 0 THEN 'f' WHEN k % 5 = 1 THEN 'f2' END AS expected_files",
    "user_id % 6 <> 0 AS active", "CASE WHEN user_id % 7 = 0 THEN 1 ELSE 0 END AS violations", "CASE WHEN user_id % 11 = 0 THEN 1 ELSE 0 END AS watchdog_errors", where="event_id % 2 = 0 AND event_id % 50 <> 0",
)


@query(
    "quiescent",
    f"""WITH b AS (SELECT run_id, max(db_digest) FILTER (phase = 'before') AS bd, max(db_digest) FILTER (phase = 'after') AS ad, max(file_digest) FILTER (phase = 'before') AS bf, max(file_digest) FILTER (phase = 'after') AS af FROM {SNAPSHOTS.sql} GROUP BY 1)
    SELECT run_id, reason, reason IS NULL AS quiescent FROM (SELECT b.run_id, CASE WHEN NOT coalesce(active AND violations = 0 AND watchdog_errors = 0, false) THEN 'fence was violated' WHEN bd <> ad OR bf <> af OR bd IS NULL OR ad IS NULL THEN 'source changed during the interval'
      WHEN expected_db <> ad THEN 'database changed after the dump' WHEN expected_files <> af THEN 'files changed after the manifest' END AS reason FROM b LEFT JOIN {RUN_FENCES.sql} f ON f.run_id = b.run_id)""",
)
def quiescent(spark, sf):
    return op.quiescent(SNAPSHOTS.frame(spark, sf), RUN_FENCES.frame(spark, sf))


FENCES = project(
    EVENTS, "'f' || CAST(event_id DIV 2 AS STRING) AS fence_id", "event_id DIV 2 % 20 AS host_id", "CASE WHEN event_id % 2 = 0 THEN 'error' ELSE 'click' END AS service", "TSUS(1704067200000000 + event_id DIV 2 * 60000000) AS active_from",
    "TSUS(1704067200000000 + event_id DIV 2 * 60000000 + (1 + event_id DIV 2 % 30) * 3600000000) AS active_to", where="event_id DIV 2 % 5 = 0",
)
POLLED = project(
    EVENTS, "user_id % 20 AS host_id", "event_type AS service", "TSUS(at_us DIV 600000000 * 600000000) AS at", "CASE WHEN k % 10 = 0 THEN NULL ELSE k % 3 = 0 END AS running",
)
POLLED_SQL = POLLED.sql.replace("AS at,", "AS seen,")


@query(
    "fence_violations",
    f"""WITH h AS (SELECT f.fence_id, p.seen, bool_or(p.running IS NULL) AS unreadable FROM {FENCES.sql} f JOIN {POLLED_SQL} p ON p.host_id = f.host_id AND p.service = f.service AND p.seen >= f.active_from AND p.seen < f.active_to
      WHERE p.running OR p.running IS NULL GROUP BY ALL), c AS (SELECT fence_id, count(*) AS violations, count(*) FILTER (unreadable) AS watchdog_errors, max(seen) AS last FROM h GROUP BY 1)
    SELECT f.fence_id, coalesce(violations, 0) AS violations, coalesce(watchdog_errors, 0) AS watchdog_errors, epoch_us(last) AS last_violation FROM (SELECT DISTINCT fence_id FROM {FENCES.sql}) f LEFT JOIN c ON c.fence_id = f.fence_id""",
)
def fence_violations(spark, sf):
    return emit(op.fence_violations(FENCES.frame(spark, sf), POLLED.frame(spark, sf)))


TOKENS = project(EVENTS, "user_id % 25 AS migration_id", "event_type AS domain", "seen_at", "event_id AS task_id", "event_id DIV 500 + k DIV 10 AS token")


@query(
    "reject_stale_tokens",
    f"""SELECT task_id, token, coalesce(token < max(token) OVER (PARTITION BY migration_id, domain ORDER BY seen_at, task_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stale FROM {TOKENS.sql}""",
)
def reject_stale_tokens(spark, sf):
    return op.reject_stale_tokens(TOKENS.frame(spark, sf).withColumnRenamed("seen_at", "at")).select("task_id", "token", "stale")


# issued between 680 s before and 39 s after they are received
TASKS = project(
    EVENTS, "'n' || CAST(user_id % 4 AS STRING) AS nonce", "event_id AS task_id", "at_us AS received_us", "at_us + (k - 3) * 6500000 AS expires_us",
    "at_us + (event_id * 37 % 720 - 680) * 1000000 AS issued_us",
)
_IN_TIME = "expires_us > received_us AND issued_us <= received_us + 30000000 AND expires_us - issued_us <= 600000000"


@query(
    "reject_replays",
    f"""WITH RECURSIVE {greedy_sql(f"SELECT * FROM {TASKS.sql} WHERE {_IN_TIME}", 'nonce', 'received_us', 'expires_us', 'task_id')}
    SELECT nonce, task_id, CASE WHEN NOT ({_IN_TIME}) THEN 'expiry' WHEN task_id IN (SELECT id FROM a) THEN 'accepted' ELSE 'replay' END AS verdict FROM {TASKS.sql}""",
)
def reject_replays(spark, sf):
    return op.reject_replays(TASKS.frame(spark, sf)).select("nonce", "task_id", "verdict")


PROGRESS = project(EVENTS, "user_id AS attempt_id", "event_id AS sequence", "event_type AS phase", "cents AS completed", "k AS total")


@query("progress_latest", f"SELECT attempt_id, max(sequence) AS sequence, arg_max(phase, sequence) AS phase, arg_max(completed, sequence) AS completed, arg_max(total, sequence) AS total FROM {PROGRESS.sql} GROUP BY attempt_id")
def progress_latest(spark, sf):
    return op.progress_latest(PROGRESS.frame(spark, sf))


FENCE_STATES = project(EVENTS, "user_id AS migration_id", "seen_at", "event_id AS state_id", "k AS run_id", "k % 3 <> 0 AS active", "cents AS violation_count")


@query(
    "active_attestations",
    f"SELECT migration_id, max(state_id) AS state_id, epoch_us(max(seen_at)) AS at, arg_max(run_id, state_id) AS run_id, true AS active, arg_max(violation_count, state_id) AS violation_count FROM {FENCE_STATES.sql} GROUP BY migration_id HAVING arg_max(active, state_id)",
)
def active_attestations(spark, sf):
    return emit(op.active_attestations(FENCE_STATES.frame(spark, sf).withColumnRenamed("seen_at", "at")))


POSITIONS = project(
    EVENTS, "event_id", "k",
    """CASE k % 7 WHEN 0 THEN '{"seconds":' || CAST(event_id AS STRING) || ',"increment":3}' WHEN 1 THEN '{"seconds":{"$numberInt":"' || CAST(event_id AS STRING) || '"},"increment":{"$numberLong":"-4"}}' WHEN 2 THEN '{"seconds":"5","increment":1}'
      WHEN 3 THEN '{"seconds":1}' WHEN 4 THEN '{"seconds":{"$numberLong":"x"},"increment":1}' WHEN 5 THEN 'broken' ELSE '{"seconds":1.5,"increment":1}' END AS json""",
)


@query("log_position", f"SELECT event_id, CASE WHEN k % 7 < 2 THEN event_id END AS seconds, CASE k % 7 WHEN 0 THEN 3 WHEN 1 THEN -4 END AS increment FROM {POSITIONS.sql}")
def log_position(spark, sf):
    return POSITIONS.frame(spark, sf).select("event_id", op.log_position(F.col("json")).alias("p")).select("event_id", "p.seconds", "p.increment")
