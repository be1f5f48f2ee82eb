"""Posted records over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.adapters import EVENTS, project
from fleetlens.operators import intake as op
from fleetlens.plans.registry import emit, query
from fleetlens.sources import schemas
from fleetlens.sources.readers import explode_results, parse_records

_ISO = "replace(CAST(TSUS(at_us DIV 1000000 * 1000000) AS STRING), ' ', 'T') || 'Z'"
HEARTBEAT_LINES = project(
    EVENTS, "event_id",
    f"""CASE WHEN k = 99 THEN '{{"server_id": broken' ELSE '{{"server_id":"h' || CAST(user_id AS STRING) || '","timestamp":"' || {_ISO} || '","cpu_percent":' || CAST(k AS STRING) || '.5,"new_key":{{"x":' || CAST(k AS STRING) || '}},"network_counters":['
      || CASE WHEN k % 5 = 0 THEN '' ELSE '{{"name":"eth0","rx_bytes":' || CAST(cents AS STRING) || ',"tx_bytes":18446744073709551615}},{{"name":"lo","rx_bytes":1,"tx_bytes":2}}' END
      || '],"disks":' || CASE WHEN k % 4 = 0 THEN 'null' ELSE '[{{"device":"/dev/sda1","mountpoint":"/","total_bytes":100,"used_bytes":' || CAST(k AS STRING) || ',"used_percent":' || CAST(k AS STRING) || '.0}}]' END || '}}' END AS value""",
)
_SECONDS_US = "at_us // 1000000 * 1000000"


@query(
    "read_heartbeats",
    f"""SELECT 'h' || user_id AS server_id, {_SECONDS_US} AS timestamp, k + CAST(0.5 AS DOUBLE) AS cpu_percent, CAST(k AS VARCHAR) AS new_key,
      CAST(CASE WHEN k % 5 = 0 THEN 0 ELSE 2 END AS INT) AS counters FROM {EVENTS.sql} WHERE k < 99""",
)
def read_heartbeats(spark, sf):
    records = parse_records(HEARTBEAT_LINES.frame(spark, sf), schemas.HEARTBEAT).filter("raw IS NOT NULL")
    return emit(
        records, "server_id", "timestamp", "cpu_percent", F.try_variant_get("raw", "$.new_key.x", "string").alias("new_key"),
        F.size("network_counters").alias("counters"),
    )


@query(
    "explode_children",
    f"""SELECT 'h' || user_id AS server_id, {_SECONDS_US} AS timestamp, name, CASE WHEN name = 'lo' THEN '1' ELSE CAST(cents AS VARCHAR) END AS rx_bytes, CASE WHEN name = 'lo' THEN '2' ELSE '18446744073709551615' END AS tx_bytes
    FROM {EVENTS.sql}, (VALUES ('eth0'), ('lo')) AS n(name) WHERE k < 99 AND k % 5 <> 0""",
)
def explode_children(spark, sf):
    records = parse_records(HEARTBEAT_LINES.frame(spark, sf), schemas.HEARTBEAT)
    out = op.explode_children(records, "network_counters")
    return emit(out.withColumns({c: F.col(c).cast("string") for c in ("rx_bytes", "tx_bytes")}))


BATCH_LINES = project(
    EVENTS, "event_id",
    f"""'{{"server_id":"h' || CAST(user_id AS STRING) || '","results":[' || CASE WHEN k % 6 = 0 THEN '' ELSE '{{"monitor_id":"m' || CAST(k AS STRING) || '","checked_at":"' || {_ISO} || '","status":"ok","latency_ms":' || CAST(cents AS STRING)
      || ',"details":{{"port":' || CAST(k AS STRING) || '}}}},{{"monitor_id":"m' || CAST(k + 1 AS STRING) || '","checked_at":null,"status":"critical","latency_ms":null,"details":{{}}}}' END || ']}}' AS value""",
)
BATCH_SQL = f"""SELECT 'h' || user_id AS server_id, 'm' || k AS monitor_id, {_SECONDS_US} AS checked_at, 'ok' AS status, cents AS latency_ms, CAST(k AS VARCHAR) AS port FROM {EVENTS.sql} WHERE k % 6 <> 0
    UNION ALL SELECT 'h' || user_id, 'm' || (k + 1), NULL, 'critical', NULL, NULL FROM {EVENTS.sql} WHERE k % 6 <> 0"""


@query("read_check_results", BATCH_SQL)
def read_check_results(spark, sf):
    rows = explode_results(parse_records(BATCH_LINES.frame(spark, sf), schemas.CHECK_BATCH))
    return emit(rows, "server_id", "monitor_id", "checked_at", "status", "latency_ms", F.try_variant_get("details", "$.port", "string").alias("port"))


@query(
    "quarantine",
    f"""SELECT server_id, monitor_id, CASE WHEN status = 'critical' THEN 'missing checked_at,missing latency_ms' END AS reasons FROM ({BATCH_SQL})""",
)
def quarantine(spark, sf):
    rows = explode_results(parse_records(BATCH_LINES.frame(spark, sf), schemas.CHECK_BATCH))
    good, bad = op.quarantine(rows, op.endpoint_rules("results"))
    good = good.select("server_id", "monitor_id", F.lit(None).cast("string").alias("reasons"))
    return good.unionByName(bad.select("server_id", "monitor_id", F.array_join("reasons", ",").alias("reasons")))


CHECK_TYPES = project(
    EVENTS, "event_id",
    """CASE k % 6 WHEN 0 THEN '["active_state","port"]' WHEN 1 THEN '{"port":true}' WHEN 2 THEN '"port"' WHEN 3 THEN '[1,2]' WHEN 4 THEN '["http"]' ELSE '[broken' END AS check_types""",
)


@query("string_array", f"SELECT event_id, CASE check_types WHEN '[\"active_state\",\"port\"]' THEN 'active_state,port' WHEN '[\"http\"]' THEN 'http' END AS check_types FROM {CHECK_TYPES.sql}")
def string_array(spark, sf):
    return CHECK_TYPES.frame(spark, sf).select("event_id", F.array_join(op.string_array(F.col("check_types")), ",").alias("check_types"))


COMMAND_FIELDS = project(
    EVENTS, "event_id", "k",
    """CASE k % 6 WHEN 0 THEN 'null' WHEN 1 THEN '' WHEN 2 THEN '"discover_services"' WHEN 3 THEN '{"type":"exec_script","command_id":"c' || CAST(event_id AS STRING) || '","timeout_seconds":5}' WHEN 4 THEN '{"type":"install_capability"}' ELSE '""' END AS pending_command""",
)


@query(
    "parse_string_or_object",
    f"""SELECT event_id, CASE k % 6 WHEN 2 THEN 'discover_services' WHEN 5 THEN '' END AS legacy, CASE k % 6 WHEN 3 THEN 'exec_script' WHEN 4 THEN 'install_capability' END AS type,
      CASE k % 6 WHEN 3 THEN 'c' || event_id END AS command_id FROM {COMMAND_FIELDS.sql}""",
)
def parse_string_or_object(spark, sf):
    parsed = op.parse_string_or_object(F.col("pending_command"))
    return COMMAND_FIELDS.frame(spark, sf).select("event_id", parsed.alias("p")).select("event_id", "p.*")


ACTIONS = project(
    EVENTS, "event_id", "CASE WHEN k % 9 = 0 THEN '' WHEN k % 9 <> 1 THEN 'r1' END AS run_id", "CASE WHEN k % 4 = 0 THEN 'ansible' WHEN k % 4 = 1 THEN '' ELSE 'plan' END AS action_type",
    "CASE WHEN k % 3 = 0 THEN 'site.yml' END AS ansible_playbook",
)


@query(
    "validate_action",
    f"""SELECT event_id, CASE WHEN coalesce(run_id, '') = '' THEN 'run_id is required' WHEN action_type = '' THEN 'action_type is required' WHEN action_type = 'ansible' AND ansible_playbook IS NULL THEN 'ansible_playbook is required' END AS error FROM {ACTIONS.sql}""",
)
def validate_action(spark, sf):
    return op.validate_action(ACTIONS.frame(spark, sf)).select("event_id", "error")


JOBS = project(EVENTS, "event_id", "k", "CASE WHEN k % 9 = 0 THEN '' ELSE 'r' END AS run_id", "CASE WHEN k % 8 = 0 THEN '' ELSE 'v1' END AS bundle_version")


@query(
    "validate_audit_job",
    f"""SELECT event_id, CASE WHEN run_id = '' THEN 'run_id is required' WHEN bundle_version = '' THEN 'bundle_version is required' WHEN k % 7 = 0 THEN 'checks is required' WHEN k % 7 = 1 THEN 'check_key is required'
      WHEN k % 7 = 2 THEN 'check b is not read-only' END AS error FROM {JOBS.sql}""",
)
def validate_audit_job(spark, sf):
    def check(key, read_only):
        return F.struct(F.lit(key).alias("check_key"), F.lit(read_only).alias("read_only"))

    m = F.col("k") % 7
    checks = (
        F.when(m == 0, F.filter(F.array(check("a", True)), lambda c: F.lit(False)))
        .when(m == 1, F.array(check("a", True), check("", False)))
        .when(m == 2, F.array(check("a", True), check("b", False), check("", True)))
        .otherwise(F.array(check("a", True)))
    )
    return op.validate_audit_job(JOBS.frame(spark, sf).withColumn("checks", checks)).select("event_id", "error")


CONFIGS = project(EVENTS, "user_id AS host_id", "seen_at AS fetched_at", "event_id", "k AS version", "event_type AS policy", "'x' AS pending_command", "'y' AS command_id")


@query(
    "latest_state",
    f"SELECT host_id, epoch_us(arg_max(fetched_at, event_id)) AS fetched_at, max(event_id) AS event_id, arg_max(version, event_id) AS version, arg_max(policy, event_id) AS policy FROM {CONFIGS.sql} GROUP BY host_id",
)
def latest_state(spark, sf):
    return emit(op.cached_config(CONFIGS.frame(spark, sf), "host_id", ["fetched_at", "event_id"]))


POSTED = project(EVENTS, "'r' || CAST(user_id * 10 + k % 10 AS STRING) AS run_id", "event_id", "seen_at", "event_type AS status")
LANDED = project(EVENTS, "'r' || CAST(user_id * 10 + k % 10 AS STRING) AS run_id", where="k = 7 OR user_id % 6 = 0")


@query(
    "land_once",
    f"""SELECT run_id, min(event_id) AS event_id, epoch_us(min(seen_at)) AS seen_at, arg_min(status, event_id) AS status FROM {POSTED.sql} p WHERE NOT EXISTS (SELECT 1 FROM {LANDED.sql} l WHERE l.run_id = p.run_id) GROUP BY run_id""",
)
def land_once(spark, sf):
    return emit(op.land_once(POSTED.frame(spark, sf), LANDED.frame(spark, sf), "run_id", ["seen_at", "event_id"]))


POLLS = project(
    EVENTS, "event_id", "user_id AS host_id", "seen_at AS fetched_at",
    "CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN 'nonsense' WHEN 2 THEN 'run_playbook:restart:i:m' ELSE 'discover_services' END AS command", "CASE WHEN k % 7 = 0 THEN '' WHEN k < 60 THEN 'c1' ELSE 'c2' END AS command_id",
)


@query(
    "suppress_repeat_commands",
    f"""WITH v AS (SELECT *, command || ':' || CASE WHEN command_id = '' THEN CAST(fetched_at AS VARCHAR) ELSE command_id END AS key FROM {POLLS.sql} WHERE command NOT IN ('', 'nonsense')),
    l AS (SELECT *, lag(key) OVER (PARTITION BY host_id ORDER BY fetched_at, event_id) AS previous FROM v) SELECT event_id, host_id, command, command_id FROM l WHERE key IS DISTINCT FROM previous""",
)
def suppress_repeat_commands(spark, sf):
    return op.suppress_repeat_commands(POLLS.frame(spark, sf)).select("event_id", "host_id", "command", "command_id")


ATTEMPTS = project(
    EVENTS, "'r' || CAST(user_id % 3 AS STRING) AS run_id", "event_id AS attempt_id", "at_us AS started_us",
    "at_us + CASE WHEN k % 97 = 0 THEN 10800000000 WHEN k % 89 = 0 THEN 3600000000 ELSE (k + 1) * 5000000 END AS finished_us", "k % 4 <> 0 AS handled",
)


def greedy_sql(rows: str, key: str, at: str, until: str, tie: str) -> str:
    """Accepted rows by walking each key, one accepted row a step."""
    return f"""n AS (SELECT * FROM ({rows})),
    a AS (SELECT {key} AS key, arg_min({tie}, ({at}, {tie})) AS id, arg_min({until}, ({at}, {tie})) AS until FROM n GROUP BY {key}
      UNION ALL SELECT a.key, x.id, x.until FROM a JOIN LATERAL (SELECT arg_min({tie}, ({at}, {tie})) AS id, arg_min({until}, ({at}, {tie})) AS until FROM n WHERE n.{key} = a.key AND n.{at} >= a.until) x ON true WHERE x.id IS NOT NULL)"""


@query(
    "suppress_within_ttl",
    f"""WITH RECURSIVE {greedy_sql(f"SELECT *, CASE WHEN handled THEN finished_us + 1800000001 ELSE finished_us END AS until_us FROM {ATTEMPTS.sql}", 'run_id', 'started_us', 'until_us', 'attempt_id')}
    SELECT run_id, attempt_id, attempt_id IN (SELECT id FROM a) AS accepted FROM {ATTEMPTS.sql}""",
)
def suppress_within_ttl(spark, sf):
    return op.suppress_within_ttl(ATTEMPTS.frame(spark, sf)).select("run_id", "attempt_id", "accepted")
