"""Checks, incidents and remediation over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.adapters import CHECK_RESULTS, EVENTS, project
from fleetlens.operators import checks as op
from fleetlens.plans.registry import emit, query

RESULTS = CHECK_RESULTS.sql
RANK = "CASE status WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END"
UNRANK = "CASE {} WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'ok' END"


@query(
    "worst_status",
    f"SELECT monitor_id, {UNRANK.format(f'max({RANK})')} AS worst_status, count(*) AS checks "
    f"FROM {RESULTS} GROUP BY monitor_id",
)
def worst_status(spark, sf):
    return op.worst_status(CHECK_RESULTS.frame(spark, sf), ["monitor_id"])


INCIDENTS_SQL = f"""
WITH r AS (SELECT monitor_id, checked_at, event_id, {RANK} AS rank FROM {RESULTS}),
s AS (SELECT *, CASE WHEN rank > 0 AND coalesce(lag(rank) OVER w, 0) = 0 THEN 1 ELSE 0 END AS opens,
        count(*) FILTER (rank = 0) OVER w AS oks
      FROM r WINDOW w AS (PARTITION BY monitor_id ORDER BY checked_at, event_id)),
n AS (SELECT *, sum(opens) OVER (PARTITION BY monitor_id ORDER BY checked_at, event_id) AS run FROM s)
SELECT monitor_id, min(oks) AS incident_no,
       min(checked_at) FILTER (rank > 0) AS opened_at,
       min(checked_at) FILTER (rank = 0) AS closed_at,
       {UNRANK.format('max(rank)')} AS worst_status,
       count(*) FILTER (rank > 0) AS failed_checks
FROM n WHERE run > 0 GROUP BY monitor_id, run
"""


@query(
    "open_incidents",
    f"SELECT * REPLACE (epoch_us(opened_at) AS opened_at, epoch_us(closed_at) AS closed_at) FROM ({INCIDENTS_SQL})",
)
def open_incidents(spark, sf):
    return emit(op.open_incidents(CHECK_RESULTS.frame(spark, sf)))


@query(
    "incident_durations",
    f"SELECT monitor_id, count(*) AS incidents, count(*) FILTER (closed_at IS NULL) AS still_open, "
    f"CAST(coalesce(sum(epoch_us(closed_at) - epoch_us(opened_at)), 0) AS BIGINT) AS total_us "
    f"FROM ({INCIDENTS_SQL}) GROUP BY monitor_id",
)
def incident_durations(spark, sf):
    incidents = op.open_incidents(CHECK_RESULTS.frame(spark, sf))
    return incidents.groupBy("monitor_id").agg(
        F.count("*").alias("incidents"),
        F.count_if(F.col("closed_at").isNull()).alias("still_open"),
        F.coalesce(F.sum(F.unix_micros("closed_at") - F.unix_micros("opened_at")), F.lit(0)).alias("total_us"),
    )


STATES = project(
    EVENTS,
    "event_id",
    "CASE WHEN user_id % 4 = 0 THEN 'systemd' WHEN user_id % 4 = 1 THEN 'docker' WHEN user_id % 4 = 2 THEN 'process' ELSE 'cron' END AS service_type",
    "CASE WHEN k % 5 = 0 THEN ' active ' WHEN k % 5 = 1 THEN 'failed' WHEN k % 5 = 2 THEN 'true' WHEN k % 5 = 3 THEN '' ELSE CAST(k AS STRING) END AS raw_state",
    "k % 7 = 0 AS command_failed",
    "CASE WHEN event_id % 3 = 0 THEN '' ELSE 'nginx' END AS process_match",
)


@query(
    "active_ok",
    f"""SELECT event_id,
      CASE WHEN service_type IN ('systemd', 'docker') THEN CASE WHEN command_failed AND trim(raw_state) = '' THEN 'unknown' ELSE trim(raw_state) END
           WHEN service_type = 'process' AND process_match <> '' THEN CASE WHEN NOT command_failed AND trim(raw_state) <> '' THEN 'running' ELSE 'not_running' END
           ELSE 'unknown' END AS active_state,
      CASE service_type WHEN 'systemd' THEN NOT command_failed AND trim(raw_state) = 'active'
           WHEN 'docker' THEN NOT command_failed AND trim(raw_state) = 'true'
           WHEN 'process' THEN process_match <> '' AND NOT command_failed AND trim(raw_state) <> ''
           ELSE false END AS is_active,
      CASE WHEN service_type IN ('systemd', 'docker') THEN NULL
           WHEN service_type = 'process' THEN CASE WHEN process_match = '' THEN 'process monitor missing process_match' END
           ELSE 'unsupported service type: ' || service_type END AS probe_error
    FROM {STATES.sql}""",
)
def active_ok(spark, sf):
    return op.active_ok(STATES.frame(spark, sf)).select("event_id", "active_state", "is_active", "probe_error")


PROBES = project(
    EVENTS,
    "event_id",
    "user_id",
    "CASE WHEN event_id % 4 = 0 THEN 'active_state' WHEN event_id % 4 = 1 THEN 'port' WHEN event_id % 4 = 2 THEN 'http' ELSE 'ping' END AS check_type",
    "CASE WHEN k = 13 THEN 'timeout' END AS probe_error",
    "k % 3 <> 0 AS is_active",
    "CAST(k % 10 AS INT) AS port",
    "k % 4 <> 0 AS port_open",
    "CASE WHEN k % 9 = 0 THEN '' ELSE 'http://localhost/' END AS http_endpoint",
    "CAST(CASE WHEN k % 11 = 0 THEN 0 ELSE 150 + k * 2 END AS INT) AS http_code",
)
PROBE_STATUS_SQL = f"""SELECT event_id, user_id, CASE
   WHEN check_type = 'active_state' THEN CASE WHEN probe_error IS NOT NULL THEN 'warning' WHEN is_active THEN 'ok' ELSE 'critical' END
   WHEN check_type = 'port' THEN CASE WHEN port <= 0 OR probe_error IS NOT NULL THEN 'warning' WHEN port_open THEN 'ok' ELSE 'critical' END
   WHEN check_type = 'http' THEN CASE WHEN http_endpoint = '' OR probe_error IS NOT NULL THEN 'warning'
        WHEN http_code >= 200 AND http_code < 300 THEN 'ok' ELSE 'critical' END
   ELSE 'warning' END AS status FROM {PROBES.sql}"""


@query("classify_probe", PROBE_STATUS_SQL)
def classify_probe(spark, sf):
    return op.classify_probe(PROBES.frame(spark, sf)).select("event_id", "user_id", "status")


MONITORS = project(
    EVENTS, "user_id AS monitor_id", "user_id % 5 <> 0 AS enabled",
    "CASE WHEN user_id % 70 = 0 THEN 0 ELSE 21600 * (1 + user_id % 3) END AS interval_seconds",
)


@query(
    "missed_checks",
    f"""WITH m AS (SELECT DISTINCT monitor_id, CASE WHEN interval_seconds > 0 THEN interval_seconds ELSE 60 END AS step
                   FROM {MONITORS.sql} WHERE enabled),
    s AS (SELECT monitor_id, step, unnest(generate_series(0, (30 * 86400 - 1) // step)) AS slot FROM m),
    seen AS (SELECT DISTINCT r.monitor_id, (epoch_us(r.checked_at) // 1000000 - 1704067200) // step AS slot
             FROM {RESULTS} r JOIN m ON r.monitor_id = m.monitor_id WHERE r.checked_at >= TIMESTAMP '2024-01-01')
    SELECT monitor_id, (1704067200 + slot * step) * 1000000 AS slot_start FROM s
    WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.monitor_id = s.monitor_id AND seen.slot = s.slot)""",
)
def missed_checks(spark, sf):
    monitors = MONITORS.frame(spark, sf).distinct()
    start, end = F.timestamp_seconds(F.lit(1704067200)), F.timestamp_seconds(F.lit(1704067200 + 30 * 86400))
    return emit(op.missed_checks(CHECK_RESULTS.frame(spark, sf), monitors, start, end))


HEARTBEATS = project(EVENTS, "user_id AS host_id", "seen_at", "CASE WHEN k % 10 = 0 THEN 0 ELSE 600 * k END AS interval_seconds")


@query(
    "stale_hosts",
    f"""WITH n AS (SELECT host_id, max(seen_at) AS last_seen, arg_max(interval_seconds, seen_at) AS step FROM {HEARTBEATS.sql} GROUP BY host_id)
    SELECT host_id, epoch_us(last_seen) AS last_seen, 1706659200000000 - epoch_us(last_seen) AS silent_us FROM n
    WHERE 1706659200000000 - epoch_us(last_seen) > 3 * 1000000 * CASE WHEN step > 0 THEN step ELSE 30 END""",
)
def stale_hosts(spark, sf):
    now = F.timestamp_seconds(F.lit(1706659200))
    return emit(op.stale_hosts(HEARTBEATS.frame(spark, sf), now), "host_id", "last_seen", "silent_us")


WANTED = project(
    EVENTS, "user_id % 20 AS host_id", "CASE WHEN k = 1 THEN '' ELSE 'm' || CAST(user_id AS STRING) END AS monitor_id",
    "k % 6 < 4 AS enabled", "event_id AS ord",
)
# twenty monitors on from those that are wanted
ACTIVE = project(EVENTS, "user_id % 20 AS host_id", "'m' || CAST(user_id + 20 AS STRING) AS monitor_id")


@query(
    "monitor_reconcile",
    f"""WITH c AS (SELECT host_id, monitor_id, max(ord) AS wanted_ord FROM {WANTED.sql} WHERE enabled AND monitor_id <> '' GROUP BY ALL),
    a AS (SELECT DISTINCT host_id, monitor_id FROM {ACTIVE.sql})
    SELECT coalesce(a.host_id, c.host_id) AS host_id, coalesce(a.monitor_id, c.monitor_id) AS monitor_id,
      CASE WHEN c.host_id IS NULL THEN 'stop' WHEN a.host_id IS NULL THEN 'start' ELSE 'keep' END AS action
    FROM a FULL JOIN c ON a.host_id = c.host_id AND a.monitor_id = c.monitor_id""",
)
def monitor_reconcile(spark, sf):
    return op.monitor_reconcile(ACTIVE.frame(spark, sf), WANTED.frame(spark, sf)).select("host_id", "monitor_id", "action")


REPAIRS = project(
    EVENTS,
    "event_id",
    "CASE WHEN user_id % 4 < 2 THEN 'systemd' WHEN user_id % 4 = 2 THEN 'docker' ELSE 'process' END AS service_type",
    "CASE WHEN k % 3 = 0 THEN 'reload_first' WHEN k % 3 = 1 THEN 'full' ELSE 'restart_only' END AS remediation_policy",
    "CASE WHEN k % 2 = 0 THEN 'nginx' WHEN k % 5 = 0 THEN 'Postgres' ELSE 'api' END AS service_name",
    "CASE WHEN event_id % 2 = 0 THEN 'auto' ELSE 'manual' END AS trigger",
    "k % 4 <> 0 AS remediation_enabled",
    "CASE WHEN k % 8 = 0 THEN ARR('docker_restart') WHEN k % 8 = 1 THEN ARR('systemd_restart', 'systemd_reload') ELSE ARR('nginx_test_reload', 'postgres_restart_verify', 'systemd_restart') END AS allowed_playbook_ids",
    "CASE WHEN event_id % 7 = 0 THEN 'nginx_test_reload' WHEN event_id % 7 = 1 THEN 'postgres_restart_verify' WHEN event_id % 7 = 2 THEN 'docker_restart' WHEN event_id % 7 = 3 THEN 'systemd_reload' WHEN event_id % 7 = 4 THEN 'unheard_of' ELSE 'systemd_restart' END AS playbook_id",
)


@query(
    "choose_playbook",
    f"""SELECT event_id, CASE
      WHEN service_type = 'docker' THEN 'docker_restart'
      WHEN service_type <> 'systemd' THEN NULL
      WHEN remediation_policy = 'full' THEN 'systemd_reset_failed'
      WHEN remediation_policy <> 'reload_first' THEN 'systemd_restart'
      WHEN service_name = 'nginx' THEN 'nginx_test_reload' ELSE 'systemd_reload' END AS playbook_id FROM {REPAIRS.sql}""",
)
def choose_playbook(spark, sf):
    return op.choose_playbook(REPAIRS.frame(spark, sf)).select("event_id", "playbook_id")


@query(
    "playbook_allowed",
    f"""WITH p(playbook_id, st, apps) AS (VALUES ('systemd_restart', 'systemd', ''), ('systemd_reload', 'systemd', ''),
      ('systemd_reset_failed', 'systemd', ''), ('nginx_test_reload', 'systemd', 'nginx'),
      ('postgres_restart_verify', 'systemd', 'postgresql postgres'), ('docker_restart', 'docker', ''))
    SELECT event_id, refusal, refusal IS NULL AS allowed FROM (SELECT event_id, CASE
      WHEN st IS NULL THEN 'unknown playbook'
      WHEN trigger = 'auto' AND NOT remediation_enabled THEN 'remediation disabled'
      WHEN NOT list_contains(allowed_playbook_ids, r.playbook_id) THEN 'not in allowlist'
      WHEN st <> service_type THEN 'service type mismatch'
      WHEN apps <> '' AND NOT list_contains(string_split(apps, ' '), lower(service_name)) THEN 'service not applicable' END AS refusal
    FROM {REPAIRS.sql} r LEFT JOIN p ON r.playbook_id = p.playbook_id)""",
)
def playbook_allowed(spark, sf):
    return op.playbook_allowed(REPAIRS.frame(spark, sf)).select("event_id", "refusal", "allowed")


COMMANDS = project(
    EVENTS,
    "event_id",
    "CASE WHEN k % 10 = 0 THEN '  ' WHEN k % 10 = 1 THEN ' discover_services ' WHEN k % 10 = 2 THEN 'run_playbook:restart:' || CAST(k AS STRING)"
    " WHEN k % 10 = 3 THEN 'reboot now' WHEN k % 10 = 4 THEN 'run_playbook: reload_nginx :i' || CAST(event_id AS STRING) || ':m' || CAST(user_id AS STRING) || ':extra'"
    " ELSE 'run_playbook:' || CASE WHEN k % 2 = 0 THEN 'restart_nginx' ELSE 'docker_restart' END || ':i' || CAST(event_id AS STRING) || ':m' || CAST(user_id AS STRING) END AS command",
)


@query(
    "parse_command",
    f"""WITH t AS (SELECT event_id, trim(command) AS c FROM {COMMANDS.sql}),
    s AS (SELECT *, string_split(c, ':') AS p, starts_with(c, 'run_playbook:') AS is_run FROM t),
    r AS (SELECT *, is_run AND len(p) >= 4 AS runs, trim(p[2]) AS pb FROM s)
    SELECT event_id, CASE WHEN c = 'discover_services' THEN c WHEN runs THEN 'run_playbook' END AS kind,
      CASE WHEN runs THEN CASE pb WHEN 'restart_nginx' THEN 'systemd_restart' WHEN 'restart' THEN 'systemd_restart'
           WHEN 'reload_nginx' THEN 'nginx_test_reload' ELSE pb END END AS playbook_id,
      CASE WHEN runs THEN p[3] END AS incident_id, CASE WHEN runs THEN p[4] END AS monitor_id,
      CASE WHEN c = '' OR c = 'discover_services' OR runs THEN NULL WHEN is_run THEN 'invalid run_playbook command format'
           ELSE 'unknown pending_command' END AS error FROM r""",
)
def parse_command(spark, sf):
    parsed = COMMANDS.frame(spark, sf).withColumn("parsed", op.parse_command(F.col("command")))
    return parsed.select("event_id", "parsed.*")


STEPS = project(
    "conversations",
    "conv_id AS run_id",
    "turn AS ord",
    "length(text) % 5 = 0 AS failed",
    "CASE WHEN (conv_id + turn) % 3 = 0 THEN 'abort' WHEN (conv_id + turn) % 3 = 1 THEN 'Continue' ELSE 'warn' END AS fail_action",
    "length(text) % 11 <> 0 AS known_handler",
    "CASE WHEN length(text) % 10 = 0 THEN '' ELSE 'exit ' || CAST(length(text) % 13 AS STRING) END AS error",
    "CASE WHEN length(text) % 2 = 0 THEN '' ELSE 's' || CAST(turn AS STRING) END AS step_id",
)
VERIFICATIONS = project(
    "conversations",
    "conv_id AS run_id",
    "CAST(CASE WHEN conv_id % 6 = 0 THEN 3 ELSE 0 END AS INT) AS exit_code",
    "CASE WHEN conv_id % 4 = 0 THEN 'inactive' WHEN conv_id % 4 = 1 THEN 'true' ELSE ' active ' END AS output",
    "CASE WHEN conv_id % 5 = 0 THEN '' ELSE 'active' END AS expected",
    "conv_id % 7 = 0 AS verify_failed",
    where="turn = 0 AND conv_id % 9 <> 0",
)


@query(
    "remediation_outcome",
    f"""WITH s AS {STEPS.sql}, stop AS (SELECT run_id, min(ord) FILTER (failed AND lower(fail_action) <> 'continue') AS last_ord FROM s GROUP BY 1),
    ran AS (SELECT s.run_id, count(*) AS steps_run, count(*) FILTER (failed) AS steps_failed FROM s JOIN stop ON s.run_id = stop.run_id
            WHERE last_ord IS NULL OR ord <= last_ord GROUP BY 1)
    SELECT ran.*, steps_failed = 0 AND (v.run_id IS NULL OR (exit_code = 0 AND (expected = '' OR contains(trim(output), expected)))) AS success
    FROM ran LEFT JOIN {VERIFICATIONS.sql} v ON v.run_id = ran.run_id""",
)
def remediation_outcome(spark, sf):
    out = op.remediation_outcome(STEPS.frame(spark, sf), VERIFICATIONS.frame(spark, sf))
    return out.select("run_id", "steps_run", "steps_failed", "success")


PLAN_SQL = f"""WITH s AS (SELECT *, NOT known_handler OR failed AS bad FROM {STEPS.sql}),
    stop AS (SELECT run_id, min(ord) FILTER (bad AND lower(fail_action) = 'abort') AS last_ord FROM s GROUP BY 1),
    r AS (SELECT s.* FROM s JOIN stop ON s.run_id = stop.run_id WHERE last_ord IS NULL OR ord <= last_ord)
    SELECT run_id, count(*) AS steps_run,
      coalesce(arg_max(CASE WHEN known_handler AND lower(fail_action) = 'warn' THEN 'partial' ELSE 'failed' END, ord) FILTER (bad), 'success') AS status,
      arg_min(error, ord) FILTER (bad AND error <> '') AS error FROM r GROUP BY run_id"""


@query("plan_status", PLAN_SQL)
def plan_status(spark, sf):
    return op.plan_status(STEPS.frame(spark, sf).withColumnRenamed("fail_action", "on_failure"))


@query(
    "rollback_order",
    f"""WITH r AS (SELECT conv_id AS run_id, turn + 1 AS ord, role AS action FROM conversations), p AS ({PLAN_SQL})
    SELECT run_id, action, rollback_ord FROM (SELECT run_id, action, max(ord) OVER (PARTITION BY run_id) - ord + 1 AS rollback_ord FROM r)
    WHERE run_id IN (SELECT run_id FROM p WHERE status = 'failed')""",
)
def rollback_order(spark, sf):
    rollbacks = project("conversations", "conv_id AS run_id", "turn + 1 AS ord", "role AS action").frame(spark, sf)
    return op.rollback_order(plan_status(spark, sf), rollbacks)


@query(
    "playbook_status",
    f"""WITH s AS {STEPS.sql}, stop AS (SELECT run_id, min(ord) FILTER (failed AND lower(fail_action) <> 'continue') AS last_ord FROM s GROUP BY 1),
    ran AS (SELECT s.run_id, count(*) AS steps_run, bool_or(failed) AS any_failed, arg_min(error, ord) FILTER (failed) AS step_error
            FROM s JOIN stop ON s.run_id = stop.run_id WHERE last_ord IS NULL OR ord <= last_ord GROUP BY 1)
    SELECT ran.run_id, steps_run, step_error, NOT any_failed AND v.run_id IS NOT NULL AS verification_ran,
      CASE WHEN any_failed OR coalesce(verify_failed, false) THEN 'failed' ELSE 'success' END AS status
    FROM ran LEFT JOIN {VERIFICATIONS.sql} v ON v.run_id = ran.run_id""",
)
def playbook_status(spark, sf):
    verifications = VERIFICATIONS.frame(spark, sf).select("run_id", "verify_failed")
    return op.playbook_status(STEPS.frame(spark, sf), verifications)


@query(
    "step_ids",
    f"SELECT run_id, ord, CASE WHEN step_id = '' THEN 'step_' || CAST(ord + 1 AS STRING) ELSE step_id END AS step_id FROM {STEPS.sql}",
)
def step_ids(spark, sf):
    return STEPS.frame(spark, sf).select("run_id", "ord", op.step_ids(F.col("step_id"), F.col("ord") + 1).alias("step_id"))


TEMPLATES = project(
    EVENTS, "event_id", "'systemctl {{verb}} {{unit}} {{gone}} # {{unit}} k={{k}}' AS template", "event_type AS unit",
    "CASE WHEN k % 2 = 0 THEN 'restart' ELSE 'stop {{unit}}' END AS verb", "CAST(k AS STRING) AS k",
)


@query(
    "render_template",
    "SELECT event_id, replace(replace(replace(template, '{{k}}', k), '{{unit}}', unit), '{{verb}}', verb) AS text "
    f"FROM {TEMPLATES.sql}",
)
def render_template(spark, sf):
    values = F.create_map(F.lit("unit"), F.col("unit"), F.lit("verb"), F.col("verb"), F.lit("k"), F.col("k"))
    return TEMPLATES.frame(spark, sf).select("event_id", op.render_template(F.col("template"), values).alias("text"))


RUNS = project(
    EVENTS, "event_id AS run_id", "user_id AS monitor_id", "CASE WHEN k % 20 = 0 THEN k END AS incident_id",
    "TSUS(at_us + 60000000 * k) AS started_at", where="event_type = 'click'",
)


@query(
    "link_remediation",
    f"""WITH i AS ({INCIDENTS_SQL})
    SELECT run_id, r.monitor_id, epoch_us(started_at) AS started_at,
      coalesce(r.incident_id, (SELECT max(i.incident_no) FROM i WHERE i.monitor_id = r.monitor_id AND i.opened_at <= r.started_at
        AND (i.closed_at IS NULL OR r.started_at < i.closed_at))) AS incident_id FROM {RUNS.sql} r""",
)
def link_remediation(spark, sf):
    incidents = op.open_incidents(CHECK_RESULTS.frame(spark, sf))
    return emit(op.link_remediation(RUNS.frame(spark, sf), incidents))


@query(
    "check_sla",
    f"""WITH w AS (SELECT monitor_id, date_trunc('day', checked_at) AS period, status, latency_ms FROM {RESULTS}),
    r AS (SELECT *, row_number() OVER (PARTITION BY monitor_id, period ORDER BY latency_ms) AS rn, count(*) OVER (PARTITION BY monitor_id, period) AS n FROM w)
    SELECT monitor_id, epoch_us(period) AS period, count(*) AS checks,
      CAST(count(*) FILTER (status = 'ok') AS DOUBLE) / count(*) AS availability,
      min(latency_ms) FILTER (rn >= ceil(n * 0.5)) AS latency_p50, min(latency_ms) FILTER (rn >= ceil(n * 0.95)) AS latency_p95
    FROM r GROUP BY monitor_id, period""",
)
def check_sla(spark, sf):
    return emit(op.check_sla(CHECK_RESULTS.frame(spark, sf)))


@query(
    "status_cube",
    f"""SELECT service_type, status, count(*) AS checks, CAST(GROUPING(service_type) * 2 + GROUPING(status) AS INT) AS level
    FROM {RESULTS} GROUP BY CUBE (service_type, status)""",
)
def status_cube(spark, sf):
    return op.status_cube(CHECK_RESULTS.frame(spark, sf))


ADHOC = project(
    EVENTS,
    "event_id",
    "CASE WHEN event_id % 2 = 0 THEN 'http' ELSE 'port' END AS check_type",
    "CASE WHEN k % 12 = 0 THEN ' ' ELSE 'http://localhost/' END AS url",
    "CASE WHEN k % 3 = 0 THEN CAST(150 + k AS STRING) WHEN k % 3 = 1 THEN 'many' END AS expect_status",
    "CAST(CASE WHEN user_id % 2 = 0 THEN 200 ELSE 150 + k END AS INT) AS http_code",
    "CASE WHEN k % 10 = 0 THEN '' WHEN k % 10 = 1 THEN '80a' ELSE CAST(k AS STRING) END AS port",
    "k % 4 <> 0 AS port_open",
    "user_id % 9 = 0 AS dry_run",
)


@query(
    "expected_status",
    f"""SELECT event_id, error, CASE WHEN error IS NULL THEN 'success' ELSE 'failed' END AS result FROM (
    SELECT *, CASE WHEN check_type = 'http' THEN
        CASE WHEN trim(url) = '' THEN 'missing param: url' WHEN dry_run THEN NULL
             WHEN http_code <> want THEN 'unexpected status: got=' || http_code || ' want=' || want END
      ELSE CASE WHEN port = '' THEN 'missing param: port' WHEN NOT regexp_full_match(port, '[0-9]+') THEN 'invalid port'
             WHEN dry_run THEN NULL WHEN NOT port_open THEN 'port closed' END END AS error
    FROM (SELECT *, coalesce(TRY_CAST(expect_status AS INT), 200) AS want FROM {ADHOC.sql}))""",
)
def expected_status(spark, sf):
    return op.expected_status(ADHOC.frame(spark, sf)).select("event_id", "error", "result")


POSTED = project(
    EVENTS,
    "user_id AS host_id",
    "event_id AS command_id",
    "k % 5 = 0 AS shell",
    "CASE WHEN k % 10 = 0 THEN '' ELSE 'uptime' END AS cmd",
    "CASE WHEN k % 6 = 0 THEN '' WHEN k % 6 = 1 THEN '/usr/bin/df' WHEN k % 6 = 2 THEN 'df' WHEN k % 6 = 3 THEN '/opt/bin/df' WHEN k % 6 = 4 THEN '/usr/bin/ls' ELSE 'ls' END AS exe",
    "user_id % 2 = 0 AS allow_shell",
)
ALLOWLIST = project(
    EVENTS,
    # every third host has no list
    "CASE WHEN user_id % 3 = 0 THEN -user_id ELSE user_id END AS host_id",
    "CASE WHEN user_id % 5 = 0 THEN ' ' WHEN user_id % 5 = 1 THEN '/usr/bin/ls' WHEN user_id % 5 = 2 THEN ' df ' WHEN user_id % 5 = 3 THEN '/usr/bin/df' WHEN k % 2 = 0 THEN 'ls' ELSE '/opt/bin/df' END AS allowed",
)


@query(
    "command_policy",
    f"""WITH l AS (SELECT host_id, trim(allowed) AS allowed FROM {ALLOWLIST.sql}), c AS {POSTED.sql}
    SELECT host_id, command_id, refusal, refusal IS NULL AS allowed FROM (SELECT *, CASE
      WHEN shell THEN CASE WHEN NOT allow_shell THEN 'shell mode disabled' WHEN cmd = '' THEN 'missing param: cmd' END
      WHEN exe = '' THEN 'missing param: exe'
      WHEN EXISTS (SELECT 1 FROM l WHERE l.host_id = c.host_id) AND NOT EXISTS (SELECT 1 FROM l WHERE l.host_id = c.host_id AND l.allowed <> ''
        AND (l.allowed = exe OR (NOT contains(l.allowed, '/') AND l.allowed = string_split(exe, '/')[-1]))) THEN 'exe not allowed' END AS refusal FROM c)""",
)
def command_policy(spark, sf):
    out = op.command_policy(POSTED.frame(spark, sf), ALLOWLIST.frame(spark, sf))
    return out.select("host_id", "command_id", "refusal", "allowed")
