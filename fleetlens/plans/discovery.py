"""Service discovery over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.adapters import EVENTS, project
from fleetlens.operators import discovery as op
from fleetlens.plans.registry import query
from fleetlens.plans.telemetry import FIELDS

UNIT_LINES = project(
    EVENTS, "user_id AS host_id", "event_id AS line_no",
    "CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN event_type || '.service loaded active' WHEN 2 THEN '  ' || event_type || '.service   loaded failed failed A service' ELSE event_type || '.timer loaded active running x' END AS line",
)
UNITS_SQL = f"""SELECT host_id, line_no, regexp_replace(f[1], '\\.service$', '') AS name, 'systemd' AS service_type, f[1] AS unit, f[3] || '/' || f[4] AS state
    FROM (SELECT host_id, line_no, {FIELDS.format('line')} AS f FROM {UNIT_LINES.sql}) WHERE len(f) >= 4"""


@query("parse_systemd_units", UNITS_SQL)
def parse_systemd_units(spark, sf):
    return op.parse_systemd_units(UNIT_LINES.frame(spark, sf))


CONTAINER_LINES = project(
    EVENTS, "user_id AS host_id", "event_id AS line_no",
    "CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN '{\"ID\": \"c1\", \"Names' WHEN 2 THEN ' {\"ID\":\"c' || CAST(k AS STRING) || '\",\"Names\":\"\",\"Status\":\"Up\",\"Image\":\"redis:7\"}'"
    " ELSE '{\"ID\":\"c' || CAST(k AS STRING) || '\",\"Names\":\"' || event_type || '\",\"Status\":\"Up ' || CAST(k AS STRING) || ' hours\",\"Image\":\"nginx\"}' END AS line",
)
CONTAINERS_SQL = f"""SELECT host_id, line_no, CASE WHEN coalesce(j->>'Names', '') = '' THEN coalesce(j->>'ID', '') ELSE j->>'Names' END AS name, 'docker' AS service_type,
      j->>'Status' AS state, j->>'ID' AS container_id, j->>'Image' AS image
    FROM (SELECT host_id, line_no, TRY_CAST(trim(line) AS JSON) AS j FROM {CONTAINER_LINES.sql} WHERE trim(line) <> '') WHERE j IS NOT NULL"""


@query("parse_container_rows", CONTAINERS_SQL)
def parse_container_rows(spark, sf):
    return op.parse_container_rows(CONTAINER_LINES.frame(spark, sf))


PROCESS_LIST = project(
    EVENTS, "user_id AS host_id", "event_id AS line_no", "event_id * 7 % 32768 AS pid",
    "CASE k % 12 WHEN 0 THEN 'nginx' WHEN 1 THEN 'mysqld' WHEN 2 THEN 'sshd' WHEN 3 THEN 'httpd' WHEN 4 THEN 'sh' ELSE event_type END AS comm",
    "CASE k % 7 WHEN 0 THEN '/usr/sbin/nginx -g daemon' WHEN 1 THEN 'postgres: postgresql main' WHEN 2 THEN '-c redis-server --port ' || CAST(k AS STRING) ELSE '' END AS args",
)
_WORDS = (
    "('nginx', 'nginx'), ('postgres', 'postgres'), ('postgres', 'postgresql'), ('mysql', 'mysqld'), ('redis', 'redis-server'), ('docker', 'dockerd'),"
    " ('sshd', 'sshd'), ('fail2ban', 'fail2ban-server'), ('caddy', 'caddy'), ('apache', 'apache2'), ('apache', 'httpd'), ('traefik', 'traefik')"
)
PROCESSES_SQL = f"""SELECT host_id, service AS name, 'process' AS service_type, 'running' AS state, arg_min(pid, line_no) AS pid, arg_min(comm, line_no) AS comm, arg_min(args, line_no) AS args
    FROM {PROCESS_LIST.sql} p JOIN (VALUES {_WORDS}) AS w(service, word) ON p.comm = w.word OR contains(p.args, w.word) GROUP BY host_id, service"""


@query("match_known_processes", PROCESSES_SQL)
def match_known_processes(spark, sf):
    return op.match_known_processes(PROCESS_LIST.frame(spark, sf))


@query(
    "discovered_services",
    f"""SELECT host_id, name, service_type, state, unit, container_id, pid FROM (SELECT host_id, name, service_type, state, unit, NULL AS container_id, NULL AS pid FROM ({UNITS_SQL})
    UNION ALL SELECT host_id, name, service_type, state, NULL, container_id, NULL FROM ({CONTAINERS_SQL})
    UNION ALL SELECT host_id, name, service_type, state, NULL, NULL, pid FROM ({PROCESSES_SQL}))""",
)
def discovered_services(spark, sf):
    parts = [parse_systemd_units(spark, sf), parse_container_rows(spark, sf), match_known_processes(spark, sf)]
    return op.discovered_services(parts).select("host_id", "name", "service_type", "state", "unit", "container_id", "pid")


SNAPSHOT = project(
    EVENTS, "user_id AS host_id", "at_us DIV 86400000000 AS day", "event_id",
    "CASE WHEN k % 2 = 0 THEN 'systemd' ELSE 'docker' END AS service_type", "event_type AS name",
    "CASE k % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'failed' END AS state",
)


def _day_sql(day: int) -> str:
    return f"""(SELECT host_id, service_type, name, arg_max(coalesce(state, '-'), event_id) AS s FROM {SNAPSHOT.sql}
      WHERE day % 2 = {day} GROUP BY host_id, service_type, name)"""


@query(
    "discovery_diff",
    f"""SELECT * FROM (SELECT coalesce(a.host_id, b.host_id) AS host_id, coalesce(a.service_type, b.service_type) AS service_type, coalesce(a.name, b.name) AS name,
      nullif(a.s, '-') AS old_state, nullif(b.s, '-') AS new_state,
      CASE WHEN a.host_id IS NULL THEN 'appeared' WHEN b.host_id IS NULL THEN 'vanished' WHEN a.s <> b.s THEN 'changed' END AS change
    FROM {_day_sql(0)} a FULL JOIN {_day_sql(1)} b ON a.host_id = b.host_id AND a.service_type = b.service_type AND a.name = b.name) WHERE change IS NOT NULL""",
)
def discovery_diff(spark, sf):
    def of(day):
        return (
            SNAPSHOT.frame(spark, sf).filter(F.col("day") % 2 == day)
            .groupBy("host_id", "service_type", "name").agg(F.max_by("state", "event_id").alias("state"))
        )

    return op.discovery_diff(of(0), of(1))


FACTS = project(
    EVENTS, "user_id AS host_id", "'key.' || CAST(event_id AS STRING) AS fact_key",
    "CASE k % 4 WHEN 0 THEN 'platform' WHEN 1 THEN 'runtime' WHEN 2 THEN 'compose' ELSE 'service' END AS kind",
    "event_type || CAST(k AS STRING) AS value", "cents % 100 / 100.0 AS confidence",
)


@query(
    "pivot_facts",
    "SELECT host_id, " + ", ".join(
        f"arg_min(value, (-confidence, fact_key)) FILTER (kind = '{k}') AS {k}" for k in ("platform", "runtime", "compose", "service")
    ) + f", count(*) AS facts FROM {FACTS.sql} GROUP BY host_id",
)
def pivot_facts(spark, sf):
    return op.pivot_facts(FACTS.frame(spark, sf), ["platform", "runtime", "compose", "service"])


@query("stable_key", f"SELECT fact_key, 'service.' || substr(sha256(value), 1, 16) AS stable_key FROM {FACTS.sql}")
def stable_key(spark, sf):
    return FACTS.frame(spark, sf).select("fact_key", op.stable_key("service", F.col("value")).alias("stable_key"))
