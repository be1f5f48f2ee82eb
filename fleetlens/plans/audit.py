"""Compliance audit over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.adapters import EVENTS, project
from fleetlens.operators import audit as op
from fleetlens.plans.registry import query
from fleetlens.plans.telemetry import FIELDS

CHECKS = (
    "ssh_root_login", "ssh_password_auth", "public_ssh", "public_postgresql", "public_mysql", "public_redis",
    "public_docker_socket", "pending_security_updates", "reboot_required", "time_sync_disabled", "agent_offline",
    "failed_systemd_services", "auth_log_missing", "failed_login_spike", "disk_usage_critical", "sudo_users",
)
_CHECK = "CASE event_id % 16 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(CHECKS)) + " END AS check_key"
_SOCKET = (
    "CASE k % 7 WHEN 0 THEN 'LISTEN 0 128 0.0.0.0:{p} 0.0.0.0:*' WHEN 1 THEN 'tcp LISTEN [::]:{p}' WHEN 2 THEN 'LISTEN 0 1 127.0.0.1:{p} 0.0.0.0:*'"
    " WHEN 3 THEN 'ESTAB *:{p}' WHEN 4 THEN 'Udp UNCONN :::{p}9' ELSE '' END"
)
_OUTPUT = f"""CASE event_id % 16
  WHEN 0 THEN CASE k % 5 WHEN 0 THEN '# PermitRootLogin no' || chr(10) || 'Port 22' WHEN 1 THEN 'Port 22' || chr(10) || '  PermitRootLogin  YES' WHEN 2 THEN 'permitrootlogin prohibit-password' WHEN 3 THEN 'PermitRootLogin' ELSE 'PermitRootLogin forced-commands-only' || chr(10) || 'PermitRootLogin no' END
  WHEN 1 THEN CASE k % 4 WHEN 0 THEN 'PasswordAuthentication no' WHEN 1 THEN 'PasswordAuthentication yes' WHEN 2 THEN '#PasswordAuthentication yes' ELSE '' END
  WHEN 2 THEN {_SOCKET.format(p=22)} WHEN 3 THEN {_SOCKET.format(p=5432)} WHEN 4 THEN {_SOCKET.format(p=3306)} WHEN 5 THEN {_SOCKET.format(p=6380)}
  WHEN 6 THEN CASE k % 9 WHEN 0 THEN 'tcp 0.0.0.0:2375' WHEN 1 THEN 'srw-rw---- /var/run/docker.sock' WHEN 2 THEN 'srw x' WHEN 3 THEN 'no docker.sock' ELSE 'none' END
  WHEN 7 THEN CASE k % 9 WHEN 0 THEN 'Listing...' WHEN 1 THEN 'libc/noble-Security 2.39 amd64 [upgradable]' WHEN 2 THEN 'libc 1 [upgradable from: 0]' ELSE '' END
  WHEN 9 THEN CASE k % 9 WHEN 0 THEN 'NTP service: inactive' WHEN 1 THEN 'System clock synchronized: no' ELSE 'System clock synchronized: yes' END
  WHEN 10 THEN CASE k % 8 WHEN 0 THEN ' Active ' WHEN 1 THEN 'inactive' ELSE 'loaded' || chr(10) || 'failed' END
  WHEN 11 THEN CASE k % 12 WHEN 0 THEN '0 loaded units listed.' WHEN 1 THEN '10 loaded units listed.' WHEN 2 THEN ' ' WHEN 3 THEN event_type || '.Service x' ELSE event_type || '.service loaded failed failed x' || chr(10) || 'b' || CAST(user_id % 3 AS STRING) || '.service loaded' END
  WHEN 12 THEN CASE k % 4 WHEN 0 THEN '-- No entries --' WHEN 1 THEN '' ELSE 'sshd[1]: session opened' END
  WHEN 13 THEN repeat('Failed password for root; ', CAST(k % 9 AS INT)) || repeat('authentication failure', CAST(k % 3 AS INT))
  WHEN 14 THEN '/dev/sda1 100 50 50 ' || CAST(k AS STRING) || '% /' || chr(10) || 'tmpfs 1 1 1 ' || CAST(cents % 95 AS STRING) || '% /run x% 12%%'
  ELSE event_type END AS output"""
OUTPUTS = project(
    EVENTS, "event_id DIV 64 AS run_id", _CHECK, "event_id AS ord",
    "CASE WHEN event_id % 16 = 12 THEN CASE k % 7 WHEN 0 THEN 'auth_log' ELSE 'sshd_journal' END WHEN event_id % 16 = 11 AND k % 5 > 0 THEN 'failed_systemd'"
    " WHEN event_id % 16 = 15 THEN 'sudo_group' WHEN event_id % 16 = 7 THEN 'dnf_updates' WHEN event_id % 16 = 8 THEN 'reboot_required' ELSE 'x' END AS name",
    "CAST(CASE WHEN k % 4 < 3 THEN 1 WHEN k % 9 = 0 THEN 2 ELSE 0 END AS INT) AS exit_code",
    _OUTPUT,
)


def _directive(key: str) -> str:
    lines = f"list_filter(list_transform(string_split(t, chr(10)), lambda s: trim(s)), lambda s: NOT starts_with(s, '#'))"
    return f"list_filter(list_transform({lines}, lambda s: {FIELDS.format('s')}), lambda w: len(w) >= 2 AND w[1] = '{key}')[1][2]"


def _public(*ports: int) -> str:
    port = " OR ".join(f"contains(w, ':{p}')" for p in ports)
    hit = f"len(list_filter({FIELDS.format('s')}, lambda w: ({port}) AND regexp_matches(w, '^(0\\.0\\.0\\.0:|\\[::\\]:|:::|\\*:)'))) > 0"
    return f"len(list_filter(string_split(t, chr(10)), lambda s: (contains(s, 'listen') OR contains(s, 'udp')) AND {hit})) > 0"


_COUNT = "(length(t) - length(replace(t, 'failed password', ''))) // 15 + (length(t) - length(replace(t, 'authentication failure', ''))) // 22"
_TOP = f"coalesce(list_max(list_transform(list_filter({FIELDS.format('t')}, lambda w: regexp_full_match(w, '[0-9]+%')), lambda w: CAST(replace(w, '%', '') AS BIGINT))), 0)"
_STATUS = f"""CASE check_key
  WHEN 'ssh_root_login' THEN CASE WHEN {_directive('permitrootlogin')} IS NULL THEN 'unknown .5' WHEN {_directive('permitrootlogin')} IN ('yes', 'forced-commands-only') THEN 'fail .95' ELSE 'pass .9' END
  WHEN 'ssh_password_auth' THEN CASE WHEN {_directive('passwordauthentication')} IS NULL THEN 'unknown .5' WHEN {_directive('passwordauthentication')} = 'yes' THEN 'fail .95' ELSE 'pass .9' END
  WHEN 'public_ssh' THEN CASE WHEN {_public(22)} THEN 'fail .9' ELSE 'pass .75' END
  WHEN 'public_postgresql' THEN CASE WHEN {_public(5432)} THEN 'fail .9' ELSE 'pass .75' END
  WHEN 'public_mysql' THEN CASE WHEN {_public(3306)} THEN 'fail .9' ELSE 'pass .75' END
  WHEN 'public_redis' THEN CASE WHEN {_public(6379, 6380)} THEN 'fail .9' ELSE 'pass .75' END
  WHEN 'public_docker_socket' THEN CASE WHEN contains(t, '2375') OR contains(t, '2376') OR (contains(t, 'srw') AND contains(t, 'docker.sock')) THEN 'fail .85' ELSE 'pass .75' END
  WHEN 'pending_security_updates' THEN CASE WHEN contains(t, 'security') OR (contains(t, 'upgradable') AND NOT contains(t, 'listing...')) THEN 'warning .8' WHEN NOT ok THEN 'unknown .4' ELSE 'pass .75' END
  WHEN 'reboot_required' THEN CASE WHEN ok THEN 'warning .95' ELSE 'pass .9' END
  WHEN 'time_sync_disabled' THEN CASE WHEN regexp_matches(t, 'disabled|ntp service: inactive|system clock synchronized: no') THEN 'fail .85' WHEN ok THEN 'pass .8' ELSE 'unknown .4' END
  WHEN 'agent_offline' THEN CASE WHEN list_contains(list_transform(string_split(t, chr(10)), lambda s: trim(s)), 'active') THEN 'pass .95' ELSE 'fail .8' END
  WHEN 'failed_systemd_services' THEN CASE WHEN contains(t, '0 loaded units listed') OR contains(t, 'no failed units') THEN 'pass .9' WHEN contains(t, 'loaded units listed') OR contains(t, '.service') THEN 'warning .8' ELSE 'unknown .4' END
  WHEN 'auth_log_missing' THEN CASE WHEN auth THEN 'pass .9' ELSE 'warning .8' END
  WHEN 'failed_login_spike' THEN CASE WHEN {_COUNT} >= 20 THEN 'fail .85' WHEN NOT ok THEN 'unknown .4' ELSE 'pass .7' END
  WHEN 'disk_usage_critical' THEN CASE WHEN {_TOP} >= 90 THEN 'fail .9' ELSE 'pass .8' END
  ELSE CASE WHEN ok THEN 'warning .7' ELSE 'unknown .4' END END"""
JOINED_SQL = f"""SELECT run_id, check_key, string_agg(lower(output) || chr(10), '' ORDER BY ord) AS t, bool_or(exit_code = 0) AS ok,
    bool_or(exit_code = 0 AND (name = 'auth_log' OR (name = 'sshd_journal' AND trim(output) <> '' AND NOT contains(lower(output), 'no entries')))) AS auth
    FROM {OUTPUTS.sql} GROUP BY run_id, check_key"""
VERDICTS_SQL = f"""SELECT run_id, check_key, t, split_part(s, ' ', 1) AS status, CAST(split_part(s, ' ', 2) AS DOUBLE) AS confidence
    FROM (SELECT *, {_STATUS} AS s FROM ({JOINED_SQL}))"""


@query("audit_verdicts", f"SELECT run_id, check_key, status, confidence FROM ({VERDICTS_SQL})")
def audit_verdicts(spark, sf):
    return op.audit_verdicts(OUTPUTS.frame(spark, sf)).select("run_id", "check_key", "status", "confidence")


def _rule_query(name: str, rule, keys: tuple[str, ...], extra: tuple[tuple[str, str], ...] = ()) -> None:
    listed = ", ".join(f"'{k}'" for k in keys)
    more = "".join(f", {sql} AS {column}" for column, sql in extra)

    @query(name, f"SELECT run_id, check_key, status, confidence{more} FROM ({VERDICTS_SQL}) WHERE check_key IN ({listed})")
    def run(spark, sf):
        outputs = OUTPUTS.frame(spark, sf)
        parts = [op.apply_rule(outputs, r) for r in rule()]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out.select("run_id", "check_key", "status", "confidence", *[column for column, _ in extra])


_rule_query("sshd_directive", lambda: [op.ssh_root(), op.ssh_password()], ("ssh_root_login", "ssh_password_auth"))
_rule_query("public_listener", lambda: [op.public_listener(k) for k in op.LISTENERS], tuple(op.LISTENERS))
_rule_query("docker_socket_exposed", lambda: [op.docker_socket()], ("public_docker_socket",))
_rule_query("pending_updates", lambda: [op.pending_updates()], ("pending_security_updates",))
_rule_query("reboot_required", lambda: [op.reboot_required()], ("reboot_required",))
_rule_query("hygiene_service", lambda: [op.hygiene_service()], ("time_sync_disabled",))
_rule_query("agent_offline", lambda: [op.agent_offline()], ("agent_offline",))


@query(
    "failed_services",
    f"""WITH u AS (SELECT run_id, string_agg(DISTINCT u, ',' ORDER BY u) AS units FROM (SELECT run_id, unnest(list_transform(string_split(output, chr(10)), lambda s: {FIELDS.format('s')}[1])) AS u
      FROM {OUTPUTS.sql} WHERE check_key = 'failed_systemd_services' AND name = 'failed_systemd') WHERE u LIKE '%.service' GROUP BY run_id)
    SELECT v.run_id, status, confidence, CASE WHEN status = 'warning' THEN coalesce(units, '') END AS failed_services
    FROM ({VERDICTS_SQL}) v LEFT JOIN u ON u.run_id = v.run_id WHERE check_key = 'failed_systemd_services'""",
)
def failed_services(spark, sf):
    out = op.apply_rule(OUTPUTS.frame(spark, sf), op.failed_services())
    return out.select("run_id", "status", "confidence", "failed_services")


_rule_query("auth_evidence", lambda: [op.auth_evidence()], ("auth_log_missing",))
_rule_query("failed_login_spike", lambda: [op.failed_login_spike()], ("failed_login_spike",), (("failed_login_count", _COUNT),))
_rule_query("disk_critical", lambda: [op.disk_critical()], ("disk_usage_critical",), (("max_used_percent", _TOP),))
_rule_query("review_evidence", lambda: [op.review_evidence()], ("sudo_users",))

OTHER_CHECKS = project(EVENTS, "event_id DIV 64 AS run_id", "event_type AS check_key", "k % 2 = 0 AS wanted")
OTHER_OUTPUTS = project(
    EVENTS, "event_id DIV 64 AS run_id", "event_type AS check_key", "event_id AS ord", "'x' AS name",
    "CAST(k % 5 AS INT) AS exit_code", "'' AS output", where="k % 9 = 0",
)


@query(
    "review_other",
    f"""WITH c AS (SELECT DISTINCT run_id, check_key FROM {OTHER_CHECKS.sql} WHERE wanted),
    o AS (SELECT run_id, check_key, bool_or(exit_code = 0) AS ok FROM {OTHER_OUTPUTS.sql} GROUP BY ALL)
    SELECT c.run_id, c.check_key, CASE WHEN ok IS NULL THEN 'not_applicable' WHEN ok THEN 'warning' ELSE 'unknown' END AS status,
      CAST(CASE WHEN ok IS NULL THEN 1 WHEN ok THEN 0.6 ELSE 0.4 END AS DOUBLE) AS confidence FROM c LEFT JOIN o ON o.run_id = c.run_id AND o.check_key = c.check_key""",
)
def review_other(spark, sf):
    checks = OTHER_CHECKS.frame(spark, sf).filter("wanted").select("run_id", "check_key").distinct()
    return op.review_other(checks, OTHER_OUTPUTS.frame(spark, sf))


GATE = project(
    EVENTS, "event_id", "k % 5 <> 0 AS read_only",
    "CASE k % 3 WHEN 0 THEN 'ssh_root_login' WHEN 1 THEN 'made_up_check' ELSE 'disk_usage_critical' END AS check_key",
)


@query(
    "audit_gate",
    f"""SELECT event_id, CASE WHEN NOT read_only THEN 'unknown' WHEN check_key = 'made_up_check' THEN 'not_applicable' END AS gate_status,
      CAST(CASE WHEN NOT read_only THEN 0.5 WHEN check_key = 'made_up_check' THEN 1 END AS DOUBLE) AS gate_confidence,
      CASE WHEN NOT read_only THEN 'check definition is not read-only' END AS gate_error FROM {GATE.sql}""",
)
def audit_gate(spark, sf):
    return op.audit_gate(GATE.frame(spark, sf)).select("event_id", "gate_status", "gate_confidence", "gate_error")


@query(
    "command_errors",
    f"""SELECT ord, check_key, exit_code FROM {OUTPUTS.sql} WHERE (name = 'sudo_group' AND exit_code NOT IN (0, 1, 2))
      OR (check_key = 'pending_security_updates' AND name = 'dnf_updates' AND exit_code NOT IN (0, 1, 100)) OR (check_key = 'reboot_required' AND exit_code NOT IN (0, 1))
      OR (name = 'failed_systemd' AND exit_code <> 0) OR (name IN ('auth_log', 'sshd_journal') AND exit_code NOT IN (0, 1))""",
)
def command_errors(spark, sf):
    return op.command_errors(OUTPUTS.frame(spark, sf)).select("ord", "check_key", "exit_code")


@query("combine_outputs", f"SELECT run_id, check_key, md5(t) AS digest, ok AS command_ok FROM ({JOINED_SQL})")
def combine_outputs(spark, sf):
    out = op.combine_outputs(OUTPUTS.frame(spark, sf))
    return out.select("run_id", "check_key", F.md5("combined").alias("digest"), "command_ok")


RELEASES = project(
    EVENTS, "event_id DIV 2 AS run_id", "event_id AS ord", "CASE WHEN k % 13 = 0 THEN 'hostnamectl' ELSE 'os_release' END AS name",
    "CASE k % 12 WHEN 0 THEN '' WHEN 1 THEN 'ID=ubuntu' || chr(10) || 'VERSION_ID=\"24.04\"' WHEN 2 THEN 'ID=ubuntu' || chr(10) || 'VERSION_ID=\"20.04\"' WHEN 3 THEN 'ID=debian' || chr(10) || 'VERSION_ID=\"12\"'"
    " WHEN 4 THEN 'ID=debian' || chr(10) || 'VERSION_ID=\"11\"' WHEN 5 THEN 'NAME=\"CentOS Stream\"' || chr(10) || 'ID=\"centos\"' || chr(10) || 'VERSION_ID=\"9\"' WHEN 6 THEN 'ID=centos' || chr(10) || 'VERSION_ID=7'"
    " WHEN 7 THEN 'ID=fedora' || chr(10) || 'VERSION_ID=41' || chr(10) || 'VERSION_ID=42' WHEN 8 THEN '# ID=rhel' || chr(10) || ' ID = Rocky ' || chr(10) || 'VERSION_ID=9.4' WHEN 9 THEN 'ID=arch' || chr(10) || 'VERSION_ID=1'"
    " WHEN 10 THEN 'ID=rhel' || chr(10) || 'VERSION_ID=x' ELSE 'ID=ubuntu' || chr(10) || 'VERSION_ID=\"18.04\"' END AS output",
)


@query(
    "os_lifecycle",
    f"""WITH f AS (SELECT run_id, arg_min(output, ord) AS o FROM {RELEASES.sql} WHERE name = 'os_release' GROUP BY run_id),
    m(pattern, os_id, version_id, support_phase, status, confidence) AS (VALUES
      ('ID=ubuntu%24.04%', 'ubuntu', '24.04', 'standard_support', 'pass', 0.95), ('ID=ubuntu%20.04%', 'ubuntu', '20.04', 'extended_support', 'warning', 0.85),
      ('ID=debian%12%', 'debian', '12', 'extended_support', 'warning', 0.85), ('ID=debian%11%', 'debian', '11', 'lts_support', 'pass', 0.9),
      ('NAME%', 'centos', '9', 'maintenance_support', 'pass', 0.9), ('ID=centos%', 'centos', '7', 'eol', 'fail', 0.95), ('ID=fedora%', 'fedora', '42', 'eol', 'fail', 0.95),
      ('# ID%', 'rocky', '9.4', 'maintenance_support', 'pass', 0.9), ('ID=arch%', 'arch', '1', 'unmodeled', 'warning', 0.5), ('ID=rhel%', 'rhel', 'x', NULL, 'unknown', 0.4),
      ('ID=ubuntu%18.04%', 'ubuntu', '18.04', 'extended_support', 'warning', 0.85))
    SELECT run_id, coalesce(m.os_id, '') AS os_id, coalesce(version_id, '') AS version_id, support_phase, coalesce(status, 'unknown') AS status, CAST(coalesce(confidence, 0.4) AS DOUBLE) AS confidence
    FROM f LEFT JOIN m ON f.o LIKE m.pattern""",
)
def os_lifecycle(spark, sf):
    as_of = F.to_timestamp(F.lit("2026-07-01 12:00:00"))
    return op.os_lifecycle(RELEASES.frame(spark, sf), as_of)


SOFTWARE = project(
    EVENTS, "event_id DIV 20 AS run_id", "'software_inventory_host' AS check_key", "event_id AS ord", "CAST(k % 2 AS INT) AS exit_code",
    "CASE k % 5 WHEN 0 THEN 'dpkg_packages' WHEN 1 THEN 'rpm_packages' WHEN 2 THEN 'nginx_version' WHEN 3 THEN 'mariadb_version' ELSE 'os_release' END AS name",
    "CASE k % 5 WHEN 0 THEN 'nginx-core' || chr(9) || '1.' || CAST(k AS STRING) || '-1' || chr(10) || 'openssl' || chr(9) || '3.0.' || CAST(k AS STRING) || chr(10) || 'vim' || chr(9) || '9'"
    " WHEN 1 THEN 'php8.3-cli ' || chr(9) || ' 8.3.' || CAST(k AS STRING) || chr(10) || 'redis' || chr(9) || chr(10) || 'python3.12' || chr(9) || '3.12'"
    " WHEN 2 THEN CASE WHEN k % 2 = 0 THEN 'nginx' || chr(9) || '/usr/sbin/nginx' || chr(9) || 'nginx version: nginx/1.' || CAST(k AS STRING) || '.1' ELSE '' END"
    " WHEN 3 THEN 'mariadb' || chr(9) || '/usr/bin/mariadb' || chr(9) || 'mariadb Ver 15.1 Distrib 10.' || CAST(k AS STRING) || '.3-MariaDB, for debian' ELSE CASE WHEN k % 2 = 0 THEN 'ID=debian' ELSE '' END END AS output",
)
_FAMILY_SQL = """CASE WHEN p LIKE 'php%' THEN 'php' WHEN p IN ('apache2', 'apache2-bin', 'httpd') THEN 'apache' WHEN p LIKE 'nginx%' THEN 'nginx' WHEN p LIKE 'mysql%' THEN 'mysql'
    WHEN p LIKE 'mariadb%' THEN 'mariadb' WHEN p LIKE 'postgresql%' THEN 'postgresql' WHEN p IN ('redis', 'redis-server') THEN 'redis' WHEN p = 'nodejs' THEN 'nodejs' WHEN p LIKE 'python3%' THEN 'python'
    WHEN p LIKE 'openjdk%' OR p LIKE 'java-%' OR p = 'java' THEN 'java' WHEN p IN ('openssl', 'openssl-libs') THEN 'openssl' WHEN p IN ('docker', 'docker.io', 'docker-ce') THEN 'docker_engine'
    WHEN p = 'containerd' THEN 'container_runtime' END"""
ITEMS_SQL = f"""WITH l AS (SELECT run_id, ord, name, unnest(string_split(output, chr(10))) AS line, generate_subscripts(string_split(output, chr(10)), 1) AS n FROM {SOFTWARE.sql}),
    pk AS (SELECT run_id, ord, n, trim(split_part(line, chr(9), 1)) AS p, trim(split_part(line, chr(9), 2)) AS version FROM l WHERE name IN ('dpkg_packages', 'rpm_packages') AND contains(trim(line, ' ' || chr(9)), chr(9))),
    it AS (SELECT run_id, ord, n, {_FAMILY_SQL} AS family, version, true AS managed, p AS package_name, '' AS binary_path FROM pk WHERE version <> ''
      UNION ALL SELECT run_id, ord, 0, split_part(output, chr(9), 1), regexp_extract(split_part(output, chr(9), 3), CASE WHEN name = 'nginx_version' THEN 'nginx/?([0-9.]+)' ELSE 'Distrib ([0-9.]+)' END, 1), false, '', split_part(output, chr(9), 2)
      FROM {SOFTWARE.sql} WHERE name LIKE '%\\_version' ESCAPE '\\' AND output <> ''),
    s AS (SELECT *, min((ord, n)) FILTER (managed) OVER (PARTITION BY run_id, family) AS m FROM it WHERE family IS NOT NULL)
    SELECT run_id, family, arg_min(version, (ord, n)) AS version, CASE WHEN bool_or(managed) THEN 'package_manager' ELSE 'binary_probe' END AS version_source,
      coalesce(arg_min(package_name, (ord, n)) FILTER (package_name <> ''), '') AS package_name, coalesce(arg_min(binary_path, (ord, n)) FILTER (binary_path <> ''), '') AS binary_path,
      CAST(max(CASE WHEN managed THEN 0.9 ELSE 0.82 END) AS DOUBLE) AS confidence FROM s WHERE m IS NULL OR (ord, n) >= m GROUP BY run_id, family"""


@query("host_software", ITEMS_SQL)
def host_software(spark, sf):
    return op.host_software(SOFTWARE.frame(spark, sf))


@query(
    "host_inventory_status",
    f"""WITH i AS ({ITEMS_SQL}), r AS (SELECT run_id, bool_or(exit_code = 0 OR (name = 'os_release' AND output <> '')) AS seen FROM {SOFTWARE.sql} GROUP BY run_id),
    c AS (SELECT r.run_id, seen, (SELECT count(*) FROM i WHERE i.run_id = r.run_id) AS items FROM r)
    SELECT run_id, items, CASE WHEN items > 0 OR seen THEN 'pass' ELSE 'unknown' END AS status, CAST(CASE WHEN items > 0 THEN 0.9 WHEN seen THEN 0.65 ELSE 0.35 END AS DOUBLE) AS confidence FROM c""",
)
def host_inventory_status(spark, sf):
    outputs = SOFTWARE.frame(spark, sf)
    return op.host_inventory_status(outputs, op.host_software(outputs))


PACKAGE_NAMES = project(
    "part", "p_partkey",
    "CASE p_partkey % 16 WHEN 0 THEN 'php8.3' WHEN 1 THEN 'Apache2-bin' WHEN 2 THEN 'nginx-full' WHEN 3 THEN 'mysql-server' WHEN 4 THEN 'mariadb-client' WHEN 5 THEN 'postgresql-16' WHEN 6 THEN 'redis-server'"
    " WHEN 7 THEN 'nodejs' WHEN 8 THEN 'python3-pip' WHEN 9 THEN 'java-17-openjdk' WHEN 10 THEN 'openssl-libs' WHEN 11 THEN 'docker.io' WHEN 12 THEN 'containerd' WHEN 13 THEN 'redis-tools' ELSE p_name END AS package_name",
)


@query("package_family", f"SELECT p_partkey, {_FAMILY_SQL} AS family FROM (SELECT p_partkey, lower(trim(package_name)) AS p FROM {PACKAGE_NAMES.sql})")
def package_family(spark, sf):
    return PACKAGE_NAMES.frame(spark, sf).select("p_partkey", op.package_family(F.col("package_name")).alias("family"))


VERSION_TEXTS = project(
    EVENTS, "event_id",
    "CASE k % 8 WHEN 0 THEN 'php' WHEN 1 THEN 'apache' WHEN 2 THEN 'mariadb' WHEN 3 THEN 'postgresql' WHEN 4 THEN 'java' WHEN 5 THEN 'redis' WHEN 6 THEN 'container_runtime' ELSE 'unlisted' END AS family",
    "CASE k % 8 WHEN 0 THEN 'PHP 8.' || CAST(k AS STRING) || '.1 (cli)' WHEN 1 THEN 'Server version: Apache/2.4.' || CAST(k AS STRING) WHEN 2 THEN 'Ver 15.1 Distrib 10.' || CAST(k AS STRING) || '.3-MariaDB'"
    " WHEN 3 THEN 'psql (PostgreSQL) 16.' || CAST(k AS STRING) WHEN 4 THEN 'openjdk version \"17.0.' || CAST(k AS STRING) || '\"' WHEN 5 THEN CASE WHEN k % 2 = 0 THEN 'v=7.2.1' ELSE 'Redis 6.' || CAST(k AS STRING) END"
    " WHEN 6 THEN 'containerd github.com/x 1.7.' || CAST(k AS STRING) ELSE 'nothing ' || CAST(value AS STRING) END AS text",
)


@query(
    "extract_version",
    f"""SELECT event_id, CASE WHEN s <> '' THEN s ELSE regexp_extract(text, '([0-9]+\\.[0-9]+(?:\\.[0-9]+)?)', 1) END AS version FROM (SELECT *, replace(CASE family
      WHEN 'php' THEN regexp_extract(text, 'PHP\\s+([0-9.]+)', 1) WHEN 'apache' THEN regexp_extract(text, 'Apache/?([0-9.]+)', 1) WHEN 'mariadb' THEN regexp_extract(text, 'Distrib\\s+([0-9.]+)', 1)
      WHEN 'postgresql' THEN regexp_extract(text, 'PostgreSQL\\)\\s+([0-9.]+)', 1) WHEN 'java' THEN regexp_extract(text, 'version\\s+"([0-9.]+)', 1) WHEN 'redis' THEN regexp_extract(text, 'v=([0-9.]+)', 1)
      WHEN 'container_runtime' THEN regexp_extract(text, 'containerd.*\\s([0-9.]+)', 1) ELSE '' END, '-MariaDB', '') AS s FROM {VERSION_TEXTS.sql})""",
)
def extract_version(spark, sf):
    return VERSION_TEXTS.frame(spark, sf).select("event_id", op.extract_version(F.col("family"), F.col("text")).alias("version"))


CONTAINERS = project(
    EVENTS, "user_id AS run_id", "'c' || CAST(event_id AS STRING) AS container_id",
    "CASE k % 7 WHEN 0 THEN 'nginx:1.' || CAST(k AS STRING) WHEN 1 THEN 'registry:5000/team/postgres:16.' || CAST(k AS STRING) || '-alpine' WHEN 2 THEN 'redis' WHEN 3 THEN 'node:lts' WHEN 4 THEN 'custom/app:1.0' ELSE 'httpd:2.4.' || CAST(k AS STRING) END AS image",
    "event_type AS name", "'80/tcp' AS ports",
)
EXECS = project(
    EVENTS, "user_id AS run_id", "event_id AS ord", "'c' || CAST(event_id AS STRING) AS container_id",
    "CASE WHEN k % 2 = 0 THEN '' ELSE 'img' END AS image", "CASE WHEN k % 3 = 0 THEN ' ' ELSE 'given' END AS name",
    "CASE k % 7 WHEN 0 THEN 'nginx' WHEN 1 THEN 'openssl' ELSE 'apache' END AS family", "'/usr/bin/x' AS path",
    "CASE WHEN k % 4 = 0 THEN 'no version' ELSE 'v 9.' || CAST(k AS STRING) END AS version_text",
    where="k % 7 < 2 OR k % 7 = 5",
)
CONTAINER_ITEMS_SQL = f"""WITH e AS (SELECT x.run_id, x.container_id, family, '9.' || split_part(version_text, '9.', 2) AS version, path AS binary_path, CASE WHEN trim(x.name) = '' THEN p.name ELSE x.name END AS container_name,
        CASE WHEN trim(x.image) = '' THEN p.image ELSE x.image END AS image, p.ports FROM {EXECS.sql} x LEFT JOIN {CONTAINERS.sql} p ON p.run_id = x.run_id AND p.container_id = x.container_id WHERE version_text <> 'no version'),
    t AS (SELECT run_id, container_id, name, image, ports, CASE WHEN image LIKE 'nginx%' THEN 'nginx' WHEN image LIKE '%postgres%' THEN 'postgresql' WHEN image LIKE 'httpd%' THEN 'apache' END AS family,
        regexp_extract(image, ':([0-9]+\\.[0-9]+(?:\\.[0-9]+)?)(-alpine)?$', 1) AS version FROM {CONTAINERS.sql} WHERE image NOT LIKE 'custom%')
    SELECT run_id, container_id, family, version, 'container_exec' AS version_source, binary_path, container_name, image, ports, CAST(0.84 AS DOUBLE) AS confidence FROM e
    UNION ALL SELECT run_id, container_id, family, version, 'container_image_tag', '', name, image, ports, 0.72 FROM t WHERE family IS NOT NULL AND version <> ''
      AND NOT EXISTS (SELECT 1 FROM e WHERE e.run_id = t.run_id AND e.container_id = t.container_id AND e.family = t.family)"""


@query("container_software", CONTAINER_ITEMS_SQL)
def container_software(spark, sf):
    return op.container_software(CONTAINERS.frame(spark, sf), EXECS.frame(spark, sf))


# texts as the commands print them: ids twice, lines with too few fields, blanks around, ports with gaps
PS_TEXTS = project(
    EVENTS, "event_id AS run_id", "CAST(1 AS BIGINT) AS ord", "'docker_ps' AS name",
    "' c1' || chr(9) || 'nginx:1.' || CAST(k AS STRING) || chr(9) || event_type || chr(9) || '80/tcp, ,443/tcp,' || chr(10) || 'short' || chr(9) || 'line' || chr(10) || chr(10) || 'c2' || chr(9) || ' redis:7.2.' || CAST(k AS STRING) || ' ' || chr(9) || 'cache'"
    " || chr(10) || 'c3' || chr(9) || 'custom/app:1.0' || chr(9) || 'app' || CASE WHEN k % 3 = 0 THEN chr(10) || 'c1' || chr(9) || 'httpd:2.4' || chr(9) || 'web' || chr(9) || '8080/tcp' || chr(10) ELSE '' END AS output",
)
EXEC_TEXTS = project(
    EVENTS, "event_id AS run_id", "CAST(2 AS BIGINT) AS ord", "CASE WHEN k % 10 = 9 THEN 'other' ELSE 'container_version_exec' END AS name",
    "'c3' || chr(9) || 'img' || chr(9) || ' ' || chr(9) || 'openssl' || chr(9) || '/usr/bin/openssl' || chr(9) || 'OpenSSL 3.0.' || CAST(k AS STRING) || chr(10) || 'c1' || chr(9) || chr(9) || 'given' || chr(9) || 'nginx' || chr(9) || '/usr/sbin/nginx' || chr(9)"
    " || CASE WHEN k % 4 = 0 THEN 'unknown' ELSE 'nginx/1.9.' || CAST(k AS STRING) || chr(9) || 'built 2.2' END || chr(10) || 'c9' || chr(9) || chr(9) || chr(9) || 'nginx' || chr(9) || 'x' || chr(9) || 'v 5.5' || chr(10) || 'c3' || chr(9) || 'too' || chr(9) || 'few' AS output",
)
SECOND_TEXTS = project(EVENTS, "event_id AS run_id", "CAST(3 AS BIGINT) AS ord", "'docker_ps' AS name", "'late' || chr(9) || 'nginx:9.9' || chr(9) || 'late' AS output", where="k % 5 = 0")


@query(
    "container_software_from_outputs",
    f"""WITH e AS (SELECT event_id AS run_id, k, event_type, k % 10 <> 9 AS asked, k % 3 = 0 AS again FROM {EVENTS.sql}),
    i AS (SELECT run_id, 'c1' AS container_id, CASE WHEN again THEN 'httpd:2.4' ELSE 'nginx:1.' || k END AS image, CASE WHEN again THEN 'web' ELSE event_type END AS container_name,
        CASE WHEN again THEN ['8080/tcp'] ELSE ['80/tcp', '443/tcp'] END AS ports, CASE WHEN again THEN 'apache' ELSE 'nginx' END AS family, CASE WHEN again THEN '2.4' ELSE '1.' || k END AS version, e.* EXCLUDE run_id FROM e
      UNION ALL SELECT run_id, 'c2', 'redis:7.2.' || k, 'cache', [], 'redis', '7.2.' || k, e.* EXCLUDE run_id FROM e),
    x AS (SELECT run_id, 'c3' AS container_id, 'openssl' AS family, '3.0.' || k AS version, '/usr/bin/openssl' AS binary_path, 'app' AS container_name, 'img' AS image, CAST([] AS VARCHAR[]) AS ports FROM e WHERE asked
      UNION ALL SELECT run_id, container_id, 'nginx', '1.9.' || k, '/usr/sbin/nginx', 'given', image, ports FROM i WHERE asked AND k % 4 <> 0 AND container_id = 'c1'
      UNION ALL SELECT run_id, 'c9', 'nginx', '5.5', 'x', '', '', NULL FROM e WHERE asked),
    u AS (SELECT run_id, container_id, family, version, 'container_exec' AS version_source, binary_path, container_name, image, ports, CAST(0.84 AS DOUBLE) AS confidence FROM x
      UNION ALL SELECT run_id, container_id, family, version, 'container_image_tag', '', container_name, image, ports, 0.72 FROM i
        WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.run_id = i.run_id AND x.container_id = i.container_id AND x.family = i.family))
    SELECT * REPLACE (array_to_string(ports, ' ') AS ports) FROM u""",
)
def container_software_from_outputs(spark, sf):
    outputs = PS_TEXTS.frame(spark, sf).unionByName(EXEC_TEXTS.frame(spark, sf)).unionByName(SECOND_TEXTS.frame(spark, sf))
    return op.container_software_from_outputs(outputs).withColumn("ports", F.array_join("ports", " "))


# runs from 1000 on have no known software
CONTAINER_OUTPUTS = project(
    EVENTS, "user_id + k % 2 * 1000 AS run_id", "'software_inventory_containers' AS check_key", "event_id AS ord", "CAST(k % 2 AS INT) AS exit_code",
    "CASE k % 3 WHEN 0 THEN 'docker_ps' WHEN 1 THEN 'docker_inspect' ELSE 'container_version_exec' END AS name", "CASE WHEN k < 97 THEN ' ' ELSE 'row' END AS output",
)


@query(
    "container_inventory_status",
    f"""WITH i AS (SELECT run_id FROM ({CONTAINER_ITEMS_SQL})),
    r AS (SELECT run_id, bool_or(name IN ('docker_ps', 'container_version_exec') AND trim(output) <> '') AS running FROM {CONTAINER_OUTPUTS.sql} GROUP BY run_id),
    c AS (SELECT r.*, (SELECT count(*) FROM i WHERE i.run_id = r.run_id) AS items FROM r)
    SELECT run_id, items, CASE WHEN NOT running THEN 'not_applicable' WHEN items > 0 THEN 'pass' ELSE 'warning' END AS status,
      CAST(CASE WHEN NOT running THEN 1 WHEN items > 0 THEN 0.85 ELSE 0.6 END AS DOUBLE) AS confidence FROM c""",
)
def container_inventory_status(spark, sf):
    return op.container_inventory_status(CONTAINER_OUTPUTS.frame(spark, sf), container_software(spark, sf))


RESULTS = project(
    "labels", "doc_id", "CASE doc_id % 6 WHEN 0 THEN 'low' WHEN 1 THEN 'urgent' WHEN 2 THEN 'critical' WHEN 3 THEN '' WHEN 4 THEN 'High' ELSE 'high' END AS severity",
    "CASE WHEN toxic = 1 THEN 'fail' WHEN quality = 1 THEN 'pass' ELSE 'warning' END AS status", "CASE WHEN doc_id % 2 = 0 THEN 'cis' ELSE 'iso27001' END AS framework",
    "'check' || CAST(doc_id % 5 AS STRING) AS check_key", "'Check ' || CAST(doc_id % 5 AS STRING) AS name", "'raw' AS output", "'fine' AS summary",
)
_SEVERITY_SQL = "CASE WHEN severity IN ('low', 'medium', 'high', 'critical') THEN severity ELSE 'medium' END"


@query("normalize_severity", f"SELECT doc_id, {_SEVERITY_SQL} AS severity FROM {RESULTS.sql}")
def normalize_severity(spark, sf):
    return RESULTS.frame(spark, sf).select("doc_id", op.normalize_severity(F.col("severity")).alias("severity"))


@query(
    "evidence_items",
    f"""SELECT doc_id, CAST(1 AS INT) AS items, name AS title, 'command_output' AS evidence_type, 'redacted' AS redaction_status, check_key, true AS read_only FROM {RESULTS.sql}""",
)
def evidence_items(spark, sf):
    out = op.evidence_items(RESULTS.frame(spark, sf)).withColumn("e", F.get("evidence_items", F.lit(0)))
    return out.select(
        "doc_id", F.size("evidence_items").alias("items"), "e.title", "e.evidence_type", "e.redaction_status", "e.metadata.check_key", "e.metadata.read_only"
    )


@query(
    "audit_scorecard",
    f"""SELECT framework, severity, status, count(*) AS results, CAST(GROUPING(framework) * 4 + GROUPING(severity) * 2 + GROUPING(status) AS INT) AS level
    FROM (SELECT framework, {_SEVERITY_SQL} AS severity, status FROM {RESULTS.sql}) GROUP BY CUBE (framework, severity, status)""",
)
def audit_scorecard(spark, sf):
    results = RESULTS.frame(spark, sf).withColumn("severity", op.normalize_severity(F.col("severity")))
    return op.audit_scorecard(results)
