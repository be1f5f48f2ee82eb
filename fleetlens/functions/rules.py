"""Fixed rule tables.  All are small constants, so joins may broadcast them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Check status order, worst last.
STATUS_ORDER = ("ok", "warning", "critical")

# Built-in playbooks -> service type, services they apply to (empty: all).
PLAYBOOKS = (
    ("systemd_restart", "systemd", ()),
    ("systemd_reload", "systemd", ()),
    ("systemd_reset_failed", "systemd", ()),
    ("nginx_test_reload", "systemd", ("nginx",)),
    ("postgres_restart_verify", "systemd", ("postgresql", "postgres")),
    ("docker_restart", "docker", ()),
)

# Friendlier playbook names accepted in commands.
PLAYBOOK_ALIASES = {
    "restart_nginx": "systemd_restart",
    "restart": "systemd_restart",
    "reload_nginx": "nginx_test_reload",
}

# Process names looked for in a process list.
KNOWN_PROCESSES = (
    ("nginx", "nginx"),
    ("postgres", "postgres"),
    ("postgres", "postgresql"),
    ("mysql", "mysqld"),
    ("redis", "redis-server"),
    ("docker", "dockerd"),
    ("sshd", "sshd"),
    ("fail2ban", "fail2ban-server"),
    ("caddy", "caddy"),
    ("apache", "apache2"),
    ("apache", "httpd"),
    ("traefik", "traefik"),
)

# Filesystem types that are no real disks.
PSEUDO_FILESYSTEMS = (
    "tmpfs", "devtmpfs", "proc", "sysfs", "cgroup", "cgroup2", "overlay", "squashfs", "ramfs",
    "autofs", "mqueue", "debugfs", "tracefs", "fusectl", "securityfs", "pstore", "configfs", "bpf",
)

# Privileges that exist per object type.
OBJECT_PRIVILEGES = {
    "TABLE": ("SELECT", "INSERT", "UPDATE", "DELETE", "TRUNCATE", "REFERENCES", "TRIGGER", "MAINTAIN"),
    "SEQUENCE": ("SELECT", "UPDATE", "USAGE"),
    "SCHEMA": ("CREATE", "USAGE"),
}

# Package state letter -> installation state.
PACKAGE_STATES = {
    "i": "installed",
    "c": "config-files",
    "U": "unpacked",
    "F": "half-configured",
    "n": "not-installed",
}

# Audit checks -> commands, accepted exit codes, whether exit 1 is tolerated.
AUDIT_COMMANDS = (
    ("ssh_root_login", "sshd_effective_config", (0,), False),
    ("ssh_root_login", "sshd_config", (0,), False),
    ("ssh_password_auth", "sshd_effective_config", (0,), False),
    ("ssh_password_auth", "sshd_config", (0,), False),
    ("ssh_weak_ciphers_manual", "sshd_config", (0,), False),
    ("sudo_users", "sudo_group", (0, 2), True),
    ("sudo_users", "admin_group", (0, 2), True),
    ("sudo_users", "wheel_group", (0, 2), True),
    ("inactive_users_manual", "passwd", (0,), False),
    ("public_ssh", "listening_sockets", (0,), False),
    ("public_postgresql", "listening_sockets", (0,), False),
    ("public_mysql", "listening_sockets", (0,), False),
    ("public_redis", "listening_sockets", (0,), False),
    ("public_docker_socket", "docker_socket", (0, 2), True),
    ("public_docker_socket", "listening_sockets", (0,), False),
    ("unexpected_listening_ports", "listening_sockets", (0,), False),
    ("pending_security_updates", "apt_upgradable", (0,), False),
    ("pending_security_updates", "dnf_updates", (0, 1, 100), True),
    ("reboot_required", "reboot_required", (0, 1), False),
    ("unsupported_os_version", "os_release", (0,), False),
    ("unsupported_os_version", "hostnamectl", (0,), False),
    ("unattended_upgrades_disabled", "unattended_upgrades", (0,), False),
    ("time_sync_disabled", "timedatectl", (0,), False),
    ("agent_offline", "agent_status", (0,), False),
    ("failed_systemd_services", "failed_systemd", (0,), False),
    ("auth_log_missing", "auth_log", (0, 1), True),
    ("auth_log_missing", "secure_log", (0, 1), True),
    ("auth_log_missing", "sshd_journal", (0, 1), True),
    ("failed_login_spike", "auth_log_tail", (0, 1), True),
    ("failed_login_spike", "secure_log_tail", (0, 1), True),
    ("failed_login_spike", "sshd_journal_tail", (0, 1), True),
    ("disk_usage_critical", "disk_usage", (0,), False),
    ("backup_not_detected", "cron_daily", (0,), False),
    ("backup_not_detected", "timers", (0,), False),
    ("backup_older_than_threshold", "backup_dirs", (0,), False),
    ("tls_certificate_expiring", "certbot_certificates", (0,), True),
    ("weak_tls_manual", "nginx_config_test", (0,), False),
    ("software_inventory_host", "os_release", (0,), False),
    ("software_inventory_host", "dpkg_packages", (0, 1), True),
    ("software_inventory_host", "rpm_packages", (0, 1), True),
    ("software_inventory_host", "service_units", (0, 1), True),
    ("software_inventory_host", "listening_sockets", (0, 1), True),
    ("software_inventory_host", "php_version", (0, 1), True),
    ("software_inventory_host", "apache2_version", (0, 1), True),
    ("software_inventory_host", "httpd_version", (0, 1), True),
    ("software_inventory_host", "nginx_version", (0, 1), True),
    ("software_inventory_host", "mysql_version", (0, 1), True),
    ("software_inventory_host", "mariadb_version", (0, 1), True),
    ("software_inventory_host", "postgresql_version", (0, 1), True),
    ("software_inventory_host", "redis_version", (0, 1), True),
    ("software_inventory_host", "nodejs_version", (0, 1), True),
    ("software_inventory_host", "python_version", (0, 1), True),
    ("software_inventory_host", "java_version", (0, 1), True),
    ("software_inventory_host", "openssl_version", (0, 1), True),
    ("software_inventory_host", "docker_engine_version", (0, 1), True),
    ("software_inventory_host", "container_runtime_version", (0, 1), True),
    ("software_inventory_containers", "docker_ps", (0, 1), True),
    ("software_inventory_containers", "docker_inspect", (0, 1), True),
    ("software_inventory_containers", "container_version_exec", (0, 1), True),
)

# Checks without commands, which need manual or external evidence.
MANUAL_CHECKS = (
    "missing_mfa_manual", "restore_test_missing_manual", "dns_points_unknown_ip", "cloudflare_proxy_disabled",
    "origin_exposed_manual",
)

# Checks whose evidence always goes to an operator.
REVIEW_CHECKS = (
    "backup_not_detected", "backup_older_than_threshold", "tls_certificate_expiring", "weak_tls_manual",
    "ssh_weak_ciphers_manual", "sudo_users", "inactive_users_manual", "unexpected_listening_ports",
)

# Operating system lifecycle: family, major, phase, end of standard support, end of support.
OS_LIFECYCLE = (
    ("ubuntu", 24, "standard_support", "2029-06-30", None),
    ("ubuntu", 22, "standard_support", "2027-06-30", None),
    ("ubuntu", 20, "extended_support", "2025-05-31", "2030-05-31"),
    ("ubuntu", 18, "extended_support", "2023-05-31", "2028-05-31"),
    ("debian", 13, "standard_support", "2028-08-09", "2030-06-30"),
    ("debian", 12, "standard_support", "2026-06-10", "2028-06-30"),
    ("debian", 11, "lts_support", "2024-08-14", "2026-08-31"),
    ("almalinux", 10, "maintenance_support", None, "2035-05-31"),
    ("almalinux", 9, "maintenance_support", None, "2032-05-31"),
    ("almalinux", 8, "maintenance_support", None, "2029-05-31"),
    ("rocky", 10, "maintenance_support", None, "2035-05-31"),
    ("rocky", 9, "maintenance_support", None, "2032-05-31"),
    ("rocky", 8, "maintenance_support", None, "2029-05-31"),
    ("rhel", 10, "maintenance_support", None, "2035-05-31"),
    ("rhel", 9, "maintenance_support", None, "2032-05-31"),
    ("rhel", 8, "maintenance_support", None, "2029-05-31"),
    ("rhel", 7, "extended_support", "2024-06-30", "2029-05-31"),
    ("centos", 8, "eol", None, "2021-12-31"),
    ("centos", 7, "eol", None, "2024-06-30"),
    ("centos_stream", 10, "maintenance_support", None, "2030-05-31"),
    ("centos_stream", 9, "maintenance_support", None, "2027-05-31"),
    ("fedora", 43, "standard_support", "2026-11-30", None),
    ("fedora", 42, "standard_support", "2026-05-31", None),
    ("fedora", 41, "standard_support", "2025-12-01", None),
    ("fedora", 40, "eol", "2025-05-13", None),
)

# Version patterns per software family, and the one for all others.
VERSION = r"[0-9]+\.[0-9]+(?:\.[0-9]+)?"
VERSION_PATTERNS = {
    "php": rf"PHP\s+({VERSION})",
    "apache": rf"Apache/?({VERSION})",
    "nginx": rf"nginx/?({VERSION})",
    "mysql": rf"Distrib\s+({VERSION})",
    "mariadb": rf"Distrib\s+({VERSION}-MariaDB|{VERSION})",
    "postgresql": rf"PostgreSQL\)\s+({VERSION})",
    "redis": rf"v=({VERSION})",
    "nodejs": rf"v({VERSION})",
    "python": rf"Python\s+({VERSION})",
    "java": rf'version\s+"({VERSION})',
    "openssl": rf"OpenSSL\s+({VERSION})",
    "docker_engine": rf"Docker version\s+({VERSION})",
    "container_runtime": rf"containerd.*\s({VERSION})",
}

# Image base name -> software family.
IMAGE_FAMILIES = {
    "php": "php",
    "httpd": "apache",
    "nginx": "nginx",
    "mysql": "mysql",
    "mariadb": "mariadb",
    "postgres": "postgresql",
    "redis": "redis",
    "node": "nodejs",
    "python": "python",
    "openjdk": "java",
}


def small_table(spark: SparkSession, rows, names: list[str]) -> DataFrame:
    """A constant table as a local relation, whose size the planner knows."""
    columns = list(zip(*rows))
    return spark.createDataFrame(pa.table([pa.array(list(c)) for c in columns], names=names))


def playbooks(spark: SparkSession) -> DataFrame:
    rows = [(i, t, pa.scalar(list(s), pa.list_(pa.string()))) for i, t, s in PLAYBOOKS]
    return small_table(spark, rows, ["playbook_id", "playbook_service_type", "applicable_services"])


def known_processes(spark: SparkSession) -> DataFrame:
    return small_table(spark, KNOWN_PROCESSES, ["service", "word"])


def audit_commands(spark: SparkSession) -> DataFrame:
    rows = [(k, n, list(a), o) for k, n, a, o in AUDIT_COMMANDS]
    return small_table(spark, rows, ["check_key", "name", "accept", "optional"])


def audit_checks(spark: SparkSession) -> DataFrame:
    """Keys of all known checks."""
    keys = sorted({k for k, *_ in AUDIT_COMMANDS} | set(MANUAL_CHECKS))
    return small_table(spark, [(k,) for k in keys], ["check_key"])


def os_lifecycle(spark: SparkSession) -> DataFrame:
    return small_table(spark, OS_LIFECYCLE, ["family", "major", "phase", "standard_end", "extended_end"])


def object_privileges(spark: SparkSession) -> DataFrame:
    rows = [(t, p) for t, privileges in OBJECT_PRIVILEGES.items() for p in privileges]
    return small_table(spark, rows, ["object_type", "privilege"])
