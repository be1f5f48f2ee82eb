"""Edge cases of single rules."""

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import columns as col
from fleetlens.functions import rules
from fleetlens.functions.digest import canonical_json, grouped_digest, multiset_digest, multiset_parts
from fleetlens.operators import audit, changes, checks, digests, files, grants, packages, redaction, telemetry


def value(spark, column, **inputs):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()]) if inputs else spark.range(1)
    return df.select(column.alias("v") if hasattr(column, "alias") else column).first()[0]


def values(spark, make, inputs, schema="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {schema}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_device_names(spark):
    names = {
        "sda": False, "sda1": True, "vda2": True, "xvda1": True, "nvme0n1": False, "nvme0n1p1": True, "nvme1n1p12": True,
        "mmcblk0": False, "mmcblk0p1": True, "dm-0": False, "md0": False, "sr0": True,
    }
    assert values(spark, col.is_partition, names) == list(names.values())
    bases = {"/dev/sda1": "/dev/sda", "/dev/nvme0n1p2": "/dev/nvme0n1", "/dev/nvme0n1": "/dev/nvme0n"}
    assert values(spark, col.block_device_base, bases) == list(bases.values())
    assert values(spark, lambda c: col.block_device_base(c, True), ["/dev/nvme0n1"]) == ["/dev/nvme0n1"]


def test_round1(spark):
    assert values(spark, col.round1, [12.34, 12.35, -3.0, 250.0, 99.96], "double") == [12.3, 12.4, 0.0, 100.0, 100.0]
    assert values(spark, lambda c: col.round1(c, False), [250.06, -1.24], "double") == [250.1, -1.2]


def test_unsigned(spark):
    got = values(spark, col.unsigned, ["0", "18446744073709551615", "18446744073709551616", "-1", "", "1x"])
    assert [None if v is None else int(v) for v in got] == [0, 2**64 - 1, None, None, None, None]


def test_redaction(spark):
    text = "DB PASSWORD = s3cret next\n-----BEGIN OPENSSH PRIVATE KEY-----\nabc\n-----END OPENSSH PRIVATE KEY-----\napi-key:x"
    assert values(spark, redaction.redact_secrets, [text, "", "token: a=b c"]) == [
        "DB PASSWORD =[REDACTED] next\n[REDACTED_SSH_KEY]\napi-key:[REDACTED]", "", "token:[REDACTED] c",
    ]
    assert values(spark, lambda c: redaction.redact_secrets(c, True), ["token: a=b c", "secret=a=b"]) == ["token: a=[REDACTED] c", "secret=[REDACTED]"]
    assert values(spark, lambda c: redaction.redact_patterns(c, ["session.id", " "]), ["session.id = 5 x", "sessionXid=5"]) == [
        "session.id = [REDACTED] x", "sessionXid=5",
    ]
    assert values(spark, lambda c: redaction.truncate_bytes(c, 3), ["abc", "abcd", "aé€"]) == ["abc", "abc\n[TRUNCATED]", "aé\n[TRUNCATED]"]


AUDIT = [
    ("ssh_root_login", "sshd_config", 0, "Port 22\nPermitRootLogin yes", "fail"),
    ("ssh_root_login", "sshd_config", 0, "#PermitRootLogin yes", "unknown"),
    ("ssh_password_auth", "sshd_config", 0, "passwordauthentication no\npasswordauthentication yes", "pass"),
    ("public_ssh", "listening_sockets", 0, "tcp LISTEN 0 128 0.0.0.0:22 0.0.0.0:*", "fail"),
    ("public_postgresql", "listening_sockets", 0, "tcp LISTEN 0 128 127.0.0.1:5432 0.0.0.0:*", "pass"),
    ("public_redis", "listening_sockets", 0, "udp UNCONN 0 0 [::]:6380 [::]:*", "fail"),
    ("public_docker_socket", "docker_socket", 0, "srw-rw---- 1 root docker /var/run/docker.sock", "fail"),
    ("pending_security_updates", "apt_upgradable", 0, "Listing...", "pass"),
    ("pending_security_updates", "apt_upgradable", 100, "", "unknown"),
    ("reboot_required", "reboot_required", 1, "", "pass"),
    ("time_sync_disabled", "timedatectl", 0, "System clock synchronized: no", "fail"),
    ("agent_offline", "agent_status", 3, "inactive", "fail"),
    ("failed_systemd_services", "failed_systemd", 0, "10 loaded units listed.", "pass"),
    ("failed_systemd_services", "failed_systemd", 0, "b.service loaded failed failed\na.service loaded failed failed", "warning"),
    ("auth_log_missing", "sshd_journal", 0, "-- No entries --", "warning"),
    ("auth_log_missing", "secure_log", 0, "", "pass"),
    ("failed_login_spike", "auth_log_tail", 0, "Failed password\n" * 20, "fail"),
    ("failed_login_spike", "auth_log_tail", 1, "", "unknown"),
    ("disk_usage_critical", "disk_usage", 0, "/dev/sda1 10 9 1 91% /", "fail"),
    ("disk_usage_critical", "disk_usage", 0, "Use%", "pass"),
    ("sudo_users", "sudo_group", 0, "sudo:x:27:a", "warning"),
]


def test_audit_verdicts(spark):
    df = spark.createDataFrame([(i, k, 0, n, e, o) for i, (k, n, e, o, _) in enumerate(AUDIT)], "run_id int, check_key string, ord int, name string, exit_code int, output string")
    got = {r.run_id: r.status for r in audit.audit_verdicts(df).collect()}
    assert [got[i] for i in range(len(AUDIT))] == [a[4] for a in AUDIT]
    units = audit.apply_rule(df, audit.failed_services()).filter("status = 'warning'").first()
    assert units.failed_services == "a.service,b.service"
    exact = spark.createDataFrame([(1, "public_ssh", 0, "x", 0, "LISTEN 0.0.0.0:2222")], df.schema)
    assert audit.apply_rule(exact, audit.public_listener("public_ssh")).first().status == "fail"
    assert audit.apply_rule(exact, audit.public_listener("public_ssh", exact=True)).first().status == "pass"
    assert rules.audit_checks(spark).count() == 32
    assert {k for k, *_ in rules.AUDIT_COMMANDS} >= set(rules.REVIEW_CHECKS)


OS_CASES = [
    ('ID=ubuntu\nVERSION_ID="24.04"', "pass", "standard_support"),
    ('ID=debian\nVERSION_ID="12"', "pass", "standard_support"),
    ('ID=debian\nVERSION_ID="11"', "pass", "lts_support"),
    ('ID=centos\nNAME="CentOS Stream"\nVERSION_ID="9"', "pass", "maintenance_support"),
    ('ID=centos\nVERSION_ID="7"', "fail", "eol"),
    ('ID=fedora\nVERSION_ID=41', "fail", "eol"),
    ('ID=ubuntu\nVERSION_ID="18.04"', "warning", "extended_support"),
    ('ID=gentoo\nVERSION_ID="2"', "warning", "unmodeled"),
    ("VERSION_ID=2", "unknown", None),
]


def test_os_lifecycle(spark):
    df = spark.createDataFrame([(i, "unsupported_os_version", 0, "os_release", 0, t) for i, (t, _, _) in enumerate(OS_CASES)], "run_id int, check_key string, ord int, name string, exit_code int, output string")
    got = {r.run_id: (r.status, r.support_phase) for r in audit.os_lifecycle(df, F.lit("2026-05-06 12:00:00").cast("timestamp")).collect()}
    assert [got[i] for i in range(len(OS_CASES))] == [c[1:] for c in OS_CASES]
    # an end date counts as passed just after its midnight
    at = {s: audit.os_lifecycle(df.filter("run_id = 1"), F.lit(s).cast("timestamp")).first().status for s in ("2026-06-10 00:00:00", "2026-06-10 00:00:01")}
    assert list(at.values()) == ["pass", "warning"]


def test_versions(spark):
    good = ["1.0", "1:2.3-4", "2147483647:1", "1.2~rc1+x-1-2"]
    bad = ["", "a1", "1:", "2147483648:1", "1:2:3", "1.0-", "-1", "1_0", "1." + "0" * 512]
    assert values(spark, packages.valid_version, good + bad) == [True] * len(good) + [False] * len(bad)
    texts = [("mariadb", "Distrib 10.11.6-MariaDB"), ("java", 'openjdk version "17.0.9"'), ("docker_engine", "Docker version 26.1.3, build"), ("redis", "plain 7.2.4"), ("x", "none")]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "i int, f string, t string").orderBy("i")
    assert [r[0] for r in df.select(audit.extract_version(F.col("f"), F.col("t"))).collect()] == ["10.11.6", "17.0.9", "26.1.3", "7.2.4", ""]
    images = ["docker.io/library/nginx:1.25.3-alpine", "registry:5000/redis", "node:lts", "postgres:16.2", "app:1.0"]
    assert values(spark, lambda c: F.to_json(audit.image_software(c)), images) == [
        '{"family":"nginx","version":"1.25.3"}', '{"family":"redis","version":""}', '{"family":"nodejs","version":""}', '{"family":"postgresql","version":"16.2"}', '{"version":"1.0"}',
    ]


def test_capacity(spark):
    mib = 1024 * 1024
    cases = [(100 * mib, 1000 * mib, 0), (166 * mib, 1000 * mib, 16 * mib), (16 * mib, 20 * mib, 0), (16 * mib - 1, 20 * mib, 0), (-1, 1, 0), (2**62, 1, 2**63 - 1)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a long, t long, r long").orderBy("i")
    got = [r[0] for r in df.select(files.has_capacity(F.col("a"), F.col("t"), F.col("r"))).collect()]
    assert got == [False, True, True, False, False, False]


def test_multiset_digest(spark):
    def digest(*lines):
        df = spark.createDataFrame([(line,) for line in lines], "line string").repartition(3)
        return df.agg(*multiset_parts(F.col("line"), "__")).select(multiset_digest("__")).first()[0]

    assert digest("alpha", "bravo", "charlie") == digest("charlie", "alpha", "bravo")
    assert digest("alpha", "bravo") != digest("alpha", "brave") != digest("alpha", "alpha", "bravo")
    assert digest("a", "a") != digest("b", "b")  # equal XOR, different sums
    ordered = spark.createDataFrame([("t", 1, "x"), ("t", 2, "y"), ("u", 1, "y"), ("u", 2, "x")], "k string, n int, v string")
    rows = grouped_digest(ordered, ["k"], F.concat_ws("|", "n", "v")).collect()
    assert rows[0].digest != rows[1].digest and rows[0].rows == 2


def test_canonical_json(spark):
    fields = {"b": F.lit(1), "a": {"z": F.lit("<&>"), "y": F.lit(None).cast("string")}}
    assert value(spark, canonical_json(fields)) == '{"a":{"y":null,"z":"<&>"},"b":1}'


def test_structure_normalisation(spark):
    assert values(spark, digests.normalize_column_type, ["  BIGINT(20)  Unsigned", "varchar(20)", "tinyint(1)"]) == ["bigint unsigned", "varchar(20)", "tinyint"]
    assert values(spark, digests.normalize_extra, ["default_generated on update  now()", "Persistent Generated"]) == ["ON UPDATE NOW()", "STORED GENERATED"]
    dump = "-- Dumped by pg_dump version 17\r\nCREATE TABLE t;  \n\\restrict abc\n\n\n"
    assert values(spark, digests.normalize_ddl, [dump]) == ["CREATE TABLE t;\n"]


def test_commands_and_templates(spark):
    got = values(spark, lambda c: F.to_json(checks.parse_command(c)), ["", " discover_services ", "run_playbook:restart:i:m", "run_playbook:x", "rm"])
    assert got == [
        "{}", '{"kind":"discover_services"}', '{"kind":"run_playbook","playbook_id":"systemd_restart","incident_id":"i","monitor_id":"m"}',
        '{"error":"invalid run_playbook command format"}', '{"error":"unknown pending_command"}',
    ]
    filled = checks.render_template(F.lit("a {unit} {other} {unit}"), F.create_map(F.lit("unit"), F.lit("u.service")), double=False)
    assert value(spark, filled) == "a u.service {other} u.service"


def test_lsn_and_positions(spark):
    assert [v and int(v) for v in values(spark, changes.lsn, ["0/0", "1/2", "FFFFFFFF/FFFFFFFF", "x/1", None])] == [0, 2**32 + 2, 2**64 - 1, None, None]
    texts = ['{"seconds":1,"increment":{"$numberLong":"9223372036854775807"}}', '{"seconds":{"$numberInt":"7"},"increment":2}', '{"seconds":true,"increment":1}', "null"]
    got = values(spark, changes.log_position, texts)
    assert [r and (r.seconds, r.increment) for r in got] == [(1, 2**63 - 1), (7, 2), None, None]


def test_cpu_without_elapsed_ticks(spark):
    rows = [(1, 1, "2026-01-01 00:00:00", [1, 1, 1, 5, 1]), (1, 2, "2026-01-01 00:00:01", [1, 1, 1, 5, 1]), (1, 3, "2026-01-01 00:00:02", [5, 1, 1, 6, 1])]
    df = spark.createDataFrame(rows, "host_id int, event_id int, t string, fields array<long>").withColumn("seen_at", F.to_timestamp("t"))
    percents = [r.cpu_percent for r in telemetry.cpu_percent(df).orderBy("event_id").collect()]
    assert percents == [None, None, 80.0]
    assert [r.cpu_percent for r in telemetry.cpu_percent(df, no_time="zero").orderBy("event_id").collect()] == [None, 0.0, 80.0]


def test_paginate_limits(spark):
    rows = [("c", f"p{i:02d}", "amd64", 100, 50) for i in range(5)] + [("big", "p", "amd64", 999, 50)]
    df = spark.createDataFrame(rows, "capture_id string, name string, architecture string, row_bytes long, overhead long")
    pages, refused = packages.paginate(df, max_rows=3, max_bytes=50 + 201, max_pages=40, max_packages=10)
    assert [r.page for r in pages.where("capture_id = 'c'").orderBy("name").collect()] == [0, 0, 1, 1, 2]
    assert [r.page for r in pages.where("capture_id = 'big'").collect()] == [0]
    assert [tuple(r) for r in refused.collect()] == [("big", "package exceeds page budget")]
    counted = packages.page_counts(df.select("capture_id").distinct(), pages, refused).orderBy("capture_id").collect()
    assert [tuple(r) for r in counted] == [("big", None, None, "package exceeds page budget"), ("c", 3, 5, None)]
    _, few = packages.paginate(df, max_rows=3, max_bytes=251, max_pages=2, max_packages=4)
    assert {tuple(r) for r in few.collect()} == {("c", "package budget exceeded"), ("big", "package exceeds page budget")}


def test_parse_packages_rejects_whole_captures(spark):
    good = "libc6:amd64\tamd64\t2.39-0\tglibc\t2.39-0\tii "
    lines = [("a", 1, good), ("a", 2, "vim\tamd64\t9.1\t\t\trc "), ("b", 1, good), ("b", 2, good), ("c", 1, good.replace("ii ", "iR ")), ("d", 1, "x\ty")]
    df = spark.createDataFrame(lines, "capture_id string, line_no int, line string")
    kept, rejected = packages.parse_packages(df)
    assert {(r.name, r.installation_state) for r in kept.collect()} == {("libc6", "installed"), ("vim", "config-files")}
    assert {tuple(r) for r in rejected.collect()} == {("b", "duplicate package"), ("c", "state"), ("d", "columns")}


@pytest.mark.parametrize("mode,count", [("cache", 0), ("durable", 7)])
def test_state_mode(spark, mode, count):
    df = spark.createDataFrame([("s", mode, 7, "sha256:x")], "store string, state_mode string, key_count long, all_digest string")
    row = digests.state_mode_manifest(df).first()
    assert row.record_count == count and (row.record_digest == digests.EMPTY_SHA256) == (mode == "cache")


def test_fence_that_is_still_active(spark):
    from fleetlens.operators import changes

    fences = spark.sql("""SELECT 1 AS fence_id, 1 AS host_id, 'web' AS service, timestamp'2024-01-01 00:00:00' AS active_from, CAST(NULL AS timestamp) AS active_to
        UNION ALL SELECT 2, 1, 'web', timestamp'2024-01-01 00:00:00', timestamp'2024-01-01 02:00:00'""")
    states = spark.sql("""SELECT 1 AS host_id, 'web' AS service, at, running FROM VALUES
        (timestamp'2023-12-31 23:00:00', true), (timestamp'2024-01-01 01:00:00', true), (timestamp'2024-01-05 00:00:00', true),
        (timestamp'2024-01-06 00:00:00', CAST(NULL AS boolean)), (timestamp'2024-01-07 00:00:00', false) AS t(at, running)""")
    got = {r["fence_id"]: (r["violations"], r["watchdog_errors"]) for r in changes.fence_violations(fences, states).collect()}
    assert got == {1: (3, 1), 2: (1, 0)}


def test_expected_status_reads_whole_numbers(spark):
    from fleetlens.operators import checks

    rows = [("+204", 204), (" 204 ", 200), ("-1", -1), ("1000000", 1000000), ("x", 200), (None, 200)]
    df = spark.createDataFrame([("http", "u", e, w, None, None, False) for e, w in rows],
                               "check_type string, url string, expect_status string, http_code int, port string, port_open boolean, dry_run boolean")
    assert checks.expected_status(df).filter("error IS NOT NULL").count() == 0


def test_no_slots_in_an_empty_range(spark):
    import datetime

    from fleetlens.operators import checks

    at = datetime.datetime(2024, 1, 1)
    monitors = spark.sql("SELECT 1 AS monitor_id, true AS enabled, 60 AS interval_seconds")
    results = spark.sql("SELECT 1 AS monitor_id, timestamp'2024-01-01 00:00:00' AS checked_at").limit(0)
    assert checks.missed_checks(results, monitors, at, at).count() == 0


def test_rollup_keeps_decimals(spark):
    df = spark.sql("SELECT 'h' AS host_id, timestamp'2024-01-01 00:00:00' AS seen_at, CAST(v AS DOUBLE) AS v FROM VALUES (0.04), (0.04), (1234.567), (null) AS t(v)")
    row = telemetry.telemetry_rollup(df, "v").first()
    assert (row.samples, row.max_value) == (3, 1234.567)
    assert abs(row.avg_value - 1234.647 / 3) < 1e-9


def test_dropping_unique_changes_the_structure(spark):
    keys = spark.sql("SELECT '' AS table_name, '' AS constraint_name, 0 AS ordinal, '' AS column_name, '' AS referenced, '' AS update_rule, '' AS delete_rule").limit(0)
    table = {"t": (spark.range(3), ["id"])}

    def manifest(non_unique: int, prefix: str):
        indexes = spark.sql(f"SELECT 't' AS table_name, 'i' AS index_name, {non_unique} AS non_unique, 1 AS seq, 'id' AS column_name, {prefix} AS sub_part, 'btree' AS index_type")
        return digests.table_manifest(table, indexes, keys)

    same, dropped, shorter = manifest(0, "NULL"), manifest(1, "NULL"), manifest(0, "4")
    assert digests.verify_tables(same, manifest(0, "NULL")).first().equal
    assert digests.verify_tables(same, dropped).first().reason == "structure"
    assert digests.verify_tables(same, shorter).first().reason == "structure"


def test_percentile_is_of_the_values_themselves(spark):
    rows = [("a", 0.04), ("a", 0.04), ("a", 1234.567), ("b", None)] + [("c", i / 100) for i in range(1, 101)]
    df = spark.createDataFrame(rows, "host_id string, v double").withColumn("seen_at", F.to_timestamp(F.lit("2026-01-01 00:00:00")))
    got = {r.host_id: (r.samples, r.max_value, r.p95_value) for r in telemetry.telemetry_rollup(df, "v").collect()}
    assert got == {"a": (3, 1234.567, 1234.567), "b": (0, None, None), "c": (100, 1.0, 0.95)}


def test_numbers_end_where_they_end(spark):
    row = "check_type string, url string, expect_status string, http_code long, port string, port_open boolean, dry_run boolean"
    rows = [("http", "u", t, 200, None, True, False) for t in ("204", "204\n", "+200", " 200")] + [("port", None, None, None, p, True, False) for p in ("80\n", "8\n0")]
    got = [r.error for r in checks.expected_status(spark.createDataFrame(rows, row).coalesce(1)).collect()]
    assert got == ["unexpected status: got=200 want=204", None, None, None, None, "invalid port"]


def test_fields_of_a_stanza_that_come_again(spark):
    def stanza(*lines):
        return "\n".join(["Package: nginx", "Architecture: amd64", *lines, "Size: 5", "SHA256: " + "ab" * 32])

    texts = [stanza("Version: 1.0"), stanza("Version:", "Version: 2.0"), stanza("Version: 3.0", "Version:"), stanza("Version: 4.0", " Version: x", "\tno colon"),
             stanza("Version: 5.0") + "\n\nno colon after the end", stanza("Version:\t6.0 \r"), stanza("X:", "X:", "X: a", "Version: 7.0")]
    df = spark.createDataFrame([("i", n, t) for n, t in enumerate(texts)], "index_id string, stanza_no int, stanza string")
    got = {r.stanza_no: (r.error, r.version) for r in packages.parse_stanzas(df).collect()}
    assert {n: v for n, (e, v) in got.items() if e is None} == {0: "1.0", 1: "2.0", 3: "4.0", 4: "5.0", 5: "6.0", 6: "7.0"}
    assert got[2][0] == "invalid_control_metadata"


def test_slices_follow_the_counts(spark):
    from fleetlens.functions.spread import common_keys, spread_join

    many = spark.range(60_000).selectExpr("CASE WHEN id % 2 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE 'k' || (id % 20000) END AS k", "id AS n")
    one = many.select("k").distinct().withColumn("v", F.length("k")).where("k <> 'k1'")
    slices = common_keys(many, ["k"])
    assert len(slices) == 2 and 450 <= max(slices.values()) <= 550
    for how in ("inner", "left"):
        want = {(r.k, r.n, r.v) for r in many.join(one, "k", how).collect()}
        joined = spread_join(many, one, ["k"], ["n"], how)
        assert {(r.k, r.n, r.v) for r in joined.select("k", "n", "v").collect()} == want
    assert spread_join(many.limit(0), one, ["k"], ["n"]).count() == 0
    for name, value in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(name, value)
    try:
        sizes = [r["count"] for r in spread_join(many, one, ["k"], ["n"]).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) > 1 and max(sizes) < 1.2 * sum(sizes) / len(sizes)


def test_mounts_stay_below(spark):
    paths = {"a": True, "./a": True, "a/../b": True, "..": False, "a/..": False, "../a": False, "a/../../b": False, ".": False, "/a": False, "": False, "a//b": True, "a/b/../..": False}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.ok for r in df.select("p", grants.bind_source_ok(F.col("p")).alias("ok")).collect()} == paths


def test_patterns_end_at_the_end_of_a_text(spark):
    df = spark.createDataFrame([("1.0",), ("1.0\n",), ("1.0-1\n",)], "v string").coalesce(1)
    assert [r.ok for r in df.select(packages.valid_version(F.col("v")).alias("ok")).collect()] == [True, False, False]
    states = spark.createDataFrame([("ii ",), ("ii \n",)], "v string").coalesce(1)
    assert [r.s for r in states.select(packages.package_state(F.col("v")).alias("s")).collect()] == ["installed", None]
    names = spark.createDataFrame([("p", "ok-name"), ("p", "name\n")], "project_id string, service string")
    assert [r.service for r in grants.dependency_violations(names, names.selectExpr("project_id", "'a1' AS service", "service AS dependency", "'' AS condition", "false AS restart")).collect()] == ["a1"]


def test_a_table_without_rows_is_in_the_manifest(spark):
    some = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, v string")
    got = {r.table_name: (r.rows, r.data_digest) for r in digests.table_manifest({"some": (some, ["k", "v"]), "none": (some.limit(0), ["k", "v"])}).collect()}
    alone = digests.row_multiset_digest(some, ["k", "v"]).first()
    assert got["some"] == (3, alone.digest) and got["none"] == (0, digests.row_multiset_digest(some.limit(0), ["k", "v"]).first().digest)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_stanzas_are_read_once_and_dealt_out(spark):
    text = "Package: nginx\nVersion: 1.0\nArchitecture: amd64\nSource: php8.3 (8:3)\nSize: 5\nSHA256: " + "ab" * 32
    rows = [("i", 1, text), ("i", 2, None), (None, None, text), (None, None, text), ("i", 3, text.replace("(8:3)", "8:3")), ("i", 4, text + "\nSize: 6")]
    found = packages.parse_stanzas(spark.createDataFrame(rows, "index_id string, stanza_no int, stanza string").coalesce(1))
    got = sorted(((r.index_id or "", r.stanza_no or 0, r.error, r.source_name, r.source_version, r.size) for r in found.collect()), key=lambda r: r[:2])
    good = (None, "php8.3", "8:3", 5)
    assert got == [("", 0, *good), ("", 0, *good), ("i", 1, *good), ("i", 2, "invalid_index_identity", "", "", None),
                   ("i", 3, "invalid_source_identity", None, None, 5), ("i", 4, "invalid_control_metadata", "php8.3", "8:3", 5)]
    plan = _plan(found)
    assert plan.count("split(stanza") == 1 and plan.count("regexp_replace(") == 1
    assert "Repartition " in plan


def test_releases_are_read_once_and_dealt_out(spark):
    text = ("Origin: Ubuntu\nSuite: noble\nCodename: noble\nDate: Thu, 11 Jan 2024 10:00:00 UTC\nSHA256:\n " + "ab" * 32 + " 7 main/binary-amd64/Packages\n "
            + "cd" * 32 + " 8 universe/binary-all/Packages\nDescription: x")
    rows = [("a", "ubuntu", text), ("b", "ubuntu", None), ("c", "ubuntu", text + "\nSuite: noble"), ("d", "ubuntu", text.replace("Date: Thu", "Date: thu")), ("a", "ubuntu", text)]
    releases = spark.createDataFrame(rows, "release_id string, os_id string, text string").coalesce(1)
    headers, indexes = packages.parse_release(releases, F.to_timestamp(F.lit("2024-02-01 00:00:00")))
    assert {r.release_id: r.error for r in headers.collect()} == {"a": None, "b": "unapproved_release", "c": "duplicate_release_field", "d": "invalid_release_date"}
    one = [("a", "main/binary-amd64/Packages", "ab" * 32, 7), ("a", "universe/binary-all/Packages", "cd" * 32, 8)]
    assert sorted(tuple(r) for r in indexes.collect()) == sorted(2 * one)
    plan = _plan(indexes)
    assert plan.count("split(text") == 1 and plan.count("(?:^|\\n)SHA256:") == 1
    assert "Repartition " in plan


def test_differences_are_counted_where_rows_meet(spark, monkeypatch):
    from fleetlens.operators import digests

    monkeypatch.setattr(digests, "ROWS_OF_A_TASK", 10)
    rows = [(n, "x" if n % 3 else None) for n in range(40)]
    source = spark.createDataFrame([*rows, (1, "x"), (1, "x"), (None, None)], "k long, v string")
    target = spark.createDataFrame([*rows[:-1], (1, "x"), (None, "y"), (None, "y")], "k long, v string")
    diff = digests.table_diff(source, target, ["k", "v"])
    plan = diff._jdf.queryExecution().executedPlan().toString()
    got = {(r.k, r.v): (r.side, r.copies) for r in diff.collect()}
    assert got == {(1, "x"): ("source", 1), (39, None): ("source", 1), (None, None): ("source", 1), (None, "y"): ("target", 2)}
    below = plan[plan.index("Exchange hashpartitioning"):]
    assert plan.count("Exchange") == 1 and ", 9), REPARTITION_BY_NUM" in below  # 85 rows, 10 a task
    assert "Aggregate" not in below
