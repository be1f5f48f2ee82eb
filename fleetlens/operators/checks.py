"""Check results, incidents and remediation runs of a whole fleet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import rules
from fleetlens.functions.columns import trimmed
from fleetlens.functions.ordered import number_segment, ordered_scan, time_segment


def status_rank(status: Column) -> Column:
    return F.array_position(F.lit(list(rules.STATUS_ORDER)), status).cast("int") - 1


def rank_status(rank: Column) -> Column:
    return F.element_at(F.lit(list(rules.STATUS_ORDER)), rank + 1)


def worst_status(df: DataFrame, keys: Sequence[str], status: str = "status") -> DataFrame:
    """One row per key with the worst of its statuses."""
    worst = F.max(status_rank(F.col(status)))
    return df.groupBy(*keys).agg(rank_status(worst).alias("worst_status"), F.count("*").alias("checks"))


def active_ok(df: DataFrame) -> DataFrame:
    """State of a service from the raw output of its state command.

    Input: ``service_type, raw_state, command_failed, process_match``.  Adds
    ``active_state, is_active, probe_error``.
    """
    raw = F.trim(F.coalesce("raw_state", F.lit("")))
    shown = F.when(F.col("command_failed") & (raw == ""), "unknown").otherwise(raw)
    matched = ~F.col("command_failed") & (raw != "")
    kind = F.col("service_type")
    no_match_word = F.coalesce("process_match", F.lit("")) == ""
    state = (
        F.when(kind.isin("systemd", "docker"), shown)
        .when((kind == "process") & ~no_match_word, F.when(matched, "running").otherwise("not_running"))
        .otherwise("unknown")
    )
    ok = (
        F.when(kind == "systemd", ~F.col("command_failed") & (raw == "active"))
        .when(kind == "docker", ~F.col("command_failed") & (raw == "true"))
        .when((kind == "process") & ~no_match_word, matched)
        .otherwise(False)
    )
    error = F.when(kind.isin("systemd", "docker"), F.lit(None).cast("string")).when(
        kind == "process", F.when(no_match_word, "process monitor missing process_match")
    ).otherwise(F.concat(F.lit("unsupported service type: "), F.coalesce(kind, F.lit(""))))
    return df.withColumns({"active_state": state, "is_active": ok, "probe_error": error})


def classify_probe(df: DataFrame) -> DataFrame:
    """Status of one probe row.

    Input: ``check_type, probe_error, is_active, port, port_open,
    http_endpoint, http_code``; a failed HTTP connection has code 0.
    """
    failed = F.col("probe_error").isNotNull()
    status = (
        F.when(
            F.col("check_type") == "active_state",
            F.when(failed, "warning").when(F.col("is_active"), "ok").otherwise("critical"),
        )
        .when(
            F.col("check_type") == "port",
            F.when((F.coalesce("port", F.lit(0)) <= 0) | failed, "warning")
            .when(F.col("port_open"), "ok")
            .otherwise("critical"),
        )
        .when(
            F.col("check_type") == "http",
            F.when((F.coalesce("http_endpoint", F.lit("")) == "") | failed, "warning")
            .when(F.col("http_code").between(200, 299), "ok")
            .otherwise("critical"),
        )
        .otherwise("warning")
    )
    return df.withColumn("status", status)


def missed_checks(results: DataFrame, monitors: DataFrame, start, end) -> DataFrame:
    """Expected check slots of enabled monitors that hold no result.

    ``monitors``: ``monitor_id, enabled, interval_seconds`` (60 when not
    positive); ``results``: ``monitor_id, checked_at``.  ``start`` and ``end``
    are columns or timestamps.
    """
    first, last = F.unix_seconds(F.lit(start)), F.unix_seconds(F.lit(end))
    wanted = monitors.filter("enabled").select(
        "monitor_id",
        F.when(F.col("interval_seconds") > 0, F.col("interval_seconds")).otherwise(60).cast("long").alias("step"),
    )
    numbers = F.when(last > first, F.sequence(F.lit(0), F.floor((last - first - 1) / F.col("step"))))  # none in an empty range
    slots = wanted.select("monitor_id", "step", F.explode(numbers).alias("slot"))
    # one row per monitor and second first: what is joined no longer grows with the results
    seconds = results.filter(F.col("checked_at") >= F.lit(start)).select(
        "monitor_id", (F.unix_seconds("checked_at") - first).alias("second")
    )
    seen = (
        seconds.distinct()
        .join(wanted, "monitor_id")
        .select("monitor_id", F.floor(F.col("second") / F.col("step")).alias("slot"))
        .distinct()
    )
    return slots.join(seen, ["monitor_id", "slot"], "left_anti").select(
        "monitor_id", F.timestamp_seconds(first + F.col("slot") * F.col("step")).alias("slot_start")
    )


def stale_hosts(heartbeats: DataFrame, now, factor: int = 3) -> DataFrame:
    """Hosts whose newest heartbeat is older than ``factor`` intervals (default interval 30 s)."""
    newest = heartbeats.groupBy("host_id").agg(
        F.max("seen_at").alias("last_seen"), F.max_by("interval_seconds", "seen_at").alias("interval_seconds")
    )
    step = F.when(F.col("interval_seconds") > 0, F.col("interval_seconds")).otherwise(30)
    silent = F.unix_micros(F.lit(now)) - F.unix_micros("last_seen")
    return newest.filter(silent > step * factor * 1_000_000).withColumn("silent_us", silent)


def open_incidents(
    results: DataFrame, key: str = "monitor_id", ts: str = "checked_at", tie: str = "event_id",
    segment_seconds: int = 3_600,
) -> DataFrame:
    """One incident per run of results that are not ok, closed by the next ok.

    Results between two oks of a monitor share the number of oks before them,
    so one running count finds all incidents; it also numbers them.
    """
    ranked = results.select(
        key, ts, tie, status_rank(F.col("status")).alias("rank"), time_segment(ts, segment_seconds).alias("segment")
    ).withColumn("is_ok", (F.col("rank") == 0).cast("long"))
    counted = ordered_scan(ranked, [key], [ts, tie], "segment", running_sum={"oks": "is_ok"})
    bad = F.col("rank") > 0
    # an ok closes what the oks before it left open
    return (
        counted.withColumn("incident_no", F.col("oks") - F.col("is_ok"))
        .groupBy(key, "incident_no")
        .agg(
            F.min(F.when(bad, F.col(ts))).alias("opened_at"),
            F.min(F.when(~bad, F.col(ts))).alias("closed_at"),
            rank_status(F.max("rank")).alias("worst_status"),
            F.count_if(bad).alias("failed_checks"),
        )
        .filter("failed_checks > 0")
    )


def monitor_reconcile(active: DataFrame, wanted: DataFrame) -> DataFrame:
    """Start what is new, stop what vanished, keep the rest, whatever its new config.

    ``wanted``: ``host_id, monitor_id, enabled, ord``; the last duplicate wins.
    """
    chosen = (
        wanted.filter("enabled AND monitor_id <> ''")
        .groupBy("host_id", "monitor_id")
        .agg(F.max("ord").alias("wanted_ord"))
    )
    running = active.select("host_id", "monitor_id").distinct().withColumn("running", F.lit(True))
    action = (
        F.when(F.col("wanted_ord").isNull(), "stop").when(F.col("running").isNull(), "start").otherwise("keep")
    )
    return running.join(chosen, ["host_id", "monitor_id"], "full_outer").withColumn("action", action)


def choose_playbook(df: DataFrame) -> DataFrame:
    """Playbook for an automatic repair, null when there is none."""
    policy = F.col("remediation_policy")
    playbook = F.when(
        F.col("service_type") == "systemd",
        F.when(
            policy == "reload_first",
            F.when(F.col("service_name") == "nginx", "nginx_test_reload").otherwise("systemd_reload"),
        )
        .when(policy == "full", "systemd_reset_failed")
        .otherwise("systemd_restart"),
    ).when(F.col("service_type") == "docker", "docker_restart")
    return df.withColumn("playbook_id", playbook)


def playbook_allowed(df: DataFrame) -> DataFrame:
    """Whether a playbook may run on a monitor, and why not.

    Input: ``playbook_id, trigger, remediation_enabled, allowed_playbook_ids,
    service_type, service_name``.
    """
    joined = df.join(F.broadcast(rules.playbooks(df.sparkSession)), "playbook_id", "left")
    applies = F.exists("applicable_services", lambda s: F.lower(s) == F.lower(F.col("service_name")))
    allowed_ids = F.coalesce("allowed_playbook_ids", F.array().cast("array<string>"))
    refusal = (
        F.when(F.col("playbook_service_type").isNull(), "unknown playbook")
        .when((F.col("trigger") == "auto") & ~F.col("remediation_enabled"), "remediation disabled")
        .when((F.size(allowed_ids) > 0) & ~F.array_contains(allowed_ids, F.col("playbook_id")), "not in allowlist")
        .when(F.col("playbook_service_type") != F.col("service_type"), "service type mismatch")
        .when((F.size("applicable_services") > 0) & ~applies, "service not applicable")
    )
    return joined.withColumns({"refusal": refusal, "allowed": refusal.isNull()}).drop(
        "playbook_service_type", "applicable_services"
    )


def parse_command(text: Column) -> Column:
    """Struct ``kind, playbook_id, incident_id, monitor_id, error``; all null for an empty command."""
    text = F.trim(text)
    parts = F.split(text, ":")
    aliases = F.create_map(*[F.lit(x) for pair in rules.PLAYBOOK_ALIASES.items() for x in pair])
    playbook = F.trim(F.get(parts, F.lit(1)))
    is_run = text.startswith("run_playbook:")
    runs = is_run & (F.size(parts) >= 4)
    kind = F.when(text == "discover_services", "discover_services").when(runs, "run_playbook")
    error = F.when(
        text != "",
        F.when(is_run & ~runs, "invalid run_playbook command format").when(
            ~is_run & (text != "discover_services"), "unknown pending_command"
        ),
    )
    return F.struct(
        kind.alias("kind"),
        F.when(runs, F.coalesce(F.try_element_at(aliases, playbook), playbook)).alias("playbook_id"),
        F.when(runs, F.get(parts, F.lit(2))).alias("incident_id"),
        F.when(runs, F.get(parts, F.lit(3))).alias("monitor_id"),
        error.alias("error"),
    )


def _until_first(steps: DataFrame, stops: Column, segment_width: int = 1_024) -> DataFrame:
    """Steps up to and including the first one that stops its run."""
    flagged = steps.withColumns(
        {"stops": F.coalesce(stops, F.lit(False)).cast("int"), "segment": number_segment("ord", segment_width)}
    )
    counted = ordered_scan(flagged, ["run_id"], ["ord"], "segment", running_sum={"stopped": "stops"})
    return counted.filter("stopped - stops = 0").select(*steps.columns)


def remediation_outcome(steps: DataFrame, verifications: DataFrame) -> DataFrame:
    """Result of each run.

    ``steps``: ``run_id, ord, failed, fail_action``; ``verifications``:
    ``run_id, exit_code, output, expected``, which runs even after a failure.
    """
    stops = F.col("failed") & (F.lower("fail_action") != "continue")
    ran = _until_first(steps, stops).groupBy("run_id").agg(
        F.count("*").alias("steps_run"), F.count_if("failed").alias("steps_failed")
    )
    verified = (F.col("exit_code") == 0) & (
        (F.coalesce("expected", F.lit("")) == "") | F.contains(F.trim("output"), F.col("expected"))
    )
    checked = verifications.select("run_id", verified.alias("verified"))
    return ran.join(checked, "run_id", "left").withColumn(
        "success", (F.col("steps_failed") == 0) & F.coalesce("verified", F.lit(True))
    )


def plan_status(steps: DataFrame) -> DataFrame:
    """Status, first error and rollback need of each plan.

    Input: ``run_id, ord, known_handler, failed, on_failure, error``.
    """
    bad = ~F.col("known_handler") | F.col("failed")
    ran = _until_first(steps, bad & (F.lower("on_failure") == "abort"))
    verdict = F.when(F.col("known_handler") & (F.lower("on_failure") == "warn"), "partial").otherwise("failed")
    return ran.groupBy("run_id").agg(
        F.count("*").alias("steps_run"),
        F.coalesce(F.max_by(verdict, F.when(bad, F.col("ord"))), F.lit("success")).alias("status"),
        F.min_by("error", F.when(bad & (F.col("error") != ""), F.col("ord"))).alias("error"),
    )


def rollback_order(statuses: DataFrame, rollbacks: DataFrame) -> DataFrame:
    """Rollback steps of failed plans, last one first."""
    due = rollbacks.join(statuses.filter("status = 'failed'").select("run_id"), "run_id", "left_semi")
    size = rollbacks.groupBy("run_id").agg(F.max("ord").alias("top"))
    return due.join(size, "run_id").select("run_id", "action", (F.col("top") - F.col("ord") + 1).alias("rollback_ord"))


def playbook_status(steps: DataFrame, verifications: DataFrame) -> DataFrame:
    """Status of posted playbooks; verification counts only after success.

    ``steps``: ``run_id, ord, failed, fail_action, error``; ``verifications``:
    ``run_id, verify_failed``.
    """
    ran = _until_first(steps, F.col("failed") & (F.lower("fail_action") != "continue"))
    runs = ran.groupBy("run_id").agg(
        F.count("*").alias("steps_run"),
        F.bool_or("failed").alias("any_failed"),
        F.min_by("error", F.when(F.col("failed"), F.col("ord"))).alias("step_error"),
    )
    joined = runs.join(verifications, "run_id", "left")
    verify_ran = ~F.col("any_failed") & F.col("verify_failed").isNotNull()
    verify_bad = verify_ran & F.col("verify_failed")
    return joined.select(
        "run_id",
        "steps_run",
        F.when(F.col("any_failed") | verify_bad, "failed").otherwise("success").alias("status"),
        verify_ran.alias("verification_ran"),
        "step_error",
    )


def step_ids(step_id: Column, ord_: Column) -> Column:
    """Given id, or ``step_<n>`` when it is empty."""
    return F.coalesce(F.nullif(step_id, F.lit("")), F.concat(F.lit("step_"), ord_.cast("string")))


def render_template(text: Column, values: Column, double: bool = True) -> Column:
    """Replace ``{{name}}`` (or ``{name}``) for every entry of a map, names in order."""
    left, right = ("{{", "}}") if double else ("{", "}")
    return F.aggregate(
        F.array_sort(F.map_entries(values)),
        text,
        lambda acc, e: F.replace(acc, F.concat(F.lit(left), e["key"], F.lit(right)), e["value"]),
    )


def link_remediation(runs: DataFrame, incidents: DataFrame, segment_seconds: int = 3_600) -> DataFrame:
    """Attach each run to the incident open when it started; a given incident id wins.

    ``runs``: ``run_id, monitor_id, incident_id, started_at``; ``incidents`` as
    made by :func:`open_incidents`.
    """
    marks = incidents.select(
        "monitor_id",
        F.col("opened_at").alias("at"),
        F.lit(0).alias("side"),
        F.struct("incident_no", "closed_at").alias("incident"),
    )
    asks = runs.withColumnsRenamed({"started_at": "at"}).withColumn("side", F.lit(1))
    line = asks.unionByName(marks, allowMissingColumns=True).withColumn("segment", time_segment("at", segment_seconds))
    seen = ordered_scan(line, ["monitor_id"], ["at", "side", "run_id"], "segment", last_value={"open": "incident"})
    still_open = F.col("open.closed_at").isNull() | (F.col("at") < F.col("open.closed_at"))
    return seen.filter("side = 1").select(
        "run_id",
        "monitor_id",
        F.col("at").alias("started_at"),
        F.coalesce("incident_id", F.when(still_open, F.col("open.incident_no"))).alias("incident_id"),
    )


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact percentiles of a column with few distinct values, from its histogram.

    Rows are first counted per (key, value), so what is ranked per key is the
    number of distinct values, not the number of rows.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    ranked = counts.withColumns(
        {
            "upto": F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)),
            "total": F.sum("n").over(w),
        }
    )
    return ranked.groupBy(*keys).agg(
        *[
            F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * F.lit(q)), F.col(value))).alias(name)
            for name, q in quantiles.items()
        ]
    )


def check_sla(results: DataFrame, grain: str = "1 day") -> DataFrame:
    """Availability and latency percentiles per monitor and period."""
    windowed = results.withColumn("period", F.window("checked_at", grain)["start"])
    keys = ["monitor_id", "period"]
    summary = windowed.groupBy(*keys).agg(
        F.count("*").alias("checks"),
        (F.count_if(F.col("status") == "ok").cast("double") / F.count("*")).alias("availability"),
    )
    tail = nearest_rank(windowed, keys, "latency_ms", {"latency_p50": 0.5, "latency_p95": 0.95})
    return summary.join(tail, keys, "left")


def status_cube(results: DataFrame) -> DataFrame:
    """Check counts for every combination of service type and status, with totals."""
    return results.cube("service_type", "status").agg(
        F.count("*").alias("checks"), F.grouping_id().cast("int").alias("level")
    )


def expected_status(df: DataFrame) -> DataFrame:
    """Result of ad-hoc checks.

    Input: ``check_type, url, expect_status, http_code, port, port_open, dry_run``.
    """
    # a whole number, signed or not, without blanks; anything else means 200
    number = F.when(F.col("expect_status").rlike(r"\A[+-]?[0-9]+\z"), F.col("expect_status").try_cast("long"))
    expect = F.coalesce(number, F.lit(200))
    port_text = trimmed(F.coalesce("port", F.lit("")))
    http = (
        F.when(trimmed(F.coalesce("url", F.lit(""))) == "", "missing param: url")
        .when(F.col("dry_run"), None)
        .when(
            F.col("http_code") != expect,
            F.concat(F.lit("unexpected status: got="), F.col("http_code"), F.lit(" want="), expect),
        )
    )
    port = (
        F.when(port_text == "", "missing param: port")
        .when(~port_text.rlike(r"\A[+-]?[0-9]+\z"), "invalid port")
        .when(F.col("dry_run"), None)
        .when(~F.col("port_open"), "port closed")
    )
    error = F.when(F.col("check_type") == "http", http).when(F.col("check_type") == "port", port)
    return df.withColumns({"error": error, "result": F.when(error.isNull(), "success").otherwise("failed")})


def command_policy(commands: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Whether posted commands may run under the host's policy.

    ``commands``: ``host_id, command_id, shell, cmd, exe, allow_shell``;
    ``allowlist``: ``host_id, allowed`` (a host without entries allows all).
    The list is joined by host, so it may be as large as the fleet.
    """
    entries = (
        allowlist.select("host_id", F.trim("allowed").alias("allowed")).filter("allowed <> ''").distinct()
    )
    listed = allowlist.select("host_id").distinct().withColumn("has_list", F.lit(True))
    exe = F.coalesce("exe", F.lit(""))
    base = F.substring_index(exe, "/", -1)
    wanted = commands.withColumns({"exe": exe, "base": base})
    # an entry matches the whole path, or the base name when it is a bare name itself
    hits = (
        wanted.select("host_id", "command_id", F.explode(F.array_distinct(F.array("exe", "base"))).alias("allowed"), "exe")
        .join(entries, ["host_id", "allowed"])
        .filter("allowed = exe OR NOT contains(allowed, '/')")
        .select("host_id", "command_id")
        .distinct()
        .withColumn("hit", F.lit(True))
    )
    joined = wanted.join(listed, "host_id", "left").join(hits, ["host_id", "command_id"], "left")
    refusal = F.when(
        F.col("shell"),
        F.when(~F.col("allow_shell"), "shell mode disabled").when(F.coalesce("cmd", F.lit("")) == "", "missing param: cmd"),
    ).otherwise(
        F.when(F.col("exe") == "", "missing param: exe").when(
            F.col("has_list").isNotNull() & F.col("hit").isNull(), "exe not allowed"
        )
    )
    return joined.withColumns({"refusal": refusal, "allowed": refusal.isNull()}).drop("base", "has_list", "hit")
