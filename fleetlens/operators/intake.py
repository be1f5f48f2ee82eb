"""Checks and de-duplication of posted records before they are stored."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.greedy import greedy_accept
from fleetlens.functions.ordered import number_segment, ordered_scan, time_segment
from fleetlens.operators.checks import parse_command

CHILDREN = ("disks", "network_interfaces", "network_counters", "disk_latency", "top_processes_cpu", "top_processes_mem")
COMMAND_COLUMNS = ("pending_action", "pending_audit_job", "pending_command", "command_id")
TTL_SECONDS = 1_800


def explode_children(heartbeats: DataFrame, field: str, keys: Sequence[str] = ("server_id", "timestamp")) -> DataFrame:
    """Child table of one array field; heartbeats without children give no row."""
    if field not in CHILDREN:
        raise ValueError(f"{field} is no child array")
    return heartbeats.select(*keys, F.inline(field))


def parse_string_or_object(json: Column) -> Column:
    """Struct ``legacy, type, command_id`` of a field that is a string, an object, null or empty."""
    v = F.try_parse_json(json)
    kind = F.schema_of_variant(v)

    def text(key: str) -> Column:
        return F.when(kind.startswith("OBJECT"), F.try_variant_get(v, f"$.{key}", "string"))

    return F.struct(
        F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).alias("legacy"),
        text("type").alias("type"),
        text("command_id").alias("command_id"),
    )


def string_array(json: Column) -> Column:
    """Array of strings, null when the JSON value is an object, a string or another array."""
    v = F.try_parse_json(json)
    ok = F.schema_of_variant(v) == "ARRAY<STRING>"
    return F.when(ok, F.try_variant_get(v, "$", "array<string>"))


def missing(*columns: str) -> dict[str, Column]:
    """Quarantine rules for required fields."""
    return {f"missing {c}": F.col(c).isNull() for c in columns}


def endpoint_rules(endpoint: str) -> dict[str, Column]:
    """Required fields of the posted record types."""
    required = {
        "results": ("monitor_id", "checked_at", "status", "latency_ms", "details"),
        "discovery": ("server_id", "discovered_at", "services"),
        "remediation-log": ("server_id", "monitor_id", "playbook_id", "trigger", "success", "steps", "started_at", "finished_at"),
    }
    return missing(*required[endpoint])


def quarantine(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejected rows with all their reasons.  Rules are true for bad rows."""
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(reason)) for reason, bad in rules.items()]))
    judged = df.withColumn("reasons", reasons)
    return judged.filter(F.size("reasons") == 0).drop("reasons"), judged.filter(F.size("reasons") > 0)


def validate_action(df: DataFrame) -> DataFrame:
    """First error of a posted action (``run_id, action_type, ansible_playbook``)."""
    error = (
        F.when(F.coalesce("run_id", F.lit("")) == "", "run_id is required")
        .when(F.coalesce("action_type", F.lit("")) == "", "action_type is required")
        .when((F.col("action_type") == "ansible") & F.col("ansible_playbook").isNull(), "ansible_playbook is required")
    )
    return df.withColumn("error", error)


def validate_audit_job(df: DataFrame) -> DataFrame:
    """First error of an audit job (``run_id, bundle_version, checks`` with key and read_only)."""
    checks = F.coalesce(F.col("checks"), F.array().cast("array<struct<check_key:string,read_only:boolean>>"))
    bad = F.filter(checks, lambda c: (F.coalesce(c["check_key"], F.lit("")) == "") | ~F.coalesce(c["read_only"], F.lit(False)))
    first = F.get(bad, F.lit(0))
    error = (
        F.when(F.coalesce("run_id", F.lit("")) == "", "run_id is required")
        .when(F.coalesce("bundle_version", F.lit("")) == "", "bundle_version is required")
        .when(F.size(checks) == 0, "checks is required")
        .when(F.coalesce(first["check_key"], F.lit("")) == "", F.when(first.isNotNull(), "check_key is required"))
        .otherwise(F.when(first.isNotNull(), F.concat(F.lit("check "), first["check_key"], F.lit(" is not read-only"))))
    )
    return df.withColumn("error", error)


def latest_state(df: DataFrame, keys: Sequence[str], order: Sequence[str], drop: Sequence[str] = ()) -> DataFrame:
    """Newest row per key, without the named columns.

    A partial ``max_by`` per task, so a key with many rows is no hot spot.
    """
    rest = [c for c in df.columns if c not in keys and c not in drop]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return newest.select(*keys, "row.*")


def cached_config(df: DataFrame, host: str, order: Sequence[str]) -> DataFrame:
    """Last good config per host, without what must not run again."""
    return latest_state(df, [host], order, [c for c in COMMAND_COLUMNS if c in df.columns])


def land_once(df: DataFrame, landed: DataFrame, run_id: str, order: Sequence[str]) -> DataFrame:
    """First row of every run id that is not stored yet.

    Repeats go before the join, so an id posted very often is one row there.
    """
    rest = [c for c in df.columns if c != run_id]
    first = df.groupBy(run_id).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return first.join(landed.select(run_id), run_id, "left_anti").select(run_id, "row.*")


def suppress_repeat_commands(
    polls: DataFrame, host: str = "host_id", ts: str = "fetched_at", tie: str = "event_id", segment_seconds: int = 3_600
) -> DataFrame:
    """Polled commands that differ from the one before.

    Input: also ``command, command_id``.  Only valid commands count; without
    an id the poll time stands in.
    """
    parsed = polls.withColumn("parsed", parse_command(F.col("command"))).filter("parsed.kind IS NOT NULL").drop("parsed")
    stamp = F.coalesce(F.nullif(F.col("command_id"), F.lit("")), F.unix_micros(ts).cast("string"))
    keyed = parsed.withColumns(
        {"command_key": F.concat_ws(":", F.trim("command"), stamp), "segment": time_segment(ts, segment_seconds)}
    )
    seen = ordered_scan(keyed, [host], [ts, tie], "segment", lag={"previous_key": "command_key"})
    return seen.filter(~F.col("command_key").eqNullSafe(F.col("previous_key"))).select(*polls.columns)


def suppress_within_ttl(
    attempts: DataFrame, key: str = "run_id", ttl_seconds: int = TTL_SECONDS, segment_seconds: int = 21_600
) -> DataFrame:
    """Mark audit attempts that the guard lets through.

    Input: ``<key>, attempt_id, started_us, finished_us, handled``.  An
    accepted attempt blocks until it ends, and when it was handled for the TTL
    after that (the last microsecond included); refused ones change nothing.
    An attempt may run for any time.
    """
    second = 1_000_000
    until = F.when(F.col("handled"), F.col("finished_us") + ttl_seconds * second + 1).otherwise(F.col("finished_us"))
    work = attempts.withColumns(
        {
            "until_us": F.greatest(until, F.col("started_us") + 1),
            "segment": number_segment("started_us", segment_seconds * second),
            "hour": number_segment("started_us", 3_600 * second),
        }
    )
    return greedy_accept(work, [key], "started_us", "until_us", "attempt_id", "segment", "hour").drop("until_us", "segment", "hour")
