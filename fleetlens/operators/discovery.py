"""Services found on hosts, from collected command output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import rules
from fleetlens.functions.columns import field, words

CONTAINER_ROW = "ID string, Names string, Status string, Image string, Ports string"


def parse_systemd_units(lines: DataFrame) -> DataFrame:
    """``systemctl list-units`` lines: unit, name and ``active/sub`` state."""
    f = F.col("f")
    return (
        lines.withColumn("f", words(F.col("line")))
        .filter(F.size("f") >= 4)
        .select(
            "host_id", "line_no",
            F.regexp_replace(field(f, 0), r"\.service$", "").alias("name"),
            F.lit("systemd").alias("service_type"),
            field(f, 0).alias("unit"),
            F.concat_ws("/", field(f, 2), field(f, 3)).alias("state"),
        )
    )


def parse_container_rows(lines: DataFrame) -> DataFrame:
    """One JSON object per line; lines that are none are skipped."""
    row = F.from_json(F.trim("line"), CONTAINER_ROW, {"mode": "PERMISSIVE"})
    is_object = F.try_parse_json(F.trim("line")).isNotNull() & F.trim("line").startswith("{")
    return (
        lines.filter(is_object)
        .withColumn("row", row)
        .select(
            "host_id", "line_no",
            F.coalesce(F.nullif(F.col("row.Names"), F.lit("")), F.col("row.ID"), F.lit("")).alias("name"),
            F.lit("docker").alias("service_type"),
            F.col("row.Status").alias("state"),
            F.col("row.ID").alias("container_id"),
            F.col("row.Image").alias("image"),
        )
    )


def match_known_processes(processes: DataFrame) -> DataFrame:
    """Known services in a process list (``host_id, line_no, pid, comm, args``).

    Each row is tested against the constant word list in place, so only
    matches leave the scan; the first process of a host wins per service.
    """
    known = F.array(*[F.struct(F.lit(s).alias("service"), F.lit(w).alias("word")) for s, w in rules.KNOWN_PROCESSES])
    hits = F.filter(known, lambda k: (F.col("comm") == k["word"]) | F.contains(F.col("args"), k["word"]))
    matched = processes.select(
        "host_id", "line_no", "pid", "comm", "args",
        F.explode(F.array_distinct(F.transform(hits, lambda h: h["service"]))).alias("name"),
    )
    first = matched.groupBy("host_id", "name").agg(F.min_by(F.struct("pid", "comm", "args"), "line_no").alias("p"))
    return first.select(
        "host_id", "name", F.lit("process").alias("service_type"), F.lit("running").alias("state"), "p.pid", "p.comm", "p.args"
    )


def discovered_services(parts: Sequence[DataFrame]) -> DataFrame:
    """All services of all detectors, by host, type and name."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.orderBy("host_id", "service_type", "name")


def discovery_diff(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """Services that appeared, vanished or changed state between two snapshots."""
    keys = ["host_id", "service_type", "name"]
    old = prev.select(*keys, F.col("state").alias("old_state"), F.lit(True).alias("was"))
    new = cur.select(*keys, F.col("state").alias("new_state"), F.lit(True).alias("now"))
    change = F.when(F.col("was").isNull(), "appeared").when(F.col("now").isNull(), "vanished").when(
        ~F.col("old_state").eqNullSafe(F.col("new_state")), "changed"
    )
    return old.join(new, keys, "full_outer").withColumn("change", change).filter("change IS NOT NULL").drop("was", "now")


def stable_key(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(f"{prefix}."), F.substring(F.sha2(value, 256), 1, 16))


def pivot_facts(observations: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """One row per host with the surest value of each fact kind.

    Input: ``host_id, fact_key, kind, value, confidence``; ties go to the
    smaller fact key.
    """
    def best(kind: str) -> Column:
        order = F.when(F.col("kind") == kind, F.struct(-F.col("confidence"), F.col("fact_key")))
        return F.min_by("value", order).alias(kind)

    return observations.groupBy("host_id").agg(*[best(k) for k in kinds], F.count("*").alias("facts"))
