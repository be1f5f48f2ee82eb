"""Readers and writers over files that Spark writes from the driver tables first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.adapters import EVENTS, project
from fleetlens.functions.folders import shared_folder
from fleetlens.plans.registry import emit, query
from fleetlens.sources import readers
from fleetlens.sources.file_tree import file_tree


def _folder(df: DataFrame, name: str) -> str:
    return f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


def _posted(df: DataFrame, record) -> str:
    """A folder of JSON lines, one for each row, with a line among them that is none."""
    path = _folder(df, "posted")
    bad = df.sparkSession.createDataFrame([("no JSON {",)], "value string")
    df.select(F.to_json(record).alias("value")).unionByName(bad).write.text(path)
    return path


POSTED = project(
    EVENTS, "event_id", "'s' || CAST(user_id AS STRING) AS server_id", "event_type", "k", "at_us", "TSUS(at_us DIV 1000000 * 1000000) AS at", "TSUS(at_us DIV 1000000 * 1000000 + 5000000) AS later",
)
_AT = "at_us // 1000000 * 1000000"


@query(
    "read_discovery",
    f"""SELECT server_id, {_AT} AS discovered_at, 'svc' || k AS name, 'systemd' AS type, CAST(k AS INT) AS pid, CASE WHEN k % 2 = 0 THEN '80,' || (8000 + k) END AS ports, event_type AS kind FROM {POSTED.sql}
    UNION ALL SELECT server_id, {_AT}, 'db', 'docker', NULL, NULL, NULL FROM {POSTED.sql} WHERE k % 3 = 0""",
)
def read_discovery(spark, sf):
    rows = POSTED.frame(spark, sf)
    first = F.struct(
        F.concat(F.lit("svc"), "k").alias("name"), F.lit("systemd").alias("type"), F.col("k").cast("int").alias("pid"),
        F.when(F.col("k") % 2 == 0, F.array(F.lit(80), (F.col("k") + 8000).cast("int"))).alias("ports"), F.struct(F.col("event_type").alias("kind")).alias("meta"))
    none = F.lit(None)
    second = F.struct(F.lit("db").alias("name"), F.lit("docker").alias("type"), none.cast("int").alias("pid"), none.cast("array<int>").alias("ports"), none.cast("struct<kind:string>").alias("meta"))
    services = F.when(F.col("k") % 3 == 0, F.array(first, second)).otherwise(F.array(first))
    path = _posted(rows, F.struct("server_id", F.col("at").alias("discovered_at"), services.alias("services"), F.lit(1).alias("newer")))
    found = readers.read_discovery(spark, path).filter("raw IS NOT NULL").select("server_id", "discovered_at", F.inline("services"))
    return emit(found, "server_id", "discovered_at", "name", "type", "pid", F.array_join("ports", ",").alias("ports"), F.try_variant_get("meta", "$.kind", "string").alias("kind"))


@query(
    "read_remediation_log",
    f"""SELECT server_id, 'i' || event_id AS incident_id, event_type AS trigger, k % 2 = 0 AS success, CAST(CASE WHEN k % 4 = 0 THEN 0 ELSE 2 END AS INT) AS steps, CASE WHEN k % 4 > 0 THEN CAST(k * 10 AS BIGINT) END AS last_ms,
      CAST(k AS BIGINT) AS verified, {_AT} AS started_at, {_AT} + 5000000 AS finished_at FROM {POSTED.sql}""",
)
def read_remediation_log(spark, sf):
    step = lambda n, ms: F.struct(F.lit(n).alias("order"), F.lit("restart").alias("command"), F.lit(0).alias("exit_code"), ms.alias("duration_ms"))
    steps = F.when(F.col("k") % 4 > 0, F.array(step(1, F.col("k")), step(2, F.col("k") * 10))).otherwise(F.array().cast("array<struct<order:int,command:string,exit_code:int,duration_ms:bigint>>"))
    record = F.struct(
        "server_id", F.concat(F.lit("i"), "event_id").alias("incident_id"), F.col("event_type").alias("trigger"), (F.col("k") % 2 == 0).alias("success"),
        steps.alias("steps"), F.struct(F.col("k").alias("checks")).alias("verification"), F.col("at").alias("started_at"), F.col("later").alias("finished_at"))
    found = readers.read_remediation_log(spark, _posted(POSTED.frame(spark, sf), record)).filter("raw IS NOT NULL")
    return emit(
        found, "server_id", "incident_id", "trigger", "success", F.size("steps").alias("steps"), F.get("steps", F.lit(1))["duration_ms"].alias("last_ms"),
        F.try_variant_get("verification", "$.checks", "bigint").alias("verified"), "started_at", "finished_at")


@query(
    "read_ops_result",
    f"""SELECT 'r' || event_id AS run_id, server_id, event_type AS status, 'step' || n AS step_id, n = 1 AS changed, CASE WHEN n = 2 THEN 'failed' END AS error FROM {POSTED.sql}, (VALUES (1), (2)) AS s(n)""",
)
def read_ops_result(spark, sf):
    step = lambda n: F.struct(F.lit(f"step{n}").alias("step_id"), F.lit(n == 1).alias("changed"), F.lit("failed" if n == 2 else None).cast("string").alias("error"))
    record = F.struct(F.concat(F.lit("r"), "event_id").alias("run_id"), "server_id", F.col("event_type").alias("status"), F.array(step(1), step(2)).alias("step_results"))
    found = readers.read_ops_result(spark, _posted(POSTED.frame(spark, sf), record)).filter("raw IS NOT NULL")
    steps = found.select("run_id", "server_id", "status", F.explode("step_results").alias("s"))
    return steps.select("run_id", "server_id", "status", "s.step_id", "s.changed", "s.error")


@query(
    "read_audit_result",
    f"""SELECT 'r' || event_id AS run_id, server_id, 'check' || k AS check_key, event_type AS status, CAST(k AS DOUBLE) / 4 AS confidence, CAST(k AS BIGINT) AS line, CASE WHEN k % 2 = 0 THEN 'timeout' END AS errors FROM {POSTED.sql}""",
)
def read_audit_result(spark, sf):
    result = F.struct(
        F.concat(F.lit("check"), "k").alias("check_key"), F.col("event_type").alias("status"), (F.col("k") / 4).alias("confidence"), F.struct(F.col("k").alias("line")).alias("raw_output"),
        F.when(F.col("k") % 2 == 0, F.array(F.lit("timeout"))).alias("errors"))
    record = F.struct(F.concat(F.lit("r"), "event_id").alias("run_id"), "server_id", F.array(result).alias("results"))
    found = readers.read_audit_result(spark, _posted(POSTED.frame(spark, sf), record)).filter("raw IS NOT NULL").select("run_id", "server_id", F.inline("results"))
    return found.select("run_id", "server_id", "check_key", "status", "confidence", F.try_variant_get("raw_output", "$.line", "bigint").alias("line"), F.array_join("errors", ",").alias("errors"))


@query(
    "read_command_result",
    f"""SELECT server_id, 'c' || event_id AS command_id, CASE WHEN k % 5 = 0 THEN NULL ELSE CAST(k % 3 AS INT) END AS exit_code, CAST(k AS BIGINT) * 10000000000 AS duration_ms, event_type || chr(10) || '"x"' AS output, {_AT} AS started_at FROM {POSTED.sql}""",
)
def read_command_result(spark, sf):
    record = F.struct(
        "server_id", F.concat(F.lit("c"), "event_id").alias("command_id"), F.when(F.col("k") % 5 > 0, (F.col("k") % 3).cast("int")).alias("exit_code"),
        (F.col("k") * 10_000_000_000).alias("duration_ms"), F.concat("event_type", F.lit('\n"x"')).alias("output"), F.col("at").alias("started_at"))
    found = readers.read_command_result(spark, _posted(POSTED.frame(spark, sf), record)).filter("raw IS NOT NULL")
    return emit(found, "server_id", "command_id", "exit_code", "duration_ms", "output", "started_at")


LANDED = project(EVENTS, "event_id", "event_type", "user_id", "cents")


@query("write_table", f"SELECT event_id, event_type, user_id, cents FROM {LANDED.sql}")
def write_table(spark, sf):
    """Appended in two parts by event type, and read back."""
    rows = LANDED.frame(spark, sf)
    path = _folder(rows, "landed")
    for part in (rows.filter("user_id % 2 = 0"), rows.filter("user_id % 2 <> 0 OR user_id IS NULL")):
        readers.write_table(part, path, ["event_type"])
    return spark.read.parquet(path).select("event_id", "event_type", "user_id", "cents")


LINES = project("customer", "c_nationkey AS n", "c_name || ' ' || c_mktsegment AS value")


@query(
    "file_tree",
    f"""SELECT 'n=' || n AS path, 'directory' AS type, CAST(0 AS BIGINT) AS size, '' AS digest FROM {LINES.sql} GROUP BY n
    UNION ALL SELECT 'n=' || n || '/part', 'file', CAST(sum(strlen(value) + 1) AS BIGINT), 'sha256:' || sha256(string_agg(value || chr(10), '' ORDER BY encode(value))) FROM {LINES.sql} GROUP BY n""",
)
def files_of_a_tree(spark, sf):
    """One folder and file for each nation, written by Spark, then walked."""
    rows = LINES.frame(spark, sf)
    path = _folder(rows, "tree")
    rows.repartition("n").sortWithinPartitions("n", "value").write.partitionBy("n").text(path)
    found = file_tree(spark, path).filter(~F.col("path").rlike(r"[.]crc$|_SUCCESS$"))
    return found.select(F.regexp_replace("path", r"/part-[^/]*$", "/part").alias("path"), "type", "size", "digest")
