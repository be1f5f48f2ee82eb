"""Host telemetry over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.adapters import EVENTS, project
from fleetlens.functions import columns as col
from fleetlens.operators import telemetry as op
from fleetlens.plans.registry import emit, query


def round1_sql(x: str, clamp: bool = True) -> str:
    if clamp:
        x = f"least(greatest({x}, 0.0), 100.0)"
    return f"floor(({x}) * 10 + 0.5) / 10"


def delta_sql(c: str, w: str = "w") -> str:
    return f"CASE WHEN {c} >= lag({c}) OVER {w} THEN {c} - lag({c}) OVER {w} END AS d_{c}"


SECONDS = "(epoch_us(seen_at) - lag(epoch_us(seen_at)) OVER w) / 1000000 AS d_seconds"

# counters that grow with time and start again now and then
COUNTERS = project(
    EVENTS, "event_id", "user_id % 50 AS host_id", "'eth' || CAST(user_id DIV 50 AS STRING) AS name", "seen_at",
    "(at_us DIV 1000000) % 500000 * 3 + cents AS rx_bytes", "(at_us DIV 1000000) % 300000 * 2 + k AS tx_bytes",
)


@query(
    "counter_delta",
    f"""SELECT event_id, {delta_sql('rx_bytes')}, {delta_sql('tx_bytes')}, {SECONDS} FROM {COUNTERS.sql}
    WINDOW w AS (PARTITION BY host_id, name ORDER BY seen_at, event_id)""",
)
def counter_delta(spark, sf):
    out = op.counter_delta(COUNTERS.frame(spark, sf), ["host_id", "name"], "seen_at", "event_id", ["rx_bytes", "tx_bytes"])
    return out.select("event_id", "d_rx_bytes", "d_tx_bytes", "d_seconds")


@query(
    "network_rates",
    f"""SELECT event_id, CASE WHEN d_seconds > 0 THEN d_rx_bytes / d_seconds END AS rx_rate, CASE WHEN d_seconds > 0 THEN d_tx_bytes / d_seconds END AS tx_rate
    FROM (SELECT event_id, {delta_sql('rx_bytes')}, {delta_sql('tx_bytes')}, {SECONDS} FROM {COUNTERS.sql}
    WINDOW w AS (PARTITION BY host_id, name ORDER BY seen_at, event_id))""",
)
def network_rates(spark, sf):
    return op.network_rates(COUNTERS.frame(spark, sf)).select("event_id", "rx_rate", "tx_rate")


CPU = project(
    EVENTS, "event_id", "user_id AS host_id", "seen_at",
    "ARR((at_us DIV 1000000) % 700000 * 2 + k, k, (at_us DIV 1000000) % 700000, (at_us DIV 1000000) % 700000 * 5 + cents, k, 0) AS fields",
)


CPU_SQL = f"""SELECT event_id, host_id, seen_at, CASE WHEN d_total > 0 THEN {round1_sql('(d_total - d_idle) / d_total * 100')} END AS cpu_percent FROM (
    SELECT event_id, host_id, seen_at, {delta_sql('total')}, {delta_sql('idle')} FROM (
      SELECT event_id, host_id, seen_at, CAST(list_sum(fields) AS BIGINT) AS total, fields[4] + fields[5] AS idle FROM {CPU.sql})
    WINDOW w AS (PARTITION BY host_id ORDER BY seen_at, event_id))"""


@query("cpu_percent", f"SELECT event_id, cpu_percent FROM ({CPU_SQL})")
def cpu_percent(spark, sf):
    return op.cpu_percent(CPU.frame(spark, sf)).select("event_id", "cpu_percent")


MEMINFO = project(
    EVENTS, "event_id DIV 5 % 40 AS host_id", "event_id DIV 5 AS sample",
    "CASE event_id % 5 WHEN 0 THEN 'MemTotal' WHEN 1 THEN 'MemAvailable' WHEN 2 THEN 'Cached' WHEN 3 THEN 'Buffers' ELSE 'SwapFree' END AS name",
    "CASE WHEN k = 0 THEN 0 WHEN event_id % 5 = 0 THEN 400000 + k * 1000 ELSE k * 3000 + cents END AS kb",
)


@query(
    "memory_breakdown",
    f"""WITH w AS (SELECT host_id, sample,
      coalesce(max(kb) FILTER (name = 'MemTotal'), 0) AS total, coalesce(max(kb) FILTER (name = 'MemAvailable'), 0) AS available,
      coalesce(max(kb) FILTER (name = 'Cached'), 0) + coalesce(max(kb) FILTER (name = 'Buffers'), 0) AS cached FROM {MEMINFO.sql} GROUP BY host_id, sample)
    SELECT host_id, sample, total * 1024 AS total_bytes, (total - available) * 1024 AS used_bytes, available * 1024 AS available_bytes,
      cached * 1024 AS cached_bytes, {round1_sql('(total - available) / total * 100')} AS used_percent FROM w WHERE total > 0 AND available > 0""",
)
def memory_breakdown(spark, sf):
    return op.memory_breakdown(MEMINFO.frame(spark, sf))


@query(
    "round1",
    f"SELECT event_id, {round1_sql('value')} AS clamped, {round1_sql('value', False)} AS raw FROM {EVENTS.sql}",
)
def round1(spark, sf):
    v = F.col("value")
    return EVENTS.frame(spark, sf).select("event_id", col.round1(v).alias("clamped"), col.round1(v, False).alias("raw"))


_MOUNTPOINT = "CASE k % 6 WHEN 0 THEN '/' WHEN 1 THEN '/var' WHEN 2 THEN '/var/lib/docker/x' WHEN 3 THEN '/snap/core' WHEN 4 THEN '/data' ELSE '/home' END AS mountpoint"
MOUNTS = project(
    EVENTS, "user_id AS host_id", "event_id AS line_no", _MOUNTPOINT,
    "CASE cents % 7 WHEN 0 THEN 'tmpfs' WHEN 1 THEN '/dev/sda' || CAST(k % 4 AS STRING) WHEN 2 THEN '/dev/nvme0n1p2' WHEN 3 THEN '/dev/nvme1n1' ELSE '/dev/vda1' END AS source",
    "CASE cents % 5 WHEN 0 THEN 'tmpfs' WHEN 1 THEN 'overlay' WHEN 2 THEN 'xfs' ELSE 'ext4' END AS fs_type",
)
STATFS = project(
    EVENTS, "user_id AS host_id", _MOUNTPOINT, "user_id % 7 * 1000003 AS total_bytes", "user_id % 7 * (k % 6) * 90001 AS free_bytes",
)
USAGE_SQL = f"""WITH m AS (SELECT host_id, mountpoint, arg_min(source, line_no) AS device, arg_min(fs_type, line_no) AS fs_type FROM {MOUNTS.sql}
      WHERE fs_type NOT IN ('tmpfs', 'overlay') AND mountpoint NOT LIKE '/var/lib/docker/%' AND mountpoint NOT LIKE '/snap/%' AND source LIKE '/dev/%'
      GROUP BY host_id, mountpoint),
    s AS (SELECT DISTINCT * FROM {STATFS.sql})
    SELECT m.host_id, m.device, m.mountpoint, m.fs_type, s.total_bytes, s.total_bytes - s.free_bytes AS used_bytes,
      {round1_sql('(s.total_bytes - s.free_bytes) / s.total_bytes * 100')} AS used_percent
    FROM m JOIN s ON m.host_id = s.host_id AND m.mountpoint = s.mountpoint WHERE s.total_bytes > 0"""
BASE_SQL = "regexp_replace(regexp_replace({}, '[0-9]+$', ''), 'p$', '')"


@query("disk_usage", USAGE_SQL)
def disk_usage(spark, sf):
    return op.disk_usage(MOUNTS.frame(spark, sf), STATFS.frame(spark, sf).distinct())


@query(
    "disk_summary",
    f"""SELECT host_id, count(DISTINCT {BASE_SQL.format('device')}) > 1 AS has_multiple_disks,
      max(used_percent) FILTER (mountpoint = '/') AS root_used_percent FROM ({USAGE_SQL}) GROUP BY host_id""",
)
def disk_summary(spark, sf):
    return op.disk_summary(disk_usage(spark, sf))


DEVICES = project(
    EVENTS, "event_id",
    "CASE k % 8 WHEN 0 THEN 'sda' WHEN 1 THEN 'sda' || CAST(k AS STRING) WHEN 2 THEN 'nvme0n' || CAST(k AS STRING) WHEN 3 THEN 'nvme0n1p' || CAST(k AS STRING)"
    " WHEN 4 THEN 'mmcblk0' WHEN 5 THEN 'mmcblk0p' || CAST(k AS STRING) WHEN 6 THEN 'dm-' || CAST(k AS STRING) ELSE 'md' || CAST(k AS STRING) END AS name",
)


@query("block_device_base", f"SELECT event_id, {BASE_SQL.format('name')} AS base FROM {DEVICES.sql}")
def block_device_base(spark, sf):
    return DEVICES.frame(spark, sf).select("event_id", col.block_device_base(F.col("name")).alias("base"))


PARTITION_SQL = """CASE WHEN regexp_matches({0}, '^(nvme|mmcblk)') THEN regexp_matches({0}, 'p[+-]?[0-9]+$')
    WHEN regexp_matches({0}, '^(dm-|md)') THEN false ELSE regexp_matches({0}, '[0-9]$') END"""


@query("is_partition", f"SELECT event_id, {PARTITION_SQL.format('name')} AS is_partition FROM {DEVICES.sql}")
def is_partition(spark, sf):
    return DEVICES.frame(spark, sf).select("event_id", col.is_partition(F.col("name")).alias("is_partition"))


DISKS = project(
    EVENTS, "event_id", "user_id % 50 AS host_id", "seen_at",
    "CASE user_id DIV 50 WHEN 0 THEN 'sda' WHEN 1 THEN 'nvme0n1' ELSE 'sda1' END AS device",
    "(at_us DIV 1000000) % 400000 DIV 700 AS reads", "(at_us DIV 1000000) % 400000 DIV 20 + k AS read_ms",
    "(at_us DIV 1000000) % 350000 DIV 9000 AS writes", "(at_us DIV 1000000) % 350000 DIV 10 + cents AS write_ms",
)
MOUNTED = project(
    EVENTS, "user_id % 50 AS host_id", "CASE WHEN k % 2 = 0 THEN '/dev/sda1' ELSE '/dev/nvme0n1p2' END AS device",
    where="user_id % 4 <> 0",
)
DISK_DELTAS_SQL = f"""SELECT * FROM (SELECT event_id, host_id, device, seen_at, {delta_sql('reads')}, {delta_sql('read_ms')}, {delta_sql('writes')}, {delta_sql('write_ms')}, {SECONDS}
      FROM (SELECT * FROM {DISKS.sql} WHERE device <> 'sda1') WINDOW w AS (PARTITION BY host_id, device ORDER BY seen_at, event_id)) d
    WHERE d_seconds IS NOT NULL AND EXISTS (SELECT 1 FROM {MOUNTED.sql} m WHERE m.host_id = d.host_id AND {BASE_SQL.format('m.device')} = '/dev/' || d.device)"""


@query(
    "disk_latency",
    f"""SELECT event_id, device,
      CASE WHEN d_reads > 0 THEN {round1_sql('d_read_ms / d_reads')} END AS read_latency_ms,
      CASE WHEN d_writes > 0 THEN {round1_sql('d_write_ms / d_writes')} END AS write_latency_ms,
      CASE WHEN d_reads > 0 AND d_seconds > 0 THEN {round1_sql('d_reads / d_seconds')} END AS read_iops,
      CASE WHEN d_writes > 0 AND d_seconds > 0 THEN {round1_sql('d_writes / d_seconds')} END AS write_iops FROM ({DISK_DELTAS_SQL})""",
)
def disk_latency(spark, sf):
    out = op.disk_latency(DISKS.frame(spark, sf), MOUNTED.frame(spark, sf))
    return out.select("event_id", "device", "read_latency_ms", "write_latency_ms", "read_iops", "write_iops")


@query(
    "disk_latency_avg",
    f"""SELECT host_id, epoch_us(date_trunc('day', seen_at)) AS window_start,
      CASE WHEN sum(d_reads) > 0 THEN {round1_sql('sum(d_read_ms) / sum(d_reads)')} END AS read_latency_ms,
      CASE WHEN sum(d_writes) > 0 THEN {round1_sql('sum(d_write_ms) / sum(d_writes)')} END AS write_latency_ms
    FROM ({DISK_DELTAS_SQL}) GROUP BY host_id, date_trunc('day', seen_at)""",
)
def disk_latency_avg(spark, sf):
    return emit(op.disk_latency_avg(DISKS.frame(spark, sf), MOUNTED.frame(spark, sf), "1 day"))


PROCESSES = project(
    EVENTS, "(at_us DIV 86400000000) % 7 AS host_id", "at_us DIV 86400000000 AS day", "user_id AS pid", "cents AS ticks",
    "k * 4096 AS rss", "event_type AS name",
)
_SNAP_SQL = f"""SELECT host_id, day, pid, CAST(sum(ticks) AS BIGINT) AS ticks, max(rss) AS rss_bytes, min(name) AS name FROM {PROCESSES.sql} GROUP BY host_id, day, pid"""


@query(
    "top_processes",
    f"""WITH s AS ({_SNAP_SQL}), t AS (SELECT day, CAST(sum(ticks) AS BIGINT) AS total FROM s GROUP BY day),
    p AS (SELECT b.host_id, b.day AS sample, b.pid, b.name, b.rss_bytes, b.ticks - a.ticks AS d,
            CASE WHEN tb.total - ta.total > 0 THEN tb.total - ta.total ELSE 1 END AS base
          FROM s b JOIN s a ON a.day = b.day - 1 AND a.pid = b.pid JOIN t tb ON tb.day = b.day JOIN t ta ON ta.day = a.day WHERE b.ticks >= a.ticks),
    c AS (SELECT *, {round1_sql('d / base * 100')} AS cpu_percent FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY host_id, sample ORDER BY cpu_percent DESC, pid) AS cpu_rank,
            row_number() OVER (PARTITION BY host_id, sample ORDER BY rss_bytes DESC, pid) AS rss_rank FROM c)
    SELECT 'cpu' AS by, host_id, sample, CAST(cpu_rank AS INT) AS rank, pid, name, cpu_percent, rss_bytes FROM r WHERE cpu_rank <= 5
    UNION ALL SELECT 'rss', host_id, sample, CAST(rss_rank AS INT), pid, name, cpu_percent, rss_bytes FROM r WHERE rss_rank <= 5""",
)
def top_processes(spark, sf):
    snaps = PROCESSES.frame(spark, sf).groupBy("host_id", "day", "pid").agg(
        F.sum("ticks").alias("ticks"), F.max("rss").alias("rss_bytes"), F.min("name").alias("name")
    )
    # two samples a day apart; the host of a pair is the host of its later sample
    later = snaps.withColumnRenamed("day", "sample")
    earlier = snaps.select(
        ((F.col("day") + 1) % 7).alias("host_id"), (F.col("day") + 1).alias("sample"), "pid", "ticks"
    )
    totals = snaps.groupBy("day").agg(F.sum("ticks").alias("total"))
    before = totals.select((F.col("day") + 1).alias("day"), F.col("total").alias("total_a"))
    system = totals.join(before, "day").select(
        (F.col("day") % 7).alias("host_id"), F.col("day").alias("sample"), (F.col("total") - F.col("total_a")).alias("d_total")
    )
    return (
        op.top_processes(earlier, later, system, "cpu").withColumn("by", F.lit("cpu"))
        .unionByName(op.top_processes(earlier, later, system, "rss").withColumn("by", F.lit("rss")))
    )


NET_LINES = project(
    EVENTS, "user_id AS host_id", "event_id % 40 AS line_no", "event_id",
    "CASE WHEN k % 9 = 0 THEN 'Inter-|   Receive' WHEN k % 9 = 1 THEN ' eth0: 12 3 4' WHEN k % 9 = 2 THEN '  eth1: x 1 2 3 4 5 6 7 8 9'"
    " ELSE '  eth' || CAST(k % 3 AS STRING) || ':   ' || CAST(cents AS STRING) || ' 1 0 0  0 0 0 0   ' || CAST(k AS STRING) || ' 3 0 0 0 0 0 0' END AS line",
)
FIELDS = "list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> '')"


@query(
    "parse_net_dev",
    f"""SELECT host_id, line_no, name, CAST(f[1] AS BIGINT) AS rx_bytes, CAST(f[9] AS BIGINT) AS tx_bytes FROM (
      SELECT host_id, line_no, trim(split_part(line, ':', 1)) AS name, {FIELDS.format("split_part(line, ':', 2)")} AS f
      FROM {NET_LINES.sql} WHERE line_no > 2 AND contains(line, ':'))
    WHERE len(f) >= 9 AND regexp_full_match(f[1], '[0-9]+') AND regexp_full_match(f[9], '[0-9]+')""",
)
def parse_net_dev(spark, sf):
    out = op.parse_net_dev(NET_LINES.frame(spark, sf))
    return out.withColumns({c: F.col(c).cast("long") for c in ("rx_bytes", "tx_bytes")})


DISK_LINES = project(
    EVENTS, "user_id AS host_id", "event_id AS line_no",
    "CASE WHEN k % 7 = 0 THEN '8 0 sda 1 2' ELSE '   8   ' || CAST(k AS STRING) || CASE k % 4 WHEN 0 THEN ' sdb ' WHEN 1 THEN ' sdb1 ' WHEN 2 THEN ' nvme0n1 ' ELSE ' nvme0n1p2 ' END"
    " || CAST(cents AS STRING) || ' 2 3 ' || CAST(k AS STRING) || ' ' || CAST(cents * 2 AS STRING) || ' 6 7 ' || CASE WHEN k % 11 = 0 THEN 'x' ELSE CAST(k * 3 AS STRING) END || ' 9 10 11' END AS line",
)


@query(
    "parse_diskstats",
    f"""SELECT host_id, line_no, f[3] AS device, CAST(f[4] AS BIGINT) AS reads, CAST(f[7] AS BIGINT) AS read_ms, CAST(f[8] AS BIGINT) AS writes, CAST(f[11] AS BIGINT) AS write_ms
    FROM (SELECT host_id, line_no, {FIELDS.format('line')} AS f FROM {DISK_LINES.sql})
    WHERE len(f) >= 14 AND NOT ({PARTITION_SQL.format('f[3]')}) AND regexp_full_match(f[11], '[0-9]+')""",
)
def parse_diskstats(spark, sf):
    out = op.parse_diskstats(DISK_LINES.frame(spark, sf))
    return out.withColumns({c: F.col(c).cast("long") for c in ("reads", "read_ms", "writes", "write_ms")})


STAT_LINES = project(
    EVENTS, "user_id AS host_id", "event_id AS line_no",
    "CASE WHEN k % 8 = 0 THEN CAST(event_id AS STRING) || ' no name S 1' WHEN k % 8 = 1 THEN CAST(event_id AS STRING) || ' (short) S 1 2 3'"
    " ELSE CAST(event_id AS STRING) || ' (' || event_type || CASE WHEN k % 2 = 0 THEN ' (x)' ELSE '' END || ') S 1 2 3 4 5 6 7 8 9 10 ' || CAST(cents AS STRING) || ' ' || CAST(k AS STRING) || ' 0 0' END AS line",
)


@query(
    "parse_pid_stat",
    f"""SELECT host_id, line_no, name, f[1] AS state, CAST(f[12] AS BIGINT) + CAST(f[13] AS BIGINT) AS cpu_ticks FROM (
      SELECT host_id, line_no, regexp_extract(line, '^[^(]*\\((.*)\\)', 1) AS name, {FIELDS.format("string_split(line, ')')[-1]")} AS f
      FROM {STAT_LINES.sql} WHERE contains(line, '(')) WHERE len(f) >= 13""",
)
def parse_pid_stat(spark, sf):
    return op.parse_pid_stat(STAT_LINES.frame(spark, sf)).withColumn("cpu_ticks", F.col("cpu_ticks").cast("long"))


STATUS_LINES = project(
    EVENTS, "user_id AS host_id", "event_id AS line_no",
    "CASE k % 4 WHEN 0 THEN 'VmSize: 12 kB' WHEN 1 THEN 'VmRSS:' WHEN 2 THEN 'VmRSS:  ' || CAST(cents AS STRING) || ' kB' ELSE 'VmRSS: n/a kB' END AS line",
)


@query(
    "parse_vmrss",
    f"""SELECT host_id, line_no, CAST(f[2] AS BIGINT) * 1024 AS rss_bytes FROM (SELECT host_id, line_no, {FIELDS.format('line')} AS f
    FROM {STATUS_LINES.sql} WHERE starts_with(line, 'VmRSS:')) WHERE len(f) >= 2 AND regexp_full_match(f[2], '[0-9]+')""",
)
def parse_vmrss(spark, sf):
    return op.parse_vmrss(STATUS_LINES.frame(spark, sf)).withColumn("rss_bytes", F.col("rss_bytes").cast("long"))


MOUNT_LINES = project(
    EVENTS, "user_id AS host_id", "event_id AS line_no",
    "CASE WHEN k % 9 = 0 THEN '36 35 98:0 / /mnt rw' WHEN k % 9 = 1 THEN '36 35 98:0 / - ext4 /dev/sda'"
    " ELSE '36 35 98:' || CAST(k AS STRING) || ' / /mnt/' || event_type || CASE WHEN k % 2 = 0 THEN chr(92) || '040x' ELSE '' END || CASE WHEN k % 3 = 0 THEN '/' ELSE '' END"
    " || ' rw,noatime master:1 - ext3 /dev/root' || CAST(k AS STRING) || ' rw' END AS line",
)


@query(
    "parse_mountinfo",
    f"""SELECT host_id, line_no, regexp_replace(replace(pre[5], chr(92) || '040', ' '), '(.)/$', '\\1') AS mountpoint, post[2] AS source, post[1] AS fs_type FROM (
      SELECT host_id, line_no, {FIELDS.format("split_part(line, ' - ', 1)")} AS pre, {FIELDS.format("split_part(line, ' - ', 2)")} AS post
      FROM {MOUNT_LINES.sql} WHERE contains(line, ' - ')) WHERE len(pre) >= 5 AND len(post) >= 2""",
)
def parse_mountinfo(spark, sf):
    return op.parse_mountinfo(MOUNT_LINES.frame(spark, sf))


OS_LINES = project(
    EVENTS, "user_id AS host_id", "event_id AS line_no",
    "CASE k % 6 WHEN 0 THEN 'NAME=x' WHEN 1 THEN '# ID=none' WHEN 2 THEN 'ID=' || event_type WHEN 3 THEN 'VERSION_ID=\"' || CAST(k AS STRING) || '.04\"' WHEN 4 THEN 'ID=\"\"' ELSE 'broken' END AS line",
)
STRICT_LINES = project(OS_LINES, "host_id * 100 + line_no % 97 AS host_id", "line_no", "line")


@query(
    "os_info_first_complete",
    f"""WITH p AS (SELECT host_id, line_no, split_part(line, '=', 1) AS key, trim(split_part(line, '=', 2), '"') AS value FROM {OS_LINES.sql}
        WHERE contains(line, '=') AND line NOT LIKE '#%'),
    a AS (SELECT host_id, min(line_no) FILTER (key = 'ID') AS i, min(line_no) FILTER (key = 'VERSION_ID') AS v FROM p WHERE value <> '' GROUP BY 1)
    SELECT p.host_id, coalesce(arg_max(value, line_no) FILTER (key = 'ID'), '') AS distro, coalesce(arg_max(value, line_no) FILTER (key = 'VERSION_ID'), '') AS version
    FROM p LEFT JOIN a ON a.host_id = p.host_id WHERE key IN ('ID', 'VERSION_ID') AND (i IS NULL OR v IS NULL OR (line_no <= i OR line_no <= v)) GROUP BY 1""",
)
def os_info_first_complete(spark, sf):
    return op.os_info(OS_LINES.frame(spark, sf))


@query(
    "os_info_last",
    f"""SELECT host_id, coalesce(arg_max(value, line_no) FILTER (key = 'ID'), '') AS distro, coalesce(arg_max(value, line_no) FILTER (key = 'VERSION_ID'), '') AS version FROM (
      SELECT host_id, line_no, split_part(line, '=', 1) AS key, trim(split_part(line, '=', 2), '"') AS value FROM {OS_LINES.sql} WHERE contains(line, '=') AND line NOT LIKE '#%')
    WHERE key IN ('ID', 'VERSION_ID') GROUP BY 1""",
)
def os_info_last(spark, sf):
    return op.os_info(OS_LINES.frame(spark, sf), "last")


@query(
    "os_info_strict",
    f"""SELECT host_id, max(value) FILTER (key = 'ID') AS distro, max(value) FILTER (key = 'VERSION_ID') AS version FROM (
      SELECT host_id, line_no, split_part(line, '=', 1) AS key, trim(split_part(line, '=', 2), '"') AS value FROM {STRICT_LINES.sql} WHERE contains(line, '=') AND line NOT LIKE '#%')
    GROUP BY 1 HAVING count(*) FILTER (key = 'ID') = 1 AND count(*) FILTER (key = 'VERSION_ID') = 1 AND distro <> '' AND version <> ''""",
)
def os_info_strict(spark, sf):
    return op.os_info(STRICT_LINES.frame(spark, sf), "strict")


@query(
    "capability_matrix",
    f"SELECT user_id AS host_id, bool_or(k = 1) AS ansible, bool_or(k % 50 = 3) AS docker, false AS podman FROM {EVENTS.sql} GROUP BY user_id",
)
def capability_matrix(spark, sf):
    caps = F.create_map(F.lit("ansible"), F.col("k") == 1, F.lit("docker"), F.col("k") % 50 == 3)
    return op.capability_matrix(EVENTS.frame(spark, sf).select(F.col("user_id").alias("host_id"), caps.alias("capabilities")))


@query(
    "telemetry_rollup",
    f"""WITH t AS (SELECT host_id, date_trunc('day', seen_at) AS d, cpu_percent, CAST(round(cpu_percent * 10) AS BIGINT) AS tenths FROM ({CPU_SQL})),
    r AS (SELECT *, CASE WHEN tenths IS NOT NULL THEN row_number() OVER (PARTITION BY host_id, d ORDER BY cpu_percent NULLS LAST) END AS rn, count(tenths) OVER (PARTITION BY host_id, d) AS n FROM t)
    SELECT host_id, epoch_us(d) AS window_start, count(tenths) AS samples, CAST(sum(CAST(cpu_percent AS DECIMAL(28,10))) AS DOUBLE) / count(tenths) AS avg_value, max(cpu_percent) AS max_value,
      min(cpu_percent) FILTER (rn >= ceil(n * 0.95)) AS p95_value FROM r GROUP BY host_id, d""",
)
def telemetry_rollup(spark, sf):
    return emit(op.telemetry_rollup(op.cpu_percent(CPU.frame(spark, sf)), "cpu_percent", grain="1 day"))


@query(
    "region_rollup",
    f"""SELECT region, host_id, count(*) AS samples, CAST(sum(cents) AS BIGINT) AS total, CAST(GROUPING(region) * 2 + GROUPING(host_id) AS INT) AS level
    FROM (SELECT user_id % 5 AS region, user_id AS host_id, cents FROM {EVENTS.sql}) GROUP BY ROLLUP (region, host_id)""",
)
def region_rollup(spark, sf):
    hosts = EVENTS.frame(spark, sf).selectExpr("user_id % 5 AS region", "user_id AS host_id", "cents")
    return op.region_rollup(hosts, "cents")
