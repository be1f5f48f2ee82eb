"""Host metrics from cumulative counters, mount tables and process snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import rules
from fleetlens.functions.columns import block_device_base, clean_path, field, is_partition, round1, unquote, unsigned, words
from fleetlens.functions.ordered import number_segment, ordered_scan, time_segment
from fleetlens.functions.spread import spread_join


def counter_delta(
    df: DataFrame, keys: Sequence[str], ts: str, tie: str, cols: Sequence[str], segment_seconds: int = 3_600
) -> DataFrame:
    """Add ``d_<col>`` per counter and ``d_seconds``.

    A counter that went down was reset: its delta is null.  (Unsigned
    subtraction would give a huge number instead.)
    """
    work = df.withColumn("segment", time_segment(ts, segment_seconds))
    scanned = ordered_scan(
        work, keys, [ts, tie], "segment", lag={**{f"p_{c}": c for c in cols}, "p_ts": ts}
    )
    deltas = {f"d_{c}": F.when(F.col(c) >= F.col(f"p_{c}"), F.col(c) - F.col(f"p_{c}")) for c in cols}
    seconds = (F.unix_micros(ts) - F.unix_micros("p_ts")) / 1_000_000
    return scanned.withColumns({**deltas, "d_seconds": seconds}).select(*df.columns, *deltas, "d_seconds")


def cpu_percent(samples: DataFrame, ts: str = "seen_at", tie: str = "event_id", no_time: str = "null") -> DataFrame:
    """Busy share between neighbouring samples of a host.

    Input: ``host_id, fields`` (array of tick counters, the 4th idle and the
    5th iowait).  Without elapsed ticks the result is null, or 0 when
    ``no_time`` is ``zero``.
    """
    total = F.aggregate("fields", F.lit(0).cast("long"), lambda acc, v: acc + v)
    idle = field(F.col("fields"), 3) + F.coalesce(field(F.col("fields"), 4), F.lit(0))
    ticks = counter_delta(
        samples.withColumns({"total": total, "idle": idle}), ["host_id"], ts, tie, ["total", "idle"]
    )
    dt, di = F.col("d_total"), F.col("d_idle")
    empty = F.lit(0.0) if no_time == "zero" else F.lit(None).cast("double")
    percent = F.when(dt > 0, round1((dt - di) / dt * 100)).when(dt.isNotNull(), empty)
    return ticks.withColumn("cpu_percent", percent)


def memory_breakdown(meminfo: DataFrame) -> DataFrame:
    """Memory use per host and sample from ``host_id, sample, name, kb`` rows.

    Samples without a total or an available amount are left out.
    """
    def kb(name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("name") == name, F.col("kb"))), F.lit(0))

    wide = meminfo.groupBy("host_id", "sample").agg(
        kb("MemTotal").alias("total"),
        kb("MemAvailable").alias("available"),
        (kb("Cached") + kb("Buffers")).alias("cached"),
    )
    used = F.col("total") - F.col("available")
    return wide.filter("total > 0 AND available > 0").select(
        "host_id",
        "sample",
        (F.col("total") * 1024).alias("total_bytes"),
        (used * 1024).alias("used_bytes"),
        (F.col("available") * 1024).alias("available_bytes"),
        (F.col("cached") * 1024).alias("cached_bytes"),
        round1(used / F.col("total") * 100).alias("used_percent"),
    )


def disk_usage(mounts: DataFrame, statfs: DataFrame) -> DataFrame:
    """Use of real disks.

    ``mounts``: ``host_id, line_no, mountpoint, source, fs_type``; ``statfs``:
    ``host_id, mountpoint, total_bytes, free_bytes``.  The first line of a
    mountpoint wins.
    """
    mp, src = F.col("mountpoint"), F.col("source")
    real = mounts.filter(
        ~F.col("fs_type").isin(*rules.PSEUDO_FILESYSTEMS)
        & ~mp.contains("/var/lib/docker/")
        & ~mp.contains("/var/lib/containerd/")
        & ~mp.startswith("/snap/")
        & src.startswith("/dev/")
    )
    first = real.groupBy("host_id", "mountpoint").agg(
        F.min_by(F.struct("source", "fs_type"), "line_no").alias("m")
    )
    used = F.col("total_bytes") - F.col("free_bytes")
    return (
        first.join(statfs.filter("total_bytes > 0"), ["host_id", "mountpoint"])
        .select(
            "host_id",
            F.col("m.source").alias("device"),
            "mountpoint",
            F.col("m.fs_type").alias("fs_type"),
            "total_bytes",
            used.alias("used_bytes"),
            round1(used / F.col("total_bytes") * 100).alias("used_percent"),
        )
    )


def disk_summary(usage: DataFrame) -> DataFrame:
    """Whether a host has several disks, and how full its root is."""
    return usage.groupBy("host_id").agg(
        (F.countDistinct(block_device_base(F.col("device"))) > 1).alias("has_multiple_disks"),
        F.max(F.when(F.col("mountpoint") == "/", F.col("used_percent"))).alias("root_used_percent"),
    )


def _disk_deltas(samples: DataFrame, mounted: DataFrame | None, ts: str, tie: str) -> DataFrame:
    deltas = counter_delta(
        samples.filter(~is_partition(F.col("device"))),
        ["host_id", "device"], ts, tie, ["reads", "read_ms", "writes", "write_ms"],
    ).filter("d_seconds IS NOT NULL")
    if mounted is None:
        return deltas
    devices = mounted.select("host_id", block_device_base(F.col("device")).alias("base")).distinct()
    return deltas.withColumn("base", F.concat(F.lit("/dev/"), "device")).join(devices, ["host_id", "base"], "left_semi")


def disk_latency(
    samples: DataFrame, mounted: DataFrame | None, ts: str = "seen_at", tie: str = "event_id", clamp: bool = True
) -> DataFrame:
    """Latency and operations per second of each mounted device.

    The clamp to 100 also holds for these two, as it does at the source;
    ``clamp=False`` gives the raw values.
    """
    def ratio(n: str, d: str) -> Column:
        return F.when(F.col(d) > 0, round1(F.col(n) / F.col(d), clamp))

    def rate(n: str) -> Column:
        return F.when((F.col(n) > 0) & (F.col("d_seconds") > 0), round1(F.col(n) / F.col("d_seconds"), clamp))

    return _disk_deltas(samples, mounted, ts, tie).withColumns(
        {
            "read_latency_ms": ratio("d_read_ms", "d_reads"),
            "write_latency_ms": ratio("d_write_ms", "d_writes"),
            "read_iops": rate("d_reads"),
            "write_iops": rate("d_writes"),
        }
    )


def disk_latency_avg(
    samples: DataFrame, mounted: DataFrame | None, window: str = "1 hour", ts: str = "seen_at", tie: str = "event_id"
) -> DataFrame:
    """Ratio of sums over all devices of a host and window, null without operations."""
    def ratio(n: str, d: str) -> Column:
        return F.when(F.sum(d) > 0, round1(F.sum(n) / F.sum(d)))

    deltas = _disk_deltas(samples, mounted, ts, tie)
    return deltas.groupBy("host_id", F.window(ts, window)["start"].alias("window_start")).agg(
        ratio("d_read_ms", "d_reads").alias("read_latency_ms"),
        ratio("d_write_ms", "d_writes").alias("write_latency_ms"),
    )


def network_rates(counters: DataFrame, ts: str = "seen_at", tie: str = "event_id") -> DataFrame:
    """Bytes per second of each interface between neighbouring samples."""
    deltas = counter_delta(counters, ["host_id", "name"], ts, tie, ["rx_bytes", "tx_bytes"])
    return deltas.withColumns(
        {
            "rx_rate": F.when(F.col("d_seconds") > 0, F.col("d_rx_bytes") / F.col("d_seconds")),
            "tx_rate": F.when(F.col("d_seconds") > 0, F.col("d_tx_bytes") / F.col("d_seconds")),
        }
    )


def top_processes(snap_a: DataFrame, snap_b: DataFrame, system: DataFrame, by: str = "cpu", k: int = 5) -> DataFrame:
    """The k largest processes of every host sample, by ``cpu`` or ``rss``.

    Snapshots: ``host_id, sample, pid, ticks`` and in ``snap_b`` also ``name,
    rss_bytes``; ``system``: ``host_id, sample, d_total``.  The limit is
    applied before the shuffle too, so a host with many processes stays cheap.
    Equal values are ordered by pid.
    """
    a = snap_a.select("host_id", "sample", "pid", F.col("ticks").alias("ticks_a"))
    procs = snap_b.join(a, ["host_id", "sample", "pid"]).filter("ticks >= ticks_a")
    procs = spread_join(procs, system, ["host_id", "sample"], ["pid"], counted=snap_b)
    base = F.when(F.col("d_total") > 0, F.col("d_total")).otherwise(1)
    procs = procs.withColumn("cpu_percent", round1((F.col("ticks") - F.col("ticks_a")) / base * 100))
    measure = F.col("cpu_percent") if by == "cpu" else F.col("rss_bytes")
    w = Window.partitionBy("host_id", "sample").orderBy(measure.desc(), "pid")
    return (
        procs.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .select("host_id", "sample", "rank", "pid", "name", "cpu_percent", "rss_bytes")
    )


def parse_net_dev(lines: DataFrame) -> DataFrame:
    """``/proc/net/dev`` lines (``host_id, line_no, line``) into counters."""
    line = F.trim("line")
    colon = F.instr(line, ":")
    values = words(F.substring(line, colon + 1, F.length(line)))
    return (
        lines.filter((F.col("line_no") > 2) & (colon > 0))
        .withColumn("f", values)
        .filter(F.size("f") >= 9)
        .select(
            "host_id",
            "line_no",
            F.trim(F.substring_index(line, ":", 1)).alias("name"),
            unsigned(field(F.col("f"), 0)).alias("rx_bytes"),
            unsigned(field(F.col("f"), 8)).alias("tx_bytes"),
        )
        .filter("rx_bytes IS NOT NULL AND tx_bytes IS NOT NULL")
    )


def parse_diskstats(lines: DataFrame) -> DataFrame:
    """``/proc/diskstats`` lines into counters of whole devices."""
    parsed = lines.withColumn("f", words(F.col("line"))).filter(F.size("f") >= 14)
    names = {"reads": 3, "read_ms": 6, "writes": 7, "write_ms": 10}
    out = parsed.select(
        "host_id", "line_no", field(F.col("f"), 2).alias("device"),
        *[unsigned(field(F.col("f"), n)).alias(c) for c, n in names.items()],
    )
    return out.filter(~is_partition(F.col("device"))).dropna(subset=list(names))


def parse_pid_stat(lines: DataFrame) -> DataFrame:
    """``/proc/<pid>/stat`` lines: name between the first ``(`` and the last ``)``, state, ticks."""
    line = F.col("line")
    name = F.regexp_extract(line, r"(?s)^[^(]*\((.*)\)", 1)
    rest = words(F.substring_index(line, ")", -1))
    return (
        lines.filter(line.rlike(r"(?s)^[^(]*\(.*\)"))
        .withColumn("f", rest)
        .filter(F.size("f") >= 13)
        .select(
            "host_id", "line_no", name.alias("name"), field(F.col("f"), 0).alias("state"),
            (unsigned(field(F.col("f"), 11)) + unsigned(field(F.col("f"), 12))).alias("cpu_ticks"),
        )
        .filter("cpu_ticks IS NOT NULL")
    )


def parse_vmrss(lines: DataFrame) -> DataFrame:
    """``VmRSS:`` lines into bytes."""
    f = words(F.col("line"))
    return (
        lines.filter(F.col("line").startswith("VmRSS:"))
        .select("host_id", "line_no", (unsigned(field(f, 1)) * 1024).alias("rss_bytes"))
        .filter("rss_bytes IS NOT NULL")
    )


def parse_mountinfo(lines: DataFrame) -> DataFrame:
    """``mountinfo`` lines into mountpoint, source and filesystem type."""
    line = F.col("line")
    sep = F.instr(line, " - ")
    pre = words(F.substring(line, F.lit(1), sep - 1))
    post = words(F.substring(line, sep + 3, F.length(line)))
    return (
        lines.filter(sep > 0)
        .withColumns({"pre": pre, "post": post})
        .filter((F.size("pre") >= 5) & (F.size("post") >= 2))
        .select(
            "host_id", "line_no",
            clean_path(F.replace(field(F.col("pre"), 4), F.lit("\\040"), F.lit(" "))).alias("mountpoint"),
            field(F.col("post"), 1).alias("source"),
            field(F.col("post"), 0).alias("fs_type"),
        )
    )


def os_info(lines: DataFrame, rule: str = "first_complete") -> DataFrame:
    """Distribution and version of each host from ``os-release`` lines.

    ``first_complete`` stops reading once both are known, ``last`` lets the
    last duplicate win, ``strict`` refuses hosts with duplicates.
    """
    line = F.trim("line")
    cut = F.instr(line, "=")
    key = F.trim(F.substring(line, F.lit(1), cut - 1))
    quotes = '"' if rule == "first_complete" else "\"'"
    value = unquote(F.trim(F.substring(line, cut + 1, F.length(line))), quotes)
    pairs = (
        lines.filter((cut > 0) & ~line.startswith("#"))
        .select("host_id", "line_no", key.alias("key"), value.alias("value"))
        .filter(F.col("key").isin("ID", "VERSION_ID"))
    )

    def of(name: str, what: Column) -> Column:
        return F.when(F.col("key") == name, what)

    if rule == "first_complete":
        flags = {n: of(key, (F.col("value") != "").cast("int")) for n, key in (("id", "ID"), ("version", "VERSION_ID"))}
        flags = {n: F.coalesce(flag, F.lit(0)) for n, flag in flags.items()}
        work = pairs.withColumns({**flags, "segment": number_segment("line_no", 1_024)})
        counted = ordered_scan(
            work, ["host_id"], ["line_no"], "segment", running_sum={"ids_read": "id", "versions_read": "version"}
        )
        # a line counts when the lines before it did not know both yet
        pairs = counted.filter("ids_read - id = 0 OR versions_read - version = 0")
    out = pairs.groupBy("host_id").agg(
        F.coalesce(F.max_by("value", of("ID", F.col("line_no"))), F.lit("")).alias("distro"),
        F.coalesce(F.max_by("value", of("VERSION_ID", F.col("line_no"))), F.lit("")).alias("version"),
        F.count(of("ID", F.lit(1))).alias("ids"),
        F.count(of("VERSION_ID", F.lit(1))).alias("versions"),
    )
    if rule == "strict":
        out = out.filter("ids = 1 AND versions = 1 AND distro <> '' AND version <> ''")
    return out.drop("ids", "versions")


def capability_matrix(heartbeats: DataFrame, tools: Sequence[str] = ("ansible", "docker", "podman")) -> DataFrame:
    """One boolean column per tool from the ``capabilities`` map of each heartbeat."""
    return heartbeats.groupBy("host_id").agg(
        *[F.coalesce(F.bool_or(F.try_element_at("capabilities", F.lit(t))), F.lit(False)).alias(t) for t in tools]
    )


def telemetry_rollup(df: DataFrame, value: str, ts: str = "seen_at", grain: str = "1 hour") -> DataFrame:
    """Average, maximum and 95th percentile (nearest rank) of a column per host and window, all of the values as they are.

    The average is summed in decimals of ten places, so it does not depend on
    the order.  Rows are read and shuffled once, counted by value.  The counts
    are added up by tenths, which tells the tenth that holds the percentile and
    how many values lie below it; only the values of that tenth are ranked.
    """
    keys = ["host_id", "window_start"]
    counted = df.select(
        "host_id", F.window(ts, grain)["start"].alias("window_start"), F.col(value).alias("raw"), F.col(value).try_cast("decimal(28,10)").alias("exact"),
    ).groupBy(*keys, "raw").agg(F.count("raw").alias("n"), F.sum("exact").alias("total"), F.count("exact").alias("summed"))
    counted = counted.withColumn("tenth", F.floor(F.col("raw") * 10))
    tenths = counted.groupBy(*keys, "tenth").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("summed").alias("summed"), F.max("raw").alias("top"))
    group = Window.partitionBy(*keys)
    tenths = tenths.withColumns({
        "below": F.sum("n").over(group.orderBy("tenth").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"),
        "rank": F.expr("(95 * sum(n) over (partition by host_id, window_start) + 99) div 100"),
    })
    holds = (F.col("n") > 0) & (F.col("below") < F.col("rank")) & (F.col("rank") <= F.col("below") + F.col("n"))
    summary = tenths.groupBy(*keys).agg(
        F.sum("n").alias("samples"), F.try_divide(F.sum("total").cast("double"), F.sum("summed")).alias("avg_value"),
        F.max("top").alias("max_value"), F.max(F.when(holds, F.struct("tenth", "below", "rank"))).alias("at"))
    inside = counted.filter("n > 0").join(summary.select(*keys, "at.tenth", "at.below", "at.rank"), [*keys, "tenth"])
    upto = F.col("below") + F.sum("n").over(group.orderBy("raw").rowsBetween(Window.unboundedPreceding, 0))
    tail = inside.withColumn("upto", upto).groupBy(*keys).agg(F.min(F.when(F.col("upto") >= F.col("rank"), F.col("raw"))).alias("p95_value"))
    return summary.drop("at").join(tail, keys, "left")


def region_rollup(df: DataFrame, value: str) -> DataFrame:
    """Totals per region and host, per region, and overall."""
    return df.rollup("region", "host_id").agg(
        F.count("*").alias("samples"), F.sum(value).alias("total"), F.grouping_id().cast("int").alias("level")
    )
