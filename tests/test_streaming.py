"""Streaming forms against their batch forms, on the events table in several files."""

import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from fleetlens.adapters import CHECK_RESULTS, EVENTS
from fleetlens.operators import changes, checks, intake
from fleetlens.plans import changes as change_plans
from fleetlens.plans import intake as intake_plans
from fleetlens.streaming import sinks, stateful
from fleetlens.streaming.tables import LatestTable

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def work():
    # a new folder per run; it is left behind
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def as_stream(spark, df, work, name, order):
    """The rows of a frame as a stream of four micro-batches in time order."""
    path = f"{work}/{name}"
    bounds = df.approxQuantile(order, [0.25, 0.5, 0.75], 0.0)
    edges = [None, *bounds, None]
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        part = df
        part = part.filter(F.col(order) > lo) if lo is not None else part
        part = part.filter(F.col(order) <= hi) if hi is not None else part
        part.coalesce(1).write.mode("append").parquet(f"{path}/p={i}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{path}/p=*")


def run(stream, work, name, mode="append"):
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", f"{work}/cp-{name}").trigger(availableNow=True).start()
    )
    assert query.awaitTermination(240)
    return stream.sparkSession.table(name)


def test_suppress_within_ttl(spark, work):
    attempts = intake_plans.ATTEMPTS.frame(spark, SF)
    got = run(stateful.suppress_within_ttl(as_stream(spark, attempts, work, "attempts", "attempt_id")), work, "ttl")
    want = intake.suppress_within_ttl(attempts).filter("accepted")
    ids = {r.tie for r in got.filter("accepted").collect()}
    assert ids == {r.attempt_id for r in want.collect()}
    assert got.count() == attempts.count()


def test_reject_replays(spark, work):
    tasks = change_plans.TASKS.frame(spark, SF)
    got = run(stateful.reject_replays(as_stream(spark, tasks, work, "tasks", "task_id")), work, "replays")
    want = changes.reject_replays(tasks).filter("verdict = 'accepted'")
    assert {r.tie for r in got.filter("accepted").collect()} == {r.task_id for r in want.collect()}


def test_open_incidents(spark, work):
    results = CHECK_RESULTS.frame(spark, SF)
    got = run(stateful.open_incidents(as_stream(spark, results, work, "results", "event_id")), work, "incidents", "update")
    closed = {(r.monitor_id, r.opened_us, r.closed_us, r.failed_checks) for r in got.filter("closed_us IS NOT NULL").collect()}
    batch = checks.open_incidents(results).filter("closed_at IS NOT NULL").select(
        "monitor_id", F.unix_micros("opened_at").alias("o"), F.unix_micros("closed_at").alias("c"), "failed_checks"
    )
    assert closed == {tuple(r) for r in batch.collect()}


def test_catchup_status(spark, work):
    samples = change_plans.SLOTS.frame(spark, SF).withColumnRenamed("seen_at", "at")
    got = run(stateful.catchup_status(as_stream(spark, samples, work, "slots", "poll_id")), work, "slots")
    batch = changes.catchup_status(samples).filter("status <> 'running'").select("slot_id", "status", F.unix_micros("decided_at"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in batch.collect()}


def test_stale_hosts(spark, work):
    beats = EVENTS.frame(spark, SF).selectExpr("event_id % 200 AS host_id", "seen_at", "k * 60 AS interval_seconds", "event_id")
    got = run(stateful.stale_hosts(as_stream(spark, beats, work, "beats", "event_id")), work, "hosts").collect()
    last = {}
    for r in beats.groupBy("host_id").agg(F.unix_micros(F.max("seen_at")).alias("at"), F.max_by("interval_seconds", "seen_at").alias("s")).collect():
        last[r.host_id] = (r.at, r.s or 30)
    end = max(at for at, _ in last.values())
    # hosts whose last heartbeat is far behind the watermark must have been reported
    surely = {h for h, (at, s) in last.items() if end - at > (3 * s + 7_200) * 1_000_000}
    final = {}
    for r in sorted(got, key=lambda r: (r.host_id, r.last_us, r.state != "online")):
        final[r.host_id] = r.state
    assert surely and all(final[h] == "offline" for h in surely)
    assert all(r.state in ("offline", "online") for r in got)


def test_telemetry_windows(spark, work):
    events = EVENTS.frame(spark, SF).selectExpr("user_id AS host_id", "seen_at", "cents", "event_id")
    got = run(sinks.telemetry_windows(as_stream(spark, events, work, "telemetry", "event_id"), "cents"), work, "windows")
    want = events.groupBy("host_id", F.window("seen_at", "1 hour")["start"].alias("s")).agg(
        F.count("cents").alias("n"), F.sum("cents").alias("t"), F.max("cents").alias("m")
    )
    a, b = {tuple(r) for r in got.collect()}, {tuple(r) for r in want.collect()}
    # the windows that the watermark has not passed yet stay open
    assert a <= b and len(b - a) < 20


def test_fence_polls(spark, work):
    fences, states = change_plans.FENCES.frame(spark, SF), change_plans.POLLED.frame(spark, SF)
    stream = as_stream(spark, states.withColumn("n", F.unix_seconds("at")), work, "states", "n").drop("n")
    got = run(sinks.fence_polls(stream, fences), work, "polls")
    want = changes.fence_violations(fences, states)
    counts = {r.fence_id: r.n for r in got.groupBy("fence_id").agg(F.count("*").alias("n")).collect()}
    batch = {r.fence_id: r.violations for r in want.filter("violations > 0").collect()}
    assert set(counts) <= set(batch)
    assert sum(batch.values()) - sum(counts.values()) <= 3
    assert all(counts[f] <= batch[f] for f in counts)


def progress(stream, work, name):
    """The last progress of a stream run to its end, and its result."""
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", f"{work}/cp-{name}").trigger(availableNow=True).start()
    )
    assert query.awaitTermination(240)
    return query.lastProgress, stream.sparkSession.table(name)


def test_state_of_silent_hosts_and_slots_goes(spark, work):
    # forty keys in the first hour, one of them again days later, twice, so that the watermark gets there
    rows = [(h, f"2026-01-01 00:{m:02d}:00", 30, h * 100 + m) for h in range(40) for m in range(0, 60, 20)]
    rows += [(0, f"2026-03-0{d} 00:00:00", 30, 10_000 + d) for d in (1, 2, 3)]
    beats = spark.createDataFrame(rows, "host_id long, t string, interval_seconds long, event_id long").withColumn("seen_at", F.to_timestamp("t"))
    last, got = progress(stateful.stale_hosts(as_stream(spark, beats, work, "silent", "event_id")), work, "silent")
    offline = {r.host_id for r in got.where("state = 'offline'").collect()}
    assert offline >= set(range(1, 40))
    assert last["stateOperators"][0]["numRowsTotal"] <= 2  # host 0 and its timer

    slots = beats.selectExpr(
        "host_id AS slot_id", "seen_at AS at", "event_id AS poll_id", "'0/1' AS remote_lsn", "CAST(NULL AS STRING) AS latest_end_lsn", "'0/2' AS source_lsn",
        "1L AS wal_bytes", "2L AS max_wal_bytes", "true AS active", "false AS ready", "host_id <> 5 AS present", "timestamp'2027-01-01 00:00:00' AS deadline")
    last, got = progress(stateful.catchup_status(as_stream(spark, slots, work, "silentslots", "poll_id")), work, "silentslots")
    assert [(r.slot_id, r.status) for r in got.collect()] == [(5, "slot vanished")]
    assert last["stateOperators"][0]["numRowsTotal"] <= 2


POSTED = ["user_id * 10 + k % 10 AS run_id", "event_id", "seen_at AS finished_at", "event_type AS status"]


def test_land_once(spark, work):
    posted = EVENTS.frame(spark, SF).selectExpr(*POSTED)
    half = posted.where("event_id % 2 = 0")
    stream = as_stream(spark, half, work, "posted", "event_id")
    assert sinks.land_once_stream(stream, f"{work}/landed", f"{work}/cp-landed").awaitTermination(240)
    ids = half.select("run_id").distinct().count()
    landed = spark.read.parquet(f"{work}/landed")
    assert landed.count() == landed.select("run_id").distinct().count() == ids

    # started again with nothing new, and with the rest: its own ids are in the state, no landed file is read
    posted.where("event_id % 2 = 1").coalesce(1).write.mode("append").parquet(f"{work}/posted/p=3")
    query = sinks.land_once_stream(stream, f"{work}/landed", f"{work}/cp-landed")
    assert query.awaitTermination(240)
    landed = spark.read.parquet(f"{work}/landed")
    assert landed.count() == landed.select("run_id").distinct().count() == posted.select("run_id").distinct().count()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == landed.count()

    # another stream, whose state knows nothing, lands nothing twice
    again = as_stream(spark, posted, work, "posted-again", "event_id")
    assert sinks.land_once_stream(again, f"{work}/landed", f"{work}/cp-again").awaitTermination(240)
    assert spark.read.parquet(f"{work}/landed").count() == landed.count()


def test_latest_state(spark, work):
    posted = EVENTS.frame(spark, SF).selectExpr(*POSTED)
    stream = as_stream(spark, posted, work, "states-posted", "event_id")
    args = (f"{work}/latest", f"{work}/cp-latest", ["run_id"], ["finished_at", "event_id"])
    assert sinks.latest_state_stream(stream, *args, buckets=16).awaitTermination(240)
    table = LatestTable(args[0], ("run_id",), ("finished_at", "event_id"), 16)
    want = intake.latest_state(posted, ["run_id"], ["finished_at", "event_id"])
    both = {(r.run_id, r.event_id, r.status) for r in want.collect()}
    assert {(r.run_id, r.event_id, r.status) for r in table.read(spark, posted.schema).collect()} == both
    some = want.limit(5).select("run_id")
    assert table.lookup(some, posted.schema).count() == 5


def files_of(path):
    return {os.path.relpath(f, path): os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/bucket=*/version=*/*.parquet")}


def test_merge_leaves_other_buckets_alone(spark, work):
    table = LatestTable(f"{work}/merged", ("k",), ("at", "id"), 64)
    row = "k long, at long, id long, text string"
    frame = lambda rows: spark.createDataFrame(rows, row)
    first = [(k, 1, k, "first") for k in range(500)] + [(None, 1, -1, "no key")]
    assert len(table.merge(frame(first), 0)) == 64
    before = files_of(table.path)
    touched = table.merge(frame([(3, 2, 1, "new"), (3, 0, 9, "old"), (None, 2, 0, "newer"), (1000, 1, 1, "more")]), 1)
    assert 1 <= len(touched) <= 3
    after = files_of(table.path)
    same = {f for f in before if int(f.split("/")[0].split("=")[1]) not in touched}
    assert same and all(after[f] == before[f] for f in same)
    assert all(f.split("/")[1] == "version=1" for f in set(after) - set(before))
    got = {r.k: r.text for r in table.read(spark, row).collect()}
    assert len(got) == 502 and got[3] == "new" and got[None] == "newer" and got[1000] == "more" and got[4] == "first"
    # a repeated micro-batch changes nothing, an empty one neither, and old versions of a bucket go
    assert table.merge(frame([(3, 2, 1, "new"), (3, 0, 9, "old"), (None, 2, 0, "newer"), (1000, 1, 1, "more")]), 1) == touched
    assert {r.k: r.text for r in table.read(spark, row).collect()} == got
    assert table.merge(frame([]), 2) == set()
    for version in (3, 4, 5):
        table.merge(frame([(3, version, 1, f"v{version}")]), version)
    bucket = next(b for b, v in table.manifest(spark).items() if v == 5)
    assert {f.split("/")[1] for f in files_of(table.path) if f.startswith(f"bucket={bucket}/")} == {"version=4", "version=5"}
    with pytest.raises(ValueError):
        LatestTable(table.path, ("k",), ("at", "id"), 32).read(spark, row)


def test_checkpoint_dir(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    base = named.rstrip("/") if named else "/shared/cp"
    assert sinks.checkpoint_dir(spark, "a", "/shared/cp/") == f"{base}/a"
