"""Change logs, replication progress, fences and signed tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.greedy import greedy_accept
from fleetlens.functions.spread import spread_join
from fleetlens.functions.ordered import number_segment, ordered_scan, time_segment
from fleetlens.operators.intake import latest_state

INACTIVE_SECONDS = 10
MAX_ENVELOPE_SECONDS = 600
MAX_AHEAD_SECONDS = 30


def log_position(json: Column) -> Column:
    """Struct ``seconds, increment`` of a log position, null when it is invalid.

    Each part is a number or an object with ``$numberInt`` / ``$numberLong`` text.
    """
    v = F.try_parse_json(json)

    def part(name: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
        wrapped = F.coalesce(
            F.nullif(F.try_variant_get(v, f"$.{name}['$numberLong']", "string"), F.lit("")),
            F.nullif(F.try_variant_get(v, f"$.{name}['$numberInt']", "string"), F.lit("")),
        )
        text = F.when(wrapped.rlike(r"\A[+-]?[0-9]+\z"), wrapped.try_cast("long"))
        return F.when(kind == "BIGINT", F.try_variant_get(v, f"$.{name}", "long")).when(kind.startswith("OBJECT"), text)

    seconds, increment = part("seconds"), part("increment")
    return F.when(
        seconds.isNotNull() & increment.isNotNull(), F.struct(seconds.alias("seconds"), increment.alias("increment"))
    )


def compact_changes(log: DataFrame, bounds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Last state of every changed document, and operations that cannot be replayed.

    ``log``: ``db, collection, op, doc_id, document, position`` (a struct that
    orders field by field); ``bounds``: ``db, start, end`` positions, start
    excluded.  A null document means the document was deleted.
    """
    scoped = spread_join(log, bounds, ["db"], ["collection", "doc_id"]).filter((F.col("position") > F.col("start")) & (F.col("position") <= F.col("end")))
    supported = F.col("op").isin("i", "u", "d") & ~F.col("collection").isin("", "$cmd") & F.col("doc_id").isNotNull()
    unsupported = scoped.filter(~supported).groupBy("db", "collection", "op").agg(F.count("*").alias("operations"))
    document = F.when(F.col("op") != "d", F.col("document"))
    mutations = scoped.filter(supported).groupBy("db", "collection", "doc_id").agg(
        F.max_by(F.struct(document.alias("document")), "position").alias("last"), F.max("position").alias("position")
    )
    return mutations.select("db", "collection", "doc_id", "last.document", "position"), unsupported


def validate_delta(delta: DataFrame) -> DataFrame:
    """Errors of delta entries (``delta_id, collection, doc_id, document``, the last two JSON)."""
    v_id, v_doc = F.try_parse_json("doc_id"), F.try_parse_json("document")
    inner = F.to_json(F.try_variant_get(v_doc, "$._id", "variant"))
    no_document = F.col("document").isNull() | F.is_variant_null(v_doc)
    error = (
        F.when(~F.col("collection").rlike(r"^[A-Za-z_][A-Za-z0-9_.-]{0,254}$"), "collection")
        .when(v_id.isNull() | F.schema_of_variant(v_id).startswith("ARRAY"), "identity is invalid")
        .when(~no_document & (v_doc.isNull() | ~inner.eqNullSafe(F.to_json(v_id))), "identity changed")
    )
    parsed = delta.withColumns({"error": error, "id_json": F.coalesce(F.to_json(v_id), F.col("doc_id"))})
    own = parsed.filter("error IS NOT NULL").select("delta_id", "collection", "doc_id", "error")
    repeated = (
        parsed.groupBy("delta_id", "collection", "id_json").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
        .filter("n > 1").select("delta_id", "collection", "doc_id", F.lit("duplicate identity").alias("error"))
    )
    return own.unionByName(repeated)


def apply_delta(base: DataFrame, delta: DataFrame, keys: Sequence[str] = ("db", "collection", "doc_id")) -> DataFrame:
    """Base documents with the delta's replacements, insertions and deletions."""
    changed = delta.select(*keys, F.col("document").alias("new_document"), F.lit(True).alias("changed"))
    joined = base.select(*keys, "document").join(changed, list(keys), "full_outer")
    document = F.when(F.col("changed"), F.col("new_document")).otherwise(F.col("document"))
    return joined.select(*keys, document.alias("document")).filter("document IS NOT NULL")


def changed_after(log: DataFrame, bounds: DataFrame) -> DataFrame:
    """Whether a database changed after its window's end."""
    newest = log.groupBy("db").agg(F.max("position").alias("newest"))
    return bounds.join(newest, "db", "left").select(
        "db", F.coalesce(F.col("newest") > F.col("end"), F.lit(False)).alias("unstable")
    )


def lsn(text: Column) -> Column:
    """Log sequence number ``A/B`` (hex) as a decimal; null and malformed text give null."""
    high = F.conv(F.substring_index(text, "/", 1), 16, 10).cast("decimal(20,0)")
    low = F.conv(F.substring_index(text, "/", -1), 16, 10).cast("decimal(20,0)")
    number = high * F.lit(4_294_967_296).cast("decimal(10,0)") + low
    return F.when(text.rlike("^[0-9A-F]+/[0-9A-F]+$"), number.cast("decimal(38,0)"))


def catchup_status(samples: DataFrame, segment_seconds: int = 3_600) -> DataFrame:
    """First decision in the polls of every replication slot.

    Input: ``slot_id, at, poll_id, remote_lsn, latest_end_lsn, source_lsn,
    wal_bytes, present, active, ready, max_wal_bytes, deadline``.  A slot fails
    at once when a poll finds it gone (``present`` false; null: not known, so
    there), when it stays inactive for over 10 s, keeps too much log or misses
    the deadline, and is done when all source changes are applied.
    """
    zero = F.lit(0).cast("decimal(38,0)")
    applied = F.greatest(F.coalesce(lsn(F.col("remote_lsn")), zero), F.coalesce(lsn(F.col("latest_end_lsn")), zero)) >= lsn(F.col("source_lsn"))
    work = samples.withColumns({"segment": time_segment("at", segment_seconds), "applied": F.coalesce(applied, F.lit(False))})
    order = ["at", "poll_id"]
    prev = ordered_scan(work, ["slot_id"], order, "segment", lag={"was_active": "active"})
    marked = prev.withColumn("spell_start", F.when(~F.col("active") & F.coalesce("was_active", F.lit(True)), F.col("at")))
    spells = ordered_scan(marked, ["slot_id"], order, "segment", last_value={"inactive_since": "spell_start"})
    silent = F.unix_micros("at") - F.unix_micros("inactive_since")
    decision = (
        F.when(~F.col("present"), "slot vanished")
        .when(~F.col("active") & (silent > INACTIVE_SECONDS * 1_000_000), "slot inactive")
        .when(F.col("wal_bytes") > F.col("max_wal_bytes"), "log over its ceiling")
        .when(F.col("ready") & F.col("applied"), "caught up")
        .when(F.col("at") > F.col("deadline"), "deadline")
    )
    decided = F.when(decision.isNotNull(), F.struct(*order))
    return spells.withColumn("decision", decision).groupBy("slot_id").agg(
        F.coalesce(F.min_by("decision", decided), F.lit("running")).alias("status"),
        F.min(F.when(decision.isNotNull(), F.col("at"))).alias("decided_at"),
        F.count("*").alias("polls"),
    )


def quiescent(snapshots: DataFrame, fences: DataFrame) -> DataFrame:
    """Whether a source stood still between two snapshots.

    ``snapshots``: ``run_id, phase`` (``before`` / ``after``)``, db_digest,
    file_digest``; ``fences``: ``run_id, expected_db, expected_files, active,
    violations, watchdog_errors`` (expectations may be null).
    """
    def of(phase: str, *cols: str) -> list[Column]:
        return [F.max(F.when(F.col("phase") == phase, F.col(c))).alias(f"{phase}_{c}") for c in cols]

    both = snapshots.groupBy("run_id").agg(*of("before", "db_digest", "file_digest"), *of("after", "db_digest", "file_digest"))
    joined = both.join(fences, "run_id", "left")
    fence_ok = F.col("active") & (F.col("violations") == 0) & (F.col("watchdog_errors") == 0)
    same = F.col("before_db_digest").eqNullSafe(F.col("after_db_digest")) & F.col("before_file_digest").eqNullSafe(F.col("after_file_digest"))
    complete = F.col("before_db_digest").isNotNull() & F.col("after_db_digest").isNotNull()
    reason = (
        F.when(~F.coalesce(fence_ok, F.lit(False)), "fence was violated")
        .when(~(same & complete), "source changed during the interval")
        .when(F.col("expected_db").isNotNull() & (F.col("expected_db") != F.col("after_db_digest")), "database changed after the dump")
        .when(F.col("expected_files").isNotNull() & (F.col("expected_files") != F.col("after_file_digest")), "files changed after the manifest")
    )
    return joined.select("run_id", reason.alias("reason"), reason.isNull().alias("quiescent"))


def polls_in_fences(fences: DataFrame, polls: DataFrame, bucket_seconds: int) -> DataFrame:
    """Polls of a fenced service from ``active_from`` on, before ``active_to`` if the fence has one.

    The interval join is an equality join on (host, service, time bucket), so
    a long fence is spread over buckets and only matching polls meet it.  A
    fence that is still active has no last bucket and meets the polls of its
    service.
    """
    width = bucket_seconds
    first, last = F.floor(F.unix_seconds("active_from") / width), F.floor(F.unix_seconds("active_to") / width)
    ended = fences.filter("active_to > active_from").withColumn("bucket", F.explode(F.sequence(first, last)))
    dated = polls.withColumn("bucket", F.floor(F.unix_seconds("at") / width))
    inside = dated.join(ended, ["host_id", "service", "bucket"]).filter("at >= active_from AND at < active_to").select("fence_id", "at", "running")
    after = polls.join(fences.filter("active_to IS NULL"), ["host_id", "service"]).filter("at >= active_from")
    return inside.unionByName(after.select("fence_id", "at", "running"))


def fence_violations(fences: DataFrame, states: DataFrame, bucket_seconds: int = 3_600) -> DataFrame:
    """Violations and watchdog errors of each fence.

    ``fences``: ``fence_id, host_id, service, active_from, active_to``, one row
    per fenced service; ``states``: ``host_id, service, at, running`` (null:
    unreadable).  A poll counts once per fence, however many services ran.  A
    fence without ``active_to`` is still active.
    """
    hits = polls_in_fences(fences, states.filter("running OR running IS NULL"), bucket_seconds)
    per_poll = hits.groupBy("fence_id", "at").agg(F.bool_or(F.col("running").isNull()).alias("unreadable"))
    counted = per_poll.groupBy("fence_id").agg(
        F.count("*").alias("violations"), F.count_if("unreadable").alias("watchdog_errors"), F.max("at").alias("last_violation")
    )
    return fences.select("fence_id").distinct().join(counted, "fence_id", "left").select(
        "fence_id", F.coalesce("violations", F.lit(0)).alias("violations"),
        F.coalesce("watchdog_errors", F.lit(0)).alias("watchdog_errors"), "last_violation",
    )


def reject_stale_tokens(tasks: DataFrame, segment_seconds: int = 3_600) -> DataFrame:
    """Mark tasks whose fencing token is below the highest one seen before.

    Input: ``migration_id, domain, at, task_id, token``.
    """
    work = tasks.withColumn("segment", time_segment("at", segment_seconds))
    seen = ordered_scan(
        work, ["migration_id", "domain"], ["at", "task_id"], "segment", running_max_before={"highest": "token"}
    )
    return seen.withColumn("stale", F.coalesce(F.col("token") < F.col("highest"), F.lit(False))).drop("segment", "highest")


def valid_in_time() -> Column:
    """Whether a task is received before it expires, lives no longer than allowed from its issue, and is not issued in the future.

    Clocks may differ by ``MAX_AHEAD_SECONDS``.  A missing time is not valid.
    """
    second = 1_000_000
    received, issued, expires = F.col("received_us"), F.col("issued_us"), F.col("expires_us")
    valid = (expires > received) & (issued <= received + MAX_AHEAD_SECONDS * second) & (expires - issued <= MAX_ENVELOPE_SECONDS * second)
    return F.coalesce(valid, F.lit(False))


def reject_replays(tasks: DataFrame, segment_seconds: int = 21_600) -> DataFrame:
    """Mark tasks whose nonce is still in use, or whose times are not valid (:func:`valid_in_time`).

    Input: ``nonce, task_id, issued_us, received_us, expires_us``.  A refused
    task does not renew its nonce.
    """
    second = 1_000_000
    in_time = valid_in_time()
    work = tasks.filter(in_time).withColumns(
        {
            "segment": number_segment("received_us", segment_seconds * second),
            "hour": number_segment("received_us", 3_600 * second),
        }
    )
    judged = greedy_accept(work, ["nonce"], "received_us", "expires_us", "task_id", "segment", "hour")
    verdict = F.when(F.col("accepted"), "accepted").otherwise("replay")
    late = tasks.filter(~in_time).withColumn("verdict", F.lit("expiry"))
    return judged.withColumn("verdict", verdict).drop("segment", "hour", "accepted").unionByName(late)


def progress_latest(progress: DataFrame) -> DataFrame:
    """Newest progress of each attempt (``attempt_id, sequence, phase, completed, total``)."""
    return latest_state(progress, ["attempt_id"], ["sequence"])


def active_attestations(fence_states: DataFrame) -> DataFrame:
    """Newest state of every fence that is active, by migration and run.

    Input: ``migration_id, run_id, at, state_id, active, ...``.
    """
    newest = latest_state(fence_states, ["migration_id"], ["at", "state_id"])
    return newest.filter("active").orderBy("migration_id", "run_id")
