"""Package inventories and their provenance for all hosts of a fleet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from fleetlens.functions import rules
from fleetlens.functions.columns import computed, field, trimmed
from fleetlens.functions.pages import Limits, cut_pages
from fleetlens.functions.spread import dealt

# Inventory limits and identity patterns.
MAX_PACKAGES = 10_000
MAX_PAGE_PACKAGES = 250
MAX_PAGES = 40
MAX_PAGE_BYTES = 262_144
MAX_CAPTURE_BYTES = 1_900_000
MAX_CAPTURE_MS = 120_000
MAX_RECEIPTS = 32
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"
PACKAGE_NAME = r"^[a-z0-9][a-z0-9+.-]{1,127}\z"
ARCHITECTURE = r"^[a-z0-9][a-z0-9-]{0,31}\z"
VERSION = r"^([0-9]+:)?[0-9]([A-Za-z0-9.+~-]*[A-Za-z0-9.+~])?\z"
SHA256_HEX = r"^[a-f0-9]{64}\z"
APPROVED_PACKAGES = r"^(nginx|libnginx-mod-|apache2|php8\.|libapache2-mod-php8\.)"
MAX_EPOCH = 2_147_483_647


def valid_version(version: Column) -> Column:
    """``[epoch:]upstream[-revision]`` of at most 512 characters."""
    epoch = F.regexp_extract(version, "^([0-9]+):", 1)
    fits = (epoch == "") | F.coalesce(epoch.try_cast("decimal(38,0)") <= MAX_EPOCH, F.lit(False))
    return version.rlike(VERSION) & F.length(version).between(1, 512) & fits


def package_state(code: Column) -> Column:
    """Installation state of a three-letter state code, null when it is invalid."""
    states = F.create_map(*[F.lit(x) for pair in rules.PACKAGE_STATES.items() for x in pair])
    return F.when(code.rlike(r"^[uihrp]. \z"), F.try_element_at(states, F.substring(code, 2, 1)))


def parse_packages(lines: DataFrame, max_packages: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Packages of good captures, and the rejected captures with a reason.

    Input: ``capture_id, line_no, line`` with six tab-separated fields.  One
    bad or repeated row rejects its whole capture, and so does more than
    ``max_packages`` rows where the caller sets such a limit.
    """
    f = F.split("line", "\t", -1)
    raw_name = field(f, 0)
    has_arch = raw_name.contains(":")
    name = F.when(has_arch, F.regexp_replace(raw_name, ":[^:]*$", "")).otherwise(raw_name)
    arch, version, source, source_version = (field(f, n) for n in (1, 2, 3, 4))
    state = package_state(field(f, 5))
    no_source = (source == "") & (source_version == "")
    problem = (
        F.when(F.size(f) != 6, "columns")
        .when(has_arch & (F.substring_index(raw_name, ":", -1) != arch), "architecture mismatch")
        .when(~name.rlike(PACKAGE_NAME) | ~arch.rlike(ARCHITECTURE) | ~valid_version(version), "identity")
        .when(state.isNull(), "state")
        .when(~no_source & ~(source.rlike(PACKAGE_NAME) & valid_version(source_version)), "source identity")
    )
    rows = lines.select(
        "capture_id", "line_no", name.alias("name"), arch.alias("architecture"), version.alias("version"),
        F.when(~no_source, source).alias("source_name"), F.when(~no_source, source_version).alias("source_version"),
        state.alias("installation_state"), problem.alias("problem"),
    )
    whole = rows.groupBy("capture_id").agg(
        F.count("*").alias("n"), F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("line_no"))).alias("problem")
    )
    repeated = (
        rows.filter("problem IS NULL").groupBy("capture_id", "name", "architecture").agg(F.count("*").alias("n")).filter("n > 1")
        .select("capture_id").distinct().withColumn("repeated", F.lit(True))
    )
    excess = F.lit(None).cast("string") if max_packages is None else F.when(F.col("n") > max_packages, "too many packages")
    reason = F.coalesce("problem", F.when(F.col("repeated"), "duplicate package"), excess)
    rejected = whole.join(repeated, "capture_id", "left").select("capture_id", reason.alias("reason")).filter("reason IS NOT NULL")
    good = rows.drop("problem").join(rejected.select("capture_id"), "capture_id", "left_anti")
    return good, rejected


def source_identity(value: Column, name: Column, version: Column) -> Column:
    """Struct ``name, version, error`` of a ``Source`` field: empty, ``name`` or ``name (version)``."""
    given = F.coalesce(value, F.lit(""))
    empty = given == ""

    def identity(parts: Column) -> Column:
        source = field(parts, 0)
        source_version = F.when(F.size(parts) == 2, F.regexp_extract(field(parts, 1), r"^\((.*)\)$", 1)).otherwise(version)
        ok = F.size(parts).between(1, 2) & source.rlike(PACKAGE_NAME) & valid_version(source_version)
        ok = F.coalesce(ok, F.lit(False))
        return F.struct(
            F.when(empty, name).when(ok, source).alias("name"),
            F.when(empty, version).when(ok, source_version).alias("version"),
            F.when(~empty & ~ok, "invalid_source_identity").alias("error"),
        )

    # the parts are found once, as the element of an array
    return field(F.transform(F.array(F.filter(F.split(given, r"\s+"), lambda w: w != "")), identity), 0)


def capture_status(captures: DataFrame) -> DataFrame:
    """Status and errors of each capture.

    Input: ``capture_id, platform`` (``ok``, ``unavailable``, ``invalid`` or
    ``unsupported``)``, state_before, state_after`` (null: unreadable)``,
    exit_code`` (null: no query)``, query_error, truncated, parse_error,
    timed_out``.
    """
    early = (
        F.when(F.col("platform") == "unavailable", "platform_unavailable")
        .when(F.col("platform") == "invalid", "invalid_platform")
        .when(F.col("platform") == "unsupported", "unsupported_platform")
        .when(F.col("state_before").isNull(), "package_state_unavailable")
        .when(F.col("exit_code").isNull(), "query_unavailable")
    )
    failed = F.col("exit_code") != 0
    stable = F.col("state_after").isNotNull() & (F.col("state_before") == F.col("state_after"))
    # fixed values: the error codes below
    errors = F.array_compact(
        F.array(
            F.when(failed | F.col("query_error"), "query_failed"),
            F.when(F.col("truncated"), "query_output_truncated"),
            F.when(F.col("parse_error"), "malformed_package_rows"),
            F.when(~stable, "capture_state_changed"),
            F.when(F.col("timed_out"), "capture_timeout"),
        )
    )
    all_errors = F.when(early.isNotNull(), F.array(early)).otherwise(errors)
    status = (
        F.when(early.isNotNull(), "unsupported").when(failed, "failed").when(F.size(errors) == 0, "complete").otherwise("partial")
    )
    return captures.select(
        "capture_id", status.alias("status"), all_errors.alias("errors"),
        (early.isNull() & stable & ~F.col("timed_out")).alias("stable"),
    )


def paginate(
    packages: DataFrame, max_rows: int = MAX_PAGE_PACKAGES, max_bytes: int = MAX_PAGE_BYTES,
    max_pages: int = MAX_PAGES, max_packages: int | None = MAX_PACKAGES,
) -> tuple[DataFrame, DataFrame]:
    """Pages of each capture in name and architecture order, and the captures that a receiver would refuse.

    Input: ``capture_id, name, architecture, row_bytes, overhead`` (bytes of a
    page without packages).  A page takes the longest run of packages within
    both limits.  Every capture is paged, whatever its size; ``max_packages``
    (none: no limit), ``max_pages`` and a package that fits no page (it has one
    for itself) only give the capture a reason in the second result.
    """
    limits = Limits(max_rows, max_bytes)
    paged = cut_pages(packages, "capture_id", ["name", "architecture"], "row_bytes", "overhead", limits)
    too_large = F.col("row_bytes") + F.col("overhead") > max_bytes
    sizes = paged.groupBy("capture_id").agg(
        F.count("*").alias("n"), F.max("page").alias("last"), F.min(F.when(too_large, F.col("page"))).alias("large"))
    reason = (
        F.when(F.lit(max_packages is not None) & (F.col("n") > (max_packages or 0)), "package budget exceeded")
        .when(F.col("large") <= max_pages, "package exceeds page budget")
        .when(F.col("last") >= max_pages, "page budget exceeded")
    )
    return paged, sizes.select("capture_id", reason.alias("reason")).filter("reason IS NOT NULL")


def page_counts(captures: DataFrame, paged: DataFrame, refused: DataFrame) -> DataFrame:
    """Pages of every capture; an empty capture has one empty page.

    A refused capture (``capture_id, reason``, as of :func:`paginate`) has its reason and no numbers.
    """
    pages = paged.groupBy("capture_id").agg((F.max("page") + 1).alias("pages"), F.count("*").alias("packages"))
    accepted = F.col("reason").isNull()
    return captures.join(pages, "capture_id", "left").join(refused, "capture_id", "left").select(
        "capture_id", F.when(accepted, F.coalesce("pages", F.lit(1))).alias("pages"),
        F.when(accepted, F.coalesce("packages", F.lit(0))).alias("packages"), "reason",
    )


def reassemble_snapshot(pages: DataFrame, completions: DataFrame) -> DataFrame:
    """Whether the pages of each snapshot are those its completion names.

    ``pages``: ``snapshot_id, page_no, page_digest, packages`` (repeats are
    fine when they agree); ``completions``: ``snapshot_id, page_count,
    package_count, page_digests`` (in page order).
    """
    per_page = pages.groupBy("snapshot_id", "page_no").agg(
        F.min("page_digest").alias("page_digest"), F.max("page_digest").alias("other"), F.max("packages").alias("packages")
    )
    promised = completions.select("snapshot_id", F.posexplode("page_digests").alias("page_no", "promised"))
    matched = per_page.join(promised, ["snapshot_id", "page_no"], "left")
    seen = matched.groupBy("snapshot_id").agg(
        F.count("*").alias("pages"), F.sum("packages").alias("packages"),
        F.count_if(F.col("page_digest") != F.col("other")).alias("conflicts"),
        F.count_if(F.col("page_digest") == F.col("promised")).alias("matching"),
    )
    joined = completions.join(seen, "snapshot_id", "left")
    refusal = (
        F.when(F.col("conflicts") > 0, "conflicting page digest")
        .when(F.coalesce("pages", F.lit(0)) != F.col("page_count"), "page count")
        .when(F.size("page_digests") != F.col("page_count"), "page count")
        .when(F.col("packages") != F.col("package_count"), "package count")
        .when(F.col("matching") != F.col("page_count"), "page digest")
    )
    return joined.select("snapshot_id", refusal.alias("refusal"), refusal.isNull().alias("complete"))


def request_window_valid(requests: DataFrame, now) -> DataFrame:
    """First reason to refuse an inventory request, null when it is valid.

    Input: ``ids`` (array of identity strings)``, issued_at, expires_at`` and
    the limits ``max_packages, max_page_packages, max_pages, max_page_bytes,
    max_capture_bytes, max_capture_ms``.
    """
    at = F.unix_micros(F.lit(now))
    issued, expires = F.unix_micros("issued_at"), F.unix_micros("expires_at")
    second = 1_000_000
    clock = (
        (expires > at) & (issued <= at + 30 * second) & (expires > issued) & (expires - issued <= 30 * 60 * second)
    )
    ceilings = {
        "max_packages": (1, MAX_PACKAGES), "max_page_packages": (1, MAX_PAGE_PACKAGES), "max_pages": (1, MAX_PAGES),
        "max_page_bytes": (1024, MAX_PAGE_BYTES), "max_capture_bytes": (1024, MAX_CAPTURE_BYTES), "max_capture_ms": (1, MAX_CAPTURE_MS),
    }
    limits = reduce(lambda a, b: a & b, [F.col(c).between(lo, hi) for c, (lo, hi) in ceilings.items()])
    refusal = (
        F.when(F.exists("ids", lambda i: ~i.rlike(UUID)), "identity")
        .when(~F.coalesce(clock, F.lit(False)), "clock")
        .when(~limits, "limits")
    )
    return requests.withColumns({"refusal": refusal, "valid": refusal.isNull()})


def parse_stanzas(stanzas: DataFrame) -> DataFrame:
    """Index entries from ``Key: value`` blocks.

    Input: ``index_id, stanza_no, stanza`` (as read with a blank line as the
    separator).  Adds the fields and ``error``; blocks of other families, or
    without a usable size and digest, are dropped.  A field that comes twice
    is an error unless it was empty before.
    """
    out = computed(dealt(stanzas.select("index_id", "stanza_no", "stanza")), whole=F.split("stanza", "\n"))
    blank = F.array_position("whole", "")
    block = F.when(blank > 0, F.slice("whole", F.lit(1), blank.cast("int") - 1)).otherwise(F.col("whole"))  # a blank line ends it
    lines = F.filter(block, lambda s: ~s.startswith(" ") & ~s.startswith("\t"))
    fields = F.transform(lines, lambda s: F.struct(
        s.contains(":").alias("named"), F.substring_index(s, ":", 1).alias("key"), trimmed(F.substring(s, F.instr(s, ":") + 1, F.length(s))).alias("value")))
    out = computed(out.select("index_id", "stanza_no", fields.alias("fields")), all=F.col("fields"))
    out = computed(out.drop("fields"), keys=F.col("all.key"), last_first=F.reverse("all.key"))

    def value(key: str) -> Column:
        return F.coalesce(field(F.filter("all", lambda f: f.named & (f.key == key) & (f.value != "")), 0).value, F.lit(""))

    # a field may come again only while it is empty
    differ = F.size("keys") == F.size(F.array_distinct("keys"))
    repeated = F.exists(
        F.transform("all", lambda f, i: (f.value != "") & (F.array_position("last_first", f.key) != F.size("keys") - i)), lambda again: again)
    out = computed(
        out, metadata_ok=~F.exists("all", lambda f: ~f.named) & (differ | ~repeated), name=value("Package"), version=value("Version"),
        architecture=value("Architecture"), source=value("Source"), size_text=value("Size"), archive_sha=value("SHA256"),
    )
    identity = F.col("name").rlike(PACKAGE_NAME) & valid_version(F.col("version")) & F.col("architecture").rlike(ARCHITECTURE)
    out = computed(out, s=source_identity(F.col("source"), F.col("name"), F.col("version")))
    approved = F.col("name").rlike(APPROVED_PACKAGES)
    # fixed values: the error codes below
    error = (
        F.when(~F.col("metadata_ok"), "invalid_control_metadata")
        .when(~identity, "invalid_index_identity")
        .when(approved, F.col("s.error"))
    )
    size = F.when(F.col("size_text").rlike("^[0-9]+$"), F.col("size_text").try_cast("long"))
    usable = F.coalesce((F.col("size") >= 1) & F.col("archive_sha").rlike(SHA256_HEX), F.lit(False))
    return (
        computed(out, error=error, size=size)
        .filter(F.col("error").isNotNull() | (approved & usable))
        .select(
            "index_id", "stanza_no", "error", "name", "architecture", "version", F.col("s.name").alias("source_name"),
            F.col("s.version").alias("source_version"), "archive_sha", "size",
        )
    )


# Releases whose indexes are accepted.
RELEASES = {
    "ubuntu": ("Ubuntu", ("noble", "noble-updates", "noble-security"), ("noble", "noble-updates", "noble-security")),
    "debian": (
        "Debian", ("trixie", "trixie-updates", "trixie-security"),
        ("trixie", "stable", "oldstable", "trixie-updates", "stable-updates", "oldstable-updates", "trixie-security", "stable-security", "oldstable-security"),
    ),
}
INDEX_PATH = r"^(main|restricted|universe|multiverse|contrib|non-free|non-free-firmware)/binary-(amd64|all)/Packages\z"


def _release_date(text: Column) -> Column:
    """RFC 1123 date; the weekday is not needed."""
    plain = F.regexp_extract(text, r"^[A-Z][a-z]{2}, ([0-9]{2} [A-Z][a-z]{2} [0-9]{4} [0-9:]{8}) (?:UTC|GMT|[+-]0000)$", 1)
    return F.when(plain != "", F.try_to_timestamp(plain, F.lit("dd MMM yyyy HH:mm:ss")))


def parse_release(releases: DataFrame, now, index_path: str = INDEX_PATH) -> tuple[DataFrame, DataFrame]:
    """Headers with the first error, and the listed indexes of good releases.

    Input: ``release_id, os_id, text``.  A date in the future is refused; an
    expiry is only recorded.
    """
    # indented lines between the SHA256 header and the next header
    section = F.regexp_extract("text", r"(?:^|\n)SHA256:[^\n]*((?:\n[ \t][^\n]*)*)", 1)
    read = computed(
        dealt(releases.select("release_id", "os_id", "text")),
        heads=F.transform(
            F.filter(F.split("text", "\n"), lambda s: ~s.startswith(" ") & ~s.startswith("\t") & s.contains(":")),
            lambda s: F.struct(F.substring_index(s, ":", 1).alias("key"), F.trim(F.substring(s, F.instr(s, ":") + 1, F.length(s))).alias("value"))),
        sums=F.transform(F.filter(F.split(section, "\n"), lambda s: F.trim(s) != ""), lambda s: F.split(F.trim(s), r"\s+")),
    )

    def value(key: str) -> Column:
        return F.coalesce(field(F.filter("heads", lambda h: h.key == key), 0).value, F.lit(""))

    sums_ok = ~F.exists(
        "sums", lambda w: (F.size(w) != 3) | ~F.get(w, F.lit(0)).rlike(SHA256_HEX) | ~F.get(w, F.lit(1)).rlike("^[0-9]+$")
    )
    wanted = F.filter("sums", lambda w: F.get(w, F.lit(2)).rlike(index_path) & (F.get(w, F.lit(1)).try_cast("long") > 0))
    read = computed(
        read.drop("text"), keys=F.col("heads.key"), sums_ok=sums_ok, wanted=wanted, origin=value("Origin"), codename=value("Codename"),
        suite=value("Suite"), date_text=value("Date"), until_text=value("Valid-Until"))
    paths = F.transform("wanted", lambda w: F.get(w, F.lit(2)))
    parsed = computed(
        read.drop("heads", "sums"), keys_ok=F.size("keys") == F.size(F.array_distinct("keys")), paths_ok=F.size(paths) == F.size(F.array_distinct(paths)),
        date=_release_date(F.col("date_text")), valid_until=_release_date(F.col("until_text")))

    def by_os(pick) -> Column:
        return F.when(F.col("os_id") == "debian", pick("debian")).otherwise(pick("ubuntu"))

    origin_ok = by_os(lambda o: F.col("origin") == RELEASES[o][0]) & by_os(lambda o: F.col("codename").isin(*RELEASES[o][1]))
    code, suite = F.col("codename"), F.col("suite")
    pockets_agree = (code.endswith("-security") == suite.endswith("-security")) & (code.endswith("-updates") == suite.endswith("-updates"))
    suite_ok = by_os(lambda o: suite.isin(*RELEASES[o][2])) & ((F.col("os_id") != "debian") | pockets_agree)
    late = F.unix_micros("date") > F.unix_micros(F.lit(now)) + 30_000_000
    # fixed values: the error codes below
    error = (
        F.when(~F.col("sums_ok"), "invalid_release_checksum")
        .when(~F.col("paths_ok"), "duplicate_release_index")
        .when(~F.col("keys_ok"), "duplicate_release_field")
        .when(~origin_ok, "unapproved_release")
        .when(F.col("date").isNull() | late, "invalid_release_date")
        .when(~suite_ok, "unapproved_release_pocket")
        .when((F.col("until_text") != "") & (F.col("valid_until").isNull() | (F.col("valid_until") < F.col("date"))), "invalid_release_expiry")
    )
    judged = computed(parsed, error=error)
    headers = judged.select("release_id", "os_id", "codename", "date", "valid_until", "error")
    indexes = judged.filter("error IS NULL").select("release_id", F.explode("wanted").alias("w")).select(
        "release_id", F.get("w", F.lit(2)).alias("path"), F.get("w", F.lit(0)).alias("digest"), F.get("w", F.lit(1)).cast("long").alias("size")
    )
    return headers, indexes


def provenance_candidate(name: Column, source: Column, state: Column, os_id: Column) -> Column:
    """Whether a package belongs to a family whose origin is proven."""
    branch = F.when(os_id == "debian", "php8.4").otherwise("php8.3")
    nginx = name.isin("nginx", "nginx-common") | name.startswith("nginx-") | name.startswith("libnginx-mod-")
    apache = (name == "apache2") | name.startswith("apache2-")
    php = F.startswith(name, F.concat(branch, F.lit("-"))) | (name == F.concat(F.lit("libapache2-mod-"), branch))
    family = F.when(nginx, source == "nginx").when(apache, source == "apache2").otherwise(php & (source == branch))
    return (state == "installed") & F.coalesce(family, F.lit(False))


def provenance_match(packages: DataFrame, index: DataFrame) -> DataFrame:
    """Index entry of every candidate package, or the reason there is none.

    ``packages``: ``capture_id, os_id, name, architecture, version,
    source_name, source_version, installation_state``; ``index``: ``source_id,
    os_id`` and the identity columns, ``archive_sha``.  The index is reduced
    to one row per identity before the join, so the join never multiplies
    packages.
    """
    identity = ["os_id", "name", "architecture", "version", "source_name", "source_version"]
    candidates = packages.filter(
        provenance_candidate(F.col("name"), F.col("source_name"), F.col("installation_state"), F.col("os_id"))
    )
    entries = index.groupBy(*identity).agg(
        F.min("archive_sha").alias("sha_a"), F.max("archive_sha").alias("sha_z"), F.min("source_id").alias("source_id"),
    )
    joined = candidates.join(entries, identity, "left")
    reason = F.when(F.col("source_id").isNull(), "exact_authenticated_package_missing").when(
        F.col("sha_a") != F.col("sha_z"), "conflicting_published_artifacts"
    )
    return joined.select(
        "capture_id", "name", "architecture", "version", reason.alias("reason"),
        F.when(reason.isNull(), F.col("source_id")).alias("source_id"), F.when(reason.isNull(), F.col("sha_a")).alias("archive_sha"),
    )


def within_receipt_budget(receipts: DataFrame, limit: int = MAX_RECEIPTS) -> DataFrame:
    """Captures with more candidates than a report may hold."""
    n = receipts.groupBy("capture_id").agg(F.count("*").alias("receipts"))
    return n.withColumn("error", F.when(F.col("receipts") > limit, "receipt_budget_exceeded"))


def verify_files(published: DataFrame, installed: DataFrame) -> DataFrame:
    """Whether the installed files of each package are the published ones.

    ``published``: ``package_id, path, kind`` (``regular``, ``symlink``,
    ``directory`` or another)``, digest, target, is_conffile``; ``installed``:
    ``package_id, path, digest, target``.
    """
    keys = ["package_id", "path"]
    files = published.filter("kind <> 'directory'")
    repeated = files.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys, F.lit("duplicate_payload_path").alias("reason"))
    here = installed.select(*keys, F.col("digest").alias("have_digest"), F.col("target").alias("have_target"))
    joined = files.join(here, keys, "left")
    reason = F.when(
        ~F.col("is_conffile"),
        F.when(F.col("kind") == "symlink", F.when(~F.col("target").eqNullSafe(F.col("have_target")), "installed_symlink_mismatch"))
        .when(F.col("kind") != "regular", "unsupported_payload_entry")
        .when(~F.col("digest").eqNullSafe(F.col("have_digest")), "installed_file_mismatch"),
    )
    found = joined.select(*keys, "is_conffile", reason.alias("reason")).unionByName(
        repeated.withColumn("is_conffile", F.lit(True))
    )
    per_package = found.groupBy("package_id").agg(
        F.min_by("reason", F.when(F.col("reason").isNotNull(), F.struct("path", "reason"))).alias("reason"),
        F.count_if(~F.col("is_conffile")).alias("checked"),
    )
    everything = published.select("package_id").distinct()
    final = F.coalesce("reason", F.when(F.coalesce("checked", F.lit(0)) == 0, "empty_payload_manifest"))
    return everything.join(per_package, "package_id", "left").select(
        "package_id", final.alias("reason"), F.when(final.isNull(), "verified").otherwise("unknown").alias("status")
    )


def provenance_status(receipts: DataFrame, captures: DataFrame) -> DataFrame:
    """Status of each capture's provenance report.

    ``receipts``: ``capture_id, status``; ``captures``: ``capture_id, stable,
    errors`` (number of report errors).  An unstable capture verifies nothing.
    """
    totals = receipts.groupBy("capture_id").agg(
        F.count("*").alias("receipts"), F.count_if(F.col("status") == "verified").alias("verified")
    )
    joined = captures.join(totals, "capture_id", "left").withColumns(
        {"receipts": F.coalesce("receipts", F.lit(0)), "verified": F.coalesce("verified", F.lit(0))}
    )
    status = (
        F.when(~F.col("stable") | (F.col("verified") == 0), "unknown")
        .when((F.col("verified") == F.col("receipts")) & (F.col("errors") == 0), "verified")
        .otherwise("partial")
    )
    return joined.select("capture_id", status.alias("status"), "receipts", F.when(F.col("stable"), F.col("verified")).otherwise(0).alias("verified"))


def provenance_consistency(packages: DataFrame, receipts: DataFrame, reports: DataFrame) -> DataFrame:
    """Contradictions inside posted provenance reports, one row each.

    ``packages``: ``capture_id, name, architecture, version, source_name,
    source_version, origin`` (``official`` or ``unknown``)``, evidence``;
    ``receipts``: ``capture_id, name, architecture, version, source_name,
    source_version, status, reasons`` (number)``, receipt_digest``;
    ``reports``: ``capture_id, status, errors, complete``.
    """
    keys = ["capture_id", "name", "architecture"]

    def found(df: DataFrame, error: str) -> DataFrame:
        return df.select("capture_id", F.lit(error).alias("error")).distinct()

    repeated = receipts.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    wrong_reasons = receipts.filter(
        ((F.col("status") == "verified") & (F.col("reasons") > 0)) | ((F.col("status") != "verified") & (F.col("reasons") == 0))
    )
    totals = receipts.groupBy("capture_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "verified").alias("v"))
    computed = F.when(F.coalesce("v", F.lit(0)) == 0, "unknown").when(
        (F.col("v") == F.col("n")) & (F.col("errors") == 0), "verified"
    ).otherwise("partial")
    wrong_status = reports.join(totals, "capture_id", "left").filter(F.col("status") != computed)
    verified = receipts.filter("status = 'verified'")
    r = verified.select(
        *keys, F.col("version").alias("r_version"), F.col("source_name").alias("r_source"), F.col("source_version").alias("r_source_version"),
        "receipt_digest",
    )
    joined = packages.join(r, keys, "left").join(reports.select("capture_id", F.col("status").alias("report_status"), "complete"), "capture_id", "left")
    has_receipt = F.col("receipt_digest").isNotNull()
    official = F.col("origin") == "official"
    unqualified = official & ~F.coalesce(F.col("complete") & F.col("report_status").isin("verified", "partial"), F.lit(False))
    identity = official & ~F.coalesce(
        (F.col("version") == F.col("r_version")) & (F.col("source_name") == F.col("r_source")) & (F.col("source_version") == F.col("r_source_version")),
        F.lit(False),
    )
    digest = official & has_receipt & (F.col("evidence") != F.concat(F.lit("provenance:"), F.col("receipt_digest")))
    return reduce(
        DataFrame.unionByName,
        [
            found(repeated, "duplicate_provenance_receipt"),
            found(wrong_reasons, "invalid_provenance_reasons"),
            found(wrong_status, "invalid_provenance_summary"),
            found(joined.filter(has_receipt & ~official), "provenance_summary_origin_mismatch"),
            found(joined.filter(unqualified), "unqualified_provenance_origin"),
            found(joined.filter(identity), "provenance_package_identity_mismatch"),
            found(joined.filter(digest), "provenance_receipt_digest_mismatch"),
        ],
    )
