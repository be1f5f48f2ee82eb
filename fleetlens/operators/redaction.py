"""Removal and detection of secrets in collected text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a secret's name, what a private key looks like, and limits.
SECRET_NAMES = r"password|secret|token|api[_-]?key|private[_-]?key"
PRIVATE_KEY = r"(?s)-----BEGIN (OPENSSH|RSA|EC|DSA) PRIVATE KEY-----.*?-----END (OPENSSH|RSA|EC|DSA) PRIVATE KEY-----"
SECRET_ENV_WORDS = ("password", "secret", "token", "private_key", "api_key")
ENV_KEY = r"^[A-Z][A-Z0-9_]{0,127}\z"
MAX_OUTPUT_BYTES = 200_000  # of one output, where a receiver asks for a limit
# a word border where only ASCII letters, digits and _ are word characters
BORDER = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
BLANK = r"[\t\n\f\r ]"


def redact_secrets(text: Column, keep_before_equals: bool = False) -> Column:
    """Replace private keys and the values of secret-named settings.

    In ``name: a=b`` the source keeps ``a``; that leaks text, so it is only
    done with ``keep_before_equals``.
    """
    text = F.regexp_replace(text, PRIVATE_KEY, "[REDACTED_SSH_KEY]")
    setting = rf"((?:{SECRET_NAMES})\s*[:=])\s*[^\s]+"
    if not keep_before_equals:
        return F.regexp_replace(text, f"(?i){setting}", "$1[REDACTED]")
    colon_then_equals = rf"((?:{SECRET_NAMES})\s*:\s*[^\s=]*=)[^\s]*"
    return F.regexp_replace(text, f"(?i){colon_then_equals}|{setting}", "$1$2[REDACTED]")


def truncate_bytes(text: Column, limit: int) -> Column:
    """Cut a text at a number of UTF-8 bytes and mark the cut."""
    head = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, limit).cast("string"))
    return F.when(F.octet_length(text) > limit, F.concat(head, F.lit("\n[TRUNCATED]"))).otherwise(text)


def redact_patterns(text: Column, patterns: Sequence[str], limit: int | None = None) -> Column:
    """Redact the values of settings whose name starts with one of the words; then truncate, where a limit is given."""
    wanted = [p.strip() for p in patterns if p.strip()]
    redacted = reduce(
        lambda acc, p: F.regexp_replace(
            acc, rf"(?iu)({BORDER}\Q{p}\E[0-9A-Za-z_]*{BORDER}{BLANK}*[:=]{BLANK}*)[^\t\n\f\r ]+", "$1[REDACTED]"), wanted, text
    )
    return redacted if limit is None else truncate_bytes(redacted, limit)


def secret_shaped_env(env: Column, declared_secrets: Column) -> Column:
    """First reason to refuse an environment map, null when it is fine."""
    entries = F.map_entries(env)

    def secret_shaped(e: Column) -> Column:
        name = F.lower(e["key"])
        shaped = reduce(lambda a, b: a | b, [name.contains(w) for w in SECRET_ENV_WORDS])
        points_to = F.regexp_replace(e["value"], "^/run/secrets/", "")
        is_file = (
            e["key"].endswith("_FILE")
            & e["value"].startswith("/run/secrets/")
            & F.array_contains(declared_secrets, points_to)
        )
        return shaped & ~is_file

    return (
        F.when(F.size(entries) > 128, "too many entries")
        .when(F.exists(entries, lambda e: (F.octet_length(e["value"]) > 4096) | ~e["key"].rlike(ENV_KEY)), "invalid entry")
        .when(F.exists(entries, secret_shaped), "secret-shaped")
        .when(F.exists(entries, lambda e: e["value"].contains("${")), "interpolation")
    )


def sanitize_acl_rule(rule: Column, username: Column) -> Column:
    """Struct ``tokens, error`` of an access rule without its secrets."""
    tokens = F.filter(F.split(rule, r"\s+"), lambda w: w != "")
    policy = F.slice(tokens, 3, F.greatest(F.size(tokens) - 2, F.lit(0)))
    kept = F.filter(policy, lambda t: ~F.substring(t, 1, 1).isin("#", ">", "<", "!"))
    invalid = (F.size(tokens) < 3) | (F.size(tokens) > 512) | (F.get(tokens, F.lit(0)) != "user") | (
        F.get(tokens, F.lit(1)) != username
    )
    error = (
        F.when(invalid, "rule is invalid")
        .when(F.exists(policy, lambda t: t.rlike(r"[()]")), "selectors are not supported")
        .when(F.size(kept) == 0, "no policy left")
    )
    return F.struct(F.when(error.isNull(), kept).alias("tokens"), error.alias("error"))
