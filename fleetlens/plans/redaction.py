"""Redaction over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.adapters import EVENTS, project
from fleetlens.operators import redaction as op
from fleetlens.plans.registry import query

TEXTS = project(
    "documents", "doc_id",
    "text || CASE doc_id % 7 WHEN 0 THEN chr(10) || 'DB_password = p' || CAST(doc_id AS STRING) || ' rest' WHEN 1 THEN chr(10) || 'api-key: a=b' || CAST(doc_id AS STRING)"
    " WHEN 2 THEN chr(10) || '-----BEGIN RSA PRIVATE KEY-----' || chr(10) || 'abc' || chr(10) || '-----END RSA PRIVATE KEY----- tail' WHEN 3 THEN ' token_id : x y' ELSE '' END AS text",
)
# The names of secrets and the shape of a private key, for the oracles.
_NAMES = "password|secret|token|api[_-]?key|private[_-]?key"
_KEY = "'(?s)-----BEGIN (OPENSSH|RSA|EC|DSA) PRIVATE KEY-----.*?-----END (OPENSSH|RSA|EC|DSA) PRIVATE KEY-----'"


@query(
    "redact_secrets",
    f"""SELECT doc_id, md5(t) AS digest, length(t) AS chars, (length(t) - length(replace(t, '[REDACTED', ''))) // 9 AS marks FROM (
      SELECT doc_id, regexp_replace(regexp_replace(text, {_KEY}, '[REDACTED_SSH_KEY]', 'g'), '(?i)(({_NAMES})\\s*[:=])\\s*[^\\s]+', '\\1[REDACTED]', 'g') AS t FROM {TEXTS.sql})""",
)
def redact_secrets(spark, sf):
    t = TEXTS.frame(spark, sf).withColumn("t", op.redact_secrets(F.col("text")))
    marks = F.regexp_count("t", F.lit(r"\[REDACTED")).cast("long")
    return t.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("chars"), marks.alias("marks"))


@query(
    "redact_secrets_as_found",
    f"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, {_KEY}, '[REDACTED_SSH_KEY]', 'g'),
      '(?i)((?:{_NAMES})\\s*:\\s*[^\\s=]*=)[^\\s]*|((?:{_NAMES})\\s*[:=])\\s*[^\\s]+', '\\1\\2[REDACTED]', 'g')) AS digest FROM {TEXTS.sql}""",
)
def redact_secrets_as_found(spark, sf):
    return TEXTS.frame(spark, sf).select("doc_id", F.md5(op.redact_secrets(F.col("text"), True)).alias("digest"))


@query(
    "redact_patterns",
    f"""SELECT doc_id, md5(t) AS digest, strlen(t) AS bytes FROM (
      SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)(\\btoken\\w*\\b\\s*[:=]\\s*)\\S+', '\\1[REDACTED]', 'g'),
        '(?i)(\\bdb_\\w*\\b\\s*[:=]\\s*)\\S+', '\\1[REDACTED]', 'g') AS t FROM {TEXTS.sql})""",
)
def redact_patterns(spark, sf):
    redacted = op.redact_patterns(F.col("text"), ["token", " ", "db_"])
    return TEXTS.frame(spark, sf).select("doc_id", F.md5(redacted).alias("digest"), F.octet_length(redacted).cast("long").alias("bytes"))


ENVIRONMENTS = project(
    EVENTS, "event_id",
    "CASE k % 8 WHEN 0 THEN 'DB_PASSWORD' WHEN 1 THEN 'DB_PASSWORD_FILE' WHEN 2 THEN 'API_TOKEN_FILE' WHEN 3 THEN 'bad-key' ELSE 'MODE' END AS name",
    "CASE WHEN k % 8 = 1 THEN '/run/secrets/db' WHEN k % 8 = 2 THEN '/run/secrets/other' WHEN k % 8 = 4 THEN '$' || '{HOME}' WHEN k = 5 THEN repeat('x', 5000) ELSE 'x' END AS value",
)


@query(
    "secret_shaped_env",
    f"""SELECT event_id, CASE WHEN length(value) > 4096 OR NOT regexp_full_match(name, '[A-Z][A-Z0-9_]*') THEN 'invalid entry'
      WHEN regexp_matches(lower(name), 'password|secret|token|private_key|api_key') AND NOT (name LIKE '%\\_FILE' ESCAPE '\\' AND value = '/run/secrets/db') THEN 'secret-shaped'
      WHEN contains(value, '${{') THEN 'interpolation' END AS refusal FROM {ENVIRONMENTS.sql}""",
)
def secret_shaped_env(spark, sf):
    env = F.create_map(F.col("name"), F.col("value"), F.lit("LANG"), F.lit("C"))
    refusal = op.secret_shaped_env(env, F.array(F.lit("db")))
    return ENVIRONMENTS.frame(spark, sf).select("event_id", refusal.alias("refusal"))


ACL_RULES = project(
    EVENTS, "event_id", "'u' || CAST(user_id AS STRING) AS username",
    "CASE k % 7 WHEN 0 THEN 'user' WHEN 1 THEN 'user other on' WHEN 2 THEN 'user u' || CAST(user_id AS STRING) || ' on (~x +get)'"
    " WHEN 3 THEN 'user u' || CAST(user_id AS STRING) || ' #abc >pw' ELSE 'user u' || CAST(user_id AS STRING) || ' on  #abc ~app:* <old !h +@read -' || event_type END AS acl",
)
ACL_SQL = f"""SELECT event_id, username, CASE WHEN error IS NULL THEN array_to_string(kept, ' ') END AS policy, error FROM (SELECT *, CASE
      WHEN len(f) < 3 OR f[1] <> 'user' OR f[2] <> username THEN 'rule is invalid' WHEN regexp_matches(array_to_string(f[3:], ' '), '[()]') THEN 'selectors are not supported'
      WHEN len(kept) = 0 THEN 'no policy left' END AS error FROM (SELECT *, list_filter(f[3:], lambda t: substr(t, 1, 1) NOT IN ('#', '>', '<', '!')) AS kept FROM (
        SELECT event_id, username, list_filter(regexp_split_to_array(acl, '\\s+'), lambda w: w <> '') AS f FROM {ACL_RULES.sql})))"""


@query("sanitize_acl_rule", f"SELECT event_id, policy, error FROM ({ACL_SQL})")
def sanitize_acl_rule(spark, sf):
    clean = op.sanitize_acl_rule(F.col("acl"), F.col("username"))
    out = ACL_RULES.frame(spark, sf).withColumn("r", clean)
    return out.select("event_id", F.array_join("r.tokens", " ").alias("policy"), "r.error")
