"""Digests and verification over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.adapters import EVENTS, Input, project
from fleetlens.functions.digest import canonical_digest, sorted_map
from fleetlens.operators import digests as op
from fleetlens.plans.redaction import ACL_SQL, ACL_RULES
from fleetlens.plans.registry import query

_ORDER = (
    "o_orderkey", "o_custkey", "o_orderstatus", "CAST(round(o_totalprice * 100) AS BIGINT) AS cents", "o_orderpriority",
)
ORDERS = Input(
    "orders", (*_ORDER, "unix_micros(CAST(o_orderdate AS TIMESTAMP)) AS date_us"), duck_columns=(*_ORDER, "epoch_us(o_orderdate) AS date_us"),
)
COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "cents", "o_orderpriority", "date_us"]
TARGET = project(
    ORDERS, "o_orderkey", "o_custkey", "o_orderstatus", "CASE WHEN o_orderkey % 101 = 5 THEN cents + 1 ELSE cents END AS cents",
    "o_orderpriority", "date_us", where="o_orderkey % 97 <> 3",
)
LINEITEM = project(
    "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "CAST(round(l_extendedprice * 100) AS BIGINT) AS cents", "l_returnflag", "l_linestatus",
)
LINE_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "cents", "l_returnflag", "l_linestatus"]


def line_sql(cols, sep="chr(9)"):
    return f"concat_ws({sep}, " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'NULL')" for c in cols) + ")"


def words_sql(h: str = "h") -> str:
    """Sum and XOR words of a column of hex digests, as text."""
    out = []
    for n in range(4):
        w = f"CAST('0x' || substr({h}, {n * 16 + 1}, 16) AS UBIGINT)"
        out += [f"CAST(coalesce(bit_xor({w}), 0) AS VARCHAR) AS xor{n}", f"CAST(coalesce(sum({w}), 0) % 18446744073709551616 AS VARCHAR) AS sum{n}"]
    return ", ".join(out)


def digest_sql(h: str = "h") -> str:
    """The final digest of a multiset of hex digests."""
    xor, sums = [], []
    for n in range(4):
        w = f"CAST('0x' || substr({h}, {n * 16 + 1}, 16) AS UBIGINT)"
        xor.append(f"lpad(printf('%x', coalesce(bit_xor({w}), 0)), 16, '0')")
        sums.append(f"'\"' || printf('%x', CAST(coalesce(sum({w}), 0) % 18446744073709551616 AS UBIGINT)) || '\"'")
    body = " || ',' || ".join(sums)
    return (
        f"'sha256:' || sha256('{{\"rows\":' || count({h}) || ',\"schema_version\":\"operations.migration.mysql-row-multiset.v1\",\"sum\":[' || {body} || '],\"xor\":\"' || "
        + " || ".join(xor) + " || '\"}')"
    )


def _multiset_oracle(source: str, cols) -> str:
    return f"WITH d AS (SELECT sha256({line_sql(cols)}) AS h FROM {source}) SELECT {digest_sql()} AS digest, count(h) AS rows, {words_sql()} FROM d"


@query("row_multiset_digest", _multiset_oracle(ORDERS.sql, COLS))
def row_multiset_digest(spark, sf):
    return op.row_multiset_digest(ORDERS.frame(spark, sf), COLS)


@query("lineitem_multiset_digest", _multiset_oracle(LINEITEM.sql, LINE_COLS))
def lineitem_multiset_digest(spark, sf):
    return op.row_multiset_digest(LINEITEM.frame(spark, sf), LINE_COLS)


def _json_sql(cols) -> str:
    return "to_json(struct_pack(" + ", ".join(f"{c} := {c}" for c in cols) + "))"


@query(
    "sample_checksum",
    f"""SELECT md5(string_agg(h, '' ORDER BY h)) AS checksum, count(*) AS sampled FROM (SELECT md5(CAST({_json_sql(COLS)} AS VARCHAR)) AS h FROM {ORDERS.sql} ORDER BY h LIMIT 1000)""",
)
def sample_checksum(spark, sf):
    return op.sample_checksum(ORDERS.frame(spark, sf), COLS)


CATALOGUE = project(
    "part", "p_brand AS table_name", "p_partkey AS ordinal", "p_name AS column_name", "upper(p_type) AS data_type",
    "CASE p_size % 3 WHEN 0 THEN ' BIGINT(20)  unsigned ' WHEN 1 THEN 'varchar(' || CAST(p_size AS STRING) || ')' ELSE 'Int(11)' END AS column_type",
    "CASE WHEN p_size % 2 = 0 THEN 'yes' ELSE 'NO' END AS is_nullable",
    "CASE p_size % 4 WHEN 0 THEN 'default_generated on update  now' WHEN 1 THEN ' persistent generated' ELSE '' END AS extra",
    "CASE WHEN p_size % 5 = 0 THEN 'LOWER( x )  + 1' ELSE '' END AS generation",
    "CASE WHEN p_size % 3 = 1 THEN p_size END AS character_maximum_length", "CASE WHEN p_size % 3 <> 1 THEN 10 + p_size % 7 END AS numeric_precision",
    "CASE WHEN p_size % 3 <> 1 THEN p_size % 4 END AS numeric_scale", "CASE WHEN p_size % 13 = 0 THEN 6 END AS datetime_precision",
)
INDEXES = project(
    "part", "p_brand AS table_name", "p_type AS index_name", "p_size % 2 AS non_unique", "p_size AS seq", "p_name AS column_name",
    "CASE WHEN p_size % 3 = 0 THEN p_size END AS sub_part", "'btree' AS index_type", where="p_size % 7 = 0",
)
FOREIGN_KEYS = project(
    "part", "p_brand AS table_name", "p_type AS constraint_name", "p_size AS ordinal", "p_name AS column_name", "'t.c' AS referenced",
    "'cascade' AS update_rule", "'Restrict' AS delete_rule", where="p_size % 11 = 0",
)
_TYPE_SQL = "regexp_replace(trim(regexp_replace(regexp_replace(lower(column_type), '\\b(tinyint|smallint|mediumint|int|integer|bigint)\\([0-9]+\\)', '\\1', 'g'), '\\s+', ' ', 'g')), '\\s+', ' ', 'g')"
_EXTRA_SQL = "trim(regexp_replace(replace(replace(upper(trim(extra)), 'DEFAULT_GENERATED', ''), 'PERSISTENT GENERATED', 'STORED GENERATED'), '\\s+', ' ', 'g'))"


@query(
    "structure_digest",
    f"""WITH l AS (SELECT table_name, concat_ws(chr(9), 'column', ordinal, column_name, lower(data_type), {_TYPE_SQL}, upper(is_nullable), coalesce(CAST(character_maximum_length AS VARCHAR), ''), coalesce(CAST(numeric_precision AS VARCHAR), ''), coalesce(CAST(numeric_scale AS VARCHAR), ''), coalesce(CAST(datetime_precision AS VARCHAR), ''), {_EXTRA_SQL}, trim(regexp_replace(lower(generation), '\\s+', ' ', 'g'))) AS line FROM {CATALOGUE.sql}
      UNION ALL SELECT table_name, concat_ws(chr(9), 'index', index_name, non_unique, seq, column_name, coalesce(CAST(sub_part AS VARCHAR), ''), upper(index_type)) FROM {INDEXES.sql}
      UNION ALL SELECT table_name, concat_ws(chr(9), 'foreign key', constraint_name, ordinal, column_name, referenced, upper(update_rule), upper(delete_rule)) FROM {FOREIGN_KEYS.sql}),
    d AS (SELECT table_name, sha256(line) AS h FROM l) SELECT table_name, {digest_sql()} AS structure_digest, count(*) AS parts FROM d GROUP BY table_name""",
)
def structure_digest(spark, sf):
    return op.structure_digest(CATALOGUE.frame(spark, sf), INDEXES.frame(spark, sf), FOREIGN_KEYS.frame(spark, sf))


NATIONS = project("nation", "n_nationkey", "n_name")
REGIONS = project("region", "r_regionkey", "r_name")
SUPPLIERS = project("supplier", "s_suppkey", "s_nationkey")
CUSTOMERS = project("customer", "c_custkey", "c_nationkey")
PARTS = project("part", "p_partkey", "p_name")
# what the other side holds: rows gone, a value changed, a type changed
RENAMED = project("nation", "n_nationkey", "CASE WHEN n_nationkey = 3 THEN 'RENAMED' ELSE n_name END AS n_name")
RETYPED = project("supplier", "s_suppkey", "CAST(s_nationkey AS STRING) AS s_nationkey")
SOURCE_TABLES = {
    "orders": (ORDERS, COLS), "lineitem": (LINEITEM, LINE_COLS), "nation": (NATIONS, ["n_nationkey", "n_name"]), "region": (REGIONS, ["r_regionkey", "r_name"]),
    "supplier": (SUPPLIERS, ["s_suppkey", "s_nationkey"]), "customer": (CUSTOMERS, ["c_custkey", "c_nationkey"]),
}
TARGET_TABLES = {k: v for k, v in SOURCE_TABLES.items() if k != "region"} | {
    "orders": (TARGET, COLS), "nation": (RENAMED, ["n_nationkey", "n_name"]), "supplier": (RETYPED, ["s_suppkey", "s_nationkey"]), "part": (PARTS, ["p_partkey", "p_name"]),
}


def _tables(spark, sf, tables):
    return {name: (rows.frame(spark, sf), cols) for name, (rows, cols) in tables.items()}


def _structure_sql(rows, cols) -> str:
    """Lines of a table's columns, from the engine's own types."""
    kinds = "CASE t WHEN 'BIGINT' THEN 'long' || chr(9) || 'bigint' WHEN 'INTEGER' THEN 'integer' || chr(9) || 'int' WHEN 'VARCHAR' THEN 'string' || chr(9) || 'string' END"
    types = " UNION ALL ".join(f"SELECT {i} AS i, '{c}' AS c, (SELECT typeof({c}) FROM {rows} LIMIT 1) AS t" for i, c in enumerate(cols, 1))
    return f"SELECT sha256(concat_ws(chr(9), 'column', i, c, {kinds}, 'YES', '', '', '', '', '', '')) AS h FROM ({types})"


def _manifest_sql(name, rows, cols) -> str:
    data = f"SELECT count(*) AS rows, {digest_sql()} AS data_digest FROM (SELECT sha256({line_sql(cols)}) AS h FROM {rows})"
    return f"SELECT '{name}' AS table_name, rows, data_digest, structure_digest FROM ({data}) CROSS JOIN (SELECT {digest_sql()} AS structure_digest FROM ({_structure_sql(rows, cols)}))"


def _verdict_sql(name) -> str:
    (s, cols), (t, _) = SOURCE_TABLES.get(name, (None, None)), TARGET_TABLES.get(name, (None, None))
    count = lambda x: f"(SELECT count(*) FROM {x.sql})" if x else "CAST(NULL AS BIGINT)"
    if s is None or t is None:
        reason = "'missing'" if t is None else "'unexpected'"
    else:
        kinds = lambda x: "[" + ", ".join(f"(SELECT typeof({c}) FROM {x.sql} LIMIT 1)" for c in cols) + "]"
        listed = ", ".join(cols)
        reason = f"""CASE WHEN {kinds(s)} <> {kinds(t)} THEN 'structure' WHEN {count(s)} <> {count(t)} THEN 'rows'
          WHEN EXISTS (SELECT {listed} FROM {s.sql} EXCEPT ALL SELECT {listed} FROM {t.sql}) THEN 'data' END"""
    return f"SELECT '{name}' AS table_name, {count(s)} AS source_rows, {count(t)} AS target_rows, {reason} AS reason"


@query("table_manifest", " UNION ALL ".join(_manifest_sql(n, r.sql, c) for n, (r, c) in SOURCE_TABLES.items()))
def table_manifest(spark, sf):
    return op.table_manifest(_tables(spark, sf, SOURCE_TABLES))


@query(
    "verify_tables",
    f"SELECT *, reason IS NULL AS equal FROM ({' UNION ALL '.join(_verdict_sql(n) for n in sorted({*SOURCE_TABLES, *TARGET_TABLES}))})",
)
def verify_tables(spark, sf):
    return op.verify_tables(op.table_manifest(_tables(spark, sf, SOURCE_TABLES)), op.table_manifest(_tables(spark, sf, TARGET_TABLES)))


@query(
    "table_diff",
    f"""SELECT *, 'source' AS side, CAST(1 AS BIGINT) AS copies FROM (SELECT {', '.join(COLS)} FROM {ORDERS.sql} EXCEPT ALL SELECT {', '.join(COLS)} FROM {TARGET.sql})
    UNION ALL SELECT *, 'target', 1 FROM (SELECT {', '.join(COLS)} FROM {TARGET.sql} EXCEPT ALL SELECT {', '.join(COLS)} FROM {ORDERS.sql})""",
)
def table_diff(spark, sf):
    return op.table_diff(ORDERS.frame(spark, sf), TARGET.frame(spark, sf), COLS)


@query(
    "canonical_digest",
    """SELECT c_custkey, 'sha256:' || sha256('{"account":{"cents":' || CAST(round(c_acctbal * 100) AS BIGINT) || ',"nation":' || c_nationkey || '},"name":"' || c_name
      || '","tags":{"a":"' || c_mktsegment || '","z":"' || c_nationkey || '"}}') AS digest FROM customer""",
)
def canonical_digest_query(spark, sf):
    customers = project("customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment", "CAST(round(c_acctbal * 100) AS BIGINT) AS cents").frame(spark, sf)
    tags = F.create_map(F.lit("z"), F.col("c_nationkey").cast("string"), F.lit("a"), F.col("c_mktsegment"))
    fields = {"tags": sorted_map(tags), "name": F.col("c_name"), "account": {"nation": F.col("c_nationkey"), "cents": F.col("cents")}}
    return customers.select("c_custkey", canonical_digest(fields).alias("digest"))


@query(
    "evidence_digest",
    """SELECT doc_id, 'sha256:' || sha256('{"bytes":' || strlen(text) || ',"output_digest":"sha256:' || sha256(text) || '","source":"' || source || '"}') AS digest FROM documents""",
)
def evidence_digest(spark, sf):
    docs = project("documents", "doc_id", "text", "source").frame(spark, sf)
    fields = {"source": F.col("source"), "output_digest": F.concat(F.lit("sha256:"), F.sha2("text", 256)), "bytes": F.octet_length("text")}
    return docs.select("doc_id", op.evidence_digest(fields).alias("digest"))


DATABASES = project("nation", "n_nationkey AS db", "md5(n_name) AS content_digest")
OWNERS = project("nation", "n_nationkey AS db", "'owner' || CAST(n_nationkey % 3 AS STRING) AS owner")
PRIVILEGES = project(
    "customer", "c_nationkey AS db", "CASE WHEN c_custkey % 3 = 0 THEN 'TABLE' ELSE 'SCHEMA' END AS object_type", "'public' AS schema_name", "c_name AS object_name",
    "CASE WHEN c_custkey % 4 = 0 THEN 'owner' || CAST(c_nationkey % 3 AS STRING) ELSE 'app' END AS grantee", "c_mktsegment AS privilege", "c_custkey % 2 = 0 AND c_custkey % 5 = 0 AS grantable",
    where="c_nationkey <> 7",
)


@query(
    "content_manifest_digest",
    f"""WITH p AS (SELECT p.*, sha256({line_sql(['object_type', 'schema_name', 'object_name', 'grantee', 'privilege', 'grantable'])}) AS h FROM {PRIVILEGES.sql} p
      WHERE grantable OR NOT EXISTS (SELECT 1 FROM {OWNERS.sql} o WHERE o.db = p.db AND o.owner = p.grantee)),
    g AS (SELECT db, count(*) AS privileges, {digest_sql()} AS d FROM p GROUP BY db)
    SELECT b.db, coalesce(privileges, 0) AS privileges, 'sha256:' || sha256('{{"content":"' || content_digest || '","privileges":"' || coalesce(d, '')
      || '","schema_version":"operations.migration.postgres-content-manifest.v1"}}') AS digest FROM {DATABASES.sql} b LEFT JOIN g ON g.db = b.db""",
)
def content_manifest_digest(spark, sf):
    return op.content_manifest_digest(DATABASES.frame(spark, sf), OWNERS.frame(spark, sf), PRIVILEGES.frame(spark, sf))


MEMBERS = project(
    "customer", "c_nationkey AS set_id", "c_custkey AS ordinal", "md5(c_name) AS manifest_digest", "c_custkey * 3 AS total_rows",
    "CAST(round(c_acctbal * 100) AS BIGINT) + 1000000 AS bytes", "c_custkey % 40 <> 0 AS does_exist", "c_custkey % 5 <> 0 OR c_nationkey % 2 = 0 AS is_empty",
)
EXTENSIONS = project("customer", "c_nationkey AS set_id", "lower(c_mktsegment) || '@1.' || CAST(c_custkey % 4 AS STRING) AS extension", where="c_nationkey % 6 <> 1")


@query(
    "database_set_rollup",
    f"""WITH m AS (SELECT *, sha256({line_sql(['ordinal', 'manifest_digest'])}) AS h FROM {MEMBERS.sql}),
    t AS (SELECT set_id, CAST(sum(total_rows) AS BIGINT) AS total_rows, CAST(sum(bytes) AS BIGINT) AS database_bytes, bool_and(does_exist) AS all_exist, bool_and(is_empty) AS all_empty,
      {digest_sql()} AS members_digest, count(*) AS members FROM m GROUP BY set_id),
    e AS (SELECT set_id, string_agg(DISTINCT extension, ',' ORDER BY extension) AS required_extensions FROM {EXTENSIONS.sql} GROUP BY set_id)
    SELECT t.*, required_extensions FROM t LEFT JOIN e ON e.set_id = t.set_id""",
)
def database_set_rollup(spark, sf):
    return op.database_set_rollup(MEMBERS.frame(spark, sf), EXTENSIONS.frame(spark, sf))


RECORDS = project(
    ORDERS, "CASE WHEN o_custkey % 7 = 0 THEN 'b' ELSE 'a' END AS store", "CAST(o_custkey % 4 AS INT) AS db", "CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE date_us DIV 1000 END AS expiry_ms",
    "encode('k' || CAST(o_orderkey AS STRING), 'UTF-8') AS key", "encode(o_orderstatus || CAST(cents AS STRING), 'UTF-8') AS value", "o_orderkey",
)


def records_sql(base: str) -> str:
    return base.replace(", 'UTF-8')", ")")


def _be(number: str, width: int) -> str:
    return f"right(lpad(printf('%x', CAST({number} AS BIGINT)), 16, '0'), {width * 2})"


_RECORD_HEX = f"{_be('db', 2)} || {_be('expiry_ms', 8)} || {_be('octet_length(key)', 4)} || {_be('octet_length(value)', 4)} || hex(key) || hex(value)"


@query(
    "keyed_records_digest",
    f"""WITH r AS (SELECT *, sha256(unhex({_RECORD_HEX})) AS h FROM {records_sql(RECORDS.sql)}),
    p AS (SELECT *, CASE WHEN expiry_ms = -1 THEN h END AS ph FROM r)
    SELECT store, count(*) AS key_count, {digest_sql('h')} AS all_digest, count(ph) AS persistent_count, {digest_sql('ph')} AS persistent_digest,
      CAST(sum(octet_length(key) + octet_length(value)) AS BIGINT) AS bytes FROM p GROUP BY store""",
)
def keyed_records_digest(spark, sf):
    return op.keyed_records_digest(RECORDS.frame(spark, sf))


SCANNED = project(ORDERS, "CAST(o_custkey % 4 AS INT) AS db", "'k' || CAST(o_custkey AS STRING) AS key")


@query("canonical_keys", f"SELECT DISTINCT db, key FROM {SCANNED.sql}")
def canonical_keys(spark, sf):
    return op.canonical_keys(SCANNED.frame(spark, sf))


RESTORED = project(
    RECORDS, "db", "key", "CASE WHEN o_orderkey % 89 = 4 THEN encode('changed', 'UTF-8') ELSE value END AS value",
    "CASE WHEN expiry_ms = -1 THEN CASE WHEN o_orderkey % 51 = 0 THEN 5 ELSE -1 END WHEN o_orderkey % 53 = 1 THEN -1 ELSE expiry_ms + o_orderkey % 2100 END AS expiry_ms",
    where="o_orderkey % 67 <> 6",
)
NOW_MS = 900_000_000_000


@query(
    "verify_keyed",
    f"""SELECT * FROM (SELECT coalesce(s.db, t.db) AS db, decode(coalesce(s.key, t.key)) AS key, CASE WHEN s.key IS NULL THEN 'undeclared key' WHEN t.key IS NULL THEN 'missing key' WHEN s.value <> t.value THEN 'value'
        WHEN (s.expiry_ms = -1 OR t.expiry_ms = -1) AND s.expiry_ms <> t.expiry_ms THEN 'expiry' WHEN s.expiry_ms <> -1 AND abs(s.expiry_ms - t.expiry_ms) > 2000 THEN 'expiry' END AS reason
      FROM (SELECT * FROM {records_sql(RECORDS.sql)} WHERE expiry_ms = -1 OR expiry_ms > {NOW_MS}) s FULL JOIN {records_sql(RESTORED.sql)} t ON s.db = t.db AND s.key = t.key) WHERE reason IS NOT NULL""",
)
def verify_keyed(spark, sf):
    out = op.verify_keyed(RECORDS.frame(spark, sf), RESTORED.frame(spark, sf), NOW_MS)
    return out.withColumn("key", F.decode("key", "UTF-8"))


@query(
    "state_mode_manifest",
    f"""WITH r AS (SELECT *, sha256(unhex({_RECORD_HEX})) AS h FROM {records_sql(RECORDS.sql)})
    SELECT store, 'durable' AS state_mode, count(*) AS record_count, {digest_sql('h')} AS record_digest FROM r WHERE store = 'a' GROUP BY store
    UNION ALL SELECT 'b', 'cache', 0, 'sha256:{'e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855'}'""",
)
def state_mode_manifest(spark, sf):
    digests = op.keyed_records_digest(RECORDS.frame(spark, sf))
    return op.state_mode_manifest(digests.withColumn("state_mode", F.when(F.col("store") == "b", "cache").otherwise("durable")))


COLLECTIONS = project(
    "part", "p_brand AS db",
    "CASE p_size % 8 WHEN 0 THEN 'system.views' WHEN 1 THEN 'system.buckets.x' WHEN 2 THEN 'system.js' WHEN 3 THEN 'enxcol_.y' WHEN 4 THEN '' ELSE p_type || CAST(p_partkey AS STRING) END AS name",
    "CASE p_partkey % 5 WHEN 0 THEN 'view' WHEN 1 THEN 'timeseries' WHEN 2 THEN 'other' ELSE 'collection' END AS type",
    "CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE p_partkey - 3 END AS doc_count", "CASE WHEN p_partkey % 10 = 0 THEN '' ELSE md5(p_name) END AS hash",
    "p_brand AS options", "p_name AS indexes", "p_size % 6 = 0 AS encrypted", "p_size % 2 = 0 AS allow_system", "p_size % 9 = 0 AS allow_encryption", "p_partkey",
)


@query(
    "collection_manifest",
    f"""SELECT name, type, doc_count, hash, 'sha256:' || sha256('{{"indexes":"' || indexes || '","options":"' || options || '"}}') AS metadata_digest,
      NOT (name = '' OR doc_count < 0 OR (type <> 'view' AND hash = '') OR (type = 'view' AND (doc_count <> 0 OR hash <> ''))) AS valid,
      concat_ws(',', CASE WHEN type = 'other' THEN 'type:' || name END, CASE WHEN (type IN ('view', 'timeseries') OR name LIKE 'system.%') AND NOT allow_system THEN 'view-or-system:' || name END,
        CASE WHEN name = 'system.js' THEN 'system:' || name END, CASE WHEN (encrypted OR name LIKE 'enxcol\\_%' ESCAPE '\\') AND NOT allow_encryption THEN 'queryable-encryption:' || name END) AS unsupported
    FROM {COLLECTIONS.sql}""",
)
def collection_manifest(spark, sf):
    return op.collection_manifest(COLLECTIONS.frame(spark, sf)).drop("db")


DUMPS = project(
    "documents", "doc_id",
    "'-- Dumped by pg_dump version 17' || chr(10) || '  ' || chr(92) || 'restrict abc' || chr(10) || text || '   ' || chr(10) || '-- Dumped from database version 16' || chr(10)"
    " || 'CREATE TABLE t (c text CHARACTER SET latin1 COLLATE x)' || chr(9) || chr(10) || chr(10) AS ddl",
)


@query(
    "normalize_ddl",
    f"""SELECT doc_id, md5(replace(regexp_replace(array_to_string(list_transform(list_filter(string_split(replace(ddl, chr(13) || chr(10), chr(10)), chr(10)),
      lambda s: NOT starts_with(trim(s), '-- Dumped from database version') AND NOT starts_with(trim(s), '-- Dumped by pg_dump version') AND NOT starts_with(trim(s), chr(92) || 'restrict ') AND NOT starts_with(trim(s), chr(92) || 'unrestrict ')),
      lambda s: rtrim(s, ' ' || chr(9))), chr(10)), '\\n+$', '') || chr(10), ' CHARACTER SET latin1 COLLATE ', ' COLLATE ')) AS digest FROM {DUMPS.sql}""",
)
def normalize_ddl(spark, sf):
    text = op.collapse_charset(op.normalize_ddl(F.col("ddl")), F.lit("latin1"))
    return DUMPS.frame(spark, sf).select("doc_id", F.md5(text).alias("digest"))


EXPECTED = project("part", "p_brand AS publication", "p_type AS table_name", "p_size AS column_no")
ACTUAL = project("part", "p_brand AS publication", "p_type AS table_name", "CASE WHEN p_partkey % 9 = 0 THEN p_size + 1 ELSE p_size END AS column_no", where="p_partkey % 13 <> 0")


@query(
    "expected_vs_actual",
    f"""WITH e AS (SELECT publication, table_name, column_no, count(*) AS e, 0 AS a FROM {EXPECTED.sql} GROUP BY ALL UNION ALL SELECT publication, table_name, column_no, 0, count(*) FROM {ACTUAL.sql} GROUP BY ALL),
    s AS (SELECT publication, table_name, column_no, sum(e) AS e, sum(a) AS a FROM e GROUP BY ALL)
    SELECT publication, CAST(sum(least(e, a)) AS BIGINT) AS matching, CAST(sum(greatest(e - a, 0)) AS BIGINT) AS missing, CAST(sum(greatest(a - e, 0)) AS BIGINT) AS unexpected FROM s GROUP BY publication""",
)
def expected_vs_actual(spark, sf):
    return op.expected_vs_actual(EXPECTED.frame(spark, sf), ACTUAL.frame(spark, sf), ["publication"], ["table_name", "column_no"])


_SEQ = "'public' AS schema_name"
SEQ_SOURCE = project("part", "p_brand AS db", _SEQ, "'s' || CAST(p_partkey AS STRING) AS sequence_name", "CASE WHEN p_partkey % 40 = 1 THEN 'x' ELSE CAST(p_partkey * 7 AS STRING) END AS last_value", "p_size % 2 = 0 AS is_called", where="p_partkey % 17 <> 0")
SEQ_TARGET = project("part", "p_brand AS db", _SEQ, "'s' || CAST(p_partkey AS STRING) AS sequence_name", "CAST(p_partkey * 7 + CASE WHEN p_partkey % 23 = 0 THEN 1 ELSE 0 END AS STRING) AS last_value", "p_size % 2 = 0 OR p_size = 5 AS is_called", where="p_partkey % 19 <> 0")


@query(
    "sequence_state",
    f"""SELECT * FROM (SELECT coalesce(s.db, t.db) AS db, coalesce(s.schema_name, t.schema_name) AS schema_name, coalesce(s.sequence_name, t.sequence_name) AS sequence_name,
      CASE WHEN t.db IS NULL THEN 'missing' WHEN s.db IS NULL THEN 'unexpected' WHEN NOT regexp_full_match(s.last_value, '-?[0-9]+') THEN 'not an integer' WHEN s.last_value <> t.last_value THEN 'last value'
        WHEN s.is_called <> t.is_called THEN 'called flag' END AS reason FROM {SEQ_SOURCE.sql} s FULL JOIN {SEQ_TARGET.sql} t ON s.db = t.db AND s.sequence_name = t.sequence_name) WHERE reason IS NOT NULL""",
)
def sequence_state(spark, sf):
    return op.sequence_state(SEQ_SOURCE.frame(spark, sf), SEQ_TARGET.frame(spark, sf))


ACL = project(EVENTS, "event_id", "user_id % 40 AS store", "event_id AS ord", "'u' || CAST(user_id AS STRING) AS username")
USER_MAP = project("customer", "c_custkey % 40 AS store", "c_custkey AS ord", "'u' || CAST(c_custkey AS STRING) AS source_user", "'t' || CAST(c_custkey AS STRING) AS target_user")


@query(
    "acl_policy_digest",
    f"""WITH a AS (SELECT a.store, a.username, arg_max(p.policy, a.ord) AS policy, arg_max(coalesce(p.error, '-'), a.ord) AS error FROM {ACL.sql} a JOIN ({ACL_SQL}) p ON p.event_id = a.event_id GROUP BY ALL),
    j AS (SELECT m.store, m.ord, CASE WHEN a.store IS NULL THEN 'user has no rule' ELSE nullif(a.error, '-') END AS error,
        sha256(concat_ws(chr(9), m.ord, m.target_user, coalesce(a.policy, 'NULL'))) AS h FROM {USER_MAP.sql} m LEFT JOIN a ON a.store = m.store AND a.username = m.source_user)
    SELECT store, count(*) AS users, arg_min(error, ord) FILTER (error IS NOT NULL) AS error, CASE WHEN count(error) = 0 THEN {digest_sql()} END AS policy_digest FROM j GROUP BY store""",
)
def acl_policy_digest(spark, sf):
    rules = ACL.frame(spark, sf).join(ACL_RULES.frame(spark, sf).select("event_id", "acl"), "event_id")
    return op.acl_policy_digest(rules, USER_MAP.frame(spark, sf))
