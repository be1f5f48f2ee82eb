"""Grants and compatibility over the driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from fleetlens.adapters import project
from fleetlens.operators import grants as op
from fleetlens.plans.registry import query

GRANTS = project(
    "customer", "c_custkey", "c_nationkey AS db", "CASE c_custkey % 3 WHEN 0 THEN 'TABLE' WHEN 1 THEN 'SCHEMA' ELSE 'SEQUENCE' END AS object_type", "'public' AS schema_name",
    "c_mktsegment AS object_name",
    "CASE c_custkey % 9 WHEN 0 THEN 'PUBLIC' WHEN 1 THEN 'pg_database_owner' WHEN 2 THEN 'pg_monitor' WHEN 3 THEN 'bad-name' ELSE 'role_' || CAST(c_custkey % 6 AS STRING) END AS grantee",
    "CASE c_custkey % 4 WHEN 0 THEN 'SELECT' WHEN 1 THEN 'USAGE' WHEN 2 THEN 'CREATE' ELSE 'TRUNCATE' END AS privilege", "c_custkey % 2 = 0 AS grantable",
)
ROLE_MAP = project("customer", "c_nationkey AS db", "'role_' || CAST(c_custkey % 6 AS STRING) AS source_role", "'app_' || CAST(c_custkey % 6 DIV 2 AS STRING) AS target_role", where="c_nationkey <> 5 AND c_custkey % 6 <> 4")
OWNERS = project("nation", "n_nationkey AS db", "lower(n_name) AS owner")
MAPPED_SQL = f"""SELECT g.*, CASE WHEN grantee = 'PUBLIC' THEN grantee WHEN grantee = 'pg_database_owner' THEN owner WHEN grantee LIKE 'role%' THEN target_role END AS principal,
      CASE WHEN grantee IN ('PUBLIC', 'pg_database_owner') THEN NULL WHEN grantee LIKE 'pg%' OR grantee = 'bad-name' THEN 'unsupported role' WHEN target_role IS NULL THEN 'missing from the role map' END AS error
    FROM {GRANTS.sql} g LEFT JOIN (SELECT DISTINCT * FROM {ROLE_MAP.sql}) m ON m.db = g.db AND m.source_role = g.grantee LEFT JOIN {OWNERS.sql} o ON o.db = g.db"""


def _mapped(spark, sf):
    return op.map_principals(GRANTS.frame(spark, sf), ROLE_MAP.frame(spark, sf).distinct(), OWNERS.frame(spark, sf))


@query("map_principals", f"SELECT c_custkey, principal, error FROM ({MAPPED_SQL})")
def map_principals(spark, sf):
    return _mapped(spark, sf).select("c_custkey", "principal", "error")


@query(
    "fold_grants",
    f"""SELECT db, object_type, schema_name, object_name, principal, privilege, bool_or(grantable) AS grantable FROM ({MAPPED_SQL}) WHERE error IS NULL GROUP BY ALL""",
)
def fold_grants(spark, sf):
    return op.fold_grants(_mapped(spark, sf).filter("error IS NULL"))


_G = ("c_nationkey AS db", "c_name AS grantee")
DB_GRANTS = project("customer", *_G, "'select' AS privilege", "CASE WHEN c_custkey % 2 = 0 THEN 'YES' ELSE 'NO' END AS is_grantable", where="c_custkey % 4 = 0")
TABLE_GRANTS = project("customer", *_G, "c_mktsegment AS table_name", "'Insert' AS privilege", "'no' AS is_grantable", where="c_custkey % 4 = 1")
COLUMN_GRANTS = project("customer", *_G, "c_mktsegment AS table_name", "'c1' AS column_name", "'UPDATE' AS privilege", "'yes' AS is_grantable", where="c_custkey % 4 = 2")
ROUTINE_GRANTS = project(
    "customer", *_G, "'f' || CAST(c_custkey AS STRING) AS routine_name", "'PROCEDURE' AS routine_type",
    "CASE c_custkey % 3 WHEN 0 THEN 'Execute, Alter Routine,Grant' WHEN 1 THEN 'Execute' ELSE '' END AS privileges", where="c_custkey % 4 = 3",
)


@query(
    "grant_inventory",
    f"""SELECT db, 'database' AS scope, grantee, '' AS object_name, '' AS column_name, 'SELECT' AS privilege, is_grantable = 'YES' AS grantable FROM {DB_GRANTS.sql}
    UNION ALL SELECT db, 'table', grantee, table_name, '', 'INSERT', false FROM {TABLE_GRANTS.sql} UNION ALL SELECT db, 'column', grantee, table_name, 'c1', 'UPDATE', true FROM {COLUMN_GRANTS.sql}
    UNION ALL SELECT db, 'routine', grantee, 'procedure:' || routine_name, '', 'EXECUTE', contains(privileges, 'Grant') FROM {ROUTINE_GRANTS.sql} WHERE privileges <> ''
    UNION ALL SELECT db, 'routine', grantee, 'procedure:' || routine_name, '', 'ALTER ROUTINE', true FROM {ROUTINE_GRANTS.sql} WHERE contains(privileges, 'Alter')""",
)
def grant_inventory(spark, sf):
    return op.grant_inventory(*[x.frame(spark, sf) for x in (DB_GRANTS, TABLE_GRANTS, COLUMN_GRANTS, ROUTINE_GRANTS)])


@query(
    "privilege_allowed",
    f"""SELECT c_custkey, CASE object_type WHEN 'TABLE' THEN privilege IN ('SELECT', 'INSERT', 'UPDATE', 'DELETE', 'TRUNCATE', 'REFERENCES', 'TRIGGER', 'MAINTAIN')
      WHEN 'SEQUENCE' THEN privilege IN ('SELECT', 'UPDATE', 'USAGE') ELSE privilege IN ('CREATE', 'USAGE') END AS allowed FROM {GRANTS.sql}""",
)
def privilege_allowed(spark, sf):
    return op.privilege_allowed(GRANTS.frame(spark, sf)).select("c_custkey", "allowed")


ACCOUNTS = project(
    "part", "p_brand AS binding_id", "p_partkey", "'s' || CAST(p_partkey % 1700 AS STRING) AS source",
    "CASE p_partkey % 41 WHEN 0 THEN 'Root' WHEN 1 THEN 'mysql.sys' ELSE 't' || CAST(p_partkey % 1800 AS STRING) END AS target",
)


@query(
    "map_is_one_to_one",
    f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY binding_id ORDER BY p_partkey) AS ord FROM {ACCOUNTS.sql})
    SELECT binding_id, 'duplicate source' AS problem, source AS account FROM a GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT binding_id, 'duplicate target', target FROM a GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT binding_id, 'reserved target', target FROM a WHERE lower(target) IN ('root', 'mysql.sys')
    UNION ALL SELECT binding_id, 'not sorted', source FROM (SELECT *, lag(source) OVER (PARTITION BY binding_id ORDER BY ord) AS previous FROM a) WHERE source <= previous""",
)
def map_is_one_to_one(spark, sf):
    from fleetlens.functions.ordered import number_segment, ordered_scan

    accounts = ACCOUNTS.frame(spark, sf).withColumn("segment", number_segment("p_partkey", 1000))
    numbered = ordered_scan(accounts, ["binding_id"], ["p_partkey"], "segment", row_number="ord")
    return op.map_is_one_to_one(numbered, demand_order=True)


USERS = project(
    "customer", "c_nationkey AS db", "'u' || CAST(c_custkey % 400 AS STRING) AS user", "CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE 'role_' || CAST(c_custkey % 6 AS STRING) END AS role",
    "CASE WHEN c_custkey % 33 = 1 THEN 99 ELSE c_nationkey END AS role_db",
)
USER_MAP = project("customer", "c_nationkey AS db", "'u' || CAST(c_custkey AS STRING) AS source", "'x' || CAST(c_custkey AS STRING) AS target")


@query(
    "normalize_users",
    f"""WITH r AS (SELECT DISTINCT * FROM {ROLE_MAP.sql}), j AS (SELECT m.db, m.target AS target_user, r.target_role, CASE WHEN u.user IS NULL THEN 'user is missing' WHEN u.role IS NOT NULL AND u.role_db <> u.db THEN 'cross-database role'
      WHEN u.role IS NOT NULL AND r.target_role IS NULL THEN 'role is not mapped' END AS error FROM {USER_MAP.sql} m LEFT JOIN {USERS.sql} u ON u.db = m.db AND u.user = m.source LEFT JOIN r ON r.db = m.db AND r.source_role = u.role)
    SELECT db, target_user, coalesce(string_agg(DISTINCT target_role, ',' ORDER BY target_role), '') AS roles, min(error) AS error FROM j GROUP BY db, target_user""",
)
def normalize_users(spark, sf):
    roles = ROLE_MAP.frame(spark, sf).distinct().selectExpr("db", "source_role AS source", "target_role AS target")
    return op.normalize_users(USERS.frame(spark, sf), roles, USER_MAP.frame(spark, sf))


ROLE_PRIVILEGES = project(
    "customer", "c_nationkey AS db", "'role_' || CAST(c_custkey % 6 AS STRING) AS role", "CASE WHEN c_custkey % 61 = 0 THEN 98 ELSE c_nationkey END AS resource_db",
    "lower(c_mktsegment) AS collection", "CASE WHEN c_custkey % 71 = 0 THEN 'bad action' ELSE 'act' || CAST(c_custkey AS STRING) END AS action", where="c_nationkey % 4 <> 1",
)
ROLES = project("nation", "n_nationkey AS db", "'role_' || CAST(n_nationkey % 7 AS STRING) AS source", "'r' || CAST(n_nationkey AS STRING) AS target")


@query(
    "normalize_roles",
    f"""WITH j AS (SELECT m.db, m.target AS target_role, p.collection, p.action, p.role IS NOT NULL AS there, CASE WHEN p.role IS NULL THEN 'role is missing' WHEN p.resource_db <> p.db THEN 'privilege leaves the database'
      WHEN contains(p.action, ' ') THEN 'action is invalid' END AS error FROM {ROLES.sql} m LEFT JOIN {ROLE_PRIVILEGES.sql} p ON p.db = m.db AND p.role = m.source),
    c AS (SELECT db, target_role, collection, action, count(*) FILTER (there) AS n, min(error) AS error FROM j GROUP BY ALL)
    SELECT db, target_role, coalesce(string_agg(collection || ':' || action, ',' ORDER BY collection || ':' || action) FILTER (n > 0), '') AS privileges,
      min(coalesce(error, CASE WHEN n > 1 THEN 'action is repeated' END)) AS error FROM c GROUP BY db, target_role""",
)
def normalize_roles(spark, sf):
    return op.normalize_roles(ROLE_PRIVILEGES.frame(spark, sf), ROLES.frame(spark, sf), "source")


_OBJECT = ("c_nationkey AS db", "c_name AS name", "'u' || CAST(c_custkey % 500 AS STRING) AS definer")
OBJECTS = {
    kind: project("customer", *_OBJECT, where=f"c_custkey % 4 = {i}") for i, kind in enumerate(("event", "routine", "trigger", "view"))
}


@query(
    "object_inventory",
    "SELECT o.db, kind, name, definer, m.target AS mapped_definer, CASE WHEN m.target IS NULL THEN 'definer is not mapped' END AS error FROM ("
    + " UNION ALL ".join(f"SELECT *, '{k}' AS kind FROM {o.sql}" for k, o in OBJECTS.items())
    + f") o LEFT JOIN {USER_MAP.sql} m ON m.db = o.db AND m.source = o.definer",
)
def object_inventory(spark, sf):
    return op.object_inventory([(k, o.frame(spark, sf)) for k, o in OBJECTS.items()], USER_MAP.frame(spark, sf))


_ENGINE = "CASE p_partkey % 6 WHEN 0 THEN 'mysql' WHEN 1 THEN 'mariadb' WHEN 2 THEN 'postgresql' WHEN 3 THEN 'mongodb' WHEN 4 THEN 'redis' ELSE 'valkey' END"
PAIRS = project(
    "part", "p_partkey AS pair_id", f"{_ENGINE} AS s_engine",
    f"CASE WHEN p_size % 9 = 0 THEN 'mysql' WHEN p_size % 9 = 1 THEN 'redis' ELSE {_ENGINE} END AS t_engine",
    "CAST(CASE WHEN p_partkey % 6 = 2 THEN 13 + p_size % 5 ELSE 5 + p_size % 4 END AS INT) AS s_major", "CAST(CASE WHEN p_partkey % 6 = 2 THEN 15 + p_size % 4 ELSE 5 + p_size % 4 + p_size % 5 DIV 4 END AS INT) AS t_major",
    "CASE WHEN p_size % 2 = 0 THEN '8.0' ELSE '8.4' END AS s_series", "CASE WHEN p_size % 3 = 0 THEN '8.0' WHEN p_size % 2 = 0 THEN '8.0' ELSE '8.4' END AS t_series",
    "'utf8mb4' AS s_charset", "CASE WHEN p_size % 11 = 0 THEN 'latin1' ELSE 'utf8mb4' END AS t_charset", "'ci' AS s_collation", "'ci' AS t_collation",
    "'STRICT_TRANS_TABLES, no_zero_date' AS s_sql_mode", "CASE WHEN p_size % 7 = 0 THEN ' ' ELSE 'NO_ZERO_DATE,strict_trans_tables' END AS t_sql_mode",
    "'aof' AS s_persistence", "CASE WHEN p_size % 5 = 0 THEN 'rdb' ELSE 'aof' END AS t_persistence",
    "ARR('pgcrypto@1.3', 'citext@1.6') AS s_extensions", "CASE WHEN p_size % 4 = 0 THEN ARR('citext@1.6') ELSE ARR('pgcrypto@1.3', 'citext@1.6', 'hstore@1.8') END AS t_extensions",
)


@query(
    "compatible",
    f"""SELECT pair_id, refusal, refusal IS NULL AS compatible FROM (SELECT pair_id, CASE
      WHEN s_engine IN ('mysql', 'mariadb') AND t_engine IN ('mysql', 'mariadb') THEN CASE WHEN s_charset <> t_charset THEN 'character set'
        WHEN s_engine = t_engine AND (s_series <> t_series OR s_collation <> t_collation OR t_sql_mode = ' ') THEN 'series, collation or SQL mode' END
      WHEN s_engine <> t_engine THEN 'engine'
      WHEN s_engine = 'postgresql' THEN CASE WHEN s_major NOT BETWEEN 14 AND 17 OR t_major < s_major OR t_major > 17 THEN 'major version' WHEN len(t_extensions) = 1 THEN 'extensions: pgcrypto@1.3' END
      WHEN s_engine = 'mongodb' THEN CASE WHEN s_major NOT BETWEEN 6 AND 8 OR s_major <> t_major OR s_series <> t_series THEN 'version' END
      WHEN s_series <> t_series OR s_persistence <> t_persistence THEN 'series or persistence' END AS refusal FROM {PAIRS.sql})""",
)
def compatible(spark, sf):
    return op.compatible(PAIRS.frame(spark, sf)).select("pair_id", "refusal", "compatible")


TABLES = project(
    "part", "p_brand AS db", "'t' || CAST(p_partkey AS STRING) AS table_name", "CASE p_size % 10 WHEN 0 THEN 'p' WHEN 1 THEN 'm' ELSE 'r' END AS kind",
    "CASE WHEN p_size % 7 = 0 THEN 'u' ELSE 'p' END AS persistence", "p_size % 13 = 0 AS is_partition", "p_size % 11 = 0 AS row_security", "p_size % 17 = 0 AS extension_owned",
)
PRIMARY_KEYS = project("part", "p_brand AS db", "'t' || CAST(p_partkey AS STRING) AS table_name", where="p_partkey % 8 <> 3")
COLUMNS = project("part", "p_brand AS db", "'t' || CAST(p_partkey AS STRING) AS table_name", "p_partkey % 6 = 2 AS generated")


@query(
    "replication_eligible",
    f"""SELECT db, table_name, reason, reason IS NULL AS eligible FROM (SELECT *, CASE WHEN kind <> 'r' THEN 'not an ordinary table' WHEN persistence <> 'p' THEN 'not permanent' WHEN is_partition THEN 'partition'
      WHEN row_security THEN 'row security' WHEN NOT EXISTS (SELECT 1 FROM {PRIMARY_KEYS.sql} p WHERE p.db = t.db AND p.table_name = t.table_name) THEN 'no primary key'
      WHEN EXISTS (SELECT 1 FROM {COLUMNS.sql} c WHERE c.db = t.db AND c.table_name = t.table_name AND generated) THEN 'generated column' WHEN extension_owned THEN 'owned by an extension' END AS reason FROM {TABLES.sql} t)""",
)
def replication_eligible(spark, sf):
    out = op.replication_eligible(TABLES.frame(spark, sf), PRIMARY_KEYS.frame(spark, sf), COLUMNS.frame(spark, sf))
    return out.select("db", "table_name", "reason", "eligible")


SERVICES = project(
    "part", "p_brand AS project_id", "CASE WHEN p_size % 9 = 0 THEN 'Bad Name' ELSE 'svc-' || CAST(p_partkey AS STRING) END AS service",
    "CASE WHEN p_size % 8 = 0 THEN 'nginx:latest' ELSE 'registry/app@sha256:' || sha2(p_name, 256) END AS image",
    "CASE p_size % 7 WHEN 0 THEN 'root' WHEN 1 THEN '0:10' WHEN 2 THEN '' ELSE '1000:1000' END AS user", "p_size % 6 <> 0 AS read_only", "p_size % 10 <> 3 AS init",
    "p_size * 20 - 10 AS pids_limit", "CASE p_size % 5 WHEN 0 THEN '0.01' WHEN 1 THEN 'two' ELSE '1.5' END AS cpus", "CASE p_size % 4 WHEN 0 THEN '8M' WHEN 1 THEN ' 1GB' WHEN 2 THEN '65g' ELSE '512mb' END AS mem_limit",
    "CASE WHEN p_size % 12 = 0 THEN ARR('NET_RAW') ELSE ARR('ALL') END AS cap_drop", "CASE WHEN p_size % 14 = 0 THEN ARR('x') ELSE ARR('no-new-privileges:true') END AS security_opt",
    "CASE WHEN p_size % 15 = 0 THEN 'always' ELSE 'no' END AS restart", "CASE WHEN p_size % 16 = 0 THEN ARR('80:80') END AS ports",
)
DECLARED = project("part", "p_brand AS project_id", "CASE WHEN p_size % 2 = 0 THEN 'volume' ELSE 'secret' END AS kind", "'n' || CAST(p_partkey % 90 AS STRING) AS name", where="p_partkey % 3 = 0")
USED = project("part", "p_brand AS project_id", "'svc-' || CAST(p_partkey AS STRING) AS service", "CASE WHEN p_size % 2 = 0 THEN 'volume' ELSE 'secret' END AS kind", "'n' || CAST(p_partkey % 80 AS STRING) AS name", where="p_partkey % 3 <> 1")
NETWORKS = project(
    "part", "p_brand AS project_id", "'net' || CAST(p_partkey AS STRING) AS name",
    "CASE p_size % 8 WHEN 0 THEN '8.8.8.0/24' WHEN 1 THEN '10.0.0.0/16' WHEN 2 THEN '192.168.300.0/24' ELSE '10.1.' || CAST(p_size AS STRING) || '.0/24' END AS subnet",
    "'10.1.' || CAST(p_size AS STRING) || '.' || CASE WHEN p_partkey % 5 = 0 THEN '2' ELSE '1' END AS gateway", "p_partkey % 11 <> 0 AS internal",
)
ATTACHMENTS = project(
    "part", "p_brand AS project_id", "'svc-' || CAST(p_partkey AS STRING) AS service", "'net' || CAST(p_partkey AS STRING) AS name",
    "'10.1.' || CAST(p_size AS STRING) || '.' || CAST(p_partkey % 270 AS STRING) AS address",
)
SERVICES_SQL = SERVICES.sql.replace("sha2(p_name, 256)", "sha256(p_name)")
_PRIVATE_BASE = "regexp_full_match(subnet, '10\\.1\\.[0-9]+\\.0/24')"


@query(
    "publishable_container",
    f"""WITH s AS (SELECT project_id, service, unnest(list_filter([CASE WHEN service = 'Bad Name' THEN 'name' END, CASE WHEN image = 'nginx:latest' THEN 'image is not pinned' END, CASE WHEN user IN ('', 'root', '0:10') THEN 'runs as root' END,
        CASE WHEN NOT read_only THEN 'root filesystem is writable' END, CASE WHEN NOT init THEN 'no init' END, CASE WHEN pids_limit NOT BETWEEN 16 AND 4096 THEN 'pids limit' END, CASE WHEN cpus <> '1.5' THEN 'cpu limit' END,
        CASE WHEN mem_limit IN ('8M', '65g') THEN 'memory limit' END, CASE WHEN cap_drop <> ['ALL'] THEN 'capabilities' END, CASE WHEN security_opt = ['x'] THEN 'new privileges' END, CASE WHEN restart = 'always' THEN 'restart policy' END,
        CASE WHEN ports IS NOT NULL THEN 'published ports' END], lambda v: v IS NOT NULL)) AS violation FROM {SERVICES_SQL}),
    r AS (SELECT project_id, service, 'undeclared ' || kind || ' ' || name AS violation FROM {USED.sql} u WHERE NOT EXISTS (SELECT 1 FROM {DECLARED.sql} d WHERE d.project_id = u.project_id AND d.kind = u.kind AND d.name = u.name)
      UNION ALL SELECT project_id, '', 'unused ' || kind || ' ' || name FROM {DECLARED.sql} d WHERE NOT EXISTS (SELECT 1 FROM {USED.sql} u WHERE d.project_id = u.project_id AND d.kind = u.kind AND d.name = u.name)),
    n AS (SELECT *, {_PRIVATE_BASE} AS fine, split_part(subnet, '.', 3) AS third FROM {NETWORKS.sql}),
    v AS (SELECT project_id, '' AS service, 'network is not internal' AS violation FROM n WHERE NOT internal UNION ALL SELECT project_id, '', 'subnet' FROM n WHERE NOT fine
      UNION ALL SELECT project_id, '', 'gateway' FROM n WHERE fine AND gateway <> '10.1.' || third || '.1' UNION ALL SELECT project_id, '', 'duplicate subnet' FROM n GROUP BY project_id, subnet HAVING count(*) > 1
      UNION ALL SELECT a.project_id, a.service, 'address outside its network' FROM {ATTACHMENTS.sql} a JOIN n ON n.project_id = a.project_id AND n.name = a.name
        WHERE NOT (n.fine AND split_part(a.address, '.', 3) = n.third AND CAST(split_part(a.address, '.', 4) AS INT) BETWEEN 2 AND 254)
      UNION ALL SELECT project_id, '', 'duplicate address' FROM {ATTACHMENTS.sql} GROUP BY project_id, address HAVING count(*) > 1)
    SELECT * FROM s UNION ALL SELECT * FROM r UNION ALL SELECT * FROM v""",
)
def publishable_container(spark, sf):
    return op.publishable_container(*[x.frame(spark, sf) for x in (SERVICES, DECLARED, USED, NETWORKS, ATTACHMENTS)])


# every project breaks each rule somewhere, some projects the bounds
RESOURCES = project(
    "part", "p_brand AS project_id", "CASE p_size % 3 WHEN 0 THEN 'network' WHEN 1 THEN 'volume' ELSE 'secret' END AS kind", "CASE WHEN p_partkey % 23 = 0 THEN 'Bad' ELSE 'n' || CAST(p_partkey AS STRING) END AS name",
    "CASE p_partkey % 7 WHEN 0 THEN 'overlay' WHEN 1 THEN 'bridge' WHEN 2 THEN 'local' ELSE '' END AS driver",
    "CASE WHEN p_size % 3 = 2 THEN CASE p_partkey % 5 WHEN 0 THEN '/run/agent/migration-secrets/p1/other' WHEN 1 THEN '/etc/n' || CAST(p_partkey AS STRING) ELSE '/run/agent/migration-secrets/p1/n' || CAST(p_partkey AS STRING) END END AS file",
)
DEPENDENCIES = project(
    "part", "p_brand AS project_id", "'svc-' || CAST(p_partkey AS STRING) AS service", "CASE p_partkey % 4 WHEN 0 THEN 'svc-' || CAST(p_partkey AS STRING) WHEN 1 THEN 'Bad!' ELSE 'svc-none' END AS dependency",
    "CASE p_partkey % 3 WHEN 0 THEN 'service_healthy' WHEN 1 THEN 'service_completed' ELSE '' END AS condition", "p_partkey % 11 = 0 AS restart",
)
ENVIRONMENT = project(
    "part", "p_brand AS project_id", "'svc-' || CAST(p_partkey AS STRING) AS service",
    "CASE p_partkey % 6 WHEN 0 THEN 'lower' WHEN 1 THEN 'DB_PASSWORD' WHEN 2 THEN 'DB_PASSWORD_FILE' WHEN 3 THEN 'PLAIN' ELSE 'OTHER' END AS k",
    "CASE p_partkey % 6 WHEN 2 THEN '/run/secrets/n' || CAST(p_partkey % 80 AS STRING) WHEN 3 THEN 'a$' || '{b}' ELSE 'v' END AS v",
)
SETTINGS = project(
    "part", "p_brand AS project_id", "'svc-' || CAST(p_partkey AS STRING) AS service", "CASE p_partkey % 5 WHEN 0 THEN '0s' WHEN 1 THEN '10s' WHEN 2 THEN '1m' ELSE '' END AS stop_grace_period",
    "CASE p_partkey % 4 WHEN 0 THEN ARR('/tmp/a:size=1m', '/tmp/../b') WHEN 1 THEN ARR('/tmp') END AS tmpfs",
    "CASE p_partkey % 8 WHEN 0 THEN ARR('data:/var/lib/x:rw') WHEN 1 THEN ARR('./a/../b:/x', '../up:/x') WHEN 2 THEN ARR('/abs:/x') WHEN 3 THEN ARR('a/..:/x') WHEN 4 THEN ARR('rel/dir:/x:ro') WHEN 5 THEN ARR('one') WHEN 6 THEN ARR('data:/x:z') ELSE ARR('data:/x/') END AS volumes",
    "CASE p_partkey % 9 WHEN 0 THEN 'json-file' WHEN 1 THEN 'syslog' WHEN 2 THEN 'json-file' END AS log_driver", "CASE p_partkey % 9 WHEN 2 THEN '10m' ELSE '' END AS log_size",
)


@query(
    "container_policy_rules",
    f"""WITH s AS (SELECT project_id, service FROM {SERVICES_SQL}), r AS (SELECT * FROM {RESOURCES.sql}), a AS (SELECT * FROM {ATTACHMENTS.sql}),
    c AS (SELECT project_id, (SELECT count(*) FROM s WHERE s.project_id = p.project_id) AS services, count(*) FILTER (kind = 'network') AS networks, count(*) FILTER (kind = 'volume') AS volumes,
      count(*) FILTER (kind = 'secret') AS secrets FROM r p GROUP BY project_id),
    v AS (SELECT project_id, '' AS service, unnest([CASE WHEN name = 'Bad' THEN 'bad name of ' || kind || ' ' || name END,
        CASE WHEN driver NOT IN ('', CASE kind WHEN 'network' THEN 'bridge' WHEN 'volume' THEN 'local' ELSE '' END) THEN 'driver of ' || kind || ' ' || name END,
        CASE WHEN kind = 'secret' AND file <> '/run/agent/migration-secrets/p1/' || name THEN 'file of ' || kind || ' ' || name END]) AS violation FROM r
      UNION ALL SELECT project_id, '', unnest([CASE WHEN services NOT BETWEEN 1 AND 64 THEN 'number of services' END, CASE WHEN networks NOT BETWEEN 1 AND 16 THEN 'number of networks' END,
        CASE WHEN volumes > 64 THEN 'number of volumes' END, CASE WHEN secrets > 32 THEN 'number of secrets' END]) FROM c
      UNION ALL SELECT project_id, service, unnest([CASE WHEN dependency = 'Bad!' OR condition = 'service_completed' OR restart THEN 'policy of dependency ' || dependency END,
        CASE WHEN (project_id, dependency) NOT IN (SELECT (project_id, service) FROM s) THEN 'unknown dependency ' || dependency END]) FROM {DEPENDENCIES.sql}
      UNION ALL SELECT project_id, service, CASE WHEN k = 'lower' THEN 'environment: invalid entry' WHEN k = 'DB_PASSWORD' THEN 'environment: secret-shaped'
        WHEN k = 'DB_PASSWORD_FILE' AND NOT EXISTS (SELECT 1 FROM {USED.sql} u WHERE u.project_id = e.project_id AND u.service = e.service AND u.kind = 'secret' AND '/run/secrets/' || u.name = e.v) THEN 'environment: secret-shaped'
        WHEN k = 'PLAIN' THEN 'environment: interpolation' END FROM {ENVIRONMENT.sql} e
      UNION ALL SELECT project_id, service, unnest([CASE WHEN stop_grace_period IN ('0s', '1m') THEN 'stop grace period' END, CASE WHEN len(tmpfs) = 2 THEN 'temporary folder' END,
        CASE WHEN volumes[1] NOT IN ('data:/var/lib/x:rw', 'rel/dir:/x:ro') THEN 'mount' END, CASE WHEN log_driver = 'syslog' OR (log_driver = 'json-file' AND log_size = '') THEN 'logging' END]) FROM {SETTINGS.sql}
      UNION ALL SELECT project_id, service, 'no network' FROM s WHERE (project_id, service) NOT IN (SELECT (project_id, service) FROM a)
      UNION ALL SELECT a.project_id, a.service, 'unknown network ' || a.name FROM a WHERE (a.project_id, a.name) NOT IN (SELECT (project_id, name) FROM {NETWORKS.sql}))
    SELECT project_id, service, violation FROM v WHERE violation IS NOT NULL""",
)
def container_policy_rules(spark, sf):
    services, used, networks, attachments = (x.frame(spark, sf) for x in (SERVICES, USED, NETWORKS, ATTACHMENTS))
    environment = ENVIRONMENT.frame(spark, sf).select("project_id", "service", F.create_map("k", "v").alias("env"))
    options = F.create_map(F.lit("max-size"), F.col("log_size"), F.lit("max-file"), F.lit("3"))
    settings = SETTINGS.frame(spark, sf).withColumn("log_options", options)
    rules = [
        op.resource_violations(services, RESOURCES.frame(spark, sf)), op.dependency_violations(services, DEPENDENCIES.frame(spark, sf)),
        op.environment_violations(environment, used), op.runtime_violations(settings), op.attachment_violations(services, networks, attachments),
    ]
    return reduce(lambda a, b: a.unionByName(b), rules)


MAPPINGS = project(
    "part", "p_brand AS contract_id", "p_partkey AS ord", "CASE p_size % 12 WHEN 0 THEN 'template1' WHEN 1 THEN 'bad name' ELSE 'db' || CAST(p_partkey % 1900 AS STRING) END AS source",
    "CASE p_size % 10 WHEN 0 THEN 'live_' ELSE 'mig_' END || CAST(p_partkey AS STRING) AS target",
)
BOUND = project(
    MAPPINGS, "contract_id", "CASE WHEN ord % 30 = 7 THEN ord + 100000 ELSE ord END AS ord", "'source' AS mode", "source AS database",
)
BOUND_TARGET = project(MAPPINGS, "contract_id", "ord", "'target' AS mode", "CASE WHEN ord % 45 = 2 THEN 'mig_other' ELSE target END AS database")


@query(
    "database_pairs",
    f"""WITH m AS {MAPPINGS.sql}, b AS {BOUND.sql}, t AS {BOUND_TARGET.sql},
    j AS (SELECT coalesce(m.contract_id, b.contract_id, t.contract_id) AS contract_id, coalesce(m.ord, b.ord, t.ord) AS ord, m.source, m.target, b.database AS bs, t.database AS bt
      FROM m FULL JOIN b ON m.contract_id = b.contract_id AND m.ord = b.ord FULL JOIN t ON t.contract_id = m.contract_id AND t.ord = m.ord)
    SELECT contract_id, ord, problem FROM (SELECT contract_id, ord, CASE WHEN source IS NULL THEN 'more databases than mappings' WHEN contains(source, ' ') THEN 'name' WHEN source = 'template1' THEN 'system database'
      WHEN target LIKE 'live%' THEN 'target prefix' WHEN source IS DISTINCT FROM bs THEN 'source order' WHEN target IS DISTINCT FROM bt THEN 'target order' END AS problem FROM j) WHERE problem IS NOT NULL
    UNION ALL SELECT contract_id, max(ord), 'duplicate source' FROM m GROUP BY contract_id, source HAVING count(*) > 1 UNION ALL SELECT contract_id, max(ord), 'duplicate target' FROM m GROUP BY contract_id, target HAVING count(*) > 1""",
)
def database_pairs(spark, sf):
    bound = BOUND.frame(spark, sf).unionByName(BOUND_TARGET.frame(spark, sf))
    return op.database_pairs(MAPPINGS.frame(spark, sf), bound, "mig_")


SETS = project(
    "part", "p_partkey DIV 8 AS set_id", "p_partkey % 8 AS ord",
    "CASE WHEN p_size % 37 = 0 THEN 'no version' ELSE 'e' || CAST(CASE WHEN p_partkey % 29 = 0 THEN 0 ELSE p_partkey % 8 END AS STRING) || '@1.' || CAST(p_size AS STRING) END AS value",
)


@query(
    "canonical_set",
    f"""WITH l AS (SELECT *, lag(value) OVER (PARTITION BY set_id ORDER BY ord) AS previous FROM {SETS.sql}),
    g AS (SELECT set_id, count(*) AS entries, count(*) FILTER (value = 'no version' OR value <= previous) = 0 AS ordered FROM l GROUP BY set_id) SELECT *, ordered AND entries <= 128 AS canonical FROM g""",
)
def canonical_set(spark, sf):
    return op.canonical_set(SETS.frame(spark, sf))
