"""Grants, roles, identities and compatibility rules of migrated databases."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import rules
from fleetlens.functions.spread import spread_join
from fleetlens.operators.redaction import secret_shaped_env

# Name patterns and system accounts.
ROLE_NAME = r"^[A-Za-z_][A-Za-z0-9_]{0,62}\z"
EXTENSION = r"^[A-Za-z0-9][A-Za-z0-9_-]{0,62}@[A-Za-z0-9][A-Za-z0-9_.+~-]{0,127}\z"
PRINCIPAL = r"^[A-Za-z_][A-Za-z0-9_.-]{0,127}\z"
RESERVED_TARGET = r"^(root|mariadb\.sys|mysql\..*)\z"
SYSTEM_DATABASES = ("postgres", "template0", "template1")


def map_principals(grants: DataFrame, role_map: DataFrame, owners: DataFrame) -> DataFrame:
    """Grants with the target's role names, or an error.

    ``grants``: ``db, grantee, ...``; ``role_map``: ``db, source_role,
    target_role``; ``owners``: ``db, owner``.
    """
    mapping = role_map.select("db", F.col("source_role").alias("grantee"), "target_role")
    by = [c for c in grants.columns if c not in ("db", "grantee")]
    joined = spread_join(grants, mapping, ["db", "grantee"], by, "left")
    joined = spread_join(joined, owners.select("db", "owner"), ["db"], ["grantee", *by], "left")
    role = F.col("grantee")
    plain = role.rlike(ROLE_NAME) & ~role.startswith("pg_")
    principal = (
        F.when(role == "PUBLIC", role).when(role == "pg_database_owner", F.col("owner")).when(plain, F.col("target_role"))
    )
    error = F.when(~role.isin("PUBLIC", "pg_database_owner"), F.when(~plain, "unsupported role").when(F.col("target_role").isNull(), "missing from the role map"))
    return joined.withColumns({"principal": principal, "error": error}).drop("target_role", "owner")


def fold_grants(grants: DataFrame) -> DataFrame:
    """Merge grants that mapping made equal; grantable if any of them was."""
    keys = ["db", "object_type", "schema_name", "object_name", "principal", "privilege"]
    return grants.groupBy(*keys).agg(F.bool_or("grantable").alias("grantable")).orderBy(*keys)


def grant_inventory(database: DataFrame, table: DataFrame, column: DataFrame, routine: DataFrame) -> DataFrame:
    """Grants of all scopes in one relation.

    The first three hold one privilege a row and ``is_grantable``; a routine
    row holds a list in which ``Grant`` stands for the flag.
    """
    def plain(df: DataFrame, scope: str, *names: Column) -> DataFrame:
        object_name, column_name = names
        return df.select(
            "db", F.lit(scope).alias("scope"), "grantee", object_name.alias("object_name"), column_name.alias("column_name"),
            F.upper("privilege").alias("privilege"), (F.upper("is_grantable") == "YES").alias("grantable"),
        )

    none = F.lit("")
    items = F.transform(F.split("privileges", ","), lambda p: F.trim(p))
    listed = routine.select(
        "db", F.lit("routine").alias("scope"), "grantee", F.concat_ws(":", F.lower("routine_type"), "routine_name").alias("object_name"),
        none.alias("column_name"), F.explode(F.filter(items, lambda p: (p != "") & (F.lower(p) != "grant"))).alias("privilege"),
        F.exists(items, lambda p: F.lower(p) == "grant").alias("grantable"),
    ).withColumn("privilege", F.upper("privilege"))
    parts = [
        plain(database, "database", none, none),
        plain(table, "table", F.col("table_name"), none),
        plain(column, "column", F.col("table_name"), F.col("column_name")),
        listed,
    ]
    return reduce(DataFrame.unionByName, parts)


def privilege_allowed(grants: DataFrame) -> DataFrame:
    """Add whether a privilege exists for its object type; the list has 13 rows."""
    allowed = F.broadcast(rules.object_privileges(grants.sparkSession).withColumn("allowed", F.lit(True)))
    return grants.join(allowed, ["object_type", "privilege"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def map_is_one_to_one(mapping: DataFrame, demand_order: bool = False, reserved: str = RESERVED_TARGET) -> DataFrame:
    """Problems of each binding's account map (``binding_id, ord, source, target``).

    ``ord`` counts without gaps; order is checked by joining neighbours.
    """
    def repeats(col: str) -> DataFrame:
        n = mapping.groupBy("binding_id", col).agg(F.count("*").alias("n")).filter("n > 1")
        return n.select("binding_id", F.lit(f"duplicate {col}").alias("problem"), F.col(col).alias("account"))

    problems = [
        repeats("source"), repeats("target"),
        mapping.filter(F.lower("target").rlike(reserved)).select("binding_id", F.lit("reserved target").alias("problem"), F.col("target").alias("account")),
    ]
    if demand_order:
        before = mapping.select("binding_id", (F.col("ord") + 1).alias("ord"), F.col("source").alias("previous"))
        problems.append(
            mapping.join(before, ["binding_id", "ord"]).filter("source <= previous")
            .select("binding_id", F.lit("not sorted").alias("problem"), F.col("source").alias("account"))
        )
    return reduce(DataFrame.unionByName, problems)


def normalize_users(users: DataFrame, role_map: DataFrame, user_map: DataFrame) -> DataFrame:
    """Mapped users with their mapped roles.

    ``users``: ``db, user, role, role_db`` (one row per assignment, role null
    for none); maps: ``db, source, target``.
    """
    assigned = user_map.select("db", F.col("source").alias("user"), F.col("target").alias("target_user")).join(
        users.withColumn("there", F.lit(True)), ["db", "user"], "left"
    )
    roles = role_map.select("db", F.col("source").alias("role"), F.col("target").alias("target_role"))
    joined = assigned.join(roles, ["db", "role"], "left")
    has_role = F.col("role").isNotNull()
    error = (
        F.when(F.col("there").isNull(), "user is missing")
        .when(has_role & (F.col("role_db") != F.col("db")), "cross-database role")
        .when(has_role & F.col("target_role").isNull(), "role is not mapped")
    )
    return joined.withColumn("error", error).groupBy("db", "target_user").agg(
        F.array_join(F.array_sort(F.collect_set("target_role")), ",").alias("roles"), F.min("error").alias("error")
    )


def normalize_roles(privileges: DataFrame, role_map: DataFrame, mode: str) -> DataFrame:
    """Mapped roles with their privileges in order.

    ``privileges``: ``db, role, resource_db, collection, action``.  On the
    target a missing role is an empty entry, on the source an error.
    """
    lookup = "target" if mode == "target" else "source"
    mapped = role_map.select("db", F.col(lookup).alias("role"), F.col("target").alias("target_role"))
    joined = mapped.join(privileges.withColumn("there", F.lit(True)), ["db", "role"], "left")
    known = F.col("there").isNotNull()
    error = F.when(~known, None if mode == "target" else "role is missing").when(
        known & ((F.col("resource_db") != F.col("db")) | F.col("collection").isNull()), "privilege leaves the database"
    ).when(known & ~F.col("action").rlike(PRINCIPAL), "action is invalid")
    keys = ["db", "target_role"]
    per_action = joined.withColumn("error", error).groupBy(*keys, "collection", "action").agg(
        F.min("error").alias("error"), F.count("there").alias("n")
    )
    repeated = F.when(F.col("n") > 1, "action is repeated")
    per_action = per_action.withColumn("error", F.coalesce("error", repeated))
    granted = F.when(F.col("n") > 0, F.concat_ws(":", "collection", "action"))
    return per_action.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_set(granted)), ",").alias("privileges"), F.min("error").alias("error")
    )


def object_inventory(objects: Sequence[tuple[str, DataFrame]], account_map: DataFrame) -> DataFrame:
    """Views, triggers, routines and events with mapped definers, by kind and name.

    Each part: ``db, name, definer``; ``account_map``: ``db, source, target``.
    """
    named = [df.select("db", F.lit(kind).alias("kind"), "name", "definer") for kind, df in objects]
    mapping = account_map.select("db", F.col("source").alias("definer"), F.col("target").alias("mapped_definer"))
    joined = reduce(DataFrame.unionByName, named).join(mapping, ["db", "definer"], "left")
    error = F.when(F.col("mapped_definer").isNull(), "definer is not mapped")
    return joined.withColumn("error", error).orderBy("db", "kind", "name")


def canonical_sql_mode(mode: Column) -> Column:
    parts = F.transform(F.split(mode, ","), lambda p: F.upper(F.trim(p)))
    return F.when(F.trim(mode) == "", "").otherwise(F.array_join(F.array_sort(parts), ","))


def compatible(pairs: DataFrame) -> DataFrame:
    """Whether a target can take a source, and why not.

    Input: ``pair_id`` and, for both sides (``s_``/``t_``): ``engine, major,
    series, charset, collation, sql_mode, persistence``; further
    ``s_extensions`` and ``t_extensions`` (arrays of ``name@version``).
    """
    s, t = F.col("s_engine"), F.col("t_engine")
    sql = ("mysql", "mariadb")
    mysql = F.when(F.col("s_charset") != F.col("t_charset"), "character set").when(
        s == t,
        F.when(
            (F.col("s_series") != F.col("t_series")) | (F.col("s_collation") != F.col("t_collation"))
            | (canonical_sql_mode(F.col("s_sql_mode")) != canonical_sql_mode(F.col("t_sql_mode"))),
            "series, collation or SQL mode",
        ),
    )
    missing = F.array_except("s_extensions", "t_extensions")
    postgres = F.when(
        ~F.col("s_major").between(14, 17) | (F.col("t_major") < F.col("s_major")) | (F.col("t_major") > 17), "major version"
    ).when(F.size(missing) > 0, F.concat(F.lit("extensions: "), F.array_join(F.array_sort(missing), ",")))
    mongo = F.when(~F.col("s_major").between(6, 8) | (F.col("t_major") != F.col("s_major")) | (F.col("s_series") != F.col("t_series")), "version")
    redis = F.when((F.col("s_series") != F.col("t_series")) | (F.col("s_persistence") != F.col("t_persistence")), "series or persistence")
    refusal = (
        F.when(s.isin(*sql) & t.isin(*sql), mysql)
        .when(s != t, "engine")
        .when(s == "postgresql", postgres)
        .when(s == "mongodb", mongo)
        .when(s.isin("redis", "valkey"), redis)
        .otherwise("engine")
    )
    return pairs.withColumns({"refusal": refusal, "compatible": refusal.isNull()})


def replication_eligible(tables: DataFrame, primary_keys: DataFrame, columns: DataFrame) -> DataFrame:
    """First reason a table cannot be replicated logically, null when it can.

    ``tables``: ``db, table_name, kind, persistence, is_partition,
    row_security, extension_owned``; ``primary_keys``: ``db, table_name``;
    ``columns``: ``db, table_name, generated``.
    """
    keys = ["db", "table_name"]
    pk = primary_keys.select(*keys).distinct().withColumn("pk", F.lit(True))
    generated = columns.filter("generated").select(*keys).distinct().withColumn("generated", F.lit(True))
    joined = tables.join(pk, keys, "left").join(generated, keys, "left")
    reason = (
        F.when(F.col("kind") != "r", "not an ordinary table")
        .when(F.col("persistence") != "p", "not permanent")
        .when(F.col("is_partition"), "partition")
        .when(F.col("row_security"), "row security")
        .when(F.col("pk").isNull(), "no primary key")
        .when(F.col("generated").isNotNull(), "generated column")
        .when(F.col("extension_owned"), "owned by an extension")
    )
    return joined.withColumns({"reason": reason, "eligible": reason.isNull()}).drop("pk", "generated")


# What a container may be named, run and mount.
CONTAINER_NAME = r"^[a-z0-9][a-z0-9_-]{1,62}\z"
PINNED_IMAGE = r"^[A-Za-z0-9][A-Za-z0-9._/:@-]{1,255}@sha256:[a-f0-9]{64}\z"
PRIVATE_IPV4 = r"^(10\.[0-9]{1,3}|192\.168|172\.(1[6-9]|2[0-9]|3[01]))\."
IPV4 = r"^((25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.|$)){4}\z"


def memory_mib(text: Column) -> Column:
    """Memory limit in MiB, null when it is malformed."""
    lower = F.lower(F.trim(text))
    number = F.regexp_extract(lower, "^([0-9]+)(m|mb|g|gb)$", 1).try_cast("long")
    return number * F.when(lower.rlike("gb?$"), 1024).otherwise(1)


def service_violations(services: DataFrame) -> DataFrame:
    """All rules a container service breaks on its own.

    Input: ``project_id, service, image, user, read_only, init, pids_limit,
    cpus, mem_limit, cap_drop, security_opt, restart, ports`` (arrays for the
    two lists and ports).
    """
    user = F.coalesce("user", F.lit(""))
    cpus, mem = F.col("cpus").try_cast("double"), memory_mib(F.col("mem_limit"))

    def listed(ok: Column, text: str) -> Column:
        return F.when(~F.coalesce(ok, F.lit(False)), text)

    found = F.array_compact(
        F.array(
            listed(F.col("service").rlike(CONTAINER_NAME), "name"),
            listed(F.col("image").rlike(PINNED_IMAGE), "image is not pinned"),
            F.when(user.isin("", "0", "root") | user.startswith("0:"), "runs as root"),
            listed(F.col("read_only"), "root filesystem is writable"),
            listed(F.col("init"), "no init"),
            listed(F.col("pids_limit").between(16, 4096), "pids limit"),
            listed(cpus.between(0.05, 16), "cpu limit"),
            listed(mem.between(16, 65_536), "memory limit"),
            listed(F.col("cap_drop") == F.array(F.lit("ALL")), "capabilities"),
            listed(F.col("security_opt") == F.array(F.lit("no-new-privileges:true")), "new privileges"),
            listed(F.coalesce("restart", F.lit("")).isin("", "no", "on-failure"), "restart policy"),
            F.when(F.size(F.coalesce("ports", F.array().cast("array<string>"))) > 0, "published ports"),
        )
    )
    return services.select("project_id", "service", F.explode(found).alias("violation"))


def reference_violations(declared: DataFrame, used: DataFrame) -> DataFrame:
    """Resources used without declaration, or declared without use.

    ``declared``: ``project_id, kind, name``; ``used``: the same and ``service``.
    """
    keys = ["project_id", "kind", "name"]
    undeclared = used.join(declared.select(*keys), keys, "left_anti").select(
        "project_id", "service", F.concat_ws(" ", F.lit("undeclared"), "kind", "name").alias("violation")
    )
    unused = declared.join(used.select(*keys), keys, "left_anti").select(
        "project_id", F.lit("").alias("service"), F.concat_ws(" ", F.lit("unused"), "kind", "name").alias("violation")
    )
    return undeclared.unionByName(unused)


def network_violations(networks: DataFrame, attachments: DataFrame) -> DataFrame:
    """Subnets and addresses that are malformed, outside their network, or given twice.

    ``networks``: ``project_id, name, subnet, gateway, internal``;
    ``attachments``: ``project_id, service, name, address``.
    """
    base = F.regexp_extract("subnet", r"^([0-9]+\.[0-9]+\.[0-9]+)\.0/24$", 1)
    address_ok = (base != "") & F.concat(base, F.lit(".0")).rlike(IPV4) & F.concat(base, F.lit(".0")).rlike(PRIVATE_IPV4)
    checks = F.array_compact(
        F.array(
            F.when(~F.col("internal"), "network is not internal"),
            F.when(~address_ok, "subnet"),
            F.when(address_ok & (F.col("gateway") != F.concat(base, F.lit(".1"))), "gateway"),
        )
    )
    of_networks = networks.select("project_id", F.lit("").alias("service"), F.explode(checks).alias("violation"))
    twice = networks.groupBy("project_id", "subnet").agg(F.count("*").alias("n")).filter("n > 1")
    of_subnets = twice.select("project_id", F.lit("").alias("service"), F.lit("duplicate subnet").alias("violation"))
    scoped = attachments.join(networks.select("project_id", "name", base.alias("base")), ["project_id", "name"])
    last = F.regexp_extract("address", r"\.([0-9]+)$", 1).try_cast("int")
    inside = F.col("address").rlike(IPV4) & (F.regexp_replace("address", r"\.[0-9]+$", "") == F.col("base")) & ~last.isin(0, 1, 255)
    of_addresses = scoped.filter(~F.coalesce(inside, F.lit(False))).select("project_id", "service", F.lit("address outside its network").alias("violation"))
    shared = attachments.groupBy("project_id", "address").agg(F.count("*").alias("n")).filter("n > 1")
    of_shared = shared.select("project_id", F.lit("").alias("service"), F.lit("duplicate address").alias("violation"))
    return reduce(DataFrame.unionByName, [of_networks, of_subnets, of_addresses, of_shared])


# What a project may declare and how its services may run.
STOP_GRACE = r"\A[1-9][0-9]{0,2}s\z"
SECRET_FILE = r"\A/run/[a-z][a-z-]*/migration-secrets/[a-z0-9][a-z0-9_-]{1,62}/[a-z0-9][a-z0-9_-]{1,62}\z"  # a site narrows it to its own folder
CONTAINER_PATH = r"\A(?:/(?!\.\.?(?:/|\z))[^/\x00]+)+\z"
DRIVERS = {"network": "bridge", "volume": "local"}
CONDITIONS = ("", "service_started", "service_healthy")
PROJECT_BOUNDS = {"service": (1, 64), "network": (1, 16), "volume": (0, 64), "secret": (0, 32)}
LOG_OPTIONS = ("max-size", "max-file")


def _violations(df: DataFrame, found: Column, service: Column | str = "service") -> DataFrame:
    return df.select("project_id", F.col(service) if isinstance(service, str) else service.alias("service"), F.explode(F.array_compact(found)).alias("violation"))


def resource_violations(services: DataFrame, resources: DataFrame, secret_file: str = SECRET_FILE) -> DataFrame:
    """Declared networks, volumes and secrets with a bad name, driver or file, and projects that declare too many or too few.

    ``services``: ``project_id, service``; ``resources``: ``project_id, kind, name, driver, file``.
    """
    named = lambda text: F.concat_ws(" ", F.lit(text), "kind", "name")
    driver = F.coalesce("driver", F.lit(""))
    allowed = F.create_map(*[F.lit(x) for pair in DRIVERS.items() for x in pair])
    other = (driver != "") & (driver != F.coalesce(F.try_element_at(allowed, F.col("kind")), F.lit("")))
    file_ok = F.coalesce(F.col("file").rlike(secret_file) & (F.substring_index("file", "/", -1) == F.col("name")), F.lit(False))
    found = F.array(
        F.when(~F.coalesce(F.col("name").rlike(CONTAINER_NAME), F.lit(False)), named("bad name of")),
        F.when(other, named("driver of")),
        F.when((F.col("kind") == "secret") & ~file_ok, named("file of")),
    )
    kinds = services.select("project_id", F.lit("service").alias("kind")).unionByName(resources.select("project_id", "kind"))
    counts = kinds.groupBy("project_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in PROJECT_BOUNDS])
    outside = F.array(*[F.when(~F.col(k).between(*PROJECT_BOUNDS[k]), f"number of {k}s") for k in PROJECT_BOUNDS])
    return _violations(resources, found, F.lit("")).unionByName(_violations(counts, outside, F.lit("")))


def dependency_violations(services: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Dependencies on what is no service of the project, or under a policy that is not supported.

    ``dependencies``: ``project_id, service, dependency, condition, restart``.
    """
    known = services.select("project_id", F.col("service").alias("dependency")).distinct().withColumn("known", F.lit(True))
    policy_ok = F.col("dependency").rlike(CONTAINER_NAME) & F.coalesce("condition", F.lit("")).isin(*CONDITIONS) & ~F.coalesce("restart", F.lit(False))
    found = F.array(
        F.when(~F.coalesce(policy_ok, F.lit(False)), F.concat_ws(" ", F.lit("policy of dependency"), "dependency")),
        F.when(F.col("known").isNull(), F.concat_ws(" ", F.lit("unknown dependency"), "dependency")),
    )
    return _violations(dependencies.join(known, ["project_id", "dependency"], "left"), found)


def environment_violations(environment: DataFrame, used: DataFrame) -> DataFrame:
    """Environments with a bad or secret entry (:func:`~fleetlens.operators.redaction.secret_shaped_env`).

    ``environment``: ``project_id, service, env`` (a map); ``used``: as in
    :func:`reference_violations`; a service may name the files of its secrets.
    """
    secrets = used.filter("kind = 'secret'").groupBy("project_id", "service").agg(F.collect_set("name").alias("secrets"))
    joined = environment.join(secrets, ["project_id", "service"], "left")
    reason = secret_shaped_env(F.col("env"), F.coalesce("secrets", F.array().cast("array<string>")))
    return _violations(joined, F.array(F.when(reason.isNotNull(), F.concat(F.lit("environment: "), reason))))


def bind_source_ok(source: Column) -> Column:
    """Whether a relative path stays below where it starts, and is not that place itself."""
    step = lambda at, part: F.when(at < 0, at).when(part == "..", at - 1).when(part.isin("", "."), at).otherwise(at + 1)
    depth = F.aggregate(F.split(source, "/"), F.lit(0), step)
    return ~source.startswith("/") & ~source.contains("\x00") & (depth > 0)


def runtime_violations(settings: DataFrame) -> DataFrame:
    """Stop period, temporary folders, mounts and logging of a service.

    ``settings``: ``project_id, service, stop_grace_period, tmpfs, volumes``
    (arrays of ``path[:options]`` and ``source:target[:ro|rw]``)``,
    log_driver`` (null: no logging is given) and ``log_options`` (a map).
    """
    none = F.array().cast("array<string>")

    def mount_ok(v: Column) -> Column:
        parts = F.split(v, ":", -1)
        source, target, mode = (F.get(parts, F.lit(n)) for n in range(3))
        shape = F.size(parts).between(2, 3) & (source != "") & F.coalesce(mode.isin("ro", "rw"), F.lit(True))
        return shape & target.rlike(CONTAINER_PATH) & (source.rlike(CONTAINER_NAME) | bind_source_ok(source))

    period = F.coalesce("stop_grace_period", F.lit(""))
    tmpfs_ok = F.forall(F.coalesce("tmpfs", none), lambda p: F.substring_index(p, ":", 1).rlike(CONTAINER_PATH))
    mounts_ok = F.forall(F.coalesce("volumes", none), lambda v: F.coalesce(mount_ok(v), F.lit(False)))
    options = F.map_entries("log_options")
    present = [F.coalesce(F.try_element_at("log_options", F.lit(o)), F.lit("")) != "" for o in LOG_OPTIONS]
    log_ok = (F.col("log_driver") == "json-file") & reduce(lambda a, b: a & b, present) & ~F.exists(
        options, lambda e: ~e["key"].isin(*LOG_OPTIONS) | (F.octet_length(e["value"]) > 16))
    found = F.array(
        F.when((period != "") & ~period.rlike(STOP_GRACE), "stop grace period"),
        F.when(~tmpfs_ok, "temporary folder"),
        F.when(~mounts_ok, "mount"),
        F.when(F.col("log_driver").isNotNull() & ~F.coalesce(log_ok, F.lit(False)), "logging"),
    )
    return _violations(settings, found)


def attachment_violations(services: DataFrame, networks: DataFrame, attachments: DataFrame) -> DataFrame:
    """Services on no network or on one that is not declared."""
    on = attachments.select("project_id", "service")
    alone = services.join(on, ["project_id", "service"], "left_anti").select("project_id", "service", F.lit("no network").alias("violation"))
    unknown = attachments.join(networks.select("project_id", "name"), ["project_id", "name"], "left_anti")
    return alone.unionByName(unknown.select("project_id", "service", F.concat(F.lit("unknown network "), "name").alias("violation")))


def container_policy(
    services: DataFrame, resources: DataFrame, used: DataFrame, networks: DataFrame, attachments: DataFrame, dependencies: DataFrame,
    environment: DataFrame, settings: DataFrame, secret_file: str = SECRET_FILE,
) -> DataFrame:
    """Every violation of a project's whole policy: what :func:`publishable_container` finds, and the rules above."""
    declared = resources.filter("kind <> 'network'").select("project_id", "kind", "name")
    return reduce(DataFrame.unionByName, [
        publishable_container(services, declared, used, networks, attachments), resource_violations(services, resources, secret_file),
        dependency_violations(services, dependencies), environment_violations(environment, used), runtime_violations(settings),
        attachment_violations(services, networks, attachments),
    ])


def publishable_container(services: DataFrame, declared: DataFrame, used: DataFrame, networks: DataFrame, attachments: DataFrame) -> DataFrame:
    """Every violation of a project's container policy; none means publishable."""
    return reduce(
        DataFrame.unionByName,
        [service_violations(services), reference_violations(declared, used), network_violations(networks, attachments)],
    )


def database_pairs(mappings: DataFrame, bindings: DataFrame, target_prefix: str) -> DataFrame:
    """Problems of a contract's database pairs against its bindings.

    ``mappings``: ``contract_id, ord, source, target``; ``bindings``:
    ``contract_id, ord, mode, database`` with mode ``source`` or ``target``.
    """
    def of(mode: str) -> DataFrame:
        return bindings.filter(F.col("mode") == mode).select("contract_id", "ord", F.col("database").alias(f"bound_{mode}"))

    keys = ["contract_id", "ord"]
    joined = mappings.join(of("source"), keys, "full_outer").join(of("target"), keys, "full_outer")
    problem = (
        F.when(F.col("source").isNull(), "more databases than mappings")
        .when(~F.col("source").rlike(ROLE_NAME) | ~F.col("target").rlike(ROLE_NAME), "name")
        .when(F.col("source").isin(*SYSTEM_DATABASES), "system database")
        .when(~F.col("target").startswith(target_prefix), "target prefix")
        .when(~F.col("source").eqNullSafe(F.col("bound_source")), "source order")
        .when(~F.col("target").eqNullSafe(F.col("bound_target")), "target order")
    )
    rows = joined.withColumn("problem", problem).filter("problem IS NOT NULL").select("contract_id", "ord", "problem")
    repeated = [
        mappings.groupBy("contract_id", c).agg(F.count("*").alias("n"), F.max("ord").alias("ord")).filter("n > 1")
        .select("contract_id", "ord", F.lit(f"duplicate {c}").alias("problem"))
        for c in ("source", "target")
    ]
    return reduce(DataFrame.unionByName, [rows, *repeated])


def canonical_set(values: DataFrame) -> DataFrame:
    """Whether each list of ``name@version`` entries is canonical.

    Input: ``set_id, ord, value`` with ``ord`` counting without gaps: 1 to 128
    entries, strictly increasing.
    """
    before = values.select("set_id", (F.col("ord") + 1).alias("ord"), F.col("value").alias("previous"))
    joined = values.join(before, ["set_id", "ord"], "left")
    bad = ~F.col("value").rlike(EXTENSION) | F.coalesce(F.col("value") <= F.col("previous"), F.lit(False))
    return joined.groupBy("set_id").agg(
        F.count("*").alias("entries"), (F.count_if(bad) == 0).alias("ordered")
    ).withColumn("canonical", F.col("ordered") & F.col("entries").between(1, 128))
