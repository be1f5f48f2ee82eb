"""Digests and comparison of tables, keyed stores, schemas and policies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.columns import words
from fleetlens.functions.digest import (
    canonical_digest, grouped_digest, line_of, multiset_digest, multiset_parts, multiset_words,
)
from fleetlens.operators.redaction import sanitize_acl_rule

EXPIRY_TOLERANCE_MS = 2_000
#: Rows of both tables that a task of a comparison gets, on average; some tens of MB in its hash table.
ROWS_OF_A_TASK = 500_000
EMPTY_SHA256 = "sha256:e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def row_multiset_digest(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: order-independent digest of all rows, with its parts.

    Two map-side aggregates and one row to the reducer, whatever the size.
    """
    parts = df.agg(*multiset_parts(line_of(cols), "__"))
    return parts.select(multiset_digest("__").alias("digest"), *[c.alias(n) for n, c in multiset_words("__").items()])


def sample_checksum(df: DataFrame, cols: Sequence[str], n: int = 1000) -> DataFrame:
    """md5 over the n smallest row hashes, in order.

    The hashes are cut to n per partition before they meet.
    """
    hashed = df.select(F.md5(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})).alias("h"))
    smallest = hashed.orderBy("h").limit(n)
    text = F.array_join(F.array_sort(F.collect_list("h")), "")
    return smallest.agg(F.md5(text).alias("checksum"), F.count("*").alias("sampled"))


def normalize_column_type(text: Column) -> Column:
    """Lower case, no integer display width, single spaces."""
    text = F.regexp_replace(F.lower(F.trim(text)), r"\b(tinyint|smallint|mediumint|int|integer|bigint)\([0-9]+\)", "$1")
    return F.array_join(words(text), " ")


def normalize_extra(text: Column) -> Column:
    """Upper case, generated keywords in one spelling, single spaces."""
    text = F.replace(F.upper(F.trim(text)), F.lit("DEFAULT_GENERATED"), F.lit(""))
    return F.array_join(words(F.replace(text, F.lit("PERSISTENT GENERATED"), F.lit("STORED GENERATED"))), " ")


def structure_digest(columns: DataFrame, indexes: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    """Digest of each table's normalised structure.

    ``columns``: ``table_name, ordinal, column_name, data_type, column_type,
    is_nullable, character_maximum_length, numeric_precision, numeric_scale,
    datetime_precision, extra, generation``; ``indexes``: ``table_name,
    index_name, non_unique, seq, column_name, sub_part, index_type``;
    ``foreign_keys``: ``table_name,
    constraint_name, ordinal, column_name, referenced, update_rule,
    delete_rule``.  The position is part of every line, which binds the order.
    """
    def known(*names: str) -> list[Column]:
        return [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]

    cols = columns.select(
        "table_name",
        line_of([
            F.lit("column"), F.col("ordinal"), F.col("column_name"), F.lower("data_type"), normalize_column_type(F.col("column_type")),
            F.upper("is_nullable"), *known("character_maximum_length", "numeric_precision", "numeric_scale", "datetime_precision"),
            normalize_extra(F.col("extra")), F.array_join(words(F.lower("generation")), " "),
        ]).alias("line"),
    )
    idx = indexes.select(
        "table_name",
        line_of([
            F.lit("index"), F.col("index_name"), F.col("non_unique"), F.col("seq"), F.col("column_name"), *known("sub_part"), F.upper("index_type"),
        ]).alias("line"),
    )
    fks = foreign_keys.select(
        "table_name",
        line_of([
            F.lit("foreign key"), F.col("constraint_name"), F.col("ordinal"), F.col("column_name"), F.col("referenced"),
            F.upper("update_rule"), F.upper("delete_rule"),
        ]).alias("line"),
    )
    return grouped_digest(cols.unionByName(idx).unionByName(fks), ["table_name"], F.col("line"), "structure_digest", "parts")


def schema_columns(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Catalogue rows of DataFrames, in the form :func:`structure_digest` reads."""
    spark = next(iter(tables.values())).sparkSession
    rows = [
        (name, i, f.name, f.dataType.typeName(), f.dataType.simpleString(), "YES" if f.nullable else "NO", "",
         str(getattr(f.dataType, "precision", "")), str(getattr(f.dataType, "scale", "")), "", "", "")
        for name, df in tables.items()
        for i, f in enumerate(df.schema.fields, 1)
    ]
    from fleetlens.functions.rules import small_table

    names = [
        "table_name", "ordinal", "column_name", "data_type", "column_type", "is_nullable", "character_maximum_length",
        "numeric_precision", "numeric_scale", "datetime_precision", "extra", "generation",
    ]
    return small_table(spark, rows, names)


def table_manifest(
    tables: Mapping[str, tuple[DataFrame, Sequence[str]]], indexes: DataFrame | None = None, foreign_keys: DataFrame | None = None
) -> DataFrame:
    """One row per table: rows, data digest and structure digest.

    ``indexes`` and ``foreign_keys`` as in :func:`structure_digest`; without
    them the structure is that of the columns.  All tables are digested in one
    aggregation; a task hands on one row for each table it read.
    """
    lines = [df.select(F.lit(name).alias("table_name"), line_of(cols).alias("line")) for name, (df, cols) in sorted(tables.items())]
    spark = lines[0].sparkSession
    # a null line is no row; it keeps tables without rows in the result
    lines.append(spark.createDataFrame([(name, None) for name in sorted(tables)], "table_name string, line string"))
    data = grouped_digest(reduce(DataFrame.unionByName, lines), ["table_name"], F.col("line"), "data_digest", "rows")
    cols = schema_columns({n: df.select(*c) for n, (df, c) in tables.items()})
    nothing = cols.filter("false")
    no_indexes = nothing.selectExpr("table_name", "'' AS index_name", "0 AS non_unique", "0 AS seq", "'' AS column_name", "'' AS sub_part", "'' AS index_type")
    no_keys = nothing.selectExpr(
        "table_name", "'' AS constraint_name", "0 AS ordinal", "'' AS column_name", "'' AS referenced", "'' AS update_rule", "'' AS delete_rule"
    )
    structure = structure_digest(
        cols, no_indexes if indexes is None else indexes, no_keys if foreign_keys is None else foreign_keys
    ).drop("parts")
    return data.join(structure, "table_name", "left").orderBy("table_name")


def verify_tables(source: DataFrame, target: DataFrame) -> DataFrame:
    """Compare two table manifests; one row per table with the reason it differs, if it does."""
    def side(df: DataFrame, s: str) -> DataFrame:
        return df.select("table_name", *[F.col(c).alias(f"{s}_{c}") for c in ("rows", "data_digest", "structure_digest")])

    joined = side(source, "s").join(side(target, "t"), "table_name", "full_outer")
    reason = (
        F.when(F.col("t_data_digest").isNull(), "missing")
        .when(F.col("s_data_digest").isNull(), "unexpected")
        .when(F.col("s_structure_digest") != F.col("t_structure_digest"), "structure")
        .when(F.col("s_rows") != F.col("t_rows"), "rows")
        .when(F.col("s_data_digest") != F.col("t_data_digest"), "data")
    )
    return joined.select(
        "table_name", F.col("s_rows").alias("source_rows"), F.col("t_rows").alias("target_rows"),
        reason.alias("reason"), reason.isNull().alias("equal"),
    )


def table_diff(source: DataFrame, target: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows that one side holds more often than the other, with how much more often.

    Rows meet by their hash before they are counted: a count inside the tasks
    that read would hold every distinct row of a file's part, and a table has
    few repeated ones.  There are as many partitions as keep ROWS_OF_A_TASK.
    """
    def signed(df: DataFrame, sign: int) -> DataFrame:
        return df.select(*cols, F.lit(sign).cast("long").alias("n"))

    rows = source.count() + target.count()
    tasks = max(int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_OF_A_TASK))
    both = signed(source, 1).unionByName(signed(target, -1)).repartition(tasks, *cols)
    both = both.groupBy(*cols).agg(F.sum("n").alias("n")).filter("n <> 0")
    return both.select(*cols, F.when(F.col("n") > 0, "source").otherwise("target").alias("side"), F.abs("n").alias("copies"))


def content_manifest_digest(databases: DataFrame, owners: DataFrame, privileges: DataFrame) -> DataFrame:
    """Digest of a database's content that stays equal across server majors.

    ``databases``: ``db, content_digest`` (no server major in it); privileges
    an owner has anyway are left out unless they are grantable.
    """
    keys = ["db", "grantee"]
    implied = owners.select("db", F.col("owner").alias("grantee"))
    granted = privileges.filter("grantable").unionByName(
        privileges.filter("NOT grantable").join(implied, keys, "left_anti").select(privileges.columns)
    )
    line = line_of(["object_type", "schema_name", "object_name", "grantee", "privilege", "grantable"])
    rights = grouped_digest(granted, ["db"], line, "privilege_digest", "privileges")
    joined = databases.join(rights, "db", "left")
    return joined.select(
        "db",
        F.coalesce("privileges", F.lit(0)).alias("privileges"),
        canonical_digest({
            "schema_version": F.lit("operations.migration.postgres-content-manifest.v1"),
            "content": F.col("content_digest"), "privileges": F.coalesce("privilege_digest", F.lit("")),
        }).alias("digest"),
    )


def database_set_rollup(members: DataFrame, extensions: DataFrame) -> DataFrame:
    """Totals of database sets.

    ``members``: ``set_id, ordinal, manifest_digest, total_rows, bytes,
    does_exist, is_empty``; ``extensions``: ``set_id, extension``.
    """
    ordered = grouped_digest(members, ["set_id"], line_of(["ordinal", "manifest_digest"]), "members_digest", "members")
    totals = members.groupBy("set_id").agg(
        F.sum("total_rows").alias("total_rows"), F.sum("bytes").alias("database_bytes"),
        F.bool_and("does_exist").alias("all_exist"), F.bool_and("is_empty").alias("all_empty"),
    )
    needed = extensions.distinct().groupBy("set_id").agg(
        F.array_join(F.array_sort(F.collect_list("extension")), ",").alias("required_extensions")
    )
    return totals.join(ordered, "set_id").join(needed, "set_id", "left")


def record_bytes(db: Column, expiry: Column, key: Column, value: Column) -> Column:
    """Bytes of a keyed record: 2-byte index, 8-byte expiry, 4-byte lengths, key, value."""
    def fixed(number: Column, width: int) -> Column:
        return F.unhex(F.right(F.lpad(F.hex(number.cast("long")), 16, "0"), F.lit(width * 2)))

    return F.concat(fixed(db, 2), fixed(expiry, 8), fixed(F.octet_length(key), 4), fixed(F.octet_length(value), 4), key, value)


def keyed_records_digest(records: DataFrame) -> DataFrame:
    """Digest and count of all records of a store and of those that never expire.

    Input: ``store, db, expiry_ms`` (-1: never)``, key, value`` (binary).  The
    records are combined as a multiset, which needs no sorted chain.
    """
    data = record_bytes(F.col("db"), F.col("expiry_ms"), F.col("key"), F.col("value"))
    kept = F.when(F.col("expiry_ms") == -1, data)
    parts = records.groupBy("store").agg(
        *multiset_parts(data, "a_"), *multiset_parts(kept, "p_"),
        F.sum(F.octet_length("key").cast("long") + F.octet_length("value")).alias("bytes"),
    )
    return parts.select(
        "store", F.col("a_rows").alias("key_count"), multiset_digest("a_").alias("all_digest"),
        F.col("p_rows").alias("persistent_count"), multiset_digest("p_").alias("persistent_digest"), "bytes",
    )


def canonical_keys(keys: DataFrame) -> DataFrame:
    """Distinct keys in order."""
    return keys.select("db", "key").distinct().orderBy("db", "key")


def verify_keyed(source: DataFrame, target: DataFrame, now_ms: int, tolerance_ms: int = EXPIRY_TOLERANCE_MS) -> DataFrame:
    """Keys that a restored store holds wrongly, with the reason.

    Expired source keys do not count; values must be equal and expiries within
    the tolerance.
    """
    s = source.select("db", "key", F.col("value").alias("sv"), F.col("expiry_ms").alias("se"), F.lit(True).alias("ins"))
    t = target.select("db", "key", F.col("value").alias("tv"), F.col("expiry_ms").alias("te"), F.lit(True).alias("int"))
    live = s.filter((F.col("se") == -1) | (F.col("se") > now_ms))
    either_never = (F.col("se") == -1) | (F.col("te") == -1)
    reason = (
        F.when(F.col("ins").isNull(), "undeclared key")
        .when(F.col("int").isNull(), "missing key")
        .when(F.col("sv") != F.col("tv"), "value")
        .when(either_never & (F.col("se") != F.col("te")), "expiry")
        .when(~either_never & (F.abs(F.col("se") - F.col("te")) > tolerance_ms), "expiry")
    )
    return live.join(t, ["db", "key"], "full_outer").withColumn("reason", reason).filter("reason IS NOT NULL").select("db", "key", "reason")


def state_mode_manifest(digests: DataFrame) -> DataFrame:
    """What a store's manifest binds: nothing of a cache, all of a durable store.

    Input: ``store, state_mode, key_count, all_digest``.
    """
    cache = F.col("state_mode") == "cache"
    return digests.select(
        "store", "state_mode",
        F.when(cache, F.lit(0).cast("long")).otherwise(F.col("key_count")).alias("record_count"),
        F.when(cache, F.lit(EMPTY_SHA256)).otherwise(F.col("all_digest")).alias("record_digest"),
    )


def collection_manifest(collections: DataFrame) -> DataFrame:
    """Validity, support and metadata digest of collections.

    Input: ``db, name, type, doc_count, hash, options, indexes,
    encrypted, allow_system, allow_encryption``.
    """
    name, kind = F.col("name"), F.col("type")
    is_view, is_series = kind == "view", kind == "timeseries"
    system = name.startswith("system.")
    managed = name == "system.views"
    bucket = name.startswith("system.buckets.")
    wants_system = is_view | is_series | system
    unsupported = F.array_compact(
        F.array(
            F.when(~kind.isin("collection", "view", "timeseries"), F.concat(F.lit("type:"), name)),
            F.when(wants_system & ~F.col("allow_system"), F.concat(F.lit("view-or-system:"), name)),
            F.when(system & ~managed & ~bucket, F.concat(F.lit("system:"), name)),
            F.when((F.col("encrypted") | name.startswith("enxcol_")) & ~F.col("allow_encryption"), F.concat(F.lit("queryable-encryption:"), name)),
        )
    )
    invalid = (
        (name == "") | (F.octet_length(name) > 255) | (F.col("doc_count") < 0) | (~is_view & (F.col("hash") == ""))
        | (is_view & ((F.col("doc_count") != 0) | (F.col("hash") != "")))
    )
    return collections.select(
        "db", "name", "type", "doc_count", "hash",
        canonical_digest({"options": F.col("options"), "indexes": F.col("indexes")}).alias("metadata_digest"),
        (~invalid).alias("valid"), F.array_join(unsupported, ",").alias("unsupported"),
    )


# Starts of dump lines that change from dump to dump.
VOLATILE_DDL = r"^(-- Dumped from database version|-- Dumped by pg_dump version|\\restrict |\\unrestrict )"


def normalize_ddl(text: Column) -> Column:
    """Dump text without volatile lines and trailing blanks, ending in one newline."""
    lines = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n")
    kept = F.filter(lines, lambda line: ~F.trim(line).rlike(VOLATILE_DDL))
    trimmed = F.transform(kept, lambda line: F.regexp_replace(line, "[ \t]+$", ""))
    return F.concat(F.regexp_replace(F.array_join(trimmed, "\n"), r"\n+\z", ""), F.lit("\n"))


def collapse_charset(ddl: Column, charset: Column) -> Column:
    """Drop a character set that only repeats the database's own."""
    return F.replace(ddl, F.concat(F.lit(" CHARACTER SET "), charset, F.lit(" COLLATE ")), F.lit(" COLLATE "))


def expected_vs_actual(expected: DataFrame, actual: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Per key: how many entries match, are missing and are unexpected."""
    def counted(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(*keys, *cols).agg(F.count("*").alias("n")).select(
            *keys, *cols, *[(F.col("n") if s == side else F.lit(0).cast("long")).alias(s) for s in ("e", "a")]
        )

    both = counted(expected, "e").unionByName(counted(actual, "a")).groupBy(*keys, *cols).agg(F.sum("e").alias("e"), F.sum("a").alias("a"))
    return both.groupBy(*keys).agg(
        F.sum(F.least("e", "a")).alias("matching"),
        F.sum(F.greatest(F.col("e") - F.col("a"), F.lit(0))).alias("missing"),
        F.sum(F.greatest(F.col("a") - F.col("e"), F.lit(0))).alias("unexpected"),
    )


def sequence_state(source: DataFrame, target: DataFrame) -> DataFrame:
    """Sequences whose last value or called flag differ, or that one side lacks."""
    keys = ["db", "schema_name", "sequence_name"]

    def side(df: DataFrame, s: str) -> DataFrame:
        return df.select(*keys, F.col("last_value").alias(f"{s}_last"), F.col("is_called").alias(f"{s}_called"), F.lit(True).alias(f"in_{s}"))

    joined = side(source, "s").join(side(target, "t"), keys, "full_outer")
    integer = F.col("s_last").rlike("^-?[0-9]+$")
    reason = (
        F.when(F.col("in_t").isNull(), "missing").when(F.col("in_s").isNull(), "unexpected")
        .when(~integer, "not an integer")
        .when(F.col("s_last") != F.col("t_last"), "last value")
        .when(F.col("s_called") != F.col("t_called"), "called flag")
    )
    return joined.withColumn("reason", reason).filter("reason IS NOT NULL").select(*keys, "reason")


def acl_policy_digest(rules: DataFrame, user_map: DataFrame) -> DataFrame:
    """Digest of the access rules of mapped users, secrets left out.

    ``rules``: ``store, ord, username, acl`` (last one per user counts);
    ``user_map``: ``store, ord, source_user, target_user``.  Stores with a
    mapped user without a usable rule get an error instead.
    """
    last = rules.groupBy("store", F.col("username").alias("source_user")).agg(F.max_by("acl", "ord").alias("acl"))
    joined = user_map.join(last, ["store", "source_user"], "left").withColumn(
        "r", sanitize_acl_rule(F.col("acl"), F.col("source_user"))
    )
    error = F.when(F.col("acl").isNull(), "user has no rule").otherwise(F.col("r.error"))
    lined = joined.select(
        "store", "ord", error.alias("error"),
        line_of([F.col("ord"), F.col("target_user"), F.array_join("r.tokens", " ")]).alias("line"),
    )
    digests = lined.groupBy("store").agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("ord"))).alias("error"), *multiset_parts(F.col("line"), "__"))
    return digests.select(
        "store", F.col("__rows").alias("users"), "error", F.when(F.col("error").isNull(), multiset_digest("__")).alias("policy_digest")
    )


def evidence_digest(fields: Mapping[str, object]) -> Column:
    """Digest of one evidence record."""
    return canonical_digest(fields)
