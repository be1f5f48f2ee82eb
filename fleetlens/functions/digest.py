"""Digests built from built-in, mergeable aggregates.

A multiset digest hashes every row on its own and combines the hashes with
sums and XOR, so it needs no order, no shuffle of rows and no state that grows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: version tag inside a row multiset digest.
ROW_MULTISET = "operations.migration.mysql-row-multiset.v1"

WORDS = 4
# a 64-bit word is summed as three pieces of 22, 22 and 20 bits, so that plain
# long sums stay exact up to 2^41 rows
PIECES = ((0, 22), (22, 22), (44, 20))


def line_of(cols: Sequence[Column | str], sep: str = "\t") -> Column:
    """Text of a row: columns as strings, ``NULL`` for nulls."""
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("NULL")) for c in cols])


def _word(hex_digest: Column, n: int) -> Column:
    """n-th 64-bit word as a signed long with the same bits."""
    return F.conv(F.substring(hex_digest, n * 16 + 1, 16), 16, -10).cast("long")


def multiset_parts(value: Column, prefix: str = "") -> list[Column]:
    """Partial aggregates of a multiset digest over binary or string values."""
    digest = F.sha2(value, 256)
    out = [F.count(value).alias(f"{prefix}rows")]
    for n in range(WORDS):
        word = _word(digest, n)
        out.append(F.bit_xor(word).alias(f"{prefix}x{n}"))
        for i, (shift, bits) in enumerate(PIECES):
            piece = F.shiftrightunsigned(word, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
            out.append(F.sum(piece).alias(f"{prefix}s{n}_{i}"))
    return out


def multiset_words(prefix: str = "") -> dict[str, Column]:
    """Columns ``rows, xor0..xor3, sum0..sum3`` (words as unsigned decimal text) from the parts."""
    out = {"rows": F.col(f"{prefix}rows")}
    modulus = F.expr("CAST(18446744073709551616 AS DECIMAL(38,0))")
    for n in range(WORDS):
        xor_hex = F.lpad(F.hex(F.coalesce(F.col(f"{prefix}x{n}"), F.lit(0).cast("long"))), 16, "0")
        out[f"xor{n}"] = F.conv(xor_hex, 16, 10)
        total = None
        for i, (shift, _) in enumerate(PIECES):
            part = F.coalesce(F.col(f"{prefix}s{n}_{i}"), F.lit(0).cast("long")).cast("decimal(38,0)")
            part = (part * F.lit(1 << shift).cast("decimal(14,0)")).cast("decimal(38,0)")
            total = part if total is None else (total + part).cast("decimal(38,0)")
        out[f"sum{n}"] = (total % modulus).cast("decimal(20,0)").cast("string")
    return out


def multiset_digest(prefix: str = "") -> Column:
    """The one digest of a multiset, from its parts."""
    words = multiset_words(prefix)
    xor = F.concat(*[F.lpad(F.lower(F.conv(words[f"xor{n}"], 10, 16)), 16, "0") for n in range(WORDS)])
    sums = F.array(*[F.lower(F.conv(words[f"sum{n}"], 10, 16)) for n in range(WORDS)])
    return canonical_digest({"schema_version": F.lit(ROW_MULTISET), "rows": words["rows"], "xor": xor, "sum": sums})


def grouped_digest(df: DataFrame, keys: Sequence[str], line: Column, name: str = "digest", rows: str = "rows") -> DataFrame:
    """Multiset digest and row count per key; put a position into the line to bind the order."""
    parts = df.groupBy(*keys).agg(*multiset_parts(line, "__"))
    return parts.select(*keys, multiset_digest("__").alias(name), F.col("__rows").alias(rows))


def _canonical(value) -> Column:
    if isinstance(value, Mapping):
        return F.struct(*[_canonical(value[k]).alias(k) for k in sorted(value)])
    return value


def canonical_json(fields: Mapping[str, object]) -> Column:
    """JSON object with sorted keys; nested mappings are sorted too."""
    return F.to_json(_canonical(fields), {"ignoreNullFields": "false"})


def canonical_digest(fields: Mapping[str, object]) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(fields), 256))


def sorted_map(m: Column) -> Column:
    """Map with its keys in order, as canonical JSON needs it."""
    return F.map_from_entries(F.array_sort(F.map_entries(m)))
