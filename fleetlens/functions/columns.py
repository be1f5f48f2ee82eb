"""Column expressions shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` and these columns, each computed once per row, however often it is read.

    The optimiser copies a plain column into every lambda and into every filter
    that it pushes down; a column of a generator is only read.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def words(text: Column) -> Column:
    """Fields between white space; an empty array for a blank text."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def trimmed(text: Column) -> Column:
    """Without white space, line ends included, at both ends."""
    return F.regexp_replace(text, r"\A\p{IsWhite_Space}+|\p{IsWhite_Space}+\z", "")


def field(array: Column, n: int) -> Column:
    """n-th element from 0, null when missing."""
    return F.get(array, F.lit(n))


def unsigned(text: Column) -> Column:
    """Unsigned 64-bit number, null when the text is none."""
    value = F.when(text.rlike("^[0-9]{1,20}$"), text.try_cast("decimal(20,0)"))
    return F.when(value <= F.lit("18446744073709551615").cast("decimal(20,0)"), value)


def round1(value: Column, clamp: bool = True) -> Column:
    """One decimal, half up; clamped to 0..100 first unless ``clamp`` is off."""
    if clamp:
        value = F.least(F.greatest(value, F.lit(0.0)), F.lit(100.0))
    return F.floor(value * 10 + 0.5).cast("double") / 10


def block_device_base(device: Column, keep_whole_nvme: bool = False) -> Column:
    """Device without its partition number.

    The plain rule also shortens an unpartitioned ``/dev/nvme0n1`` to
    ``/dev/nvme0n``; ``keep_whole_nvme`` leaves such names alone.
    """
    base = F.regexp_replace(F.regexp_replace(device, "[0-9]+$", ""), "p$", "")
    if keep_whole_nvme:
        base = F.when(device.rlike("nvme[0-9]+n[0-9]+$"), device).otherwise(base)
    return base


def is_partition(name: Column) -> Column:
    """Whether a kernel device name is a partition."""
    return (
        F.when(name.rlike("^(nvme|mmcblk)"), name.rlike("p[+-]?[0-9]+$"))
        .when(name.rlike("^(dm-|md)"), False)
        .otherwise(name.rlike("[0-9]$"))
    )


def clean_path(path: Column) -> Column:
    """Single slashes, none at the end."""
    short = F.regexp_replace(F.regexp_replace(path, "/+", "/"), "(.)/$", "$1")
    return short


def unquote(text: Column, quotes: str = "\"'") -> Column:
    return F.btrim(text, F.lit(quotes))


def hex_word(digest: Column, n: int) -> Column:
    """n-th 64-bit word of a hex digest as an unsigned decimal."""
    return F.conv(F.substring(digest, n * 16 + 1, 16), 16, 10).cast("decimal(20,0)")
