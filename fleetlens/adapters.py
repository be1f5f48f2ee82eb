"""Driver table -> operator input.

Every input is a plain projection (and filter) of a driver table, written once
in the subset of SQL that Spark and DuckDB share, so that a query and its
oracle start from the same rows.  Three tokens differ between the engines:
``DIV`` (integer division), ``TSUS(`` (timestamp from microseconds) and
``ARR(`` (array literal).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_SPARK = (("DIV", "div"), ("TSUS(", "timestamp_micros("), ("ARR(", "array("))
_DUCK = (("DIV", "//"), ("TSUS(", "make_timestamp("), ("ARR(", "list_value("))


def _speak(text: str, words: tuple[tuple[str, str], ...]) -> str:
    for token, word in words:
        text = text.replace(token, word)
    return text


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    # driver timestamps carry no zone; read them as UTC
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


@dataclass(frozen=True)
class Input:
    base: Input | str
    columns: tuple[str, ...]
    where: str | None = None
    duck_columns: tuple[str, ...] | None = None

    def frame(self, spark: SparkSession, sf: str) -> DataFrame:
        base = table(spark, sf, self.base) if isinstance(self.base, str) else self.base.frame(spark, sf)
        if self.where:
            base = base.filter(_speak(self.where, _SPARK))
        return base.selectExpr(*[_speak(c, _SPARK) for c in self.columns])

    @property
    def sql(self) -> str:
        base = self.base if isinstance(self.base, str) else self.base.sql
        columns = ", ".join(_speak(c, _DUCK) for c in self.duck_columns or self.columns)
        where = f" WHERE {_speak(self.where, _DUCK)}" if self.where else ""
        return f"(SELECT {columns} FROM {base}{where})"


def project(base: Input | str, *columns: str, where: str | None = None) -> Input:
    return Input(base, columns, where)


_EVENT = (
    "event_id",
    "user_id",
    "event_type",
    "value",
    "CAST(round(value * 100) AS BIGINT) AS cents",
    # props is {"k": n}
    "CAST(translate(props, '{}\"k: ', '') AS BIGINT) AS k",
)
EVENTS = Input(
    "events",
    (*_EVENT, "CAST(ts AS TIMESTAMP) AS seen_at", "unix_micros(CAST(ts AS TIMESTAMP)) AS at_us"),
    duck_columns=(*_EVENT, "ts AS seen_at", "epoch_us(ts) AS at_us"),
)

CHECK_RESULTS = project(
    EVENTS,
    "event_id",
    "user_id AS monitor_id",
    "seen_at AS checked_at",
    "at_us",
    "CASE WHEN event_type = 'error' THEN 'critical' WHEN event_type = 'signup' THEN 'warning' ELSE 'ok' END AS status",
    "CAST(floor(value) AS BIGINT) AS latency_ms",
    "CASE WHEN k % 3 = 0 THEN 'systemd' WHEN k % 3 = 1 THEN 'docker' ELSE 'process' END AS service_type",
)
