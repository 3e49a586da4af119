"""Shared inputs, rounding and the query list."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsegrid.sources.signal import signal_from_events

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Check:
    run: Query
    sql: str | None


CHECKS: dict[str, Check] = {}


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL counterpart if there is one."""

    def register(run: Query) -> Query:
        CHECKS[name] = Check(run, sql)
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal_from_events(table(spark, sf_dir, "events"))


# Values are compared after rounding. Means over 2^n two-digit numbers fall exactly between two rounded
# values, where the last bit decides; the shift moves them off that border in both engines.
SHIFT = "0.00000013"


def rounded(column: Column | str, digits: int = 6) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value + F.lit(float(SHIFT)), digits)


def round_columns(df: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({n: rounded(F.col(f"`{n}`"), digits) for n in names})


def sql_round(expression: str, digits: int = 6) -> str:
    return f"round({expression} + {SHIFT}, {digits})"


def sql_rounded(names: list[str], digits: int = 6) -> str:
    return ", ".join(f'{sql_round(chr(34) + n + chr(34), digits)} AS "{n}"' for n in names)


# The signal of the test events, as a common table expression.
SIGNAL = """
raw AS (
  SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) AS k FROM events
),
sig AS (
  SELECT user_id, event_id, ts,
         CAST(floor((hour(ts) * 60 + minute(ts)) / 15) AS INTEGER) AS row_idx,
         CAST(ts AS DATE) AS "date",
         value AS steps,
         CASE WHEN k % 10 <> 0 THEN k END AS hr
  FROM raw
)"""

DAY_TEXT = "strftime({0}, '%Y-%m-%d')"


def day_text(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd")
