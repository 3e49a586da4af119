"""The query list of this package and small helpers its operators share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

# The white space between words, as a character class body and as characters.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD = f"[^{SPACE_CLASS}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class LlmQuery:
    run: Query
    sql: str | None


LLM_QUERIES: dict[str, LlmQuery] = {}


def llm_query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        LLM_QUERIES[name] = LlmQuery(run, sql)
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Array of the white-space separated words of a non-null text, case kept."""
    body = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, f"[{SPACE_CLASS}]+"))


def held_out(key: Column, folds: int) -> Column:
    """True for the rows kept from learning: crc32 of the key as text is a multiple of ``folds``.

    A null key counts as the empty text.
    """
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == 0
