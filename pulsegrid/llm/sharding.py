"""Jump consistent hashing: a stable key and a shard count decide the shard, without a ring table.

Every key walks a sequence of ever farther jumps drawn from a generator seeded with the key; the last landing place
below the shard count is its shard. A key's walk does not depend on the count, so with one shard more only those
keys move whose walk lands exactly on the new shard: the fraction that must move, and into that shard alone.

Defined results: a null key counts as the empty text, so all rows with a null key share a shard; a null text has no
bytes. Rows with the same key always share a shard, however many they are, and take neighbouring slots there in any
order. An empty table gives an empty table. Results hold the key, the new columns and nothing else, so other columns
of the input cannot clash; ``add_shards`` replaces columns of the names it is asked to write.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsegrid.llm.common import llm_query, table
from pulsegrid.operators.skew import number_rows

SHARDS = 40
RECORD_BYTES = 16  # added to the bytes of a text for its record


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every 64-bit key; all keys jump together until each has passed the last shard."""
    state = keys.astype(np.uint64).copy()
    here = np.zeros(len(state), dtype=np.int64)
    going = np.arange(len(state))
    ahead = np.zeros(len(state), dtype=np.int64)
    while len(going):
        here[going] = ahead
        state[going] = state[going] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((state[going] >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead = np.floor((here[going] + 1) * step).astype(np.int64)
        inside = ahead < shards
        going, ahead = going[inside], ahead[inside]
    return here


def key_text(*keys: Column) -> Column:
    """16 hexadecimal digits that stand for the key: the first half of the MD5 of the key as text."""
    parts = [F.coalesce(k.cast("string"), F.lit("")) for k in keys]
    return F.substring(F.md5(F.concat_ws("\x1f", *parts).cast("binary")), 1, 16)


def shard_of(key: Column, shards: int) -> Column:
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def land(digits: pd.Series) -> pd.Series:
        keys = np.fromiter((int(d, 16) for d in digits), dtype=np.uint64, count=len(digits))
        return pd.Series(jump(keys, shards).astype(np.int32))

    return land(key)


def add_shards(df: DataFrame, keys: list[str], shards: int = SHARDS, name: str = "shard") -> DataFrame:
    """``df`` with the shard of its key columns; nothing is shuffled."""
    return df.withColumn(name, shard_of(key_text(*[F.col(f"`{k}`") for k in keys]), shards))


def place(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """Shard, slot in the shard and shard after growth by one, of every document.

    Slots come from one range exchange over (shard, key) and per-partition counts, so a shard is never gathered in a
    task; equal keys are spread by a running number.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    narrow = docs.select(
        F.col(f"`{key}`").alias(key),
        (F.octet_length(body) + RECORD_BYTES).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        key_text(F.col(f"`{key}`")).alias("_key"),
        F.monotonically_increasing_id().alias("_tie"),
    )
    sharded = narrow.withColumns(
        {"shard": shard_of(F.col("_key"), shards), "grown_shard": shard_of(F.col("_key"), shards + 1)}
    )
    numbered = number_rows(sharded, ["shard", "_key", key, "text_crc32", "size", "_tie"], "_number")
    starts = numbered.groupBy("shard").agg(F.min("_number").alias("_first"))  # a row for each shard
    return numbered.join(F.broadcast(starts), "shard").select(
        key, "size", "text_crc32", "shard", (F.col("_number") - F.col("_first")).alias("slot"), "grown_shard"
    )


def write_shards(docs: DataFrame, path: str, keys: list[str], shards: int = SHARDS) -> None:
    """Write ``docs`` as one folder of Parquet files per shard; a large shard is written by many tasks."""
    add_shards(docs, keys, shards).write.mode("overwrite").partitionBy("shard").parquet(path)


@llm_query("op3_jump_sharding")
def op3_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document under the law ``key``."""
    return place(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
