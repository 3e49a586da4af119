"""Packing documents into sequences of fixed length: cutting stock with column generation.

1. Whole texts become token ids once; the ids are stored.
2. A document longer than a sequence fills sequences of its own; what is left of it, and every shorter document, is an
   item. Lengths are counted in units of ``UNIT`` tokens, rounded up; only this histogram, 128 rows at most, reaches
   the driver. The unit costs about half of it per item as padding and keeps the program below small and exact.
3. There a linear program over packing patterns is solved by column generation (``cutting``); its rounded patterns
   become a small table: for each length, which ranks go to which sequences.
4. Items get their rank among those of their length by one range exchange and per-partition counts. The plan, whose
   size is bounded by the number of lengths and patterns, is broadcast to them, and each item reads its sequence off
   the row its rank falls in. A sequence's items, 1024 tokens at most, then get their offsets by a running sum.
5. Items left over by rounding, a number that does not grow with the data, are laid end to end and cut.

Items of one length may be any share of all rows: their rank is a number, not a group.

Defined results: a null or empty text is the end id alone. Repeated rows are documents of their own; ties in rank are
broken by a running number. An empty table gives no pieces. Other columns are not read, so names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pulsegrid.llm.common import llm_query, table
from pulsegrid.llm.cutting import cut_line, round_patterns, slots_of, solve
from pulsegrid.llm.tokens import ID_BYTES, token_ids
from pulsegrid.operators.skew import number_rows
from pulsegrid.session import scratch_path

SEQUENCE = 1024
UNIT = 8
END_ID = 0
RANKS = "byte_bpe_50k.tiktoken"  # the tokens of byte_bpe_50k.json as ranks
_PLAN = "unit int, first long, last long, each int, sequence long, place int"
_CUT = "_doc long, start long, length long, sequence_id long, offset long"


def public_ranks(name: str = RANKS) -> tuple[str, str]:
    """Path of a public rank file and the pattern that parts a text into pieces."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def _encode(docs: DataFrame, key: str, text: str, ranks: tuple[str, str], end_id: int) -> DataFrame:
    spark = docs.sparkSession
    folder = scratch_path(spark, "token-ids")
    encoded = docs.select(
        F.col(key).alias("_id"), token_ids(F.col(text), *ranks, end_id).alias("_ids"),
        F.monotonically_increasing_id().alias("_doc"),
    )
    sized = encoded.withColumn("_tokens", (F.octet_length("_ids") / ID_BYTES).cast("long"))
    sized.write.option("compression", "zstd").parquet(folder)
    return spark.read.parquet(folder)


def _part(ids: str, start, size):
    """Binary slice of token ids; positions are tokens."""
    return F.substring(F.col(ids), (start * ID_BYTES + 1).cast("int"), (size * ID_BYTES).cast("int"))


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    sequence: int = SEQUENCE,
    ranks: tuple[str, str] | None = None,
    end_id: int = END_ID,
) -> DataFrame:
    """Pieces of documents with their ids and their place in a sequence.

    Columns: the key, ``start``, ``length``, ``ids`` (binary), ``doc_tokens``, ``sequence_id``, ``offset``. Sequence
    numbers are unique but not without gaps.
    """
    spark = docs.sparkSession
    stored = _encode(docs, key, text, ranks or public_ranks(), end_id)
    item = (F.col("_tokens") % sequence).cast("int")
    items = stored.select(
        "_doc", (F.col("_tokens") - item).alias("_start"), item.cast("long").alias("length"),
        F.ceil(item / UNIT).cast("int").alias("_unit"),
    ).where("length > 0")
    histogram = {r["_unit"]: r["count"] for r in items.groupBy("_unit").count().collect()}
    capacity = sequence // UNIT
    slots, used = slots_of(round_patterns(solve(histogram, capacity), histogram, capacity))
    plan = spark.createDataFrame([tuple(vars(s).values()) for s in slots], _PLAN)

    numbered = number_rows(items, ["_unit", "_doc"], "_at")
    firsts = numbered.groupBy("_unit").agg(F.min("_at").alias("_first"))  # a row for each length
    ranked = numbered.join(F.broadcast(firsts), "_unit").withColumn("_rank", F.col("_at") - F.col("_first"))
    inside = (F.col("_rank") >= F.col("first")) & (F.col("_rank") <= F.col("last"))
    joined = ranked.join(F.broadcast(plan), (F.col("_unit") == F.col("unit")) & inside, "left")
    nth = F.col("_rank") - F.col("first")
    in_sequence = Window.partitionBy("sequence_id").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    planned = (
        joined.where("sequence IS NOT NULL")
        .select(
            "_doc", F.col("_start").alias("start"), "length",
            (F.col("sequence") + F.floor(nth / F.col("each"))).alias("sequence_id"),
            (F.col("place") + nth % F.col("each")).alias("_place"),
        )
        .withColumn("offset", F.coalesce(F.sum("length").over(in_sequence), F.lit(0)))
        .drop("_place")
    )
    # What rounding has left over: at most about an item per pattern.
    rest = joined.where("sequence IS NULL").select("_doc", "_start", "length").orderBy("_doc").collect()
    cut = [
        (rest[i]["_doc"], rest[i]["_start"] + start, size, used + number, offset)
        for i, start, size, number, offset in cut_line([r["length"] for r in rest], sequence)
    ]
    placed = planned.unionByName(spark.createDataFrame(cut, _CUT))
    used += len(cut)
    tails = stored.withColumn("_cut", F.col("_tokens") - item).select(
        "_id", "_doc", "_tokens", "_cut", _part("_ids", F.col("_cut"), F.lit(sequence)).alias("_tail")
    )
    pieces = placed.join(tails.where(F.col("_cut") < F.col("_tokens")), "_doc").select(
        F.col("_id").alias(key), "start", "length", _part("_tail", F.col("start") - F.col("_cut"), F.col("length")).alias("ids"),
        F.col("_tokens").alias("doc_tokens"), "sequence_id", "offset",
    )
    whole = stored.where(F.col("_tokens") >= sequence).select(
        "_id", "_ids", "_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_tokens") / sequence) - 1)).alias("_n")
    )
    full = whole.select(
        F.col("_id").alias(key), (F.col("_n") * sequence).alias("start"), F.lit(sequence).cast("long").alias("length"),
        _part("_ids", F.col("_n") * sequence, F.lit(sequence)).alias("ids"), F.col("_tokens").alias("doc_tokens"),
        (F.monotonically_increasing_id() + used).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    return pieces.unionByName(full)


def digest_pieces(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    return pieces.select(
        key, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@llm_query("op2_cutting_stock_packing")
def op2_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return digest_pieces(pack(table(spark, sf_dir, "documents").select("doc_id", "text")))
