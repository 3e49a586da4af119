"""Mixing sources to target weights: blocks of equal size dealt to sources by highest quotients.

1. Targets. Every source has a weight; together the sources share a budget of words. A source may be taken twice at
   most: what a target exceeds that by is shared again among the others by weight until none is above.
2. Quotas. The budget is cut into blocks of ``block_words`` words. The blocks are seats that go to the sources by
   Sainte-Lague: the next seat to the source with the highest quotient target / (2 * seats + 1). The order of the
   seats also deals them to output shards: shard j gets the j-th run of seats, so each shard holds a whole number of
   blocks of each source, near its weight.
3. Selection. The documents of a source lie on a line in a seeded order; the line is cut into blocks. A quota of k
   blocks out of n takes every block k // n times and k % n of them once more, spread evenly from a seeded phase. The
   blocks taken, in line order, are the source's seats in the order of the shards, so each shard gets exactly the blocks
   it was dealt. A quota above its target has its last block cut there (or left out, and the one before it cut); what a
   quota falls short of is added to the last shard from the first blocks that were not taken once more. So every source's
   words equal its target but for rounding.

Scale. Seats are never listed: with S sources and H seats a source's seats lie within S / 2H of its exact share, so
the first ones are certain and only about 3 * S seats per shard compete for the rest. Positions on the line come from
one range exchange of narrow rows, ordered by (source, seeded digest), and sums per partition; a source that holds a
third of all rows spans many partitions. Tables with one row per source are joined as Spark sees fit.

Defined results: a null text has no words and is never taken; a null source is a source of its own, ordered last.
Sources without words have target 0. Repeated rows stand next to each other on the line, in any order, and count as
documents of their own. Reruns agree: the order depends on the seed, key and size alone. An empty table gives an empty
table. The results of ``mix`` hold the named columns only; ``mix_texts`` packs all others away meanwhile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pulsegrid.llm.common import SPACE_CLASS, WORD, llm_query, table
from pulsegrid.operators.skew import number_rows
from pulsegrid.session import freeze

WEIGHTS = (3, 1, 2)  # repeated along the sources in code point order
SHARE = 1.5  # words of the mix for each word there is
MOST = 2  # times a source may be taken
BLOCK_WORDS = 1024
MIX_SHARDS = 8
SEED = 17


def _digest(seed: int, *parts: Column) -> Column:
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *texts).cast("binary"))


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST
) -> DataFrame:
    """(source, source_size, weight, target), one row per source, from rows of (source, size)."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    totals = totals.withColumn("_last", F.col("source").isNull())
    ranked = number_rows(totals, ["_last", "source"], "_rank").drop("_last")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    weighted = freeze(ranked.withColumn("weight", weight))
    limit = most * F.col("source_size")
    whole = weighted.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    budget = share * (whole["words"] or 0)
    level = budget / whole["weight"] if whole["weight"] else 0.0
    while True:  # sources at their limit leave their excess to the others; each turn is one sum over the sources
        above = F.col("weight") * F.lit(level) >= limit
        fixed = weighted.agg(
            F.coalesce(F.sum(F.when(above, limit)), F.lit(0)).alias("words"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("weight"),
        ).first()
        if not fixed["weight"]:
            break
        higher = (budget - fixed["words"]) / fixed["weight"]
        if higher <= level:
            break
        level = higher
    target = F.least(limit.cast("double"), F.col("weight") * F.lit(level))
    return weighted.select("source", "source_size", "weight", target.alias("target"), F.col("_rank").alias("_order"))


def quotas(targets: DataFrame, block_words: int = BLOCK_WORDS, shards: int = MIX_SHARDS) -> DataFrame:
    """Adds ``quota``: seats of the source among the first j-th parts of all seats, for j = 1 to ``shards``."""
    sums = targets.agg(F.sum("target").alias("_words"), F.count(F.lit(1)).alias("_sources"))
    house = F.round(F.col("_words") / block_words).cast("long")
    seats = F.floor(house * F.col("shard") / shards).cast("long")
    houses = sums.withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards)))).select(
        "shard", "_words", "_sources", seats.alias("_seats")
    )
    # One row for each shard: a bounded side, so this product is a projection of the sources.
    shared = targets.where("target > 0").join(F.broadcast(houses), how="inner", on=F.lit(True))
    fair = F.col("target") * F.col("_seats") / F.col("_words")
    slack = F.when(F.col("_seats") > 0, F.col("_sources") / (2 * F.col("_seats"))).otherwise(0)
    certain = F.greatest(F.floor(fair * (1 - slack) - 0.5), F.lit(0)).cast("long")
    possible = F.least(F.ceil(fair * (1 + slack) + 0.5).cast("long"), F.col("_seats"))
    bounded = shared.withColumns({"_certain": certain, "_possible": F.greatest(possible, certain)})
    open_seats = bounded.groupBy("shard").agg((F.first("_seats") - F.sum("_certain")).alias("_open"))
    contest = bounded.where("_possible > _certain").withColumn(
        "_seat", F.explode(F.sequence(F.col("_certain"), F.col("_possible") - 1))
    )
    by_quotient = Window.partitionBy("shard").orderBy(F.desc(F.col("target") / (2 * F.col("_seat") + 1)), "_order", "_seat")
    won = (
        contest.withColumn("_place", F.row_number().over(by_quotient))
        .join(F.broadcast(open_seats), "shard")
        .where(F.col("_place") <= F.col("_open"))
        .groupBy("shard", "_order")
        .agg(F.count(F.lit(1)).alias("_won"))
    )
    seats_won = bounded.join(won, ["shard", "_order"], "left").select(
        "_order", "shard", (F.col("_certain") + F.coalesce("_won", F.lit(0))).alias("_held")
    )
    listed = seats_won.groupBy("_order").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("shard", "_held"))), lambda x: x["_held"]).alias("quota")
    )
    none = F.array_repeat(F.lit(0).cast("long"), shards)
    return targets.join(listed, "_order", "left").withColumn("quota", F.coalesce("quota", none))


def _line(sizes: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds ``_from``: words before the document on the line of all sources in seeded order."""
    order = ["_last", "source", "_digest", key, "size", "_tie"]
    marked = sizes.withColumns(
        {
            "_last": F.col("source").isNull(),
            "_digest": _digest(seed, F.col(key), F.col("size")),
            "_tie": F.monotonically_increasing_id(),
        }
    )
    placed = freeze(marked.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    in_part = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = (
        placed.groupBy("_part")
        .agg(F.sum("size").alias("_words"))
        .select("_part", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        placed.withColumn("_within", F.coalesce(F.sum("size").over(in_part), F.lit(0)))
        .join(F.broadcast(offsets), "_part")
        .withColumn("_from", F.col("_offset") + F.col("_within"))
        .drop("_last", "_digest", "_tie", "_part", "_within", "_offset")
    )


def _whole(column: Column) -> Column:
    return column.cast("decimal(19,0)")


def _chosen_before(block: Column) -> Column:
    """Blocks with a number below ``block`` that are taken once more than the others of the source."""
    return F.floor((_whole(block) * _whole(F.col("_extra")) + F.col("_phase")) / F.col("_blocks")).cast("long")


def _seated_before(place: Column, seats: Column, block_words: int, goal: Column | None = None) -> Column:
    """Words before ``place`` on the source's line in its first ``seats`` blocks taken, cut at ``goal`` words."""
    block = F.floor(place / F.lit(block_words)).cast("long")
    start = block * block_words
    seated = F.col("_times") * block + _chosen_before(block)  # seats of earlier blocks, all of them whole
    here = F.col("_times") + _chosen_before(block + 1) - _chosen_before(block)
    here = F.greatest(F.least(seats - seated, here), F.lit(0))
    earlier = F.least(seats, seated) * block_words
    if goal is None:
        return earlier + here * (place - start)
    length = F.least(F.lit(block_words), F.col("source_size") - start)

    def with_copy(words: Column, copy: Column) -> Column:
        left = F.greatest(goal - seated * block_words - copy * length, F.lit(0))
        return words + F.when(copy < here, F.least(place - start, left)).otherwise(0).cast("long")

    copies = F.sequence(F.lit(0).cast("long"), F.greatest(here, F.lit(1)).cast("long") - 1)
    return F.aggregate(copies, F.least(earlier, goal).cast("long"), with_copy)


def _added_before(place: Column, block_words: int) -> Column:
    """Words before ``place`` added where the quota falls short: from blocks not taken once more, then from all."""
    missing = F.greatest(F.col("_goal") - F.col("_dealt"), F.lit(0))
    free = (F.col("_times") + 1) * place - _seated_before(place, F.col("_seats"), block_words)
    beyond = F.greatest(missing - ((F.col("_times") + 1) * F.col("source_size") - F.col("_dealt")), F.lit(0))
    rounds = F.floor(beyond / F.greatest(F.col("source_size"), F.lit(1))).cast("long")
    return F.least(missing, free) + rounds * place + F.least(beyond - rounds * F.col("source_size"), place)


def _taken_before(place: Column, block_words: int) -> Column:
    """Words the mix takes from the source's line before ``place``."""
    dealt = _seated_before(place, F.col("_seats"), block_words, F.col("_goal"))
    return dealt + _added_before(place, block_words)


def _shard_words(begin: Column, end: Column, block_words: int) -> Column:
    """Words the mix takes between two places for each shard."""

    def up_to(seats: Column) -> Column:
        goal = F.col("_goal")
        return _seated_before(end, seats, block_words, goal) - _seated_before(begin, seats, block_words, goal)

    sums = F.transform("quota", up_to)
    added = _added_before(end, block_words) - _added_before(begin, block_words)
    dealt = F.zip_with(sums, F.concat(F.array(F.lit(0).cast("long")), F.slice(sums, 1, F.size("quota") - 1)), lambda a, b: a - b)
    return F.transform(dealt, lambda x, i: x + F.when(i == F.size("quota") - 1, added).otherwise(0))


def lay_out(
    sizes: DataFrame,
    key: str = "doc_id",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    block_words: int = BLOCK_WORDS,
    shards: int = MIX_SHARDS,
    seed: int = SEED,
) -> DataFrame:
    """Rows of (key, source, size, ...) with their place on the source's line and what the mix does with it."""
    targets = quotas(source_targets(sizes, weights, share, most), block_words, shards)
    line = _line(sizes, key, seed)
    before = Window.orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    quota = F.element_at("quota", -1)
    # A row per source; the window adds up the words of earlier sources.
    plan = targets.withColumn("_first", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    plan = plan.withColumn("_blocks", F.greatest(F.ceil(F.col("source_size") / block_words), F.lit(1)).cast("long"))
    plan = plan.withColumn("_seats", F.least(quota, most * F.col("_blocks")))
    phase = F.conv(F.substring(_digest(seed, F.col("source")), 1, 8), 16, 10).cast("long") % F.col("_blocks")
    plan = plan.withColumns(
        {
            "_times": F.floor(F.col("_seats") / F.col("_blocks")).cast("long"),
            "_extra": (F.col("_seats") % F.col("_blocks")).cast("long"),
            "_phase": phase,
            "_goal": F.round(F.col("target")).cast("long"),
        }
    ).drop("_order")
    plan = plan.withColumn("_dealt", _seated_before(F.col("source_size"), F.col("_seats"), block_words))
    # One row per source on the right; Spark broadcasts it if small and splits uneven partitions if not.
    joined = line.join(plan.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    return joined.withColumn("_place", F.col("_from") - F.col("_first")).drop("_from", "_first", "_source")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """Size, source size, target and words taken of every document, altogether and for each shard."""
    block_words = settings.get("block_words", BLOCK_WORDS)
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    sizes = docs.select(F.col(key).alias("_id"), F.col(source).alias("source"), words.alias("size"))
    laid = lay_out(freeze(sizes), "_id", **settings)
    by_shard = _shard_words(F.col("_place"), F.col("_place") + F.col("size"), block_words)
    taken = F.aggregate("by_shard", F.lit(0).cast("long"), lambda a, b: a + b)
    dealt = laid.withColumn("by_shard", by_shard).withColumn("taken", taken)
    return dealt.select(F.col("_id").alias(key), "size", "source_size", "target", "taken", "by_shard")


def mix_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """The mixed texts, with the columns of ``docs`` (``n_chars``, if there, follows the text).

    A document comes once for each whole copy the mix takes, and once for each further block of it that is taken,
    cut to the words of that block with the white space between them kept.
    """
    block_words = settings.get("block_words", BLOCK_WORDS)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    packed = docs.select(
        F.struct(*columns).alias("_row"), F.col(key).alias("_id"), F.col(source).alias("source"), words.alias("size"),
        F.monotonically_increasing_id().alias("_mark"),
    )
    stored = freeze(packed)  # the mark must stay what it is
    laid = lay_out(stored.select("_id", "source", "size", "_mark"), "_id", **settings)
    first = F.floor(F.col("_place") / block_words).cast("long")
    last = F.floor((F.col("_place") + F.col("size") - 1) / block_words).cast("long")
    begin, end = F.col("_place"), F.col("_place") + F.col("size")

    def slice_of(block: Column) -> Column:
        low = F.greatest(block * block_words, begin)
        high = F.least((block + 1) * block_words, end)
        taken = _taken_before(high, block_words) - _taken_before(low, block_words)
        more = F.greatest(taken - F.least(F.col("_times"), F.floor(taken / (high - low))) * (high - low), F.lit(0))
        return F.struct((low - begin).alias("low"), (high - low).alias("n"), taken.alias("taken"), more.alias("more"))

    slices = laid.where("size > 0").select(
        "_mark", "size", F.transform(F.sequence(first, last), slice_of).alias("_slices")
    )
    copies = F.array_min(F.transform("_slices", lambda s: F.floor(s["taken"] / s["n"]))).cast("long")
    counted = slices.withColumn("_copies", copies)

    def rest(s: Column) -> Column:
        left = s["taken"] - F.col("_copies") * s["n"]
        return F.transform(
            F.sequence(F.lit(0), F.ceil(left / s["n"]).cast("long") - 1),
            lambda i: F.struct(s["low"].alias("low"), F.least(s["n"], left - i * s["n"]).alias("n")),
        )

    partly = F.filter("_slices", lambda s: s["taken"] > F.col("_copies") * s["n"])
    pieces = F.concat(
        F.when(F.col("_copies") > 0, F.array_repeat(F.struct(F.lit(0).cast("long").alias("low"), F.col("size").alias("n")), F.col("_copies").cast("int")))
        .otherwise(F.array().cast("array<struct<low:bigint,n:bigint>>")),
        F.flatten(F.transform(partly, rest)),
    )
    chosen = counted.select("_mark", "size", F.explode(pieces).alias("_piece"))
    joined = stored.drop("size", "source", "_id").join(chosen, "_mark")
    body = F.col(f"_row.`{text}`")
    # Each word with the white space before it, so that a slice is an exact part of the text.
    parts = F.regexp_extract_all(body, F.lit(f"([{SPACE_CLASS}]*{WORD})"))
    cut = F.array_join(F.slice(parts, (F.col("_piece.low") + 1).cast("int"), F.col("_piece.n").cast("int")), "")
    whole = F.col("_piece.n") == F.col("size")
    shaped = joined.withColumn("_text", F.when(whole, body).otherwise(F.btrim(cut, F.lit(" \t\n\x0b\x0c\r"))))
    fields = {c: F.col(f"_row.`{c}`") for c in docs.columns}
    fields[text] = F.col("_text")
    if "n_chars" in fields:
        kind = docs.schema["n_chars"].dataType
        fields["n_chars"] = F.when(whole, fields["n_chars"]).otherwise(F.length("_text")).cast(kind)
    return shaped.select(*[c.alias(name) for name, c in fields.items()])


@llm_query("op5_sainte_lague_mix")
def op5_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
