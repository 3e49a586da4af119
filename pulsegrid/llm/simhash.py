"""SimHash fingerprints and their groups, by exact comparison of tiles.

Fingerprint: a bit is one if it is set in over half of the 64-bit hashes of all word shingles. Two documents are
linked if their fingerprints differ in at most ``distance`` bits; a group is what links connect.

Comparison. Copies share a fingerprint, so only distinct fingerprints are compared, however large a group of copies
is. They are sorted by their population count (number of one bits) and cut into tiles of one population count each.
Fingerprints within the distance have population counts within the distance, so all other pairs of tiles are skipped;
the remaining pairs are compared whole, with numpy exclusive-or and bit counts. A tile pair returns a spanning forest
of its links instead of all of them: at most one row per fingerprint, and the same groups. The forests are joined to
components by alternating star steps, all as Spark joins and aggregations; neither links nor fingerprints reach the
driver. The work grows with the square of the number of distinct fingerprints, divided by what the counts skip.

Defined results: a null or empty text, or one without words, has fingerprint zero and is linked like any other. A text
with fewer words than a shingle is one shingle. Repeated rows share a group. The id of a group is its smallest
document id that is not null; a group of null ids alone has a null id. An empty table gives an empty table. ``groups``
reads the named columns only; ``drop_near_copies`` packs all other columns away, so names cannot clash. Texts are
hashed whole, in slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsegrid.llm.common import llm_query, table
from pulsegrid.operators.skew import number_rows
from pulsegrid.session import freeze

SHINGLE_WORDS = 4
DISTANCE = 4
HASH_SEED = 42
TILE = 16_384  # fingerprints in a tile
_ROWS = 128  # rows of a tile compared at a time: the working set stays in the processor's cache
_SLICE = 1 << 15  # shingles hashed at a time
_SALTS = 16  # places that the rows of one component or star are dealt to


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    # Bytes methods treat ASCII alone: lower() changes A-Z, split() parts at 09-0D and 20.
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    size = min(shingle_words, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - size + 1
    starts, ends = starts[:n], ends[size - 1 :]
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _SLICE):
        spans = zip(starts[at : at + _SLICE].tolist(), ends[at : at + _SLICE].tolist())
        hashes = np.fromiter((digest(joined[a:b], HASH_SEED) for a, b in spans), dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    """Fingerprint as a signed 64-bit number."""

    @F.pandas_udf("long")
    def compute(texts: pd.Series) -> pd.Series:
        found = np.fromiter((fingerprint(t, shingle_words) for t in texts), dtype=np.uint64, count=len(texts))
        return pd.Series(found.view(np.int64))

    return compute(F.coalesce(text, F.lit("")))


def hex_digits(print_: Column) -> Column:
    return F.lower(F.lpad(F.hex(print_), 16, "0"))


def spanning_forest(n: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it is connected with) of every node that has a smaller one."""
    label = np.arange(n)
    while len(left):
        low, high = np.minimum(label[left], label[right]), np.maximum(label[left], label[right])
        apart = low < high
        if not apart.any():
            break
        left, right = left[apart], right[apart]
        np.minimum.at(label, high[apart], low[apart])
        while True:  # every node points at the root of its tree
            further = label[label]
            if (further == label).all():
                break
            label = further
    nodes = np.flatnonzero(label != np.arange(n))
    return nodes, label[nodes]


def compare_tiles(first: np.ndarray, second: np.ndarray | None, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between two tiles, or inside one, as pairs of fingerprints."""
    both = first if second is None else np.concatenate((first, second))
    other, shift = (first, 0) if second is None else (second, len(first))
    lefts, rights = [], []
    for at in range(0, len(first), _ROWS):
        rows = first[at : at + _ROWS, None]
        begin = at if second is None else 0
        near = np.bitwise_count(rows ^ other[None, begin:]) <= distance
        i, j = np.nonzero(near)
        i, j = i + at, j + begin + shift
        distinct = i != j
        if distinct.any():
            nodes, roots = spanning_forest(len(both), i[distinct], j[distinct])
            lefts.append(nodes)
            rights.append(roots)
    if not lefts:
        return both[:0], both[:0]
    nodes, roots = spanning_forest(len(both), np.concatenate(lefts), np.concatenate(rights))
    return both[nodes], both[roots]


def tile_links(prints: DataFrame, distance: int = DISTANCE, tile: int = TILE) -> DataFrame:
    """Links (u, v) that connect the same groups as all links, from distinct fingerprints (column ``print``)."""
    spark = prints.sparkSession
    numbered = number_rows(prints.withColumn("_ones", F.bit_count("print")), ["_ones", "print"], "_at")
    firsts = numbered.groupBy("_ones").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    counts = freeze(firsts)  # 65 rows at most
    place = F.floor((F.col("_at") - F.col("_first")) / tile).cast("long")
    tiles = freeze(
        numbered.join(F.broadcast(counts), "_ones")
        .groupBy("_ones", place.alias("_tile"))
        .agg(F.collect_list("print").alias("_prints"))
    )
    chunks = F.ceil(F.col("_n") / tile).cast("long")
    listed = counts.select("_ones", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("_tile"))
    partners = listed.select(
        F.col("_ones").alias("_ones2"), F.col("_tile").alias("_tile2"),
        F.explode(F.sequence(F.col("_ones") - distance, F.col("_ones"))).alias("_ones"),
    )
    pairs = listed.join(partners, "_ones").where((F.col("_ones") < F.col("_ones2")) | (F.col("_tile") <= F.col("_tile2")))
    second = tiles.select(
        F.col("_ones").alias("_ones2"), F.col("_tile").alias("_tile2"), F.col("_prints").alias("_prints2")
    )
    same = (F.col("_ones") == F.col("_ones2")) & (F.col("_tile") == F.col("_tile2"))
    work = (
        pairs.join(tiles, ["_ones", "_tile"])
        .join(second, ["_ones2", "_tile2"])
        # Dealt by the numbers of the pair, not by chance: a stage that runs again deals every pair as before.
        .select(
            "_prints", F.when(~same, F.col("_prints2")).alias("_prints2"),
            F.xxhash64("_ones", "_tile", "_ones2", "_tile2").alias("_spread"),
        )
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")) * 2, "_spread")
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in zip(batch["_prints"], batch["_prints2"]):
                first = np.asarray(a, dtype=np.int64).view(np.uint64)
                second = None if b is None else np.asarray(b, dtype=np.int64).view(np.uint64)
                u, v = compare_tiles(first, second, distance)
                yield pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return work.mapInPandas(compare, "u long, v long")


def _join_value(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Joins one row per key to rows of which a key may have any share: each key's rows are dealt to ``_SALTS`` places."""
    salt = F.pmod(F.xxhash64(*[c for c in rows.columns if c != key]), F.lit(_SALTS)).cast("int")
    copies = F.explode(F.array(*[F.lit(i) for i in range(_SALTS)]))
    return rows.withColumn("_salt", salt).join(values.withColumn("_salt", copies), [key, "_salt"]).drop("_salt")


def connect(links: DataFrame) -> DataFrame:
    """(node, root) for every linked node that is not its group's smallest, by alternating star steps.

    Minima are combined before the exchange and joined back, the neighbours of a node dealt to several places, so a node
    with very many of them is not gathered.
    """
    edges = freeze(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
        large = _join_value(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = freeze(large.distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _join_value(large, least, "u")
        edges = freeze(
            small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        )
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark


def components(marked: DataFrame, key: str, distance: int = DISTANCE, tile: int = TILE) -> DataFrame:
    """(print, root, component_id) of every distinct fingerprint, from stored rows of (key, print)."""
    prints = freeze(marked.groupBy("print").agg(F.min(key).alias("_least")))
    roots = connect(tile_links(prints.select("print"), distance, tile))
    labelled = prints.join(roots, prints["print"] == roots["node"], "left").select(
        "print", "_least", F.coalesce("root", "print").alias("root")
    )
    least = labelled.groupBy("root").agg(F.min("_least").alias("component_id"))
    return _join_value(labelled.drop("_least"), least, "root")


def groups(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    distance: int = DISTANCE,
) -> DataFrame:
    """Fingerprint and group of every document."""
    marked = freeze(docs.select(F.col(key).alias(key), fingerprint_column(F.col(text), shingle_words).alias("print")))
    found = components(marked, key, distance)
    return marked.join(found, "print").select(key, hex_digits(F.col("print")).alias("fingerprint"), "component_id")


def drop_near_copies(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    distance: int = DISTANCE,
) -> DataFrame:
    """One document of each group, that with the smallest key; all columns of ``docs``."""
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col(key).alias("_key"),
        fingerprint_column(F.col(text), shingle_words).alias("print"),
        F.monotonically_increasing_id().alias("_mark"),
    )
    stored = freeze(packed)  # marks must stay what they are
    found = components(stored.select("_key", "print"), "_key", distance)
    # The smallest row of each fingerprint, then of each group; a missing key comes last.
    order = F.struct(F.col("_key").isNull().alias("last"), F.col("_key").alias("key"), F.col("_mark").alias("mark"))
    best = stored.groupBy("print").agg(F.min(order).alias("_best"))
    kept = found.join(best, "print").groupBy("root").agg(F.min("_best").alias("_best")).select(F.col("_best.mark").alias("_mark"))
    return stored.join(kept, "_mark", "left_semi").select("_row.*")


@llm_query("op6_simhash_groups")
def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    return groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
