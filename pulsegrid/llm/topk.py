"""Exact search for the highest inner products by pivot-table elimination.

Vectors become whole numbers: floor(64 * component). A bounded sample gives pivots, far from each other; the table of
distances of all vectors to all pivots is computed once and stored. For a query q and a candidate x every pivot p
gives |x - q| >= | |x - p| - |q - p| |; the greatest of these is the lower bound of the distance, and
(|q|^2 + |x|^2 - bound^2) / 2 is an upper bound of the inner product.

Queries and candidates are cut into tiles; candidates lie in tiles by their nearest pivot. For each query a tile is
passed over whole if the bound of its box is below the score the query has already; otherwise candidates are scored
in the order of their bounds until no bound left reaches the k-th best score: the search stops there and is exact.
The first k-th best score of a query comes from the pivot sample. A task keeps the best of a query across the tiles
it sees and returns k rows per query; these are merged by one window.

Scale. Only the sample and the pivots reach the driver. A query tile and a candidate tile have bounded sizes and are
all that a task holds. The number of tile pairs grows with queries times candidates, as the question itself does.

Defined results: vectors that are null or hold null or non-finite components take no part, on either side. Rows that
repeat both id and vector count once; a row with the query's id is never its candidate. Shorter vectors count as if
filled up with zeros; an empty vector scores 0 with all. Fewer candidates than k give fewer ranks; equal scores rank
by id, smallest first. Different vectors under one id are queries of their own. Whole numbers beyond 64 bits saturate and sums of products wrap. Rows without an id take no
part. An empty table gives an empty table. Only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pulsegrid.llm.common import llm_query, table
from pulsegrid.operators.skew import number_rows
from pulsegrid.session import freeze

SCALE = 64
TOP = 20
PIVOTS = 24
SAMPLE = 1024
QUERY_TILE, TILE = 512, 4096
FIRST_ROUND = 128  # candidates scored in the first round; each later round takes four times as many
SPREAD = 8  # tasks that share the candidates of a query tile


def whole_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v) of the rows that take part, v an array of whole numbers of one length."""
    number = lambda x: x.cast("double")
    unfit = lambda x: x.isNull() | F.isnan(number(x)) | (F.abs(number(x)) == float("inf"))
    column = F.col(f"`{vector}`")
    fit = rows.where(F.col(key).isNotNull() & column.isNotNull()).where(~F.exists(column, unfit))
    scaled = fit.select(
        F.col(key).cast("long").alias("id"), F.transform(column, lambda x: F.floor(number(x) * scale)).alias("v")
    ).dropDuplicates()
    scaled = freeze(scaled)
    length = scaled.agg(F.max(F.size("v"))).first()[0] or 0
    return scaled.select("id", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(length) - F.size("v"))).alias("v"))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows of the sample that are far from each other: each next one is the farthest from those chosen."""
    if not len(sample):
        return sample
    chosen = [int(np.argmax((sample**2).sum(axis=1)))]
    nearest = np.full(len(sample), np.inf)
    while len(chosen) < min(count, len(sample)):
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        following = int(np.argmax(nearest))
        if nearest[following] == 0:
            break
        chosen.append(following)
    return sample[chosen]


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of every vector to every pivot."""
    squared = (vectors**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * vectors @ pivots.T
    return np.sqrt(np.maximum(squared, 0.0))


def products(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit whole numbers; in floating point where that is exact."""
    largest = float(np.abs(matrix).max(initial=0)) * float(np.abs(vector).max(initial=0)) * max(len(vector), 1)
    if largest < 2**53:
        return (matrix.astype(np.float64) @ vector.astype(np.float64)).astype(np.int64)
    return matrix @ vector


class Best:
    """The k best (score, id) of a query so far."""

    def __init__(self, k: int, score: int | None = None):
        self.k, self.scores, self.ids = k, np.empty(0, np.int64), np.empty(0, np.int64)
        self.floor = -np.inf if score is None else score  # scores below it cannot be among the best

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.floor
        if not good.any():
            return
        scores, ids = np.concatenate((self.scores, scores[good])), np.concatenate((self.ids, ids[good]))
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.floor = max(self.floor, int(self.scores[-1]))


class Tile:
    """Vectors of a tile with their ids, distances to the pivots and squared lengths."""

    def __init__(self, ids, vectors: list[bytes], table_: list[bytes], pivots: int):
        self.ids = np.asarray(ids, dtype=np.int64)
        n = len(self.ids)
        self.vectors = np.frombuffer(b"".join(vectors), dtype="<i8").reshape(n, len(vectors[0]) // 8)
        self.table = np.frombuffer(b"".join(table_), dtype="<f8").reshape(n, pivots)
        self.squares = (self.vectors.astype(np.float64) ** 2).sum(axis=1)
        size = float(np.abs(self.vectors).max(initial=0)) ** 2 * self.vectors.shape[1]
        self.exact = self.vectors.astype(np.float64) if size < 2**53 else None  # floating point holds every product
        self.low, self.high = self.table.min(axis=0), self.table.max(axis=0)
        self.longest = self.squares.max()


def search(query: int, queries: Tile, tile: Tile, best: Best) -> None:
    """Scores candidates of a tile in the order of their bounds until none left can be among the best."""
    here, square = queries.table[query], queries.squares[query]
    slack = 1 + 1e-9 * (square + tile.longest)  # rounding never takes a candidate away
    gap = np.maximum(np.maximum(tile.low - here, here - tile.high), 0.0).max(initial=0.0)
    if (square + tile.longest - gap * gap) / 2 + slack < best.floor:
        return
    bound = np.abs(tile.table - here).max(axis=1, initial=0.0)
    limit = (square + tile.squares - bound * bound) / 2 + slack
    limit[tile.ids == queries.ids[query]] = -np.inf
    left = np.flatnonzero((limit >= best.floor) & (limit > -np.inf))
    take = FIRST_ROUND
    while len(left):
        if take < len(left):
            order = np.argpartition(-limit[left], take)
            now, left = left[order[:take]], left[order[take:]]
        else:
            now, left = left, left[:0]
        if queries.exact is not None and tile.exact is not None:
            scores = (tile.exact[now] @ queries.exact[query]).astype(np.int64)
        else:
            scores = products(tile.vectors[now], queries.vectors[query])
        best.add(scores, tile.ids[now])
        left = left[limit[left] >= best.floor]
        take *= 4


def _tiles(rows: DataFrame, order: list[str], size: int, name: str) -> DataFrame:
    """One row per ``size`` rows in the given order, with their columns as lists."""
    numbered = number_rows(rows, order, "_at")
    lists = [F.col(f"_rows.{f}").alias(f"{name}_{f}") for f in ("id", "v", "d")]
    grouped = numbered.groupBy(F.floor(F.col("_at") / size).alias(name)).agg(
        F.collect_list(F.struct("id", "v", "d")).alias("_rows")
    )
    return freeze(grouped.select(name, *lists))


def top_products(
    rows: DataFrame,
    is_query,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = TOP,
    scale: int = SCALE,
    pivots: int = PIVOTS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every query. ``is_query`` tests the column ``id``."""
    spark = rows.sparkSession
    vectors = whole_vectors(rows, key, vector, scale)
    drawn = vectors.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).collect()
    schema = "query long, query_id long, vec_id long, score long"
    length = len(drawn[0]["v"]) if drawn else 0
    sample = np.array([r["v"] for r in drawn], dtype=np.int64).reshape(len(drawn), length)
    sample_ids = np.array([r["id"] for r in drawn], dtype=np.int64)
    places = choose_pivots(sample.astype(np.float64), pivots)
    shared = spark.sparkContext.broadcast((sample, sample_ids, places))  # SAMPLE vectors

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = shared.value[2]
        for batch in batches:
            if len(batch):
                exact = np.array(batch["v"].tolist(), dtype="<i8").reshape(len(batch), length)
                table_ = distances(exact.astype(np.float64), places).astype("<f8")
                near = table_.argmin(axis=1) if table_.shape[1] else np.zeros(len(batch), dtype=np.int64)
                yield pd.DataFrame(
                    {
                        "id": batch["id"],
                        "near": near.astype(np.int32),
                        "far": table_[np.arange(len(batch)), near] if table_.shape[1] else 0.0,
                        "v": [row.tobytes() for row in exact],
                        "d": [row.tobytes() for row in table_],
                    }
                )

    stored = freeze(vectors.mapInPandas(measure, "id long, near int, far double, v binary, d binary"))
    candidates = _tiles(stored, ["near", "far", "id", "v"], TILE, "c")
    queries = _tiles(stored.where(is_query(F.col("id"))), ["near", "far", "id", "v"], QUERY_TILE, "q")
    # Each query tile meets each candidate tile by its number; tiles are numbered without gaps.
    meets = F.sequence(F.lit(0).cast("long"), F.lit(candidates.count() - 1).cast("long"))
    pairs = queries.select("q", F.explode(meets).alias("c"))
    work = (
        pairs.join(queries, "q").join(candidates, "c")
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "q", F.pmod("c", F.lit(SPREAD)))
        .sortWithinPartitions("q", "c")
    )

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sample, sample_ids, places = shared.value
        number, tile, best = None, None, []

        def result() -> pd.DataFrame:
            found = [(i, b) for i, b in enumerate(best) if len(b.ids)]
            return pd.DataFrame(
                {
                    "query": np.repeat([number * QUERY_TILE + i for i, _ in found], [len(b.ids) for _, b in found]),
                    "query_id": np.repeat([tile.ids[i] for i, _ in found], [len(b.ids) for _, b in found]),
                    "vec_id": np.concatenate([b.ids for _, b in found]),
                    "score": np.concatenate([b.scores for _, b in found]),
                }
            )

        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.q != number:
                    if any(len(b.ids) for b in best):
                        yield result()
                    number, tile = row.q, Tile(row.q_id, row.q_v, row.q_d, len(places))
                    best = []
                    for i in range(len(tile.ids)):
                        scores = products(sample[sample_ids != tile.ids[i]], tile.vectors[i])
                        best.append(Best(k, int(np.partition(scores, -k)[-k]) if len(scores) >= k else None))
                against = Tile(row.c_id, row.c_v, row.c_d, len(places))
                for i in range(len(tile.ids)):
                    search(i, tile, against, best[i])
        if any(len(b.ids) for b in best):
            yield result()

    found = work.mapInPandas(find, schema)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


_SQL = """
WITH fit AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), q AS (
  SELECT row_number() OVER () AS k, vec_id AS query_id, v FROM fit WHERE vec_id % 20 = 0
), scored AS (
  SELECT k, query_id, fit.vec_id,
         CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(fit.v AS DOUBLE[])) AS BIGINT) AS score
  FROM q JOIN fit ON fit.vec_id <> q.query_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS "rank" FROM scored
)
SELECT query_id, CAST("rank" AS INTEGER) AS "rank", vec_id, score FROM ranked WHERE "rank" <= 20"""


@llm_query("op4_pivot_top_k", _SQL)
def op4_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all vectors for every twentieth one."""
    return top_products(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
