from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import topk as T

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k, is_query):
    fit = set()
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fit.add((i, tuple(math.floor(64 * float(x)) for x in v)))
    out = []
    for q, a in fit:
        if is_query(q):
            scored = [(-sum(x * y for x, y in zip(a, b)), i) for i, b in fit if i != q]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def check(spark, rows, k=20, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit("x"), "v": F.lit("y"), "near": F.lit(0)})
    found = T.top_products(df, lambda i: i % 20 == 0, k=k, **options)
    assert [f.dataType.simpleString() for f in found.schema.fields] == ["bigint", "int", "bigint", "bigint"]
    stored = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert sorted(map(tuple, found.collect())) == brute(stored, k, lambda i: i % 20 == 0)


def vectors(n, length=8, seed=0, spread=1.0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(5, length))
    return [(i, [float(x) for x in np.float32(centers[i % 5] + spread * rng.normal(size=length))]) for i in range(n)]


def test_random_and_clustered_vectors(spark):
    check(spark, vectors(400))
    check(spark, vectors(300, spread=0.01), k=3, pivots=4)


def test_ties_repeats_and_unfit_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(50)] + [(20, [1.0, 2.0]), (40, [0.5, 0.5]), (None, [1.0, 1.0])]
    rows += [(60, None), (80, [1.0, None]), (100, [float("nan"), 1.0]), (120, [float("inf"), 1.0]), (140, []), (141, [3.0])]
    check(spark, rows)


def test_few_candidates_and_empty_tables(spark):
    check(spark, [(0, [1.0]), (1, [2.0])])
    check(spark, [(0, [1.0])])
    check(spark, [(0, []), (1, [])])
    check(spark, [])
    check(spark, [(3, [1.0, 1.0])])


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(2**21 + i), float(2**21 - 3 * i), float(i)]) for i in range(60)]
    check(spark, rows, k=5)


@pytest.mark.parametrize("tile", [3, 50])
def test_search_skips_but_never_loses(tile):
    rng = np.random.default_rng(tile)
    data = rng.integers(-200, 200, size=(300, 6))
    places = T.choose_pivots(data[:40].astype(float), 5)
    table = T.distances(data.astype(float), places)
    make = lambda rows: T.Tile(rows, [data[i].astype("<i8").tobytes() for i in rows], [table[i].astype("<f8").tobytes() for i in rows], 5)
    queries = make(range(10))
    for q in range(10):
        best = T.Best(7)
        for at in range(0, 300, tile):
            T.search(q, queries, make(range(at, min(at + tile, 300))), best)
        scores = data @ data[q]
        wanted = sorted((-int(scores[i]), i) for i in range(300) if i != q)[:7]
        assert list(zip((-best.scores).tolist(), best.ids.tolist())) == wanted
