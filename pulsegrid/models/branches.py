"""Scores of forests whose nodes are too many for one place.

The upper part of every tree, down to the branches that tasks have grown, is small and known to all tasks. Rows walk it
in chunks; what is left of their way lies in one branch for each tree. There the binned inputs of the rows meet the
nodes of the branch: an exchange by (tree, branch) in which a branch's nodes come first and the rows stream past them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from pulsegrid.session import freeze

_ROW = "_forest_row"
_CHUNK = 1 << 16  # rows that walk the upper parts together
_TOGETHER = 1 << 15  # rows that walk a branch together
_SENT = "tree int, branch string, deal int, kind int, ids binary, payload binary"
_LEAF, _BRANCH = -1, -2


def mean_of_trees(nodes: DataFrame, trees: int, df: DataFrame) -> DataFrame:
    """``df`` with the mean of the trees' values as ``yhat``. ``nodes`` tells the branch of every lower node."""
    kept = freeze(df.withColumn(_ROW, F.monotonically_increasing_id()))
    edges = _edges(nodes)
    tops = _upper(nodes, edges, trees)
    kind = np.min_scalar_type(max(map(len, edges)))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, inputs in _chunks(batches):
            bins = np.empty((len(edges), len(ids)), dtype=kind)
            for i, cuts in enumerate(edges):
                bins[i] = np.searchsorted(cuts, inputs[:, i], side="left")
            for tree, top in enumerate(tops):
                sent, values = [], np.full(len(ids), np.nan)
                known = np.zeros(len(ids), dtype=bool)
                for what, rows in _reached(top, bins):
                    if isinstance(what, str):
                        sent.append((tree, what, 0, 1, ids[rows].tobytes(), np.ascontiguousarray(bins[:, rows]).tobytes()))
                    else:
                        values[rows], known[rows] = what, True
                if known.any():
                    sent.append((tree, "", 1 + int(ids[0] % 1009), 1, ids[known].tobytes(), values[known].tobytes()))
                yield pd.DataFrame(sent, columns=["tree", "branch", "deal", "kind", "ids", "payload"])

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        tree, branch = int(part["tree"].iloc[0]), part["branch"].iloc[0]
        names = [int(n) for n in part["node"]]
        place = {name: i for i, name in enumerate(sorted(names))}
        links, value = np.full((4, len(names)), -1, dtype=np.int32), np.empty(len(names))
        for name, feature, threshold, v in zip(names, part["feature"], part["threshold"], part["value"]):
            at = place[name]
            value[at] = v
            if feature >= 0:
                cut = np.searchsorted(edges[feature], threshold)
                links[:, at] = feature, cut, place[2 * name], place[2 * name + 1]
        payload = links.tobytes() + value.tobytes()
        return pd.DataFrame([(tree, branch, 0, 0, b"", payload)], columns=["tree", "branch", "deal", "kind", "ids", "payload"])

    width = len(edges)

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, links, value = 0, None, None
        ids, bins, held = [], [], 0

        def walked() -> pd.DataFrame:
            return _values(np.concatenate(ids), tree, _walk(links, value, np.concatenate(bins, axis=1)))

        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.branch == "":
                    yield _values(np.frombuffer(r.ids, dtype=np.int64), r.tree, np.frombuffer(r.payload))
                    continue
                if r.kind == 0 or held >= _TOGETHER:
                    if held:
                        yield walked()
                    ids, bins, held = [], [], 0
                if r.kind == 0:
                    size = len(r.payload) // 24
                    links = np.frombuffer(r.payload, dtype=np.int32, count=4 * size).reshape(4, size)
                    tree, value = r.tree, np.frombuffer(r.payload, offset=16 * size)
                    continue
                ids.append(np.frombuffer(r.ids, dtype=np.int64))
                bins.append(np.frombuffer(r.payload, dtype=kind).reshape(width, -1))
                held += len(ids[-1])
        if held:
            yield walked()

    rows = kept.select(_ROW, vector_to_array("features").alias("x")).mapInPandas(route, _SENT)
    packed = nodes.where("branch IS NOT NULL").groupBy("tree", "branch").applyInPandas(pack, _SENT)
    met = packed.unionByName(rows).repartition("tree", "branch", "deal").sortWithinPartitions("tree", "branch", "deal", "kind")
    values = met.mapInPandas(resolve, f"{_ROW} long, tree int, value double")
    in_order = F.array_sort(F.collect_list(F.struct("tree", "value")))
    mean = F.aggregate(in_order, F.lit(0.0), lambda total, one: total + one["value"] * F.lit(1.0 / trees))
    scored = values.groupBy(_ROW).agg(mean.alias("yhat"))
    return kept.join(scored, _ROW).select(*df.columns, "yhat")


def _edges(nodes: DataFrame) -> list[np.ndarray]:
    """All thresholds of every input in order: a row goes left if its number of lower ones is no more than the place."""
    found: dict[int, list[float]] = {}
    for feature, threshold in nodes.where("feature >= 0").select("feature", "threshold").distinct().collect():
        found.setdefault(feature, []).append(threshold)
    return [np.sort(np.array(found.get(i, []), dtype=np.float64)) for i in range(max(found, default=0) + 1)]


def _upper(nodes: DataFrame, edges: list[np.ndarray], trees: int) -> list[dict]:
    """For each tree its upper nodes by name: (input, bin, value)."""
    tops: list[dict] = [{} for _ in range(trees)]
    for r in nodes.where("branch IS NULL").collect():
        cut = int(np.searchsorted(edges[r["feature"]], r["threshold"])) if r["feature"] >= 0 else -1
        tops[r["tree"]][int(r["node"])] = (r["feature"], cut, r["value"])
    return tops


def _reached(top: dict, bins: np.ndarray) -> Iterator[tuple[str | float, np.ndarray]]:
    """Rows by the value of the leaf or the name of the branch they come to."""
    todo = [(1, np.arange(bins.shape[1]))]
    while todo:
        name, rows = todo.pop()
        if not len(rows):
            continue
        feature, cut, value = top.get(name, (_BRANCH, -1, 0.0))
        if feature == _BRANCH:
            yield str(name), rows
        elif feature == _LEAF:
            yield float(value), rows
        else:
            left = bins[feature, rows] <= cut
            todo += [(2 * name, rows[left]), (2 * name + 1, rows[~left])]


def _walk(links: np.ndarray, value: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Values of the leaves that rows come to; the root is the first node."""
    at = np.zeros(bins.shape[1], dtype=np.int32)
    going = np.arange(bins.shape[1]) if links[0, 0] >= 0 else np.empty(0, dtype=np.int64)
    while len(going):
        feature, cut, left, right = links[:, at[going]]
        at[going] = np.where(bins[feature, going] <= cut, left, right)
        going = going[links[0, at[going]] >= 0]
    return value[at]


def _values(ids: np.ndarray, tree: int, value: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({_ROW: ids, "tree": np.full(len(ids), tree, dtype=np.int32), "value": value})


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, inputs, size = [], [], 0
    for batch in batches:
        if not len(batch):
            continue
        ids.append(batch[_ROW].to_numpy(np.int64))
        inputs.append(np.array(batch["x"].tolist(), dtype=np.float64))
        size += len(batch)
        if size >= _CHUNK:
            yield np.concatenate(ids), np.concatenate(inputs)
            ids, inputs, size = [], [], 0
    if ids:
        yield np.concatenate(ids), np.concatenate(inputs)
