"""Random forests on inputs binned once, grown without gathering the rows or the nodes.

Every tree draws its rows with replacement: a row's copies follow a Poisson law of mean one, drawn from what the row
holds and the tree's number. Growth has two parts.

1. Level by level, the trees of a group together, until no node has more than ``finish`` drawn rows: a pass adds up
   histograms of some hundred open nodes. They are dealt to tasks by node, which add them up and find the split there;
   the driver receives the splits alone.
2. The rows of each such node, at most ``finish`` draws, meet in one task, which grows the rest of the branch there.

The nodes of both parts go to a stored table; the driver holds the nodes of the first part only, whose number is that of
the drawn rows divided by ``finish``, for a group of trees at a time. A forest of few nodes is scored by Spark's own
model, read from that table; rows of a larger one go to the branches that they reach (``branches``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from pulsegrid.models import branches, ensemble, growth
from pulsegrid.models.binned import BinnedRows, Block, feature_edges, mixed
from pulsegrid.models.blocks import add_to
from pulsegrid.models.growth import CURVE, PULL, Leaf, Limits, Split
from pulsegrid.session import freeze, scratch_path

# Cumulated chances of 0, 1, 2, ... copies of a row; beyond the last the chance is below 2^-60.
_COPIES = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
# ``branch``: root of the branch that a task has grown; none in the upper part.
_NODES = "tree int, node string, feature int, threshold double, value double, branch string"
_OPEN = 256  # open nodes whose histograms a pass adds up
_MANY = 150  # rows of a node above which it is faster to add up its draws by bin
_WHOLE = 200_000  # nodes that one model holds; larger forests are scored branch by branch


def copies(row: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn for a tree."""
    share = (mixed(row, seed * 1_000_003 + tree) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    return np.searchsorted(_COPIES, share, side="right").astype(np.float64)


def _drawn(row: np.ndarray, tree: int, seed: int, bootstrap: bool) -> np.ndarray:
    return copies(row, tree, seed) if bootstrap else np.ones(len(row))


def grow_branch(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, node: int, depth: int, limits: Limits) -> Iterator[tuple]:
    """(node, feature, bin, value) of a branch whose rows are at hand; a leaf has feature -1.

    Between two bins lies a possible split. Draws of a node of many rows are added up by input and bin; nodes of few rows
    are left to ``_grow_small``.
    """
    size = int(bins.max(initial=0)) + 1
    offsets = np.arange(len(bins))[:, None] * size
    todo, small = [(node, depth, np.arange(len(y)))], []
    while todo:
        node, depth, rows = todo.pop()
        if len(rows) <= _MANY:
            small.append((node, depth, rows))
            continue
        pull, curve = (weight * y)[rows], weight[rows]
        whole, count = pull.sum(), curve.sum()
        value = whole / count if count > 0 else 0.0
        best = None
        if (limits.depth is None or depth < limits.depth) and count >= 2 * limits.min_leaf:
            code = (bins[:, rows] + offsets).reshape(-1)
            left, below = (
                np.bincount(code, np.tile(v, len(bins)), minlength=len(bins) * size).reshape(-1, size).cumsum(axis=1)[:, :-1]
                for v in (pull, curve)
            )
            above = count - below
            allowed = (below >= limits.min_leaf) & (above >= limits.min_leaf) & (below > 0) & (above > 0)
            if allowed.any():
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(allowed, left**2 / below + (whole - left) ** 2 / above - whole * value, -np.inf)
                most = growth.first_best(gain, abs(whole * value))
                if gain.flat[most] > 1e-12 * max(abs(whole * value), abs(whole)):
                    best = divmod(most, gain.shape[1])
        if best is None:
            yield node, -1, -1, value
            continue
        feature, cut = int(best[0]), int(best[1])
        yield node, feature, cut, value
        goes = bins[feature, rows] <= cut
        todo += [(2 * node, depth + 1, rows[goes]), (2 * node + 1, depth + 1, rows[~goes])]
    yield from _grow_small(bins, y, weight, small, size, limits)


def _grow_small(
    bins: np.ndarray, y: np.ndarray, weight: np.ndarray, todo: Sequence[tuple[int, int, np.ndarray]], size: int, limits: Limits
) -> Iterator[tuple]:
    """What ``grow_branch`` yields below small nodes (node, depth, rows); all of a level at a time, as each has little work.

    Rows lie node by node; those of a node are ordered by each input's bins. Sums are of differences from the node's mean.
    """
    nodes, depths = [n for n, _, _ in todo], np.array([d for _, d, _ in todo], dtype=np.int64)
    rows = np.concatenate([np.zeros(0, dtype=np.int64), *[r for _, _, r in todo]])
    sizes = np.array([len(r) for _, _, r in todo], dtype=np.int64)
    while nodes:
        slot = np.repeat(np.arange(len(nodes)), sizes)
        count = np.bincount(slot, weight[rows], minlength=len(nodes))
        whole = np.bincount(slot, weight[rows] * y[rows], minlength=len(nodes))
        value = np.divide(whole, count, out=np.zeros(len(nodes)), where=count > 0)
        opened = (sizes > 1) & (count >= 2 * limits.min_leaf)
        if limits.depth is not None:
            opened &= depths < limits.depth
        feature, cut = np.full(len(nodes), -1), np.full(len(nodes), -1)
        if opened.any():
            mine = np.flatnonzero(opened)
            some = opened[slot]
            found = _small_splits(bins, y, weight, rows[some], sizes[mine], value[mine], count[mine], size, limits)
            feature[mine], cut[mine] = found
        yield from zip(nodes, feature.tolist(), cut.tolist(), value.tolist())
        split = feature >= 0
        some = split[slot]
        rows, slot = rows[some], (np.cumsum(split) - 1)[slot[some]]
        feature, cut, depths = feature[split], cut[split], np.repeat(depths[split] + 1, 2)
        child = 2 * slot + (bins[feature[slot], rows] > cut[slot])
        rows = rows[np.argsort(child, kind="stable")]
        sizes = np.bincount(child, minlength=2 * len(feature))
        nodes = [2 * node + side for node, goes in zip(nodes, split.tolist()) if goes for side in (0, 1)]


def _small_splits(
    bins: np.ndarray, y: np.ndarray, weight: np.ndarray, rows: np.ndarray, sizes: np.ndarray, value: np.ndarray,
    count: np.ndarray, size: int, limits: Limits,
) -> tuple[np.ndarray, np.ndarray]:
    """(input, bin) of the best split of each node, -1 for none; ``rows`` lie node by node."""
    slot, start = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    draws = weight[rows]
    away = draws * (y[rows] - value[slot])
    key = (slot * size + bins[:, rows]) << 32 | np.arange(len(rows))
    key.sort(axis=1)
    at, code = key & 0xFFFFFFFF, key >> 32
    left = np.cumsum(away[at], axis=1)
    below = np.cumsum(draws[at], axis=1)
    below -= (np.cumsum(count) - count)[slot]
    above = count[slot] - below
    allowed = (below >= limits.min_leaf) & (above >= limits.min_leaf) & (below > 0) & (above > 0)
    allowed[:, :-1] &= code[:, 1:] != code[:, :-1]
    allowed[:, start + sizes - 1] = False
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(allowed, left**2 * (count[slot] / (below * above)), -np.inf)
    most = np.maximum.reduceat(gain.max(axis=0), start)
    scale = np.abs(value) * np.abs(value * count)
    least = np.where(most > -np.inf, most - 1e-9 * np.abs(most) - 1e-13 * scale, np.inf)
    hits = np.flatnonzero(gain >= least[slot])
    first = np.full(len(sizes), -1)
    first[slot[hits % len(rows)][::-1]] = hits[::-1]  # the first of a node is assigned last
    good = first >= 0
    good[good] = gain.reshape(-1)[first[good]] > 1e-12 * np.maximum(scale, np.abs(value * count))[good]
    feature = np.where(good, first // len(rows), -1)
    cut = np.where(good, code.reshape(-1)[first] - np.arange(len(sizes)) * size, -1)
    return feature, cut


def _tables(bins: np.ndarray, groups: Sequence[np.ndarray], pull: np.ndarray, curve: np.ndarray, size: int) -> np.ndarray:
    """Sums of pulls and draws by (group of rows, input, bin)."""
    found = np.empty((len(groups), len(bins), size, 2))
    rows, length = np.concatenate(groups), len(groups) * size
    start = np.repeat(np.arange(len(groups)) * size, [len(g) for g in groups])
    pull, curve = pull[rows], curve[rows]
    for i, column in enumerate(bins):
        code = start + column[rows]
        found[:, i, :, PULL] = np.bincount(code, pull, minlength=length).reshape(-1, size)
        found[:, i, :, CURVE] = np.bincount(code, curve, minlength=length).reshape(-1, size)
    return found


@dataclass
class _Top:
    """The upper part of a tree: splits so far, open leaves, and leaves left to be finished."""

    splits: list[Split]
    open: list[Leaf]
    closed: list[Leaf]


class RandomForest(Estimator):
    """Mean of regression trees; ``min_leaf`` drawn rows at least in a leaf, ``depth`` None for any depth.

    ``together`` trees are grown at a time. ``finish`` bounds the drawn rows that meet in a task.
    """

    def __init__(
        self,
        trees: int = 100,
        depth: int | None = None,
        min_leaf: int = 5,
        bins: int = 255,
        bootstrap: bool = True,
        finish: int = 20_000,
        together: int = 25,
        seed: int = 42,
    ):
        super().__init__()
        self.trees, self.bins, self.bootstrap, self.seed = trees, bins, bootstrap, seed
        self.limits = Limits(None, depth, min_leaf)
        self.finish, self.together = finish, together

    def _fit(self, df: DataFrame) -> RandomForestModel:
        spark = df.sparkSession
        label = F.col("label").cast("double")
        content = [c for c, kind in df.dtypes if kind != "vector"]
        base = freeze(
            df.where(label.isNotNull()).select(
                "features", label.alias("_y"), F.lit(1.0).alias("_w"), F.lit(False).alias("_held"),
                F.xxhash64(*content, vector_to_array("features")).alias("_row"),
            )
        )
        rows = BinnedRows.store(base, feature_edges(base, self.bins))
        path = scratch_path(spark, "forest")
        for first in range(0, self.trees, self.together):
            numbers = list(range(first, min(first + self.together, self.trees)))
            nodes = self._finished(rows, dict(zip(numbers, self._tops(rows, numbers))))
            nodes.write.mode("append").parquet(path)
        rows.release()
        return RandomForestModel(spark.read.schema(_NODES).parquet(path), self.trees)

    # -------------------------------------------------------- upper levels

    def _tops(self, rows: BinnedRows, numbers: Sequence[int]) -> list[_Top]:
        seed, bootstrap = self.seed, self.bootstrap

        def whole(block: Block) -> np.ndarray:
            found = []
            for tree in numbers:
                weight = _drawn(block.row, tree, seed, bootstrap)
                found.append([weight @ block.y, weight.sum(), weight.sum()])  # draws stand for rows, as in the tables
            return np.array(found)

        stats = rows.fold(whole, add_to)
        if stats is None:
            stats = np.zeros((len(numbers), 3))
        tops = [_Top([], [Leaf(1, 0, own)], []) for own in stats]
        while self._split_level(rows, numbers, tops):
            for top in tops:
                children = []
                for leaf in top.open:
                    leaf.part()
                    children += leaf.children
                    top.splits.append(leaf.split())
                top.open = children
        return tops

    def _split_level(self, rows: BinnedRows, numbers: Sequence[int], tops: list[_Top]) -> bool:
        """Keeps the leaves open that are too large to be finished and can be split; whether there are any."""
        large = [(k, leaf) for k, top in enumerate(tops) for leaf in top.open if leaf.stats[CURVE] > self.finish]
        for first in range(0, len(large), _OPEN):
            self._find_splits(rows, numbers, tops, large[first : first + _OPEN])
        for top in tops:
            going = []
            for leaf in top.open:
                (going if leaf.gain > 0 else top.closed).append(leaf)
            top.open = going
        return any(top.open for top in tops)

    def _find_splits(self, rows: BinnedRows, numbers: Sequence[int], tops: list[_Top], asked: list[tuple[int, Leaf]]) -> None:
        """Splits of open leaves, given with the places of their trees; each is found where its histogram is added up."""
        size, seed, bootstrap = max(map(len, rows.edges), default=0) + 1, self.seed, self.bootstrap
        # Leaves hold drawn rows, so the least number counts draws.
        limits = Limits(None, self.limits.depth, 1, self.limits.min_leaf)
        wanted = [
            (numbers[k], tops[k].splits, [leaf.node for at, leaf in asked if at == k]) for k in sorted({k for k, _ in asked})
        ]
        about = [(leaf.node, leaf.depth, leaf.stats) for _, leaf in asked]

        def level(block: Block) -> np.ndarray:
            found = []
            for tree, splits, nodes in wanted:
                weight = _drawn(block.row, tree, seed, bootstrap)
                reached = growth.routes(block.bins, splits, np.flatnonzero(weight))
                found.append(_tables(block.bins, [reached[node] for node in nodes], weight * block.y, weight, size))
            return np.concatenate(found)

        def use(at: int, table: np.ndarray) -> tuple:
            node, depth, stats = about[at]
            # Every row drawn counts at least once, so draws tell whether there are rows.
            leaf = Leaf(node, depth, stats, np.concatenate([table[0], table[0][..., CURVE:]], axis=-1))
            growth.find_split(leaf, limits)
            return at, leaf.gain, leaf.feature, leaf.bin, leaf.sides()[0] if leaf.gain > 0 else None

        for at, gain, feature, cut, below in rows.fold_apart(level, add_to, np.array_split, len(asked), use):
            leaf = asked[at][1]
            leaf.gain, leaf.feature, leaf.bin, leaf.below = gain, feature, cut, below

    # -------------------------------------------------------- branches

    def _finished(self, rows: BinnedRows, tops: dict[int, _Top]) -> DataFrame:
        """Node rows of the trees: the upper parts, and the branches grown where their rows meet."""
        spark, edges, seed, bootstrap = rows.frame.sparkSession, rows.edges, self.seed, self.bootstrap
        unpack, limits, most = rows._unpacker(), self.limits, self.finish
        upper, small = [], {}
        for tree, top in tops.items():
            for s in top.splits:
                upper.append((tree, str(s.node), s.feature, float(edges[s.feature][s.bin]), 0.0, None))
            for leaf in top.closed:
                if leaf.stats[CURVE] > most or leaf.stats[CURVE] == 0:  # cannot be split
                    value = float(leaf.stats[PULL] / leaf.stats[CURVE]) if leaf.stats[CURVE] else 0.0
                    upper.append((tree, str(leaf.node), -1, 0.0, value, None))
                else:
                    small[(tree, leaf.node)] = leaf.depth
        splits = {tree: top.splits for tree, top in tops.items()}

        def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    _, block = unpack(Row(**row._asdict()))
                    for tree, own in splits.items():
                        weight = _drawn(block.row, tree, seed, bootstrap)
                        parts = growth.routes(block.bins, own, np.flatnonzero(weight))
                        sent = [(node, at) for node, at in parts.items() if (tree, node) in small and len(at)]
                        if sent:
                            yield pd.DataFrame({
                                "tree": tree, "node": [str(node) for node, _ in sent], "block": row.block,
                                "bins": [np.ascontiguousarray(block.bins[:, at]).tobytes() for _, at in sent],
                                "y": [block.y[at].tobytes() for _, at in sent],
                                "weight": [weight[at].tobytes() for _, at in sent],
                            })

        kind = np.dtype(np.uint8 if max(map(len, edges), default=0) < 256 else np.uint16)

        def finish(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("block")
            tree, node = int(group["tree"].iloc[0]), int(group["node"].iloc[0])
            y = [np.frombuffer(v) for v in group["y"]]
            bins = [np.frombuffer(v, dtype=kind).reshape(len(edges), -1) for v in group["bins"]]
            weight = np.concatenate([np.frombuffer(v) for v in group["weight"]])
            found = grow_branch(np.concatenate(bins, axis=1), np.concatenate(y), weight, node, small[(tree, node)], limits)
            grown = [(tree, str(n), f, float(edges[f][b]) if f >= 0 else 0.0, float(v), str(node)) for n, f, b, v in found]
            return pd.DataFrame(grown, columns=["tree", "node", "feature", "threshold", "value", "branch"])

        sent = rows.frame.mapInPandas(send, "tree int, node string, block long, bins binary, y binary, weight binary")
        lower = sent.groupBy("tree", "node").applyInPandas(finish, _NODES)
        return spark.createDataFrame(upper, _NODES).unionByName(lower)


class RandomForestModel(Model):
    """A forest whose nodes are a table. Spark's own model scores rows where there are few nodes, and tasks that hold a
    branch each where there are many. A table without branches, saved by an earlier version, is scored by the former."""

    def __init__(self, nodes: DataFrame, trees: int):
        super().__init__()
        self.nodes, self.trees = nodes, trees
        self._scorer: Model | None = None

    def _transform(self, df: DataFrame) -> DataFrame:
        if self._scorer is None:
            if self.nodes.count() > _WHOLE and not self.nodes.where("branch IS NOT NULL").isEmpty():
                return branches.mean_of_trees(self.nodes, self.trees, df)
            self._scorer = ensemble.tree_sum_of(numbered_nodes(self.nodes), self.trees, 1.0 / max(self.trees, 1))
        scored = self._scorer.transform(df)
        return scored.select(*df.columns, F.col(ensemble.SCORE).alias("yhat"))

    def save_parts(self, spark: SparkSession, path: str) -> dict:
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        return {"trees": self.trees}

    @classmethod
    def load_parts(cls, spark: SparkSession, path: str, meta: dict) -> RandomForestModel:
        return cls(spark.read.schema(_NODES).parquet(f"{path}/nodes"), meta["trees"])


def numbered_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes of a tree numbered from its root, each after its parent, with the numbers of its children.

    A node's name is its way from the root as a number; longer names lie deeper. A tree is numbered in one task.
    """

    def number(tree: pd.DataFrame) -> pd.DataFrame:
        names = sorted(map(int, tree["node"]))
        place = {name: i for i, name in enumerate(names)}
        tree = tree.assign(at=[place[int(n)] for n in tree["node"]])
        inner = tree["feature"] >= 0
        for side, offset in (("left", 0), ("right", 1)):
            tree[side] = [place[2 * int(n) + offset] if i else -1 for n, i in zip(tree["node"], inner)]
        return tree.assign(node=tree["at"])[["tree", "node", "feature", "threshold", "left", "right", "value"]]

    schema = "tree int, node int, feature int, threshold double, left int, right int, value double"
    return nodes.groupBy("tree").applyInPandas(number, schema)
