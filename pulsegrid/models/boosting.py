"""Gradient boosting with leaves fitted to the loss, on inputs binned once.

Each round grows one tree, best leaf first, on the negative gradient (``growth``), from a store of binned rows
(``binned``); then leaves take the value their loss asks for. What reaches the driver per pass are sums by leaf, input
and bin. Scores of the rows are brought up to date while blocks are read and written anew every few rounds; with
``resume_dir`` what has been fitted until then is kept, and a fit that ended early goes on from there.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
import threading
from collections import OrderedDict
from collections.abc import Callable, Sequence
from contextlib import ExitStack
from dataclasses import dataclass
from functools import partial
from typing import Any

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsegrid.functions.weights import expm1_clipped, log1p_clipped
from pulsegrid.models import ensemble, growth
from pulsegrid.models.binned import BinnedRows, Block, drawn, feature_edges, group_quantiles
from pulsegrid.models.blocks import add_to, array_pieces
from pulsegrid.models.growth import COUNT, CURVE, PULL, FlatTree, Grown, Limits
from pulsegrid.models.losses import Loss, make_loss
from pulsegrid.session import freeze, scratch_path

_DRAW = 1 << 53


class BoostedTrees(Estimator):
    """``weigh`` maps the label to a sample weight; ``log_target`` fits log1p of the clipped label.

    ``l2`` weighs on splits and on leaves that are a ratio of gradients; leaves that are quantiles take no penalty.
    """

    def __init__(
        self,
        loss: str = "squared",
        tau: float = 0.5,
        rounds: int = 100,
        step: float = 0.06,
        leaves: int | None = 31,
        depth: int | None = None,
        bins: int = 255,
        min_leaf: int = 20,
        min_curvature: float = 0.0,
        l2: float = 0.0,
        row_share: float = 1.0,
        column_share: float = 1.0,
        valid_share: float = 0.0,
        patience: int = 10,
        weigh: Callable[[Column], Column] | None = None,
        log_target: bool = False,
        checkpoint_every: int = 5,
        resume_dir: str | None = None,
        seed: int = 42,
    ):
        super().__init__()
        if leaves is None and depth is None:
            raise ValueError("a tree needs a limit of leaves or of depth")
        self.loss = make_loss(loss, tau)
        self.rounds, self.step, self.bins = rounds, step, bins
        self.limits = Limits(leaves, depth, min_leaf, min_curvature, l2)
        self.row_share, self.column_share = row_share, column_share
        self.valid_share, self.patience = valid_share, patience
        self.weigh, self.log_target = weigh, log_target
        self.checkpoint_every, self.resume_dir, self.seed = checkpoint_every, resume_dir, seed

    def _settings(self) -> str:
        """All that decides the trees, but for how many there are."""
        parts = (self.loss, self.step, self.bins, self.limits, self.row_share, self.column_share, self.valid_share,
                 self.patience, self.log_target, self.checkpoint_every, self.seed)
        return hashlib.sha256(repr(parts).encode()).hexdigest()

    def _weight(self) -> Column:
        label = F.col("label").cast("double")
        return (self.weigh(label) if self.weigh else F.lit(1.0)).cast("double")

    def _base(self, df: DataFrame, weight: Column | None = None) -> DataFrame:
        """Inputs, label, weight and hash of the rows with a label, and which are held out; stored."""
        label = F.col("label").cast("double")
        y = log1p_clipped(label) if self.log_target else label
        weight = self._weight() if weight is None else weight
        # Draws depend on what a row holds, not on where it lies: another cluster draws the same rows.
        content = [c for c, kind in df.dtypes if kind != "vector"]
        row = F.xxhash64(*content, vector_to_array("features"))
        held = F.pmod(F.xxhash64("_row", F.lit(self.seed)), F.lit(_DRAW)) < int(self.valid_share * _DRAW)
        return freeze(
            df.where(label.isNotNull())
            .select("features", y.alias("_y"), weight.alias("_w"), row.alias("_row"))
            .withColumn("_held", held)
        )

    def prepare(self, df: DataFrame) -> Prepared:
        """Rows with label, weight, hash and bins, stored. Fits that differ in other settings may share them."""
        base = self._base(df)
        edges = feature_edges(base.where("NOT _held"), self.bins)
        return Prepared(base, BinnedRows.store(base, edges))

    def prepare_like(self, df: DataFrame, prepared: Prepared) -> BinnedRows:
        """Other rows in the bins of prepared ones."""
        return BinnedRows.store(self._base(df), prepared.rows.edges)

    def _rows_alike(self) -> tuple:
        """What decides the stored rows, but for their weights."""
        return self.bins, self.valid_share, self.seed, self.log_target

    def fit_prepared(self, prepared: Prepared) -> BoostedTreesModel:
        fit = _Fit(self, prepared)
        with fit.among:
            if not fit.resume():
                fit.begin()
            fit.run()
        return BoostedTreesModel(fit.trees, fit.start, self.step, self.loss, self.log_target)

    def _fit(self, df: DataFrame) -> BoostedTreesModel:
        prepared = self.prepare(df)
        model = self.fit_prepared(prepared)
        prepared.rows.release()
        return model


def fit_side_by_side(models: Sequence[BoostedTrees], df: DataFrame) -> list[BoostedTreesModel]:
    """Fits on the same rows, which are hashed, cut into bins and stored once, with the weights of all of them."""
    first = models[0]
    if len({model._rows_alike() for model in models}) > 1:
        raise ValueError("fits side by side need the same bins, seed, held rows and scale of the label")
    base = first._base(df, F.array(*[model._weight() for model in models]))
    stored = BinnedRows.store(base, feature_edges(base.where("NOT _held"), first.bins))
    found = []
    for i, model in enumerate(models):
        prepared = Prepared(base.withColumn("_w", F.col("_w")[i]), stored.weighed(i))
        found.append(model.fit_prepared(prepared))
        prepared.rows.release()
    return found


class Known:
    """What fits on the same rows have found out, for other fits that ask the same; the last used up to ``most`` bytes.

    A sum depends on the rows of a node and their scores alone: on the way to the node and on the trees before. Fits
    that differ in a limit or a step ask for the same sums until the difference tells.
    """

    def __init__(self, most: int = 192 << 20):
        self.most, self.held = most, 0
        self.kept: OrderedDict[tuple, tuple[Any, int]] = OrderedDict()
        self.lock = threading.Lock()

    def get(self, key: tuple) -> Any:
        with self.lock:
            if key not in self.kept:
                return None
            self.kept.move_to_end(key)
            return self.kept[key][0]

    def put(self, key: tuple, value: Any, size: int = 100) -> None:
        with self.lock:
            self.held += size - self.kept.pop(key, (None, 0))[1]
            self.kept[key] = value, size
            while self.held > self.most:
                self.held -= self.kept.popitem(last=False)[1][1]


@dataclass(frozen=True)
class Prepared:
    base: DataFrame
    rows: BinnedRows
    known: Known | None = None


def _way(splits: Sequence[growth.Split]) -> Callable[[int], tuple]:
    """(input, bin, side) of every step from the root to a node."""
    at = {s.node: s for s in splits}

    def way(node: int) -> tuple:
        steps = []
        while node > 1:
            node, side = divmod(node, 2)
            steps.append((at[node].feature, at[node].bin, side))
        return tuple(steps[::-1])

    return way


class _Fit:
    """A fit under way: the rows with their scores, the trees so far and the losses of held rows."""

    def __init__(self, model: BoostedTrees, prepared: Prepared):
        self.model, self.base, self.rows = model, prepared.base, prepared.rows
        self.spark = prepared.base.sparkSession
        self.folder = model.resume_dir or scratch_path(self.spark, "boosting")
        self.trees: list[FlatTree] = []
        self.losses: list[float] = []
        self.start = 0.0
        self.stored = 0  # trees that are in the stored scores
        self.own = False  # whether the rows are this fit's alone
        self.known = prepared.known if model.resume_dir is None else None
        self.among = ExitStack()  # the fits that make their passes together
        if self.rows.passes is not None:
            self.among.enter_context(self.rows.passes.member())
        # Tells the rows drawn and their scores from others.
        drawn_by = model.seed if model.row_share < 1 else None
        self.state = repr((id(prepared.rows), model.loss, model.row_share, drawn_by))

    def _recall(self, key: tuple) -> Any:
        return self.known.get((self.state, *key)) if self.known else None

    def _note(self, key: tuple, value: Any, size: int = 100) -> None:
        if self.known:
            self.known.put((self.state, *key), value, size)

    def _once(self, keys: Sequence[tuple], ask: Callable[[list[int]], Sequence[Any]], size: int = 100) -> list:
        """What is asked by each key; ``ask`` finds it out for the keys at some places. No fit side by side asks the same
        at a time."""
        if self.known is None:
            return list(ask(list(range(len(keys)))))
        found, passes = [None] * len(keys), self.rows.passes
        while True:
            for k, value in enumerate(found):
                if value is None:
                    found[k] = self._recall(keys[k])
            missing = {(self.state, *keys[k]): k for k, value in enumerate(found) if value is None}
            if not missing:
                return found
            mine = passes.claim(list(missing)) if passes else list(missing)
            if not mine:
                passes.wait_for_others(list(missing))
                continue
            try:
                # Another may have noted and settled them since.
                still = [key for key in mine if self.known.get(key) is None]
                for key, value in zip(still, ask([missing[key] for key in still]) if still else ()):
                    found[missing[key]] = value
                    self._note(key[1:], value, size)
            finally:
                if passes:
                    passes.settle(mine)

    def begin(self) -> None:
        self.start = self._once([("start",)], lambda _: [self._start(self.rows)])[0]
        self.rows = self.rows.later(partial(_shift, by=self.start))

    def _start(self, rows: BinnedRows) -> float:
        loss = self.model.loss
        if loss.start_quantile is not None:
            found = group_quantiles(rows, 1, _labels, loss.start_quantile)[0]
            return 0.0 if found is None else found
        total, weight = rows.fold(_label_sums, lambda a, b: (a[0] + b[0], a[1] + b[1])) or (0.0, 0.0)
        mean = total / weight if weight else 0.0
        return math.log(max(mean, 1e-6)) if loss.name == "poisson" else mean

    def run(self) -> None:
        model = self.model
        while len(self.trees) < model.rounds:
            i = len(self.trees)
            root, held = self._root(i)
            if held is not None:  # loss of the score before this round
                self.losses.append(held)
                if _no_progress(self.losses, model.patience):
                    break
            grown = growth.grow(root, partial(self._measure, i), model.limits, self._chosen(i))
            values = self._leaf_values(grown)
            self.trees.append(growth.flatten(grown.splits, values, self.rows.edges))
            step = repr((self.state, model.step, grown.splits, sorted(values.items())))
            self.state = hashlib.sha256(step.encode()).hexdigest()
            self.rows = self.rows.later(partial(_step, splits=grown.splits, values=values, step=model.step))
            if len(self.trees) % model.checkpoint_every == 0:
                self._store()
        if self.own:
            self.rows.release()

    def _chosen(self, i: int) -> np.ndarray | None:
        width, share = self.rows.width, self.model.column_share
        if share >= 1:
            return None
        return np.array(sorted(random.Random(self.model.seed + i).sample(range(width), max(1, int(width * share)))))

    def _gradients(self, i: int) -> Callable[[Block], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows of this round, pulls, curvatures) of a block."""
        loss, share, salt = self.model.loss, self.model.row_share, self.model.seed + i + 1

        def of(block: Block):
            keep = ~block.held
            if share < 1:
                keep &= drawn(block.row, salt, share)
            pull, curve = loss.arrays(block.y, block.score)
            return np.flatnonzero(keep), block.w * pull, block.w * curve

        return of

    def _size(self) -> int:
        return max(map(len, self.rows.edges), default=0) + 1

    def _root(self, i: int) -> tuple[np.ndarray, float | None]:
        size = 24 * self.rows.width * self._size()
        return self._once([("root", i)], lambda _: [self._root_sums(i)], size)[0]

    def _root_sums(self, i: int) -> tuple[np.ndarray, float | None]:
        gradients, size, loss = self._gradients(i), self._size(), self.model.loss

        shape = (self.rows.width, size, 3)

        def work(block: Block) -> np.ndarray:
            rows, pull, curve = gradients(block)
            held = loss.values(block.y, block.score)[block.held]
            return np.append(growth.histogram(block.bins, rows, pull, curve, size), [held.sum(), len(held)])

        found = self.rows.fold(work, add_to, array_pieces((math.prod(shape) + 2,)))
        if found is None:
            return np.zeros(shape), None
        total, count = found[-2:]
        return found[:-2].reshape(shape), float(total / count) if self.model.valid_share > 0 and count else None

    def _measure(self, i: int, splits: list, requests: list) -> np.ndarray:
        if not requests:
            return np.zeros((0, self.rows.width, self._size(), 3))
        if self.known is None:
            return self._sums(i, splits, requests)
        way = _way(splits)
        keys = [("side", i, way(r.node), r.feature, r.bin, r.right) for r in requests]

        def ask(missing: list[int]) -> list[np.ndarray]:
            return [table.copy() for table in self._sums(i, splits, [requests[k] for k in missing])]

        return np.stack(self._once(keys, ask, 24 * self.rows.width * self._size()))

    def _sums(self, i: int, splits: list, requests: list) -> np.ndarray:
        gradients, size = self._gradients(i), self._size()

        def work(block: Block):
            rows, pull, curve = gradients(block)
            return growth.requested(block.bins, splits, requests, pull, curve, size, rows)

        return self.rows.fold(work, add_to, array_pieces((len(requests), self.rows.width, size, 3)))

    def _leaf_values(self, grown: Grown) -> dict[int, float]:
        loss, l2 = self.model.loss, self.model.limits.l2
        number = {leaf.node: k for k, leaf in enumerate(grown.leaves)}
        splits = grown.splits

        def leaf_of(block: Block) -> np.ndarray:
            group = np.empty(len(block.y), dtype=np.int64)
            for node, at in growth.routes(block.bins, splits).items():
                group[at] = number[node]
            return group

        if loss.tau is not None:

            way, nodes = _way(splits), list(number)

            def ask(missing: list[int]) -> list[float]:
                place = np.full(len(number), -1)
                place[[number[nodes[k]] for k in missing]] = np.arange(len(missing))

                def residuals(block: Block):
                    group = place[leaf_of(block)]
                    weight = np.where(block.held | (group < 0), 0.0, block.w)
                    return np.maximum(group, 0), block.y - block.score, weight

                return [value or 0.0 for value in group_quantiles(self.rows, len(missing), residuals, loss.tau)]

            return dict(zip(nodes, self._once([("leaf", way(node)) for node in nodes], ask)))
        sums = np.array([leaf.stats[:COUNT] for leaf in grown.leaves])
        if self.model.row_share < 1:  # trees are grown on drawn rows, leaves are fitted to all

            def work(block: Block):
                group, weight = leaf_of(block), np.where(block.held, 0.0, block.w)
                pull, curve = loss.arrays(block.y, block.score)
                return np.stack([np.bincount(group, weight * v, minlength=len(number)) for v in (pull, curve)], axis=1)

            sums = self.rows.fold(work, np.add)
        if sums is None:
            return {}
        down = sums[:, CURVE] + l2
        ratio = np.divide(sums[:, PULL], down, out=np.zeros(len(sums)), where=down > 0)
        return {node: float(ratio[k]) for node, k in number.items()}

    # -------------------------------------------------------- what has been fitted so far

    def _store(self) -> None:
        """Writes the scores and, to go on from, the new trees and a manifest, which is written last."""
        done = len(self.trees)
        path = f"{self.folder}/{done // self.model.checkpoint_every % 2}"
        before, self.rows = self.rows, self.rows.written(f"{path}/rows")
        if self.own:
            before.release()
        self.own = True
        self.among.close()  # the blocks are this fit's alone
        if self.model.resume_dir is None:
            return
        ensemble.write_trees(self.spark, self.trees[self.stored :], f"{self.folder}/trees/upto={done}", first=self.stored)
        about = {
            "settings": self.model._settings(), "data": self._data(), "state": self._state(self.rows), "trees": done,
            "start": self.start, "losses": self.losses, "edges": [e.tolist() for e in self.rows.edges],
        }
        manifest = self.spark.createDataFrame([(json.dumps(about),)], "about string")
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
        self.stored = done

    def _data(self) -> str:
        """Tells the training rows from others."""
        row = self.base.agg(F.count(F.lit(1)), F.sum(F.xxhash64("_row", "_y", "_w").cast("decimal(38,0)"))).first()
        return f"{row[0]} {row[1]}"

    @staticmethod
    def _state(rows: BinnedRows) -> str:
        row = rows.frame.agg(F.count(F.lit(1)), F.sum(F.xxhash64("block", "score", "row").cast("decimal(38,0)"))).first()
        return f"{row[0]} {row[1]}"

    def resume(self) -> bool:
        """Goes on from the fullest manifest that agrees with settings, rows and stored scores; False if there is none."""
        if self.model.resume_dir is None:
            return False
        found = []
        for slot in (0, 1):
            try:
                row = self.spark.read.parquet(f"{self.folder}/{slot}/manifest").first()
            except AnalysisException:
                continue
            about = json.loads(row["about"]) if row else {}
            if about.get("settings") == self.model._settings() and about["trees"] <= self.model.rounds:
                found.append((about["trees"], slot, about))
        for done, slot, about in sorted(found, key=lambda f: -f[0]):
            edges = [np.array(e, dtype=np.float64) for e in about["edges"]]
            rows = BinnedRows(self.spark.read.parquet(f"{self.folder}/{slot}/rows"), edges)
            # The rows of the slot may be newer than its manifest, if a fit ended between the two.
            if about["data"] != self._data() or about["state"] != self._state(rows):
                continue
            self.trees = ensemble.read_trees(self.spark.read.parquet(f"{self.folder}/trees"), done)
            self.own = True
            self.rows, self.start, self.losses, self.stored = rows, about["start"], about["losses"], done
            return True
        return False


def _shift(block: Block, by: float) -> None:
    block.score += by


def _step(block: Block, splits: list, values: dict[int, float], step: float) -> None:
    for node, at in growth.routes(block.bins, splits).items():
        block.score[at] += step * values.get(node, 0.0)


def _labels(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.zeros(len(block.y), dtype=np.int64), block.y, np.where(block.held, 0.0, block.w)


def _label_sums(block: Block) -> tuple[float, float]:
    weight = np.where(block.held, 0.0, block.w)
    return float(weight @ block.y), float(weight.sum())


def _no_progress(losses: list[float], patience: int) -> bool:
    if len(losses) <= patience:
        return False
    return min(losses[-patience:]) >= min(losses[:-patience])


def staged_errors(model: BoostedTreesModel, rows: BinnedRows, rounds: Sequence[int]) -> dict[int, float]:
    """Mean absolute error of the raw score after each number of rounds, in one pass over binned rows."""
    start, step, last = model.start, model.step, model.rounds
    trees = [growth.cut_by_bins(tree, rows.edges) for tree in model.trees]
    wanted = sorted({min(n, last) for n in rounds})

    def work(block: Block) -> tuple[np.ndarray, int]:
        score, sums = np.full(len(block.y), start), []
        for k in range(wanted[-1] + 1):
            if k in wanted:
                sums.append(np.abs(block.y - score).sum())
            if k < wanted[-1]:
                score += step * growth.walk(trees[k], block.bins)
        return np.array(sums), len(block.y)

    sums, count = rows.fold(work, lambda a, b: (a[0] + b[0], a[1] + b[1]))
    means = dict(zip(wanted, (sums / count).tolist()))
    return {n: means[min(n, last)] for n in rounds}


class BoostedTreesModel(Model):
    def __init__(self, trees: list[FlatTree], start: float, step: float, loss: Loss, log_target: bool):
        super().__init__()
        self.trees, self.start, self.step, self.loss, self.log_target = trees, start, step, loss, log_target
        self._scorer: Model | None = None

    @property
    def rounds(self) -> int:
        return len(self.trees)

    def truncated(self, rounds: int) -> BoostedTreesModel:
        """The model after fewer rounds: exactly what a shorter fit with the same settings gives."""
        return BoostedTreesModel(self.trees[:rounds], self.start, self.step, self.loss, self.log_target)

    def _transform(self, df: DataFrame) -> DataFrame:
        score = F.lit(float(self.start))
        scored = df
        if self.trees:
            if self._scorer is None:
                self._scorer = ensemble.tree_sum(df.sparkSession, self.trees, self.step)
            scored = self._scorer.transform(df)
            score = score + F.col(ensemble.SCORE)
        value = self.loss.prediction(score)
        value = expm1_clipped(value) if self.log_target else value
        return scored.select(*df.columns, value.alias("yhat"))

    def save_parts(self, spark: SparkSession, path: str) -> dict:
        ensemble.write_trees(spark, self.trees, f"{path}/trees")
        return {
            "start": self.start,
            "step": self.step,
            "loss": self.loss.name,
            "tau": self.loss.tau,
            "log_target": self.log_target,
            "rounds": self.rounds,
        }

    @classmethod
    def load_parts(cls, spark: SparkSession, path: str, meta: dict) -> BoostedTreesModel:
        trees = ensemble.read_trees(spark.read.parquet(f"{path}/trees"), meta["rounds"])
        return cls(trees, meta["start"], meta["step"], Loss(meta["loss"], meta["tau"]), meta["log_target"])
