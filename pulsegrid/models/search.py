"""Choices made by expanding time folds: the quantile grid and the tolerance blend."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import replace
from itertools import product

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.functions.weights import blend
from pulsegrid.layout import DEFAULT_LAYOUT, Layout
from pulsegrid.models.boosting import BoostedTrees, BoostedTreesModel, Known, staged_errors
from pulsegrid.models.composite import Blend, BlendModel
from pulsegrid.models.together import Passes
from pulsegrid.operators.folds import Fold, expanding_folds, time_index

# The default grid, in the order in which combinations are tried. Depth None means no limit but 31 leaves.
DEFAULT_GRID = {
    "learning_rate": [0.04, 0.06, 0.08],
    "max_iter": [400, 600, 800],
    "min_samples_leaf": [50, 100, 200],
    "max_depth": [None, 6, 8],
    "max_bins": [255],
}
def combinations(grid: Mapping[str, Sequence]) -> list[dict]:
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def in_time_order(df: DataFrame, layout: Layout = DEFAULT_LAYOUT) -> tuple[DataFrame, int]:
    """Frame with ``row_index`` and its number of rows, stored once for all folds."""
    narrow = df.select(*layout.full_order, "features", "label")
    indexed = time_index(narrow, layout)  # reads the one table that numbering has written
    return indexed, indexed.count()


class GridSearchedTrees(Estimator):
    """Quantile boosting with settings chosen by the mean absolute error over expanding folds.

    Combinations that differ only in the number of rounds share one fit per fold: the shorter model is the beginning of
    the longer one, and all of them are judged in one pass. Fits with as many bins share the binned rows of a fold, and
    sums over them: a pass leaves out what an earlier fit has asked of the same rows, and like models are judged once.
    ``workers`` fits run side by side; those on the same fold make their passes together. Their Spark jobs run in
    scheduler pools (set ``spark.scheduler.mode`` to FAIR to have them share executors evenly). Combinations are decided
    on in their order, whatever ends first. Fits that pruning cannot make needless, those on the first two folds, are
    started ahead, later folds only for combinations that those have not ruled out. So results are those of a search one
    after the other. The first best combination wins; it is then fitted on all rows.
    """

    def __init__(
        self,
        grid: Mapping[str, Sequence] | None = None,
        folds: int = 5,
        tau: float = 0.8,
        prune: bool = True,
        valid_share: float = 0.1,
        patience: int = 30,
        workers: int = 16,
        layout: Layout = DEFAULT_LAYOUT,
        seed: int = 42,
    ):
        super().__init__()
        self.grid = dict(grid or DEFAULT_GRID)
        self.folds, self.tau, self.prune = folds, tau, prune
        self.valid_share, self.patience, self.layout, self.seed = valid_share, patience, layout, seed
        self.workers = max(workers, 1)
        self.results: list[dict] = []
        self.best: dict = {}
        self.fits = 0

    def _trees(self, combo: Mapping, rounds: int) -> BoostedTrees:
        return BoostedTrees(
            loss="quantile",
            tau=self.tau,
            rounds=rounds,
            step=combo.get("learning_rate", 0.06),
            depth=combo.get("max_depth"),
            bins=combo.get("max_bins", 255),
            min_leaf=combo.get("min_samples_leaf", 100),
            valid_share=self.valid_share,
            patience=self.patience,
            seed=self.seed,
        )

    def _fit(self, df: DataFrame) -> BoostedTreesModel:
        rows, count = in_time_order(df, self.layout)
        folds = expanding_folds(count, self.folds)
        wanted = sorted(set(self.grid.get("max_iter", [600])))
        longest = wanted[-1]
        combos = combinations(self.grid)
        prepared, tested, known = {}, {}, Known()
        for fold, bins in product(folds, set(self.grid.get("max_bins", [255]))):
            trees, key = self._trees({"max_bins": bins}, longest), (fold.number, bins)
            found = trees.prepare(rows.where(fold.train()))
            prepared[key] = replace(found, rows=found.rows.together(Passes(found.rows)), known=known)
            tested[key] = trees.prepare_like(rows.where(fold.test()), prepared[key])

        def errors_of(combo: Mapping, fold: Fold) -> dict[int, float]:
            """Error for each number of rounds."""
            key = (fold.number, combo.get("max_bins", 255))
            model = self._trees(combo, longest).fit_prepared(prepared[key])
            judged = ("errors", *key, hashlib.sha256(repr((model.start, model.step, model.trees)).encode()).hexdigest())
            found = known.get(judged)
            if found is None:
                found = staged_errors(model, tested[key], wanted)
                known.put(judged, found)
            return found

        self.results, best_error = [], math.inf

        def out(errors: Sequence[float]) -> bool:
            return self.prune and len(errors) >= 2 and sum(errors) / len(errors) > best_error

        def next_fold(combo: Mapping, found: Sequence[dict[int, float]]) -> bool:
            """Whether a combination seems to need another fold, as far as the errors on its first ones tell."""
            if self.prune and best_error == math.inf:
                return False  # most combinations are ruled out by the first one
            errors = [f[combo.get("max_iter", longest)] for f in found]
            return not self.prune or len(errors) < 2 or not any(out(errors[:n]) for n in range(2, len(errors) + 1))

        sure = min(2, len(folds)) if self.prune else len(folds)
        with _Ahead(df.sparkSession, errors_of, combos, folds, self.workers, sure, next_fold) as ahead:
            for at, combo in enumerate(combos):
                errors = []
                for fold in folds:
                    errors.append(ahead.result(at, fold)[combo.get("max_iter", longest)])
                    if out(errors):
                        break
                ahead.done(at)
                error = sum(errors) / len(errors)
                self.results.append({**combo, "cv_mae": error, "n_folds": len(errors)})
                if error < best_error:
                    best_error, self.best = error, combo
            self.fits = ahead.started
        for key, kept in prepared.items():
            kept.rows.release()
            tested[key].release()
        return self._trees(self.best, self.best.get("max_iter", longest)).fit(rows)

    def result_table(self, spark: SparkSession) -> DataFrame:
        """One row per combination: settings, error, folds evaluated."""
        names = [*self.grid, "cv_mae", "n_folds"]
        rows = [tuple(None if r[n] is None else float(r[n]) for n in names) for r in self.results]
        return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))


class _Ahead:
    """Runs fits side by side: first those of the ``sure`` first folds, then what ``next_fold`` does not rule out."""

    def __init__(
        self, spark: SparkSession, run: Callable, combos: list[dict], folds: list[Fold], workers: int, sure: int, next_fold: Callable
    ):
        self.sure, self.next_fold = sure, next_fold
        self.combos, self.folds, self.workers = combos, folds, workers
        self.pool = ThreadPoolExecutor(workers)
        self.futures: dict[tuple, Future] = {}
        self.started = 0
        free = list(range(workers))

        @inheritable_thread_target(spark)
        def in_pool(combo: Mapping, fold: Fold) -> dict[int, float]:
            lane = free.pop()
            try:
                spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"grid-{lane}")
                self.started += 1
                return run(combo, fold)
            finally:
                free.append(lane)

        self.run = in_pool

    def __enter__(self) -> _Ahead:
        return self

    def __exit__(self, *_) -> None:
        self.pool.shutdown(wait=True, cancel_futures=True)

    @staticmethod
    def _key(combo: Mapping, fold: Fold) -> tuple:
        return (fold.number, *[(k, v) for k, v in combo.items() if k != "max_iter"])

    def _ask(self, at: int, fold: Fold) -> Future:
        key = self._key(self.combos[at], fold)
        if key not in self.futures or self.futures[key].cancelled():
            self.futures[key] = self.pool.submit(self.run, self.combos[at], fold)
        return self.futures[key]

    def _found(self, at: int) -> list[dict[int, float]]:
        """Errors of a combination on its first folds, as far as they are known."""
        found = []
        for fold in self.folds:
            future = self.futures.get(self._key(self.combos[at], fold))
            if future is None or future.cancelled() or not future.done() or future.exception() is not None:
                break
            found.append(future.result())
        return found

    def _later(self, at: int) -> Iterator[tuple[int, Fold]]:
        """What to start ahead while combination ``at`` is waited for."""
        rest = range(at, len(self.combos))
        if at == 0:
            yield from ((0, fold) for fold in self.folds)  # nothing rules out the first combination
        yield from ((combo, fold) for fold in self.folds[: self.sure] for combo in rest)
        for combo in rest:
            found = self._found(combo)
            if self.sure <= len(found) < len(self.folds) and self.next_fold(self.combos[combo], found):
                yield combo, self.folds[len(found)]

    def result(self, at: int, fold: Fold) -> dict[int, float]:
        wanted = self._ask(at, fold)
        while not wanted.done():
            waiting = [f for f in self.futures.values() if not f.done()]
            room = 2 * self.workers - len(waiting)
            for combo, other in self._later(at) if room > 0 else ():
                known = self.futures.get(self._key(self.combos[combo], other))
                if known is None or known.cancelled():
                    waiting.append(self._ask(combo, other))
                    room -= 1
                    if room <= 0:
                        break
            wait([wanted, *waiting], return_when=FIRST_COMPLETED)
        return wanted.result()

    def done(self, at: int) -> None:
        """Drops fits that no later combination asks for."""
        later = {self._key(c, fold) for c in self.combos[at + 1 :] for fold in self.folds}
        for key, future in self.futures.items():
            if key not in later:
                future.cancel()


def blend_accuracies(
    scored: DataFrame, alphas: Sequence[float], k: float, y: str = "y", first: str = "yhat0", second: str = "yhat1"
) -> DataFrame:
    """Tolerance accuracy of every blend, all in one aggregate: columns ``alpha``, ``accuracy``."""
    hits = []
    for a in alphas:
        error = F.abs(F.col(y) - blend(F.col(first), F.col(second), a))
        hits.append(F.avg((error <= k).cast("double")))
    pairs = [F.struct(F.lit(float(a)).alias("alpha"), h.alias("accuracy")) for a, h in zip(alphas, hits)]
    return scored.agg(F.array(*pairs).alias("_pairs")).select(F.inline("_pairs"))


def best_alpha(accuracies: Sequence[tuple[float, float]]) -> float:
    """The alpha of greatest accuracy; among equals the earliest. A missing accuracy counts as none."""
    known = [a if a is not None else -1.0 for _, a in accuracies]
    return accuracies[known.index(max(known))][0]


class ToleranceBlend(Estimator):
    """Two models, blended for the most forecasts within ``k`` on the last expanding fold, refitted on all rows.

    Any other number of models gets equal weights.
    """

    def __init__(
        self,
        makers: Sequence[Callable[[], Estimator]],
        k: float = 50,
        folds: int = 3,
        alphas: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 1.0),
        layout: Layout = DEFAULT_LAYOUT,
    ):
        super().__init__()
        self.makers, self.k, self.folds = list(makers), k, folds
        self.alphas, self.layout = list(alphas), layout
        self.accuracies: list[tuple[float, float]] = []

    def _fit(self, df: DataFrame) -> BlendModel:
        count = len(self.makers)
        if count != 2:
            return Blend([make() for make in self.makers], [1.0 / count] * count).fit(df)
        rows, n = in_time_order(df, self.layout)
        fold = expanding_folds(n, self.folds)[-1]
        inner = BlendModel([make().fit(rows.where(fold.train())) for make in self.makers], [0.5, 0.5])
        judged = inner.part_forecasts(rows.where(fold.test()))
        table = blend_accuracies(judged, self.alphas, self.k, y="label")
        found = {row["alpha"]: row["accuracy"] for row in table.collect()}
        self.accuracies = [(a, found[float(a)]) for a in self.alphas]
        alpha = best_alpha(self.accuracies)
        return Blend([make() for make in self.makers], [alpha, 1.0 - alpha]).fit(rows)
