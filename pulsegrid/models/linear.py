"""Linear models whose penalty is stated per training set."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.models.blocks import MatrixRows, add_arrays


class RidgeRegression(Estimator):
    """Least squares with an L2 penalty on the coefficients as given: sum of squares + alpha |w|^2.

    Spark ML divides the label by its standard deviation before it applies the penalty, hence the factor.
    """

    def __init__(self, alpha: float = 1.0, max_iter: int = 2000, tol: float = 1e-6):
        super().__init__()
        self.alpha, self.max_iter, self.tol = alpha, max_iter, tol

    def _fit(self, df: DataFrame) -> LinearRegressionModel:
        rows, spread = df.agg(F.count("label"), F.stddev_samp("label")).first()
        return LinearRegression(
            labelCol="label",
            predictionCol="yhat",
            elasticNetParam=0.0,
            regParam=self.alpha * (spread or 1.0) / max(rows, 1),
            standardization=False,
            solver="l-bfgs",
            maxIter=self.max_iter,
            tol=self.tol,
        ).fit(df)


class LinearModel(Model):
    """``yhat`` = intercept + coefficients . features, as a Spark expression; ``scale`` where a fit estimates one."""

    def __init__(self, coefficients: Sequence[float], intercept: float, scale: float | None = None):
        super().__init__()
        self.coefficients, self.intercept, self.scale = DenseVector(coefficients), float(intercept), scale

    def _transform(self, df: DataFrame) -> DataFrame:
        weights = F.array(*[F.lit(float(c)) for c in self.coefficients.values]).cast("array<double>")
        products = F.zip_with(vector_to_array("features"), weights, lambda x, c: x * c)
        return df.withColumn("yhat", F.aggregate(products, F.lit(self.intercept), lambda total, p: total + p))

    def save_parts(self, spark: SparkSession, path: str) -> dict:
        return {"coefficients": self.coefficients.values.tolist(), "intercept": self.intercept, "scale": self.scale}

    @classmethod
    def load_parts(cls, spark: SparkSession, path: str, meta: dict) -> LinearModel:
        return cls(meta["coefficients"], meta["intercept"], meta["scale"])


class _Scaled:
    """Centre and spread of inputs and label: fits work on numbers around zero, whatever the units."""

    def __init__(self, rows: MatrixRows, width: int):
        first = rows.fold(lambda b: (len(b[1]), b[0].sum(axis=0), b[1].sum()), add_arrays)
        self.n, total, label = first if first else (0, np.zeros(width), 0.0)
        self.x, self.y = total / max(self.n, 1), label / max(self.n, 1)
        middle, centre = self.x, self.y
        second = rows.fold(lambda b: (((b[0] - middle) ** 2).sum(axis=0), ((b[1] - centre) ** 2).sum()), add_arrays)
        squares, label_squares = second if second else (np.zeros(width), 0.0)
        spread = np.sqrt(squares / max(self.n, 1))
        self.spread = np.where(spread > 0, spread, 1.0)
        self.label_spread = float(np.sqrt(label_squares / max(self.n, 1))) or 1.0

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return (x - self.x) / self.spread

    def model(self, weights: np.ndarray, intercept: float, scale: float | None = None) -> LinearModel:
        """The model of the inputs as they are, from weights of the scaled ones."""
        coefficients = weights / self.spread
        return LinearModel(coefficients, self.y + intercept - coefficients @ self.x, scale)


class StochasticRidge(Estimator):
    """Mean of half squares + alpha / 2 |w|^2 by epochs of mini-batch steps.

    In an epoch every block of rows starts from the shared weights and walks through its rows in small batches with
    a step that decays by the epoch; weights are then averaged over the blocks by tree aggregation, each counting by its
    rows. A batch's gradient is corrected by what it was at the shared weights and what that of all rows is there, so
    blocks that differ do not pull the average off, and the steps end at the minimum and not beside it. Batches are
    drawn from the block's number, not at random. Stops when the loss of an epoch's weights, which the next epoch's
    first pass gives, has not fallen by ``tol`` of itself for ``patience`` epochs.
    """

    def __init__(
        self, alpha: float = 1e-4, max_iter: int = 20, batch: int = 32, step: float = 0.5, decay: float = 0.05,
        tol: float = 1e-3, patience: int = 5, seed: int = 42,
    ):
        super().__init__()
        self.alpha, self.max_iter, self.batch, self.step, self.decay = alpha, max_iter, batch, step, decay
        self.tol, self.patience, self.seed = tol, patience, seed
        self.losses: list[float] = []

    def _fit(self, df: DataFrame) -> LinearModel:
        width = len(df.select("features").first()[0])
        rows = MatrixRows.store(df)
        scaled = _Scaled(rows, width)
        penalty = self.alpha / scaled.spread**2  # of the coefficients as given
        curve = 1.0 + penalty  # of each scaled input alone; steps are in proportion to what is left
        top = self._curvature(rows, scaled, curve, penalty)
        weights, best = np.zeros(width), np.inf
        stale, self.losses = 0, []
        for epoch in range(self.max_iter):
            gradient, loss = self._gradient(rows, scaled, weights, penalty)
            self.losses.append(loss)
            stale = 0 if loss < best - self.tol * abs(best) or epoch == 0 else stale + 1
            best = min(best, loss)
            if stale >= self.patience:
                break
            step = self.step / (1.0 + self.decay * epoch) / top / curve
            weights = self._epoch(rows, scaled, weights, gradient, penalty, step, epoch)
        return scaled.model(weights, 0.0)

    @staticmethod
    def _curvature(rows: MatrixRows, scaled: _Scaled, curve: np.ndarray, penalty: np.ndarray) -> float:
        """Greatest curvature of the loss relative to that of the inputs alone, by a few power steps."""
        vector, value = np.ones(len(curve)), 1.0
        for _ in range(6):
            vector = vector / (np.linalg.norm(vector) or 1.0)
            there = vector / np.sqrt(curve)
            found = rows.fold(lambda b: scaled.inputs(b[0]).T @ (scaled.inputs(b[0]) @ there), np.add)
            if found is None:
                return 1.0
            vector = (found / scaled.n + penalty * there) / np.sqrt(curve)
            value = float(np.linalg.norm(vector))
        return max(1.1 * value, 1e-3)

    @staticmethod
    def _gradient(rows: MatrixRows, scaled: _Scaled, weights: np.ndarray, penalty: np.ndarray) -> tuple[np.ndarray, float]:
        def work(block):
            z, e = scaled.inputs(block[0]), scaled.y - block[1]
            e = e + z @ weights
            return z.T @ e, 0.5 * float(e @ e)

        total, loss = rows.fold(work, add_arrays) or (np.zeros(len(weights)), 0.0)
        return total / max(scaled.n, 1) + penalty * weights, loss / max(scaled.n, 1) + 0.5 * float(penalty @ weights**2)

    def _epoch(self, rows, scaled, shared, gradient, penalty, step, epoch) -> np.ndarray:
        batch, seed = self.batch, (self.seed, epoch)

        def work(block):
            z = scaled.inputs(block[0])
            order = np.random.default_rng([*seed, len(z)]).permutation(len(z))
            own = shared.copy()
            for at in range(0, len(z), batch):
                part = z[order[at : at + batch]]
                moved = own - shared  # the label drops out of the difference of the two gradients
                own = own - step * (part.T @ (part @ moved) / len(part) + penalty * moved + gradient)
            return own * len(z), len(z)

        found = rows.fold(work, add_arrays)
        return shared if found is None else found[0] / found[1]


class HuberRegression(Estimator):
    """Huber loss with a scale estimated along: sum of (s + H((y - xw - c) / s) s) + alpha |w|^2.

    A pass tells rows within ``epsilon`` scales of the line from those outside, adds up the normal equations of the latter
    (those of the former are what is left of all rows') and what the scale follows from. Line and scale then move to where
    the loss would be least if the same rows stayed outside, which takes few passes. Where the loss has not fallen that
    way, the step before is taken by reweighted normal equations, in which rows outside count as much as their distance
    leaves them and which cannot raise it. The solution is where line and scale stay; ``tol`` is the greatest change, in
    standard deviations of the label, that counts as staying.
    """

    def __init__(self, epsilon: float = 1.35, alpha: float = 1e-4, max_iter: int = 200, tol: float = 1e-10):
        super().__init__()
        if epsilon <= 1.0:
            raise ValueError("the scale is defined for an epsilon above one")
        self.epsilon, self.alpha, self.max_iter, self.tol = epsilon, alpha, max_iter, tol
        self.steps = 0

    def _fit(self, df: DataFrame) -> LinearModel:
        width = len(df.select("features").first()[0])
        rows = MatrixRows.store(df)
        scaled = _Scaled(rows, width)
        penalty = np.append(self.alpha * scaled.label_spread / scaled.spread**2, 0.0)  # none on the intercept
        line, scale = np.zeros(width + 1), 1.0  # of the scaled label
        whole = rows.fold(self._whole(scaled), add_arrays)
        if whole is not None and self.max_iter:
            self.steps, line = 1, self._solved(whole[0], whole[1], penalty)
            scale, best, careful = self._spread(rows, scaled, line), np.inf, None
            while self.steps < self.max_iter:
                self.steps += 1
                sums = rows.fold(self._sums(scaled, line, scale), add_arrays)
                loss, reweighted, joint = self._moves(scaled.n, whole, sums, penalty, line, scale)
                if careful is not None and not loss <= best + 1e-12 * abs(best):
                    line, scale = careful  # from where the loss was least
                    careful = None
                    continue
                best = min(best, loss)
                moved, spread = reweighted if joint is None else joint
                # A step by reweighting keeps the scale of the line that it starts from.
                careful = None if joint is None else reweighted
                change = max(float(np.abs(moved - line).max()), abs(spread - scale) if joint is not None else 0.0)
                line, scale = moved, spread
                if scale <= 1e-12 or change <= self.tol:
                    break
        return scaled.model(line[:-1] * scaled.label_spread, line[-1] * scaled.label_spread, scale * scaled.label_spread)

    @staticmethod
    def _solved(curves: np.ndarray, pulls: np.ndarray, penalty: np.ndarray) -> np.ndarray:
        return np.linalg.lstsq(curves + np.diag(penalty), pulls, rcond=1e-13)[0]

    def _moves(self, n: int, whole: tuple, sums: tuple, penalty: np.ndarray, line: np.ndarray, scale: float) -> tuple:
        """Loss here, the next (line, scale) by reweighting, and that for the same rows outside, None if there is none."""
        squares, far, outside, curves, pulls, light_curves, light_pulls, sides = sums
        down = n - outside * self.epsilon**2
        with np.errstate(divide="ignore", invalid="ignore"):
            loss = n * scale + squares / scale + 2 * self.epsilon * far - outside * self.epsilon**2 * scale
        loss += float(penalty @ line**2)
        spread = float(np.sqrt(max(squares, 0.0) / down)) if down > 0 else scale / 2.0
        step = self._solved(whole[0] - light_curves, whole[1] - light_pulls, penalty * spread), spread
        if down <= 0 or spread <= 1e-12:
            return loss, step, None
        inner, pull = whole[0] - curves, whole[1] - pulls
        at, wide = line, spread
        for _ in range(100):
            at = self._solved(inner, pull + self.epsilon * wide * sides, penalty * wide)
            gap = at - line  # squares of the rows inside, from what they are here
            slope = pull - inner @ line
            left = squares - 2 * float(gap @ slope) + float(gap @ inner @ gap)
            if not left > 0:
                return loss, step, None
            wide, before = float(np.sqrt(left / down)), wide
            if wide < 0.9 * spread:  # towards an exact fit of some rows the line must not fall behind the scale
                return loss, step, None
            if abs(wide - before) <= 1e-15 * wide:
                break
        else:
            if abs(wide - before) > 1e-12 * wide:
                return loss, step, None
        return loss, step, (at, wide)

    @staticmethod
    def _whole(scaled: _Scaled):
        """Normal equations of all rows."""

        def work(block):
            z = np.column_stack([scaled.inputs(block[0]), np.ones(len(block[1]))])
            return z.T @ z, z.T @ ((block[1] - scaled.y) / scaled.label_spread)

        return work

    def _sums(self, scaled: _Scaled, line: np.ndarray, scale: float):
        """Squares of the rows within the border; of those outside the sum of distances, their number, their normal
        equations, what reweighting takes off these, and the sum of their inputs by side."""
        border = self.epsilon * scale
        slopes = line[:-1] / scaled.spread

        def work(block):
            y = (block[1] - scaled.y) / scaled.label_spread
            off = y - line[-1] - (block[0] - scaled.x) @ slopes
            far = np.abs(off)
            at = np.flatnonzero(far > border)
            inside = off[far <= border]
            z = np.column_stack([scaled.inputs(block[0][at]), np.ones(len(at))])
            light = z * (1.0 - border / far[at])[:, None]
            return (
                float(inside @ inside), float(far[at].sum()), len(at), z.T @ z, z.T @ y[at],
                light.T @ z, light.T @ y[at], z.T @ np.sign(off[at]),
            )

        return work

    @staticmethod
    def _spread(rows: MatrixRows, scaled: _Scaled, line: np.ndarray) -> float:
        def work(block):
            z = np.column_stack([scaled.inputs(block[0]), np.ones(len(block[1]))])
            e = (block[1] - scaled.y) / scaled.label_spread - z @ line
            return float(e @ e)

        return float(np.sqrt((rows.fold(work, lambda a, b: a + b) or 0.0) / max(scaled.n, 1)))
