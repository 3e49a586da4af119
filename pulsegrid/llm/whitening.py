"""Whitening of embeddings: projections on the eigenvectors of their covariance, scaled to unit variance.

1. Components become whole numbers, ``floor(64 c) + 1000000``. Their sums and the products of their deviations from
   the whole number next to the mean are added up exactly, in tasks by matrix products that cannot round, then by
   Spark as decimals; what the rounded centre leaves over is taken off as a fraction. Only the d x d sums reach the
   driver, d being the number of dimensions.
2. There the covariance is rounded once, to double-double numbers. Its eigenvectors in float32 are the start; they are
   refined by the iteration of Ogita and Aishima, matrix products only, carried in double-double precision: products
   are split into slices whose partial products a float64 multiplication gives without error. Eigenvalues too close
   for the iteration to part form a cluster; the cluster's own small problem, shifted by its middle so that close
   values become far apart, is solved anew and rotates the cluster's vectors, and the iteration goes on.
3. Rows are projected in tasks. The covariance of the projections is measured over all of them in one more pass.

Defined results: a vector that is null, or holds a null or a component that is not finite, takes no part; neither does
one of another length than most vectors have (of the smaller length among equals). Repeated rows count each. Scaled
components beyond 2^44 are cut to it. ``deviation`` is null where it exceeds a long. A component without variance, as
far as doubles tell, gets the value 0 in all rows and is left out of the error; all components of one single vector
are such. An empty table gives an empty table. Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.llm.common import llm_query, table

SCALE, SHIFT = 64.0, 1_000_000
COMPONENTS = 32
LARGEST = float(1 << 44)  # of a scaled component
_EXACT = 1 << 53  # whole numbers up to here are exact in float64
_SLICES = 5  # of a matrix in an exact product: over 100 bits for up to 2,000 dimensions
_STEPS = 30
_SETTLED = 2.0**-62  # a correction below this ends the iteration

Pair = tuple[np.ndarray, np.ndarray]  # a double-double matrix: value and what is left over


# ---------------------------------------------------------------- double-double matrices


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    total = a + b
    back = total - a
    return total, (a - (total - back)) + (b - back)


def add(x: Pair, y: Pair) -> Pair:
    high, low = two_sum(x[0], y[0])
    return two_sum(high, low + x[1] + y[1])


def negative(x: Pair) -> Pair:
    return -x[0], -x[1]


def slices_of(x: Pair, axis: int, bits: int) -> list[np.ndarray]:
    """Parts that add up to ``x``; along ``axis`` each has a common unit and whole multiples of it below 2^bits."""
    high, low = x
    parts = []
    for _ in range(_SLICES):
        most = np.max(np.abs(high), axis=axis, keepdims=True)
        unit = np.ldexp(1.0, np.frexp(most)[1] - bits)
        part = np.rint(high / unit) * unit
        parts.append(part)
        high, low = two_sum(high - part, low)
    return parts


def product(x: Pair, y: Pair) -> Pair:
    """Matrix product. Partial products of slices are free of rounding; they are added from the smallest on."""
    bits = (53 - int(np.ceil(np.log2(max(x[0].shape[1], 2))))) // 2
    left, right = slices_of(x, 1, bits), slices_of(y, 0, bits)
    shape = (x[0].shape[0], y[0].shape[1])
    total = np.zeros(shape), np.zeros(shape)
    for order in range(_SLICES - 1, -1, -1):
        for i in range(order + 1):
            total = add(total, (left[i] @ right[order - i], np.zeros(shape)))
    return total


def transposed(x: Pair) -> Pair:
    return x[0].T.copy(), x[1].T.copy()


def whole(x: np.ndarray) -> Pair:
    return x, np.zeros_like(x)


# ---------------------------------------------------------------- eigenvectors


def clusters(values: np.ndarray, group: np.ndarray, gap: float) -> list[np.ndarray]:
    """Positions of a group's values, each within ``gap`` of the next; clusters of two or more."""
    order = group[np.argsort(values[group], kind="stable")]
    cuts = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def _symmetric(x: Pair) -> Pair:
    total = add(x, transposed(x))
    return total[0] / 2.0, total[1] / 2.0


def _rayleigh(matrix: Pair, vectors: Pair) -> tuple[np.ndarray, Pair, Pair]:
    """(I - X'X, X'AX, eigenvalues)."""
    turned = transposed(vectors)
    off = add(whole(np.eye(len(matrix[0]))), negative(_symmetric(product(turned, vectors))))[0]
    inner = _symmetric(product(turned, product(matrix, vectors)))
    diagonal = np.diag(inner[0]).copy(), np.diag(inner[1]).copy()
    scale = np.diag(off)
    # s / (1 - r) to second order: r is tiny once the vectors are near.
    return off, inner, add(diagonal, whole(diagonal[0] * scale * (1 + scale)))


class _Step:
    """One iteration: the correction of every pair of vectors that can be told apart, and the clusters that cannot.

    A pair is told apart by the gap of its values if that is beyond the noise of the group it lies in. A group that the
    noise of all vectors holds together has less noise of its own, since what couples it to other vectors enters it
    squared; so groups are looked into again, down to those that stay together by their own noise.
    """

    def __init__(self, off: np.ndarray, inner: np.ndarray, values: Pair, norm: float):
        self.off, self.inner, self.values, self.norm = off, inner, values[0], norm
        # Column less row, with what doubles alone would lose.
        self.apart = (values[0][None, :] - values[0][:, None]) + (values[1][None, :] - values[1][:, None])
        self.change = off / 2.0
        self.together: list[np.ndarray] = []
        everything = np.arange(len(off))
        self._look_into(everything, self._noise(everything))

    def _noise(self, group: np.ndarray) -> float:
        inside = np.ix_(group, group)
        middle = (self.values[group].max() + self.values[group].min()) / 2.0
        loose = self.inner[inside] + middle * self.off[inside]
        np.fill_diagonal(loose, 0.0)
        width = float(np.abs(self.apart[inside]).max())
        rest = np.setdiff1d(np.arange(len(self.off)), group)
        across = np.linalg.norm(self.change[np.ix_(rest, group)]) if len(rest) else 0.0
        own = np.linalg.norm(loose, 2) + width * np.linalg.norm(self.off[inside], 2) + self.norm * across**2
        return max(2.0 * float(own), self.norm * 2.0**-98)

    def _look_into(self, group: np.ndarray, noise: float) -> None:
        inside = np.ix_(group, group)
        apart = self.apart[inside]
        far = np.abs(apart) > noise
        numerator = self.inner[inside] + self.values[group][None, :] * self.off[inside]
        self.change[inside] = np.where(far, numerator / np.where(far, apart, 1.0), self.off[inside] / 2.0)
        for part in clusters(self.values, group, noise):
            own = self._noise(part)
            if own < noise / 2.0:
                self._look_into(part, own)
            else:
                self.together.append(part)


def refine(matrix: Pair, vectors: np.ndarray) -> tuple[Pair, Pair]:
    """(eigenvalues, eigenvectors) of a symmetric matrix from approximate eigenvectors."""
    norm = float(np.linalg.norm(matrix[0], 2))
    x = whole(vectors.astype(np.float64))
    for _ in range(_STEPS):
        off, inner, values = _rayleigh(matrix, x)
        step = _Step(off, inner[0], values, norm)
        x = add(x, product(x, whole(step.change)))
        turned = [_turn(matrix, x, values[0], group, norm) for group in step.together]
        if not any(turned) and np.abs(step.change).max() < _SETTLED:
            break
    _, _, values = _rayleigh(matrix, x)
    order = np.argsort(-values[0], kind="stable")
    return (values[0][order], values[1][order]), (x[0][:, order], x[1][:, order])


def _turn(matrix: Pair, x: Pair, values: np.ndarray, group: np.ndarray, norm: float) -> bool:
    """Solves the small problem of a cluster, shifted by its middle, and turns its vectors; False if it is solved."""
    part = x[0][:, group], x[1][:, group]
    middle = (values[group].max() + values[group].min()) / 2.0
    shifted = add(matrix, whole(np.diag(np.full(len(matrix[0]), -middle))))
    small = _symmetric(product(transposed(part), product(shifted, part)))[0]
    span = float(np.linalg.norm(small, 2))
    loose = np.linalg.norm(small - np.diag(np.diag(small)), 2)
    if loose <= 2.0**-45 * span or span <= norm * 2.0**-95:
        return False
    x[0][:, group], x[1][:, group] = product(part, whole(np.linalg.eigh(small)[1]))
    return True


def eigen(matrix: Pair) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) by falling eigenvalue, correct to double precision."""
    most = float(np.abs(matrix[0]).max()) if matrix[0].size else 0.0
    if most == 0.0:
        return np.zeros(len(matrix[0])), np.eye(len(matrix[0]))
    scale = np.ldexp(1.0, -int(np.frexp(most)[1]))  # a power of two: nothing is rounded
    scaled = matrix[0] * scale, matrix[1] * scale
    start = np.linalg.eigh(scaled[0].astype(np.float32))[1]
    values, vectors = refine(scaled, start)
    return values[0] / scale, vectors[0]


# ---------------------------------------------------------------- Spark


def scaled(values: np.ndarray) -> np.ndarray:
    """Whole numbers ``floor(64 c)``; the shift is left out, since deviations do not know it."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * SCALE), -LARGEST, LARGEST).astype(np.int64)


def _matrix(column: pd.Series) -> np.ndarray:
    return scaled(np.array(column.tolist(), dtype=np.float64))


def exact_gram(x: np.ndarray) -> np.ndarray:
    """Sums of products of whole numbers, as Python integers where int64 could not hold them."""
    most = int(np.abs(x).max()) if x.size else 0
    if most * most * len(x) < _EXACT:
        wide = x.astype(np.float64)
        return (wide.T @ wide).astype(np.int64).astype(object)
    if most * most < _EXACT:
        half = len(x) // 2
        return exact_gram(x[:half]) + exact_gram(x[half:])
    big = x.astype(object)
    return big.T @ big


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(_id, _v) of the rows that take part: vectors as doubles, all of one length."""
    whole_ones = F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{vector}`").cast("array<double>").alias("_v"))
    rows = rows.where(F.col("_v").isNotNull()).where(whole_ones)
    sizes = rows.groupBy(F.size("_v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.where(F.size("_v") == (sizes["size"] if sizes else -1))


def _pieces(rows: DataFrame, centre: list[int] | None) -> DataFrame:
    """Partial sums of a task as rows (i, j, value): sums of dimension i at j = -1, or products of deviations."""

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = None, 0
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch["_v"])
            count += len(x)
            part = x.sum(axis=0, dtype=object) if centre is None else exact_gram(x - np.array(centre, dtype=np.int64))
            total = part if total is None else total + part
        if total is None:
            return
        if centre is None:
            i, j, value = range(-1, len(total)), -1, [count, *total.tolist()]
        else:
            i, j = np.triu_indices(len(total))
            value = total[i, j].tolist()
        yield pd.DataFrame({"i": i, "j": j, "value": [_decimal(v) for v in value]})

    return rows.select("_v").mapInPandas(add_up, "i int, j int, value decimal(38,0)")


def _decimal(value: int):
    from decimal import Decimal

    return Decimal(int(value))


class Whitening:
    """A fit: ``n`` rows, sums of the whole numbers, eigenvalues and eigenvectors of their covariance."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray):
        self.n, self.sums, self.values, self.vectors = n, sums, values, vectors

    @property
    def positive(self) -> np.ndarray:
        """Which components have variance: more than what rounding of doubles could leave of none."""
        return self.values > self.values.sum() * len(self.values) * 2.0**-50

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact, as int64 or, where that could not hold them, Python integers."""
        most = max([int(np.abs(x).max(initial=0)) * self.n, *map(abs, self.sums)])
        if 2 * most < 1 << 62:
            return x * self.n - np.array(self.sums, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def project(self, x: np.ndarray, components: int) -> np.ndarray:
        centred = self.deviations(x).astype(np.float64) / self.n
        found = np.zeros((len(x), components))
        for k in np.flatnonzero(self.positive[:components]):
            found[:, k] = centred @ self.vectors[:, k] / np.sqrt(self.values[k])
        return found


def fit(rows: DataFrame) -> Whitening | None:
    """The whitening of the usable rows; None if there are none."""
    sums = {r["i"]: int(r["value"]) for r in _pieces(rows, None).groupBy("i").agg(F.sum("value").alias("value")).collect()}
    n, size = sums.pop(-1, 0), len(sums)
    if not n or not size:
        return None
    total = [sums[i] for i in range(size)]
    centre = [round(Fraction(s, n)) for s in total]
    rest = [s - n * c for s, c in zip(total, centre)]  # what the whole centres leave over
    found = _pieces(rows, centre).groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    high, low = np.zeros((size, size)), np.zeros((size, size))
    for i, j, value in found:
        exact = Fraction(n * int(value) - rest[i] * rest[j], n * n)
        high[i, j] = high[j, i] = float(exact)
        low[i, j] = low[j, i] = float(exact - Fraction(float(exact)))
    return Whitening(n, total, *eigen((high, low)))


def _identity_error(rows: DataFrame, fitted: Whitening, components: int) -> float:
    """Largest entry of the projections' covariance less the identity, over all rows."""
    chosen = np.flatnonzero(fitted.positive[:components])

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, first = 0.0, 0.0
        for batch in batches:
            if len(batch):
                z = fitted.project(_matrix(batch["_v"]), components)[:, chosen]
                total, first = total + z.T @ z, first + z.sum(axis=0)
        if not isinstance(total, float):
            i, j = np.triu_indices(len(chosen))
            yield pd.DataFrame({"i": i, "j": j, "value": total[i, j]})
            yield pd.DataFrame({"i": np.arange(len(chosen)), "j": -1, "value": first})

    if not len(chosen):
        return 0.0
    sums = rows.select("_v").mapInPandas(products, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("v"))
    found = {(r["i"], r["j"]): r["v"] / fitted.n for r in sums.collect()}
    means = [found[(i, -1)] for i in range(len(chosen))]
    return max(abs(v - means[i] * means[j] - (i == j)) for (i, j), v in found.items() if j >= 0)


_OUT = "n long, deviation long, component int, whitened double, explained double, identity_error double"


def whiten(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """A row for each usable vector and component: key, component, n, deviation, whitened, explained, identity_error."""
    rows = usable(vectors, key, vector)
    fitted = fit(rows)
    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kind = dict(vectors.dtypes)[key]
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], schema)
    count = min(components, len(fitted.values))
    error = _identity_error(rows, fitted, count)
    trace = float(fitted.values.sum())
    explained = fitted.values[:count] / trace if trace > 0 else np.zeros(count)

    @F.pandas_udf("deviation long, whitened array<double>")
    def project(column: pd.Series) -> pd.DataFrame:
        x = _matrix(column)
        off = fitted.deviations(x).astype(object)
        squares = [int(v) for v in (off * off).sum(axis=1)]
        deviation = pd.Series([v if v < 1 << 63 else None for v in squares], dtype="Int64")
        return pd.DataFrame({"deviation": deviation, "whitened": list(fitted.project(x, count))})

    projected = rows.select("_id", project("_v").alias("_p"))
    shares = F.array(*[F.lit(float(e)) for e in explained])
    return projected.select(
        "_id", F.col("_p.deviation").alias("deviation"), F.posexplode("_p.whitened").alias("_at", "whitened")
    ).select(
        F.col("_id").alias(key), (F.col("_at") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation",
        "whitened", F.get(shares, F.col("_at")).alias("explained"), F.lit(error).alias("identity_error"),
    ).select(*names)


@llm_query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every embedding."""
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
