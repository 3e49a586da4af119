"""Training rows with their inputs binned once, and quantiles over them.

Tree models look at the same inputs hundreds of times. Here every input is cut into at most 256 bins once; rows are
packed into stored blocks (``blocks``), a byte or two per input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from copy import copy
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Row, functions as F

from pulsegrid.models.blocks import BLOCK_ROWS, Pieces, StoredBlocks, packed_evenly
from pulsegrid.models.together import Passes
from pulsegrid.session import freeze

_STORED = "block long, bins binary, y binary, w binary, row binary, held binary, score binary"


@dataclass
class Block:
    """Rows of the store: bins by (input, row), label, weight, content hash, held out, score so far."""

    bins: np.ndarray
    y: np.ndarray
    w: np.ndarray
    row: np.ndarray
    held: np.ndarray
    score: np.ndarray


def mixed(row: np.ndarray, salt: int) -> np.ndarray:
    """64 well-mixed bits of a row hash and a salt: draws depend on what a row holds, not on where it lies."""
    x = row.view(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def drawn(row: np.ndarray, salt: int, share: float) -> np.ndarray:
    """Reproducible draw of a share of rows."""
    return (mixed(row, salt) >> np.uint64(11)).astype(np.float64) < share * (1 << 53)


def feature_edges(df: DataFrame, bins: int = 255, features: str = "features") -> list[np.ndarray]:
    """Upper edges of the bins of every input; values above the last edge are the last bin.

    An input with at most ``bins`` values has a bin for each; others are cut at quantiles. Missing numbers (NaN) are in
    no edge and fall into the last bin.
    """
    width = len(df.select(features).first()[0])
    values = df.select(F.posexplode(vector_to_array(features)).alias("at", "value")).where("NOT isnan(value)")
    shares = [i / bins for i in range(1, bins)]
    found = values.groupBy("at").agg(
        F.percentile_approx("value", shares, 100 * bins).alias("cuts"), F.approx_count_distinct("value").alias("n")
    )
    edges = [np.empty(0) for _ in range(width)]
    few = []
    for at, cuts, n in found.collect():  # a row for each input
        edges[at] = np.unique(np.array(cuts, dtype=np.float64))
        if n <= 2 * bins:
            few.append(at)
    array = vector_to_array(features)
    chosen = F.explode(F.array(*[F.struct(F.lit(at).alias("at"), array[at].alias("value")) for at in few])) if few else None
    listed = (
        df.select(chosen.alias("one")).select("one.*").where("NOT isnan(value)").distinct()
        .groupBy("at").agg(F.collect_list("value").alias("all"))
        if few else None
    )
    for at, distinct in listed.collect() if few else ():
        if len(distinct) <= bins:
            edges[at] = np.sort(np.array(distinct, dtype=np.float64))[:-1]
    return edges


class BinnedRows(StoredBlocks[Block]):
    """The store, with the score updates that are not written to it yet."""

    def __init__(self, frame: DataFrame, edges: list[np.ndarray], pending: tuple[Callable[[Block], None], ...] = ()):
        self.edges, self.pending = edges, pending
        self.passes: Passes | None = None  # that fits side by side make together
        super().__init__(frame)

    @property
    def width(self) -> int:
        return len(self.edges)

    @classmethod
    def store(cls, rows: DataFrame, edges: list[np.ndarray], start: float = 0.0, path: str | None = None) -> BinnedRows:
        """Bins and stores rows with ``features``, ``_y``, ``_w`` (one weight, or an array: see ``weighed``), ``_row``
        (hash) and ``_held``."""
        kind = np.dtype(np.uint8 if max(map(len, edges), default=0) < 256 else np.uint16)

        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            number = TaskContext.get().partitionId() << 32
            parts, size = [], 0
            for batch in batches:
                if not len(batch):
                    continue
                inputs = np.array(batch["x"].tolist(), dtype=np.float64)
                bins = np.empty((len(edges), len(batch)), dtype=kind)
                for i, cuts in enumerate(edges):
                    bins[i] = np.searchsorted(cuts, inputs[:, i], side="left")
                weight = np.array(batch["_w"].tolist(), dtype=np.float64).T
                others = (batch["_y"].to_numpy(np.float64), weight, batch["_row"].to_numpy(np.int64))
                parts.append(Block(bins, *others, batch["_held"].to_numpy(bool), np.full(len(batch), start)))
                size += len(batch)
                if size >= BLOCK_ROWS:
                    yield _packed(number, parts)
                    number, parts, size = number + 1, [], 0
            if parts:
                yield _packed(number, parts)

        narrow = packed_evenly(rows, rows.count()).select(vector_to_array("features").alias("x"), "_y", "_w", "_row", "_held")
        return cls(freeze(narrow.mapInPandas(pack, _STORED), path), edges)

    def weighed(self, which: int) -> BinnedRows:
        """The rows of a store of several weights with one of them; an array of weights is stored one after the other."""
        mine = F.expr(f"substring(w, {which} * octet_length(y) + 1, octet_length(y))")
        return BinnedRows(self.frame.withColumn("w", mine), self.edges, self.pending)

    def later(self, update: Callable[[Block], None]) -> BinnedRows:
        """The rows after a score update, which is applied whenever a block is read."""
        return BinnedRows._with(self, (*self.pending, update))

    def written(self, path: str | None = None) -> BinnedRows:
        """The rows with all score updates stored."""
        unpack, pending = self._unpacker(), self.pending

        def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    number, block = unpack(row)
                    yield _packed(number, [_brought_up(block, pending)])

        return BinnedRows(freeze(self.frame.mapInPandas(rewrite, _STORED), path), self.edges)

    def fold(self, work: Callable[[Block], Any], add: Callable[[Any, Any], Any], pieces: Pieces | None = None) -> Any:
        pending = self.pending
        fold = super().fold if self.passes is None else self.passes.fold
        return fold(lambda block: work(_brought_up(block, pending)), add, pieces)

    def fold_apart(self, work: Callable[[Block], Any], *how: Any) -> list:
        pending = self.pending
        return super().fold_apart(lambda block: work(_brought_up(block, pending)), *how)

    @staticmethod
    def _with(rows: BinnedRows, pending: tuple) -> BinnedRows:
        changed = copy(rows)  # the same table and kept blocks
        changed.pending = pending
        return changed

    def together(self, passes: Passes) -> BinnedRows:
        """The rows, whose passes are made with those of others on the same blocks."""
        changed = self._with(self, self.pending)
        changed.passes = passes
        return changed

    def _unpacker(self) -> Callable[[Row], tuple[int, Block]]:
        width = self.width
        kind = np.dtype(np.uint8 if max(map(len, self.edges), default=0) < 256 else np.uint16)

        def unpack(row: Row) -> tuple[int, Block]:
            y = np.frombuffer(row.y)
            return row.block, Block(
                np.frombuffer(row.bins, dtype=kind).reshape(width, len(y)), y, np.frombuffer(row.w),
                np.frombuffer(row.row, dtype=np.int64), np.frombuffer(row.held, dtype=bool), np.frombuffer(row.score),
            )

        return unpack


def _brought_up(block: Block, pending: Sequence[Callable[[Block], None]]) -> Block:
    """The block with the score updates; the kept one stays as it is."""
    block = replace(block, score=block.score.copy())
    for update in pending:
        update(block)
    return block


def _packed(number: int, parts: Sequence[Block]) -> pd.DataFrame:
    columns = {n: np.concatenate([getattr(p, n) for p in parts], axis=-1).tobytes() for n in ("y", "w", "row", "held", "score")}
    bins = np.ascontiguousarray(np.concatenate([p.bins for p in parts], axis=1)).tobytes()
    return pd.DataFrame({"block": [number], "bins": [bins], **{n: [v] for n, v in columns.items()}})


# ---------------------------------------------------------------- quantiles by group


_DIGIT = 16  # bits of a value that a pass looks at
_LISTED = 2048  # a group with no more rows left is read whole


def _ordered(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles; both zeros are one."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _value(key: int) -> float:
    bits = key & ((1 << 63) - 1) if key >> 63 else ~key & ((1 << 64) - 1)
    return float(np.array([bits], dtype=np.uint64).view(np.float64)[0])


def _add_codes(a: tuple, b: tuple) -> tuple:
    codes, at = np.unique(np.concatenate((a[0], b[0])), return_inverse=True)
    return codes, *(np.bincount(at, np.concatenate((x, y)), minlength=len(codes)) for x, y in zip(a[1:], b[1:]))


def _cut_codes(found: tuple, count: int) -> list[tuple]:
    """Sums and listed rows in pieces; equal codes are in one piece, and so are equal values."""
    summed, listed = found
    of_code, of_value = (values % np.uint64(count) for values in (summed[0], listed[1]))
    pieces = []
    for k in range(count):
        here, there = of_code == k, of_value == k
        pieces.append((tuple(v[here] for v in summed), tuple(v[there] for v in listed)))
    return pieces


def _join_codes(pieces: Sequence[tuple]) -> tuple:
    summed, listed = (tuple(np.concatenate(p) for p in zip(*parts)) for parts in zip(*pieces))
    order = np.argsort(summed[0])
    return tuple(v[order] for v in summed), listed


def group_quantiles(
    rows: BinnedRows, groups: int, of: Callable[[Block], tuple[np.ndarray, np.ndarray, np.ndarray]], tau: float
) -> list[float | None]:
    """Weighted quantile per group: the least value at which ``tau`` of the group's weight is reached; None without rows.

    ``of`` gives group number, value and weight of a block's rows. Values are selected digit by digit from the left:
    a pass adds up weights by the next 16 bits among the values that begin with what is known, so no group is ever
    gathered; a group with few rows left is read whole in the pass after.
    """
    known = [0] * groups  # leading digits of each group's quantile
    before = [0.0] * groups
    wanted: list[float | None] = [None] * groups
    result: list[float | None] = [None] * groups
    open_, few = list(range(groups)), set()
    for depth in range(64 // _DIGIT):
        shift = 64 - _DIGIT * (depth + 1)
        marks = np.full(groups, (1 << 64) - 1, dtype=np.uint64)
        taken, read = np.zeros(groups, dtype=bool), np.zeros(groups, dtype=bool)
        for g in open_:
            marks[g], taken[g], read[g] = known[g], True, g in few

        def count(block: Block, shift=shift, marks=marks, taken=taken, read=read, depth=depth):
            group, value, weight = of(block)
            key = _ordered(value)
            keep = taken[group] & (weight > 0)
            if depth:
                keep &= key >> np.uint64(shift + _DIGIT) == marks[group]
            group, key, weight = group[keep], key[keep], weight[keep]
            whole = read[group]
            digit = (key >> np.uint64(shift)) & np.uint64((1 << _DIGIT) - 1)
            code, at = np.unique(group[~whole].astype(np.uint64) << np.uint64(_DIGIT) | digit[~whole], return_inverse=True)
            summed = (code, np.bincount(at, weight[~whole], minlength=len(code)), np.bincount(at, minlength=len(code)).astype(float))
            return summed, (group[whole], key[whole], weight[whole])

        def add(a, b):
            return _add_codes(a[0], b[0]), tuple(np.concatenate(p) for p in zip(a[1], b[1]))

        found = rows.fold(count, add, Pieces(_cut_codes, _join_codes))
        if found is None:
            break
        (code, weights, counts), listed = found
        of_group = (code >> np.uint64(_DIGIT)).astype(np.int64)
        still = []
        for g in open_:
            if g in few:
                mine = listed[0] == g
                order = np.argsort(listed[1][mine], kind="stable")
                keys, upto = listed[1][mine][order], before[g] + np.cumsum(listed[2][mine][order])
                # Sums in another order may end a hair short of the mark; then it is the greatest value.
                hit = min(int(np.searchsorted(upto, wanted[g], side="left")), len(keys) - 1)
                result[g] = _value(int(keys[hit]))
                continue
            mine = of_group == g
            if not mine.any():
                continue
            if wanted[g] is None:
                wanted[g] = float(weights[mine].sum()) * tau * (1 - 1e-12)
            upto = before[g] + np.cumsum(weights[mine])
            hit = min(int(np.searchsorted(upto, wanted[g], side="left")), len(upto) - 1)
            before[g] = float(upto[hit] - weights[mine][hit])
            known[g] = known[g] << _DIGIT | int(code[mine][hit]) & ((1 << _DIGIT) - 1)
            if not shift:
                result[g] = _value(known[g])
                continue
            still.append(g)
            if counts[mine][hit] <= _LISTED:
                few.add(g)
        open_ = still
        if not open_:
            break
    return result
