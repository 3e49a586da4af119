"""Rows stored in blocks of bytes, and sums over them.

Models that look at their training rows many times keep them packed: a stored row is a block of rows, one binary
column per array. A pass lets a function sum over each block, and adds the sums up inside each task first and, where
there are many tasks, in groups of tasks before anything reaches the driver. Large sums are cut into pieces and each
piece is added up over all tasks where it is dealt to (``Pieces``). What arrives at the driver then has the size of one
sum, whatever the number of rows and tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any, Generic, TypeVar

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Row, functions as F

from pulsegrid.session import freeze

BLOCK_ROWS = 1 << 15
_FEW_TASKS = 64  # sums of more tasks are added in groups before they travel to the driver
_FEW_BYTES = 1 << 20  # large sums travel to the driver as they are if together they are no more than this
_MOST_PIECES = 128

Block = TypeVar("Block")


@dataclass(frozen=True)
class Pieces:
    """How a large sum is cut into a number of pieces and put together again; ``size`` is its bytes, as far as known."""

    cut: Callable[[Any, int], Sequence[Any]]
    join: Callable[[Sequence[Any]], Any]
    size: int | None = None


def array_pieces(shape: tuple[int, ...]) -> Pieces:
    """An array of doubles, cut anywhere."""
    return Pieces(
        lambda whole, n: np.array_split(whole.reshape(-1), n),
        lambda parts: np.concatenate(parts).reshape(shape),
        8 * math.prod(shape),
    )


class StoredBlocks(Generic[Block]):
    """``frame`` holds a block per row, numbered by ``block``; ``unpack`` gives (number, block) of a row.

    Passes run over the blocks themselves, kept by the executors: a pass is then little more than its tasks, where a
    query of its own for each of the hundreds of passes of a fit would cost more than the sums. A lost block is read from
    the stored table again.
    """

    def __init__(self, frame: DataFrame):
        self.frame = frame
        self.blocks = frame.rdd.map(self._unpacker()).persist(StorageLevel.MEMORY_AND_DISK)
        self.tasks = self.blocks.getNumPartitions()

    def _unpacker(self) -> Callable[[Row], tuple[int, Block]]:
        raise NotImplementedError

    def release(self) -> None:
        """Lets the executors forget the blocks; the table stays."""
        self.blocks.unpersist()

    def fold(self, work: Callable[[Block], Any], add: Callable[[Any, Any], Any], pieces: Pieces | None = None) -> Any:
        """The sum of ``work`` over all blocks, None if there is none; sums are added in the order of the blocks.

        ``add`` may add to its first argument, which ``work`` has made.
        """
        return fold_blocks(self.blocks, self.tasks, work, add, pieces)

    def fold_apart(
        self, work: Callable[[Block], Any], add: Callable[[Any, Any], Any], cut: Callable[[Any, int], Sequence[Any]],
        count: int, use: Callable[[int, Any], Any],
    ) -> list:
        """``use`` (number, piece) of each of ``count`` pieces of the sum, worked out where the piece is added up."""
        sums = self.blocks.mapPartitions(lambda part: _add_up(((n, work(block)) for n, block in part), add))
        places = min(count, max(self.tasks, 8), _MOST_PIECES)
        return sum_pieces(sums, count, add, cut, places).map(lambda p: use(*p)).collect()


def _add_up(parts: Iterator[tuple[int, Any]], add: Callable[[Any, Any], Any]) -> Iterator[tuple[int, Any]]:
    total, first = None, 0
    for number, part in parts:
        total, first = (part, number) if total is None else (add(total, part), first)
    if total is not None:
        yield first, total


def fold_blocks(
    blocks: RDD, tasks: int, work: Callable[[Block], Any], add: Callable[[Any, Any], Any], pieces: Pieces | None = None
) -> Any:
    def work_up(part: Iterator[tuple[int, Block]]) -> Iterator[tuple[int, Any]]:
        return _add_up(((number, work(block)) for number, block in part), add)

    sums = blocks.mapPartitions(work_up)
    if pieces is not None and tasks > 1 and (pieces.size is None and tasks > 8 or tasks * (pieces.size or 0) > _FEW_BYTES):
        parts = sum_pieces(sums, min(tasks, _MOST_PIECES), add, pieces.cut)
        found = [part for _, part in sorted(parts.collect(), key=lambda p: p[0])]
        return pieces.join(found) if found else None
    if tasks > _FEW_TASKS:  # as many groups as members: the driver adds the square root of the tasks
        groups = math.isqrt(tasks)
        sums = sums.partitionBy(groups).mapPartitions(lambda part: _add_up(sorted(part, key=lambda p: p[0]), add))
    total = next(_add_up(sorted(sums.collect(), key=lambda p: p[0]), add), None)
    return None if total is None else total[1]


def fold_several(blocks: RDD, tasks: int, asked: Sequence[tuple]) -> list:
    """``fold_blocks`` of several (work, add, pieces) in one pass, which reads every block once."""
    large = tasks > 8 or tasks * sum(pieces.size or 0 for _, _, pieces in asked if pieces) > _FEW_BYTES
    share = max(1, min(tasks, _MOST_PIECES))
    counts = [share if pieces is not None and large else 1 for *_, pieces in asked]

    def work_up(part: Iterator[tuple[int, Block]]) -> Iterator[tuple[tuple[int, int], tuple[int, Any]]]:
        totals: list = [None] * len(asked)
        for number, block in part:
            for k, (work, add, _) in enumerate(asked):
                found = work(block)
                totals[k] = (number, found) if totals[k] is None else (totals[k][0], add(totals[k][1], found))
        for k, total in enumerate(totals):
            if total is not None:
                cut = asked[k][2].cut(total[1], counts[k]) if counts[k] > 1 else [total[1]]
                yield from (((k, n), (total[0], piece)) for n, piece in enumerate(cut))

    def gather(part: Iterator[tuple[tuple[int, int], tuple[int, Any]]]) -> Iterator[tuple[tuple[int, int], Any]]:
        mine: dict[tuple[int, int], list] = {}
        for key, piece in part:
            mine.setdefault(key, []).append(piece)
        for key, found in mine.items():
            for _, total in _add_up(sorted(found, key=lambda p: p[0]), asked[key[0]][1]):
                yield key, total

    sums = blocks.mapPartitions(work_up)
    if large:
        sums = sums.partitionBy(share, lambda key: key[0] + key[1]).mapPartitions(gather).collect()
    else:
        sums = gather(iter(sums.collect()))
    found: list[dict] = [{} for _ in asked]
    for (k, n), piece in sums:
        found[k][n] = piece
    joined = [pieces.join if count > 1 else lambda parts: parts[0] for (*_, pieces), count in zip(asked, counts)]
    return [join([parts[n] for n in sorted(parts)]) if parts else None for join, parts in zip(joined, found)]


def sum_pieces(
    sums: RDD, count: int, add: Callable[[Any, Any], Any], cut: Callable[[Any, int], Sequence[Any]], places: int | None = None
) -> RDD:
    """(number, sum of the pieces of that number), from sums (first block, sum) that ``cut`` cuts in ``count`` pieces."""

    def deal(part: Iterator[tuple[int, Any]]) -> Iterator[tuple[int, tuple[int, Any]]]:
        for first, total in part:
            yield from ((k, (first, piece)) for k, piece in enumerate(cut(total, count)))

    def gather(part: Iterator[tuple[int, tuple[int, Any]]]) -> Iterator[tuple[int, Any]]:
        mine: dict[int, list] = {}
        for k, piece in part:
            mine.setdefault(k, []).append(piece)
        for k, found in mine.items():
            for _, total in _add_up(sorted(found, key=lambda p: p[0]), add):
                yield k, total

    return sums.mapPartitions(deal).partitionBy(places or count, lambda k: k).mapPartitions(gather)


class MatrixRows(StoredBlocks[tuple[np.ndarray, np.ndarray]]):
    """Inputs (rows by columns) and labels as doubles."""

    @classmethod
    def store(cls, rows: DataFrame, features: str = "features", label: str = "label") -> MatrixRows:
        """Rows with a label; blocks hold fewer rows the more inputs there are."""

        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            number = TaskContext.get().partitionId() << 32
            xs, ys, size = [], [], 0

            def block() -> pd.DataFrame:
                x, y = np.concatenate(xs), np.concatenate(ys)
                return pd.DataFrame({"block": [number], "x": [x.tobytes()], "y": [y.tobytes()]})

            for batch in batches:
                if not len(batch):
                    continue
                xs.append(np.array(batch["x"].tolist(), dtype=np.float64))
                ys.append(batch["y"].to_numpy(np.float64))
                size += len(batch)
                if size >= BLOCK_ROWS or size * xs[0].shape[1] >= 1 << 21:
                    yield block()
                    xs, ys, size, number = [], [], 0, number + 1
            if xs:
                yield block()

        narrow = packed_evenly(rows, rows.count()).select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y")).where("y IS NOT NULL")
        return cls(freeze(narrow.mapInPandas(pack, "block long, x binary, y binary")))

    def _unpacker(self):
        def unpack(row: Row) -> tuple[int, tuple[np.ndarray, np.ndarray]]:
            labels = np.frombuffer(row.y)
            return row.block, (np.frombuffer(row.x).reshape(len(labels), -1), labels)

        return unpack


def packed_evenly(rows: DataFrame, count: int) -> DataFrame:
    """Rows in no more partitions than there are blocks to fill: a pass should not have more tasks than work."""
    most = max(1, math.ceil(count / BLOCK_ROWS))
    return rows.coalesce(most) if rows.rdd.getNumPartitions() > most else rows


def add_arrays(a: tuple, b: tuple) -> tuple:
    return tuple(x + y for x, y in zip(a, b))


def add_to(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum in place of the first array."""
    a += b
    return a
