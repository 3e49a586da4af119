"""Ordered work on series of any length.

A window partitioned by series key puts a whole series into one task. That is right for ordinary series and
wrong for one that holds a large share of all rows. The operators here measure series lengths first (one
map-side combined count over a single column) and send only the long ones down a second, equally exact path:

1. range-partition the long series by (key, order), so that one series spans many partitions;
2. number the rows globally from per-partition counts;
3. cut the numbering into blocks, copy the few rows next to a block's edges into it as a halo;
4. evaluate the same window expressions inside each block and drop the halo rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from pulsegrid.layout import DEFAULT_LAYOUT, Layout
from pulsegrid.session import freeze

# A series beyond this many rows is not sorted by a single task.
HOT_ROWS = 4_000_000
# More hot keys than this are not listed on the driver; then all rows take the block path, which is exact too.
HOT_KEY_LIST = 10_000
# Rows of one window task on the block path.
BLOCK_ROWS = 1_000_000

_ROW = "_row"  # number of a row of a long series
_POSITION_BITS = 33  # row position inside a partition in monotonically_increasing_id()


@dataclass(frozen=True)
class HotKeys:
    """Keys whose series are too long for one task; ``everything`` when they are too many to list."""

    key: str
    values: tuple = ()
    everything: bool = False
    block_rows: int = field(default=BLOCK_ROWS, compare=False)

    def __bool__(self) -> bool:
        return self.everything or bool(self.values)

    def test(self) -> Column:
        if self.everything:
            return F.lit(True)
        listed = [v for v in self.values if v is not None]
        hit = F.coalesce(F.col(self.key).isin(listed), F.lit(False)) if listed else F.lit(False)
        return hit | F.col(self.key).isNull() if None in self.values else hit

    def divide(self, df: DataFrame) -> tuple[DataFrame | None, DataFrame]:
        """(ordinary rows, rows of long series)."""
        if self.everything:
            return None, df
        return df.where(~self.test()), df.where(self.test())


def no_hot_keys(layout: Layout = DEFAULT_LAYOUT) -> HotKeys:
    return HotKeys(layout.key)


def find_hot_keys(
    df: DataFrame,
    key: str = "user_id",
    hot_rows: int = HOT_ROWS,
    block_rows: int = BLOCK_ROWS,
    list_size: int = HOT_KEY_LIST,
) -> HotKeys:
    """Count rows per key and return the long ones. At most ``list_size`` + 1 keys reach the driver."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    found = counts.where(F.col("_rows") > hot_rows).select(key).limit(list_size + 1).collect()
    if len(found) > list_size:
        return HotKeys(key, everything=True, block_rows=block_rows)
    return HotKeys(key, values=tuple(row[0] for row in found), block_rows=block_rows)


def number_rows(df: DataFrame, order: list[str], name: str = "row_index") -> DataFrame:
    """0-based position of every row in the total order given by ``order``, without a one-task sort.

    Only per-partition counts are ordered in one task: as many rows as there are shuffle partitions.
    """
    marked = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mark", F.monotonically_increasing_id())
    )
    frozen = freeze(marked)
    part = F.shiftright("_mark", _POSITION_BITS)
    position = F.col("_mark").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    sizes = frozen.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    return (
        frozen.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + position)
        .drop("_part", "_offset", "_mark")
    )


@dataclass(frozen=True)
class SeriesColumns:
    """Window expressions that look at most ``back`` rows behind and ``ahead`` rows in front."""

    build: Callable[[WindowSpec], Mapping[str, Column]]
    back: int = 0
    ahead: int = 0

    def __add__(self, other: SeriesColumns) -> SeriesColumns:
        return SeriesColumns(
            lambda w: {**self.build(w), **other.build(w)},
            max(self.back, other.back),
            max(self.ahead, other.ahead),
        )


def add_series_columns(
    df: DataFrame,
    columns: SeriesColumns,
    layout: Layout = DEFAULT_LAYOUT,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Add window columns per series. All expressions share one exchange and one sort.

    ``hot`` may be passed by a job that has measured its input once; otherwise it is measured here.
    """
    hot = find_hot_keys(df, layout.key) if hot is None else hot
    window = Window.partitionBy(layout.key).orderBy(*layout.order)
    if not hot:
        return df.withColumns(dict(columns.build(window)))
    ordinary, long = hot.divide(df)
    blocked = _in_blocks(long, columns, layout, hot.block_rows)
    if ordinary is None:
        return blocked
    return ordinary.withColumns(dict(columns.build(window))).unionByName(blocked)


def _in_blocks(df: DataFrame, columns: SeriesColumns, layout: Layout, block_rows: int) -> DataFrame:
    return _add_in_blocks(number_rows(df, layout.full_order, _ROW), columns, layout, block_rows).drop(_ROW)


def _add_in_blocks(numbered: DataFrame, columns: SeriesColumns, layout: Layout, block_rows: int) -> DataFrame:
    """Window columns of rows numbered without gaps, block by block; rows keep their number."""
    size = max(block_rows, columns.back, columns.ahead, 1)
    home = F.floor(F.col(_ROW) / F.lit(size))
    offset = F.col(_ROW) % F.lit(size)
    targets = F.array_compact(
        F.array(
            home,
            F.when(offset >= size - columns.back, home + 1),
            F.when(offset < columns.ahead, home - 1),
        )
    )
    copies = numbered.withColumn("_home", home).withColumn("_block", F.explode(targets))
    window = Window.partitionBy("_block", layout.key).orderBy(_ROW)
    return (
        copies.withColumns(dict(columns.build(window)))
        .where(F.col("_block") == F.col("_home"))
        .drop("_home", "_block")
    )


@dataclass(frozen=True)
class DividedSeries:
    """The rows of a job with several window stages, divided into ordinary and long series once.

    Long series are put in order and numbered once, the one time their rows are written. A stage reads the halo of a
    block from the numbers; after a filter the rows that are left are numbered anew from the counts of each block, so
    a block's halo again holds the last rows that were kept before it, however many blocks back they lie.
    """

    ordinary: DataFrame | None
    long: DataFrame | None
    layout: Layout
    block_rows: int = BLOCK_ROWS

    @classmethod
    def divide(cls, df: DataFrame, layout: Layout = DEFAULT_LAYOUT, hot: HotKeys | None = None) -> DividedSeries:
        hot = find_hot_keys(df, layout.key) if hot is None else hot
        if not hot:
            return cls(df, None, layout)
        ordinary, long = hot.divide(df)
        return cls(ordinary, number_rows(long, layout.full_order, _ROW), layout, hot.block_rows)

    def add(self, columns: SeriesColumns) -> DividedSeries:
        """Window columns per series."""
        window = Window.partitionBy(self.layout.key).orderBy(*self.layout.order)
        return replace(
            self,
            ordinary=None if self.ordinary is None else self.ordinary.withColumns(dict(columns.build(window))),
            long=None if self.long is None else _add_in_blocks(self.long, columns, self.layout, self.block_rows),
        )

    def each(self, change: Callable[[DataFrame], DataFrame]) -> DividedSeries:
        """A change of every row by itself."""
        return replace(
            self,
            ordinary=None if self.ordinary is None else change(self.ordinary),
            long=None if self.long is None else change(self.long),
        )

    def keep(self, choose: Callable[[DataFrame], DataFrame]) -> DividedSeries:
        """A filter; the rows of long series that stay are numbered without gaps again."""
        kept = self.each(choose)
        if kept.long is None:
            return kept
        block = F.floor(F.col(_ROW) / F.lit(self.block_rows))
        placed = kept.long.withColumn("_home", block)
        counts = placed.groupBy("_home").agg(F.count(F.lit(1)).alias("_n"))  # a row for each block
        earlier = Window.orderBy("_home").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.select("_home", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
        place = F.row_number().over(Window.partitionBy("_home").orderBy(_ROW)) - 1
        numbered = placed.withColumn("_place", place).join(F.broadcast(starts), "_home")
        return replace(kept, long=numbered.withColumn(_ROW, F.col("_start") + F.col("_place")).drop("_home", "_place", "_start"))

    def together(self) -> DataFrame:
        if self.long is None:
            return self.ordinary
        long = self.long.drop(_ROW)
        return long if self.ordinary is None else self.ordinary.unionByName(long)


def number_in_series(
    df: DataFrame,
    layout: Layout = DEFAULT_LAYOUT,
    name: str = "position",
    hot: HotKeys | None = None,
) -> DataFrame:
    """0-based position of every row inside its series."""
    hot = find_hot_keys(df, layout.key) if hot is None else hot
    window = Window.partitionBy(layout.key).orderBy(*layout.order)
    in_task = (F.row_number().over(window) - 1).cast("bigint")
    if not hot:
        return df.withColumn(name, in_task)
    ordinary, long = hot.divide(df)
    numbered = number_rows(long, layout.full_order, "_row")
    starts = numbered.groupBy(layout.key).agg(F.min("_row").alias("_start"))
    placed = (
        join_by_key(numbered, starts, layout.key, hot=hot, null_safe=True)
        .withColumn(name, F.col("_row") - F.col("_start"))
        .drop("_row", "_start")
    )
    return placed if ordinary is None else ordinary.withColumn(name, in_task).unionByName(placed)


def join_by_key(
    df: DataFrame, lookup: DataFrame, key: str, how: str = "left", hot: HotKeys | None = None, null_safe: bool = False
) -> DataFrame:
    """Join rows to one lookup row per key without gathering a long series.

    Rows of listed hot keys meet a broadcast of only those keys' lookup rows, whose number is bounded by the
    list; all other rows use an ordinary join, where Spark picks the strategy by measured size and splits what
    is still uneven. Series are measured here unless the caller has done so. ``null_safe`` lets rows without a key
    meet a lookup row without one.
    """
    hot = find_hot_keys(df, key) if hot is None else hot

    def meet(rows: DataFrame, side: DataFrame) -> DataFrame:
        if not null_safe:
            return rows.join(side, key, how)
        renamed = side.withColumnRenamed(key, "_lookup_key")
        return rows.join(renamed, F.col(key).eqNullSafe(F.col("_lookup_key")), how).drop("_lookup_key")

    if not hot or hot.everything:
        return meet(df, lookup)
    ordinary, long = hot.divide(df)
    few = lookup.where(hot.test())
    return meet(ordinary, lookup).unionByName(meet(long, F.broadcast(few)))
