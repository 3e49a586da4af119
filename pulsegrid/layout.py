"""Names of the columns that identify a series and its order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class Layout:
    """``key`` names a series, ``ts`` orders it, ``tie`` makes the order total.

    Spark gives no stable order for equal sort keys, so every ordered operator needs a tie-break that is
    unique inside a series; without one, a recomputed task could order duplicates differently.
    """

    key: str = "user_id"
    ts: str = "ts"
    tie: tuple[str, ...] = ("event_id",)
    tie_is_input: bool = False  # positions say something about a row, identifiers do not

    @property
    def order(self) -> list[str]:
        return [self.ts, *self.tie]

    @property
    def full_order(self) -> list[str]:
        return [self.key, *self.order]


DEFAULT_LAYOUT = Layout()
# Tables exploded from matrices have no event id; the cell position is unique instead.
MATRIX_LAYOUT = Layout(tie=("col_idx", "row_idx"), tie_is_input=True)
DAILY_LAYOUT = Layout(ts="day", tie=())


def layout_of(columns: Sequence[str]) -> Layout:
    """The layout a table's columns follow: events, matrix cells or days."""
    for layout in (DEFAULT_LAYOUT, MATRIX_LAYOUT, DAILY_LAYOUT):
        if {*layout.order} <= {*columns}:
            return layout
    raise ValueError(f"no known layout has an order among {sorted(columns)}; pass one")
