"""Trees grown best leaf first from histograms of binned inputs.

A leaf's histogram holds, for each input and bin, the sums of pulls and curvatures and the number of rows. The leaf of
greatest gain is opened next, until the tree has its leaves. To choose on, the children's histograms are needed: that of
the smaller child is summed over its rows, that of its sibling is the parent's less it. A pass over the data sums the
smaller children of several leaves at once: growth is tried out with what is known, and the leaves that it would open
with the splits that are left are looked into ahead. A tree takes no more passes than it is deep, and is the same as one
grown a leaf at a time.

Nodes are numbered by their way from the root, which is 1: the children of n are 2n and 2n + 1.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np

PULL, CURVE, COUNT = range(3)
_LEAST_GAIN = 1e-12  # share of the leaf's score below which a gain is rounding


@dataclass(frozen=True)
class Limits:
    """When a tree stops: leaves and depth (None: any), least rows and curvature of a leaf, penalty on splits."""

    leaves: int | None = 31
    depth: int | None = None
    min_leaf: int = 20
    min_curvature: float = 0.0
    l2: float = 0.0


@dataclass(frozen=True)
class Split:
    """Rows of ``node`` whose bin of ``feature`` is at most ``bin`` go to its left child."""

    node: int
    feature: int
    bin: int


@dataclass(frozen=True)
class Request:
    """The histogram of one side of a leaf that is to be split."""

    node: int
    feature: int
    bin: int
    right: bool


@dataclass
class Leaf:
    node: int
    depth: int
    stats: np.ndarray  # pull, curvature, rows
    histogram: np.ndarray | None = None  # (inputs, bins, 3)
    gain: float = 0.0
    feature: int = -1
    bin: int = -1
    children: tuple[Leaf, Leaf] | None = None  # once known
    below: np.ndarray | None = None  # what goes left, if the histogram is not kept

    def split(self) -> Split:
        return Split(self.node, self.feature, self.bin)

    def sides(self) -> tuple[np.ndarray, np.ndarray]:
        left = self.histogram[self.feature, : self.bin + 1].sum(axis=0) if self.below is None else self.below
        return left, self.stats - left

    def part(self, histograms: tuple = (None, None)) -> None:
        self.children = tuple(
            Leaf(2 * self.node + i, self.depth + 1, stats, table)
            for i, (stats, table) in enumerate(zip(self.sides(), histograms))
        )


@dataclass
class Grown:
    splits: list[Split] = field(default_factory=list)
    leaves: list[Leaf] = field(default_factory=list)


def routes(bins: np.ndarray, splits: Sequence[Split], some: np.ndarray | None = None) -> dict[int, np.ndarray]:
    """Row numbers, in order, of every leaf, of all rows or of some."""
    rows = bins.shape[1]
    start = np.ones(rows, dtype=bool) if some is None else np.zeros(rows, dtype=bool)
    start[some] = True
    found = {1: _listed(start)}
    for s in splits:
        at = found.pop(s.node)
        if at.dtype == bool:
            left = (bins[s.feature] <= s.bin) & at
            found[2 * s.node], found[2 * s.node + 1] = _listed(left), _listed(at ^ left)
        else:
            left = bins[s.feature].take(at) <= s.bin
            found[2 * s.node], found[2 * s.node + 1] = at.take(np.flatnonzero(left)), at.take(np.flatnonzero(~left))
    return {node: np.flatnonzero(at) if at.dtype == bool else at for node, at in found.items()}


def _listed(mask: np.ndarray) -> np.ndarray:
    """The mask of a large part of the rows, which is compared fastest over all of them; numbers of the rows of a small one."""
    return mask if 16 * np.count_nonzero(mask) > len(mask) else np.flatnonzero(mask)


def histogram(bins: np.ndarray, rows: np.ndarray, pull: np.ndarray, curve: np.ndarray, size: int) -> np.ndarray:
    """Sums by (input, bin) over some rows."""
    return histograms(bins, [rows], pull, curve, size)[0]


def requested(
    bins: np.ndarray,
    splits: Sequence[Split],
    requests: Sequence[Request],
    pull: np.ndarray,
    curve: np.ndarray,
    size: int,
    some: np.ndarray | None = None,
) -> np.ndarray:
    """Histograms of the requested sides of leaves of a tree, in order."""
    rows = routes(bins, splits, some)
    sides = []
    for r in requests:
        at = rows[r.node]
        sides.append(at[(bins[r.feature, at] <= r.bin) != r.right])
    return histograms(bins, sides, pull, curve, size)


def histograms(
    bins: np.ndarray, groups: Sequence[np.ndarray], pull: np.ndarray, curve: np.ndarray, size: int
) -> np.ndarray:
    """``histogram`` of several groups of rows, an input of all of them at a time."""
    found = np.zeros((len(groups), len(bins), size, 3))
    rows = np.concatenate(groups) if len(groups) else np.zeros(0, dtype=np.int64)
    if not len(rows):
        return found
    coded = Coded(bins, groups, rows, size)
    even = bool((curve[rows] == 1.0).all())
    least, most = pull[rows].min(), pull[rows].max()
    upper = pull == most
    if even and (upper | (pull == least))[rows].all():  # counts of both pulls tell all sums
        for i, code in enumerate(coded.of(upper)):
            below, above = coded.sums(code, twice=True)
            found[:, i, :, PULL] = least * below + most * above
            found[:, i, :, COUNT] = found[:, i, :, CURVE] = below + above
        return found
    pull, curve = coded.those(pull), coded.those(curve)
    for i, code in enumerate(coded.of()):
        count = coded.sums(code)
        found[:, i, :, PULL] = coded.sums(code, pull)
        found[:, i, :, CURVE] = count if even else coded.sums(code, curve)
        found[:, i, :, COUNT] = count
    return found


class Coded:
    """Numbers of (group, bin) by input, of the rows of groups. If those are most of the rows, all are numbered, the
    others as a group of their own: that is faster than picking rows."""

    def __init__(self, bins: np.ndarray, groups: Sequence[np.ndarray], rows: np.ndarray, size: int):
        self.bins, self.rows, self.size, self.groups = bins, rows, size, len(groups)
        self.all = 2 * len(rows) > bins.shape[1]
        self.start = np.repeat(np.arange(len(groups)) * size, [len(g) for g in groups])
        if self.all:
            start = np.full(bins.shape[1], len(groups) * size)
            start[rows] = self.start
            self.start = start
        self.length = (len(groups) + self.all) * size

    def those(self, values: np.ndarray) -> np.ndarray:
        return values if self.all else values.take(self.rows)

    def of(self, upper: np.ndarray | None = None) -> Iterator[np.ndarray]:
        """The numbers, an input at a time; ``upper`` rows have numbers of their own."""
        start = self.start if upper is None else self.start + self.length * self.those(upper)
        for column in self.bins:
            yield start + self.those(column)

    def sums(self, code: np.ndarray, weight: np.ndarray | None = None, twice: bool = False) -> np.ndarray:
        """Sums by (group, bin), or by (whether upper, group, bin)."""
        found = np.bincount(code, weight, minlength=(1 + twice) * self.length).reshape(1 + twice, -1, self.size)
        return found[:, : self.groups] if twice else found[0, : self.groups]


def _score(stats: np.ndarray, l2: float) -> np.ndarray:
    down = stats[..., CURVE] + l2
    return np.divide(stats[..., PULL] ** 2, down, out=np.zeros_like(down), where=down > 0)


def first_best(gains: np.ndarray, whole: float) -> int:
    """The first of the greatest gains. Inputs that part the rows alike have one gain, but for rounding."""
    most = float(gains.max())
    return int(np.argmax(gains >= most - 1e-9 * abs(most) - 1e-13 * whole))


def find_split(leaf: Leaf, limits: Limits, chosen: np.ndarray | None = None) -> None:
    """Sets the leaf's best split: of equal gains, the first input and lowest bin. ``chosen``: the inputs allowed."""
    table = leaf.histogram
    if table is None or (limits.depth is not None and leaf.depth >= limits.depth):
        return
    left = np.cumsum(table, axis=1)[:, :-1]
    right = leaf.stats - left
    whole = float(_score(leaf.stats, limits.l2))
    gains = _score(left, limits.l2) + _score(right, limits.l2) - whole
    allowed = np.ones(gains.shape, dtype=bool)
    for side in (left, right):
        allowed &= (side[..., COUNT] >= max(limits.min_leaf, 1)) & (side[..., CURVE] >= limits.min_curvature)
    if chosen is not None:
        barred = np.ones(len(table), dtype=bool)
        barred[chosen] = False
        allowed[barred] = False
    gains = np.where(allowed, gains, -np.inf)
    if gains.size and allowed.any():
        best = first_best(gains, abs(whole))
        leaf.feature, leaf.bin = divmod(best, gains.shape[1])
        least = _LEAST_GAIN * max(abs(whole), float(np.abs(leaf.stats[PULL])))
        leaf.gain = float(gains.flat[best]) if gains.flat[best] > least else 0.0


def grow(
    root: np.ndarray,
    measure: Callable[[list[Split], list[Request]], np.ndarray],
    limits: Limits,
    chosen: np.ndarray | None = None,
) -> Grown:
    """The tree whose root has histogram ``root``; ``measure`` sums the requested histograms over the rows."""
    first = Leaf(1, 0, root[0].sum(axis=0) if len(root) else np.zeros(3), root)
    find_split(first, limits, chosen)
    tree, waiting = Grown(), [(-first.gain, 1, first)]
    most = limits.leaves or np.inf
    while waiting and waiting[0][2].gain > 0 and len(waiting) < most:
        leaf = waiting[0][2]
        if leaf.children is None and len(waiting) + 1 < most:
            _look_ahead(tree.splits, waiting, measure, limits, chosen, most - len(waiting))
        if leaf.children is None:  # the last split
            leaf.part()
        heapq.heappop(waiting)
        tree.splits.append(leaf.split())
        for child in leaf.children:
            heapq.heappush(waiting, (-child.gain, child.node, child))
        leaf.histogram = leaf.children = None
    tree.leaves = sorted((leaf for _, _, leaf in waiting), key=lambda leaf: leaf.node)
    return tree


def _look_ahead(
    splits: list[Split], waiting: list, measure: Callable, limits: Limits, chosen: np.ndarray | None, left: float
) -> None:
    """Finds the children of all leaves that growth would open with ``left`` splits to go, as far as gains are known."""
    tried, ahead, asked = list(waiting), [], []
    while tried and left > 0:
        leaf = heapq.heappop(tried)[2]
        if leaf.gain <= 0:
            break
        left -= 1
        if leaf.children is None and limits.depth is not None and leaf.depth + 1 >= limits.depth:
            leaf.part()  # children at the limit are not split: what they sum up to is enough
        if leaf.children is None:
            asked.append(leaf)
            continue
        ahead.append(leaf.split())
        for child in leaf.children:
            heapq.heappush(tried, (-child.gain, child.node, child))
    requests = []
    for leaf in asked:
        below, above = leaf.sides()
        requests.append(Request(leaf.node, leaf.feature, leaf.bin, bool(below[COUNT] > above[COUNT])))
    if not requests:
        return
    for leaf, request, smaller in zip(asked, requests, measure([*splits, *ahead], requests)):
        other = leaf.histogram - smaller
        leaf.part((other, smaller) if request.right else (smaller, other))
        for child in leaf.children:
            find_split(child, limits, chosen)


# ---------------------------------------------------------------- flat trees


@dataclass(frozen=True)
class FlatTree:
    """Nodes as lists: ``feature`` -1 for a leaf, whose ``value`` counts; others go left if input <= ``threshold``."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    value: list[float]

    @property
    def size(self) -> int:
        return len(self.feature)


def flatten(splits: Sequence[Split], values: dict[int, float], edges: Sequence[np.ndarray]) -> FlatTree:
    """Nodes in the order in which they came up, each after its parent."""
    place = {1: 0}
    for s in splits:
        place[2 * s.node], place[2 * s.node + 1] = len(place), len(place) + 1
    size = len(place)
    tree = FlatTree([-1] * size, [0.0] * size, [-1] * size, [-1] * size, [0.0] * size)
    for node, at in place.items():
        tree.value[at] = values.get(node, 0.0)
    for s in splits:
        at = place[s.node]
        tree.feature[at], tree.threshold[at] = s.feature, float(edges[s.feature][s.bin])
        tree.left[at], tree.right[at] = place[2 * s.node], place[2 * s.node + 1]
    return tree


def cut_by_bins(tree: FlatTree, edges: Sequence[np.ndarray]) -> FlatTree:
    """The tree with the bins of its thresholds in their place."""
    bins = [int(np.searchsorted(edges[f], t)) if f >= 0 else -1 for f, t in zip(tree.feature, tree.threshold)]
    return FlatTree(tree.feature, bins, tree.left, tree.right, tree.value)


def walk(tree: FlatTree, bins: np.ndarray) -> np.ndarray:
    """Value of every row's leaf, from a tree that is cut by bins."""
    found = np.empty(bins.shape[1])
    todo = [(0, _listed(np.ones(bins.shape[1], dtype=bool)))]
    while todo:
        node, rows = todo.pop()
        if tree.feature[node] < 0:
            found[rows] = tree.value[node]
            continue
        column, cut = bins[tree.feature[node]], tree.threshold[node]
        if rows.dtype == bool:
            left = (column <= cut) & rows
            todo += [(tree.left[node], _listed(left)), (tree.right[node], _listed(rows ^ left))]
        else:
            left = column.take(rows) <= cut
            todo += [(tree.left[node], rows.take(np.flatnonzero(left))), (tree.right[node], rows.take(np.flatnonzero(~left)))]
    return found
