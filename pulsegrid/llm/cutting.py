"""Cutting stock by column generation, for a few hundred item lengths."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np

ROUNDS = 4000  # columns generated at most; any set of columns gives a valid packing, and a warning says if more would help
_EPS = 1e-9


@dataclass(frozen=True)
class Pattern:
    """``copies`` sequences that each hold ``items`` (length, how many of them)."""

    items: tuple[tuple[int, int], ...]
    copies: int


def best_pattern(values: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """Knapsack by dynamic programming: the pattern of greatest value; values[l] is that of length l, 0 if none."""
    best = np.zeros(capacity + 1)
    choice = np.zeros(capacity + 1, dtype=np.int64)
    for room in range(1, capacity + 1):
        sums = values[1 : room + 1] + best[room - 1 :: -1]
        choice[room] = 1 + int(np.argmax(sums))
        best[room] = sums[choice[room] - 1]
    items: dict[int, int] = {}
    room = capacity
    while room > 0:
        length = int(choice[room])
        if values[length] > 0:
            items[length] = items.get(length, 0) + 1
        room -= length
    return float(best[capacity]), items


def solve(demand: dict[int, int], capacity: int, rounds: int = ROUNDS) -> list[tuple[dict[int, int], float]]:
    """(pattern, how often) of a basic solution of the linear program that covers the demand with fewest sequences.

    A revised simplex over patterns: duals of the basis price new patterns by ``best_pattern``; the first basis has
    one pattern per length.
    """
    lengths = np.array(sorted(l for l, n in demand.items() if n > 0), dtype=np.int64)
    if not len(lengths):
        return []
    place = {int(l): i for i, l in enumerate(lengths)}
    fits = capacity // lengths
    patterns = [{int(l): int(f)} for l, f in zip(lengths, fits)]
    inverse = np.diag(1.0 / fits)
    amount = np.array([demand[int(l)] for l in lengths]) / fits
    for _ in range(rounds):
        duals = inverse.sum(axis=0)  # every pattern costs one sequence
        values = np.zeros(capacity + 1)
        values[lengths] = np.maximum(duals, 0.0)
        gain, items = best_pattern(values, capacity)
        if gain <= 1 + 1e-7:
            break
        column = np.zeros(len(lengths))
        for length, n in items.items():
            column[place[length]] = n
        direction = inverse @ column
        ratios = np.where(direction > _EPS, amount / np.where(direction > _EPS, direction, 1.0), np.inf)
        out = int(np.argmin(ratios))
        step = ratios[out]
        amount = np.maximum(amount - step * direction, 0.0)
        amount[out] = step
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        patterns[out] = items
    else:
        warnings.warn(f"column generation ended after {rounds} rounds, before the optimum", stacklevel=2)
    return [(p, float(a)) for p, a in zip(patterns, amount) if a > _EPS]


def round_patterns(solution: list[tuple[dict[int, int], float]], demand: dict[int, int], capacity: int) -> list[Pattern]:
    """Whole copies of patterns that the demand can fill.

    Patterns are rounded down. Then, from the largest fraction on, full patterns are taken once more while their items
    are there. Last, what remains is fitted, longest first, into the fullest open sequence that has room, and the
    sequences this fills to the brim are kept too. Items in no pattern are left to the caller.
    """
    left = dict(demand)
    kept: list[Pattern] = []

    def take(items: dict[int, int], copies: int) -> None:
        for length, n in items.items():
            left[length] -= n * copies
        kept.append(Pattern(tuple(sorted(items.items(), reverse=True)), copies))

    for items, amount in solution:
        copies = min([int(amount + 1e-6), *(left[l] // n for l, n in items.items())])
        if copies > 0:
            take(items, copies)
    for items, _ in sorted(solution, key=lambda s: (-(s[1] % 1.0), sorted(s[0].items()))):
        if sum(l * n for l, n in items.items()) == capacity and all(left[l] >= n for l, n in items.items()):
            take(items, 1)
    open_bins: dict[int, list[list[int]]] = {}  # by room left
    for length in sorted((l for l, n in left.items() for _ in range(n)), reverse=True):
        room = next((r for r in range(length, capacity) if open_bins.get(r)), None)
        bin_ = open_bins[room].pop() if room is not None else []
        bin_.append(length)
        after = (capacity if room is None else room) - length
        if after:
            open_bins.setdefault(after, []).append(bin_)
        else:
            kept.append(Pattern(tuple((l, bin_.count(l)) for l in sorted(set(bin_), reverse=True)), 1))
    return kept


@dataclass(frozen=True)
class Slot:
    """Where the items of a length with ranks ``first`` to ``last`` go.

    ``each`` of them share a sequence, at its places from ``place`` on; the sequences count up from ``sequence``.
    """

    length: int
    first: int
    last: int
    each: int
    sequence: int
    place: int


def slots_of(patterns: list[Pattern]) -> tuple[list[Slot], int]:
    """Slots of the items by rank in their length, and how many sequences there are. Higher ranks have no slot."""
    used: dict[int, int] = {}
    slots: list[Slot] = []
    sequence = 0
    for pattern in patterns:
        place = 0
        for length, n in pattern.items:
            first = used.get(length, 0)
            used[length] = first + n * pattern.copies
            slots.append(Slot(length, first, used[length] - 1, n, sequence, place))
            place += n
        sequence += pattern.copies
    return slots, sequence


def cut_line(sizes: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(item, start, size, sequence, offset) of items laid end to end and cut where a sequence is full.

    What the last sequence holds is cut into powers of two, which need no padding.
    """
    total = sum(sizes)
    ends = list(range(capacity, total + 1, capacity))
    at = total - total % capacity
    for bit in reversed(range(capacity.bit_length())):
        if total % capacity >> bit & 1:
            at += 1 << bit
            ends.append(at)
    pieces = []
    begin, current = 0, 0
    for item, length in enumerate(sizes):
        start = 0
        while start < length:
            size = min(length - start, ends[current] - begin)
            pieces.append((item, start, size, current, begin - (ends[current - 1] if current else 0)))
            start, begin = start + size, begin + size
            current += begin == ends[current]
    return pieces
