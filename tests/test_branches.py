"""Branches of a forest that a task grows from the rows at hand."""

from __future__ import annotations

import numpy as np
import pytest

from pulsegrid.models import forest
from pulsegrid.models.growth import Limits


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    bins = np.stack([rng.integers(0, n, 900) for n in (200, 3, 30)]).astype(np.uint8)
    return bins, rng.random(900) * 50 + bins[2], rng.poisson(1, 900) + 1.0


def test_small_nodes_of_a_level_are_split_together(rows, monkeypatch):
    calls = []
    splits = forest._small_splits
    monkeypatch.setattr(forest, "_small_splits", lambda *how: calls.append(how) or splits(*how))
    nodes = list(forest.grow_branch(*rows, 1, 0, Limits(None, None, 1)))
    assert sum(feature >= 0 for _, feature, _, _ in nodes) > 500 and len(calls) <= 30


@pytest.mark.parametrize("limits", [Limits(None, None, 5), Limits(None, 4, 1)])
def test_many_or_few_rows_make_no_difference(rows, monkeypatch, limits):
    found = []
    for many in (0, 150, 1000):
        monkeypatch.setattr(forest, "_MANY", many)
        found.append(sorted(forest.grow_branch(*rows, 3, 1, limits)))
    for other in found[1:]:
        assert [n[:3] for n in other] == [n[:3] for n in found[0]]
        assert [n[3] for n in other] == pytest.approx([n[3] for n in found[0]])
