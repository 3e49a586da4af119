"""Queries that fit a model of the registry as it is, with nothing left out."""

from __future__ import annotations

import pytest

from pulsegrid.checks import models
from pulsegrid.checks.common import CHECKS
from pulsegrid.models import registry
from pulsegrid.models.search import DEFAULT_GRID, GridSearchedTrees


def made_by(query, monkeypatch):
    """The estimator that the query fits."""

    class Made(Exception):
        pass

    def watched(name, **settings):
        raise Made(registry.make_model(name, **settings))

    monkeypatch.setattr(models, "make_model", watched)
    monkeypatch.setattr(models, "_frame", lambda spark, sf: None)
    with pytest.raises(Made) as found:
        CHECKS[query].run(None, "")
    return found.value.args[0]


def test_absolute_fit_has_all_rounds(monkeypatch):
    made = made_by("fit_boost_absolute", monkeypatch)
    assert made.rounds == 400 and made._settings() == registry.make_model("hgb_mae")._settings()


def test_tolerance_blend_has_both_bases_whole(monkeypatch):
    made = made_by("fit_tolerance_blend", monkeypatch)
    poisson, search = (make() for make in made.makers)
    assert poisson.rounds == 1800 and poisson._settings() == registry.make_model("lgbm_poisson_log1p")._settings()
    assert isinstance(search, GridSearchedTrees) and not search.prune
    assert (search.grid, search.folds, made.folds, made.k, len(made.alphas)) == (DEFAULT_GRID, 5, 3, 50, 7)
