"""Registered models run at the library's settings: nothing is passed that makes them smaller."""

import pytest

from cityflux.operators import evaluation, models
from cityflux.registry import QUERIES
from cityflux.registry import models as registered
from cityflux.runs import analysis


class Asked(Exception):
    pass


@pytest.fixture()
def asked(monkeypatch):
    def tell(*args, **settings):
        raise Asked(args[3:], settings)

    monkeypatch.setattr(registered, "_prepared", lambda *_: evaluation)
    monkeypatch.setattr(registered, "_parts", lambda *_: (None, None, None))
    monkeypatch.setattr(evaluation, "drop", lambda *_: None, raising=False)
    for name in ("train", "grid_search", "cross_validate"):
        monkeypatch.setattr(models, name, tell)
    monkeypatch.setattr(analysis, "run_analysis", tell)


@pytest.mark.parametrize("name, rest", [("aqi_forest", (None,)), ("aqi_gbt", (None,)), ("traffic_forest", (None,)), ("traffic_boosted", (None,)), ("grid_search", (models.FOREST_GRID,)), ("cross_validate_classes", ()), ("analysis_run", ())])
def test_no_smaller_settings(spark, sf, asked, name, rest):
    with pytest.raises(Asked) as told:
        QUERIES[name](spark, sf)
    assert told.value.args == (rest, {})
