"""The model queries fit what the library's operators fit by default."""

import inspect
from types import SimpleNamespace

import pytest

from tablelab import catalog
from tablelab.catalog import modelling
from tablelab.operators import models, sensitivity


class Called(Exception):
    pass


def arguments(monkeypatch, module, name, run):
    signature = inspect.signature(getattr(module, name))

    def spy(*args, **named):
        bound = signature.bind(*args, **named)
        bound.apply_defaults()
        raise Called(bound.arguments)

    monkeypatch.setattr(module, name, spy)
    monkeypatch.setattr(modelling, "view", lambda *_: None)
    with pytest.raises(Called) as raised:
        run(SimpleNamespace(sparkContext=SimpleNamespace(applicationId="none")), "none")
    return raised.value.args[0]


@pytest.mark.parametrize("name,grid", [("t4_gbt", models.GBT_GRID), ("t5_tree", models.TREE_GRID), ("t6_grid", models.TREE_GRID), ("t8_label_models", models.TREE_GRID), ("t14_compare", models.GBT_GRID)])
def test_searches_take_the_whole_grid(monkeypatch, name, grid):
    found = arguments(monkeypatch, models, "train", catalog.QUERIES[name])
    assert found["grid"] == grid and found["k"] == 5


@pytest.mark.parametrize("query,name", [("n3_ablation", "ablation"), ("n5_cv", "repeated_cv")])
def test_refits_take_the_default_model(monkeypatch, query, name):
    found = arguments(monkeypatch, sensitivity, name, catalog.QUERIES[query])
    assert found["params"] is None and found["k"] == 5
