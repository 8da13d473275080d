"""Registered queries run the whole job of their operator."""

import inspect

from cellgrid.operators import dispersion
from cellgrid.plans.catalog import QUERIES

from conftest import SF_SMALL


def test_dispersion_query_keeps_the_default_iterations(spark, monkeypatch):
    real, seen = dispersion.dispersion_test, []
    monkeypatch.setattr(dispersion, "dispersion_test", lambda cd, **kw: seen.append(kw) or real(cd, **kw))
    assert QUERIES["d05_dispersion_test"](spark, SF_SMALL).count() == 1
    default = inspect.signature(real).parameters["iters"].default
    assert [kw.get("iters", default) for kw in seen] == [default] == [10000]
