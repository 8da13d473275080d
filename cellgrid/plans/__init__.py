"""Ordered chains of steps (P11) and the fixture datasets used by queries."""

from __future__ import annotations

from cellgrid.data import CellData


def run(cd: CellData, steps: list) -> CellData:
    """Apply ``[(method_name, kwargs), ...]`` in the order given.

    ``select ... describe`` differs from ``describe ... select``: each step sees
    the dataset the previous one produced.
    """
    for name, kwargs in steps:
        fn = getattr(cd, name)
        out = fn(**(kwargs or {}))
        if isinstance(out, CellData):
            cd = out
    return cd
