"""Registered queries: every operator on the driver tables, with its SQL twin where SQL can say it."""

from __future__ import annotations

from . import dashboard, detection, forecasting, panel, prepare, streams, windows

MODULES = (prepare, windows, dashboard, detection, panel, forecasting, streams)


def registered() -> dict:
    """name -> (query, sql or None)"""
    out = {}
    for module in MODULES:
        for name, pair in module.QUERIES.items():
            if name in out:
                raise ValueError(f"query {name} registered twice")
            out[name] = pair
    return out
