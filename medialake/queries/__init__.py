"""The registered queries over the given tables, each beside the SQL that it equals."""

from __future__ import annotations

import importlib

_MODULES: tuple[str, ...] = ("projections", "scans", "containers", "waves", "aggregates", "balancing", "matching", "renaming", "rankings", "signals", "long_signals", "clustering", "integrity", "outputs")


def all_queries() -> dict:
    out: dict = {}
    for name in _MODULES:
        out |= importlib.import_module(f".{name}", __name__).QUERIES
    return out


def all_sql() -> dict[str, str]:
    out: dict = {}
    for name in _MODULES:
        out |= importlib.import_module(f".{name}", __name__).SQL
    return out


def flagship(spark, sf_dir: str):
    """Every facet of the inventory with counts, shares and peaks, from one expansion and one aggregation."""
    from ..operators.facets import facets, with_share
    from .fixtures import units

    return with_share(facets(units(spark, sf_dir)), ["facet"])
