"""Queries over the driver's tables, each with the SQL that it equals where SQL can express it."""

from __future__ import annotations

from brindle.plans import axes, fits, graphs, layouts, links, scores, similar, stats
from brindle.plans.base import Query

MODULES = (axes, stats, similar, graphs, scores, links, fits, layouts)


def queries() -> dict[str, Query]:
    return {name: f for m in MODULES for name, f in m.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in MODULES for name, s in m.R.oracles.items()}
