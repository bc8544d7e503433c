"""Every operator as a runnable query on the driver's tables, with its SQL counterpart."""

from tripstrata.catalogue import aggregates, builds, expressions, layout, quality, relations, sources, workload
from tripstrata.catalogue.base import ORACLES, QUERIES

__all__ = [
    "ORACLES",
    "QUERIES",
    "aggregates",
    "builds",
    "expressions",
    "layout",
    "quality",
    "relations",
    "sources",
    "workload",
]
