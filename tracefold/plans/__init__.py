"""Registered queries: each operator run over the given tables, with its SQL twin."""

from tracefold.plans.registry import ORACLES, QUERIES

from tracefold.plans import (  # noqa: F401  (importing registers the queries)
    contracts, fanin, flagship, lineage, live, nodes, outcomes, privacy, replay, sources, verify,
)

__all__ = ["ORACLES", "QUERIES"]
