"""Typed causal logs on Spark: contracts, an append-only log, and operators over it."""

import sys

from pyspark import cloudpickle

from tracefold.contract import FAIL, PASS, UNIT, ContractError, Edge, Field, Many, Relation

__all__ = ["ContractError", "Edge", "FAIL", "Field", "Many", "PASS", "Relation", "UNIT"]

# Python bodies travel to the workers by value: a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
