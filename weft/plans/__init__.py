"""Registered queries: QUERIES maps a name to (spark, data directory) -> DataFrame, ORACLES a name to DuckDB SQL."""

from weft.plans import files, inference, inventory, metrics, nulls, relational, sequence, streams, structure  # noqa: F401
from weft.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
