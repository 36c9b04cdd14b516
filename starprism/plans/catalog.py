"""The queries that ``__spark_entry__`` registers, with their SQL for the oracle."""

from __future__ import annotations

from starprism.plans import cubes, relational

QUERIES = relational.QUERIES | cubes.QUERIES
ORACLES = relational.ORACLES | cubes.ORACLES
