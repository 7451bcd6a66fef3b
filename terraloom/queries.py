"""Registered queries: name -> function of session and data folder, with the DuckDB SQL of each."""

from __future__ import annotations

from terraloom.plans import q_cover, q_grid, q_joins, q_raster, q_sources, q_text, q_whole  # noqa: F401  (they register their queries)
from terraloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
