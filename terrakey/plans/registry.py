"""All queries of the engine's own operators."""

from __future__ import annotations

from terrakey.plans import alignment, coverage, evaluation, geometry, ground, matching, products, raster, registration, runs
from terrakey.plans.common import Query

_ALL = [m.query for m in (matching, ground, geometry, raster, coverage, evaluation, runs, registration, alignment, products)]
QUERIES: dict[str, Query] = {k: v for q in _ALL for k, v in q.queries.items()}
SQL: dict[str, str] = {k: v for q in _ALL for k, v in q.sql.items()}
