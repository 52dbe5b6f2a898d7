"""All named queries, by topic."""

from __future__ import annotations

from jobledger.plans import (  # noqa: F401  (imported to register their queries)
    q_cube, q_files, q_lifecycle, q_lineage, q_nested, q_quality, q_ranking, q_rollup, q_scalar,
    q_search, q_stats, q_streams, q_userjobs,
)
from jobledger.plans.q_rollup import flagship  # noqa: F401
from jobledger.plans.registry import CHECKS, QUERIES  # noqa: F401
