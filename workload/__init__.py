"""Registered queries over the generated tables, each next to its SQL check."""

from workload import (  # noqa: F401  (imported to register their queries)
    composite_queries,
    field_queries,
    form_queries,
    link_queries,
    panel_queries,
    rate_queries,
    reshape_queries,
    source_queries,
)
from workload.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
