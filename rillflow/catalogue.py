"""All queries of the library (but those of the optional corpus package) and their DuckDB counterparts."""

from __future__ import annotations

from . import registry
from .functions import control, web  # noqa: F401  importing registers their queries
from .operators import event_log, folds, graph, invocations, tasks  # noqa: F401
from .streaming import fold  # noqa: F401


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
