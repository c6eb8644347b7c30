"""The engine's queries on the driver's tables, and their DuckDB SQL."""

from . import control, evaluation, graph, ingest, retrieval  # noqa: F401  each module registers its queries
from .workload import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
