"""All queries over the reference's operators, with their DuckDB SQL."""

from foliant.plans import cleaning_queries, control_queries, reading_queries, stream_queries, table_queries  # noqa: F401  add their queries
from foliant.plans.queries import ORACLES, QUERIES, flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
