"""All queries of the library over the driver's tables, one or more for each operator, with their DuckDB SQL."""

from __future__ import annotations

from .queries import records, text  # noqa: F401 - importing registers
from .queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
