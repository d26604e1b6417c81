"""All registered queries and the DuckDB SQL that defines each of them."""

from . import graph_queries, match_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
