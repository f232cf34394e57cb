"""All queries of the engine: importing this module registers them."""

from . import decisions, files, groups, joins, marked, queries, texts  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
