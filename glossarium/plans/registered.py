"""All queries of the library itself: importing the modules registers theirs."""

from . import curation_queries, queries, rule_queries, store_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
