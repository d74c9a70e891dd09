"""Ready-made queries: each applies operators to the driver's tables."""

from . import catalog, evaluation, history, risk, trading, validation  # noqa: F401
from .registry import QUERIES, SQL, query

__all__ = ["QUERIES", "SQL", "query"]
