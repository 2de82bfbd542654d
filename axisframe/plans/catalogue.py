"""All registered queries: QUERIES by name, and SQL for those that SQL expresses."""

from . import absent, aggregates, elementwise, jobs, members, products, shapes, spread
from .common import QUERIES, SQL

GROUPS = (elementwise, shapes, aggregates, jobs, members, absent, products, spread)

__all__ = ["GROUPS", "QUERIES", "SQL"]
