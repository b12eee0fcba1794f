"""All queries over the driver's tables and their SQL twins."""

from leafwork.plans import geometry_queries, journal_queries, layout_queries, order_queries, scalar_queries

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _module in (layout_queries, geometry_queries, scalar_queries, order_queries, journal_queries):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
