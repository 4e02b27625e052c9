"""Queries over the driver's tables and the SQL that they are compared with."""

from __future__ import annotations

from graftline.plans import domain_queries, graph_queries, scalar_queries

QUERIES = {**scalar_queries.QUERIES, **graph_queries.QUERIES, **domain_queries.QUERIES}
ORACLE = {**scalar_queries.ORACLE, **graph_queries.ORACLE, **domain_queries.ORACLE}
