"""Whole builds, and the queries that the driver runs."""

from __future__ import annotations

from termgraph.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    from termgraph.plans import eval_queries, fixture_queries, graph_queries, source_queries  # noqa: F401 (they register themselves)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
