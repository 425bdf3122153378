"""Registry of the engine's queries and their DuckDB oracles."""

from __future__ import annotations

from knotwork.operators import solvers
from knotwork.plans import graph_queries
from knotwork.sources.views import nation


def flagship(spark, sf_dir):
    """The largest flexi-clique of the nation trade graph: size, valid, nodes."""
    return solvers.max_subgraph(nation(spark, sf_dir), 0.8, "ebac").select("size", "valid", "nodes")


def queries():
    """Name -> callable(spark, sf_dir) of each graph query."""
    return dict(graph_queries.QUERIES)


def oracle_sql():
    """Name -> DuckDB SQL with the same rows."""
    return dict(graph_queries.ORACLES)
