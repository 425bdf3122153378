"""A table function for SQL: ``solve_region(TABLE(rows) PARTITION BY query_id)``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from knotwork.operators.community import MODELS, solve_region
from knotwork.operators.kernels import SolverOptions


class SolveRegion:
    """The largest set around the seed of each partition; rows have query_id, seed, model, param, src, dst (null without edges)."""

    def __init__(self):
        self.asked, self.pairs = None, []

    def eval(self, row):
        """One edge of the region."""
        self.asked = (row["query_id"], row["seed"], row["model"], row["param"])
        if row["src"] is not None:
            self.pairs.append((row["src"], row["dst"]))

    def terminate(self):
        """The result row."""
        if self.asked:
            query, seed, model, param = self.asked
            nodes, branches, late = solve_region(self.pairs, seed, MODELS[model], param, 5.0, SolverOptions())
            yield query, len(nodes), nodes, branches, late


def register(spark: SparkSession, name: str = "solve_region") -> None:
    """Make the function known to SQL."""
    spark.udtf.register(name, udtf(SolveRegion, returnType="query_id long, size long, nodes array<long>, branches long, timed_out boolean"))
