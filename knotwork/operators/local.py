"""Graphs that fit one task: brought to the driver once, bounded by ``KERNEL_EDGES``, and worked on by one executor task."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from knotwork.operators.peeling import Neighbours

#: Edges that may be shipped to a task (16 bytes each).
KERNEL_EDGES = 200_000


def small_pairs(edges: DataFrame) -> list[tuple[int, int]] | None:
    """All edges (src, dst) if they are at most KERNEL_EDGES, else None."""
    rows = edges.select("src", "dst").limit(KERNEL_EDGES + 1).toArrow()
    return list(zip(rows.column("src").to_pylist(), rows.column("dst").to_pylist(), strict=True)) if rows.num_rows <= KERNEL_EDGES else None


def task_table(spark: SparkSession, work: Callable[[], list[dict]], schema: str) -> DataFrame:
    """The rows that ``work`` returns, as a table that one task makes."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    types = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pylist(work(), schema=types)

    return spark.range(1, numPartitions=1).mapInArrow(run, schema)


def in_task(spark: SparkSession, pairs: list[tuple[int, int]], work: Callable[[Neighbours], list[dict]], schema: str) -> list:
    """The rows of ``work(graph)`` on a graph that fits a task."""
    return task_table(spark, lambda: work(Neighbours(pairs)), schema).collect()


def group_pairs(rows: pa.Table) -> list[tuple[int, int]]:
    """The edges of an Arrow group."""
    return list(zip(rows.column("src").to_pylist(), rows.column("dst").to_pylist(), strict=True))
