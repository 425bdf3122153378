"""Connected components of a table of links between classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.operators import graph


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of ``links`` (a, b: long, unequal, any order); ``root`` is the least node reachable."""
    return graph.components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")), small=False).withColumnsRenamed({"id": "node", "comp": "root"})
