"""Reading of input tables, names that cannot clash, and the shared-storage tables of the core."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.sources.scratch import discard
from knotwork.sources.scratch import saved as materialize

__all__ = ["discard", "guarded", "materialize", "table"]


def guarded(docs: DataFrame):
    """(rows, restore): ``docs`` under names that cannot clash with an operator's own, and the way back.

    ``rows`` has id (never null), text, th (hash of the text) and the columns c0, c1, ...; ``restore`` takes a
    table with the latter, and columns to put in place of some.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = F.col(f"c{names.index('text')}").cast("string")
    rows = plain.withColumns({"id": F.coalesce(F.col(f"c{names.index('doc_id')}").cast("bigint"), F.lit(-(2**63))), "text": text, "th": F.xxhash64(F.coalesce(text, F.lit("")))})

    def restore(kept: DataFrame, **new: Column) -> DataFrame:
        return kept.select(*[new.get(name, F.col(f"c{i}")).alias(name) for i, name in enumerate(names)], *[c.alias(name) for name, c in new.items() if name not in names])

    return rows, restore


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
