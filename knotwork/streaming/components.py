"""Components of a growing edge stream, an extension: windows of events become edges, edges merge labels.

The state is a table of (id, comp), written anew as a version for each batch under a folder; the version before the last is
removed. A batch's edges are contracted to links between labels; only those links are searched for components, and
a replay of a batch after a failure gives the same state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.operators.graph import components
from knotwork.sources.edges import canonical
from knotwork.sources.scratch import saved


def co_occurrence(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """window, user_id, n: who was seen in each window of an event stream (ts, user_id), with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("window"), "user_id").agg(F.count("*").alias("n"))


def co_occurrence_edges(seen: DataFrame, least: int = 2) -> DataFrame:
    """src, dst of users seen together in at least ``least`` windows, from finished windows (window, user_id).

    Users are linked with the window's least user and not with each other, so a window of many users gives as many rows.
    """
    first = seen.groupBy("window").agg(F.min("user_id").alias("src"))
    pairs = seen.join(first, "window").where("user_id <> src").groupBy("src", F.col("user_id").alias("dst")).agg(F.count("*").alias("n"))
    return pairs.where(F.col("n") >= least).select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"))


def merge_labels(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """id, comp after ``edges`` (src, dst) joined the components of ``labels``."""
    if labels is None:
        return components(canonical(edges))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    known = saved(ends.join(labels, "id", "left").select("id", F.coalesce("comp", "id").alias("comp")))
    a, b = known.select(F.col("id").alias("src"), F.col("comp").alias("a")), known.select(F.col("id").alias("dst"), F.col("comp").alias("b"))
    links = canonical(edges.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    new = saved(components(links)).select(F.col("id").alias("comp"), F.col("comp").alias("new"))
    rows = labels.unionByName(known.join(labels.select("id"), "id", "left_anti").select("id", "comp"))
    return rows.join(new, "comp", "left").select("id", F.coalesce("new", "comp").alias("comp"))


def track_components(stream: DataFrame, folder: str, checkpoint: str):
    """Start a query that keeps ``folder``/v=<batch> up to date with the components of all edges so far."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        past = spark.read.parquet(f"{folder}/v={batch_id - 1}") if batch_id else None
        merge_labels(past, batch).write.mode("overwrite").parquet(f"{folder}/v={batch_id}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v={batch_id - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
