"""Readers and writers: edge lists, query lists, community lists, result files.

Malformed input never fails a read: lines that do not parse are left out (edges) or marked (queries).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODELS = ("flexi", "quasi", "kplex")


def parse_edges(lines: DataFrame) -> DataFrame:
    """src, dst of a table of text lines (column ``value``).

    Empty lines, lines that begin with ``#``, lines without two integers, and self-loops are left out; further tokens on a
    line are ignored. Both directions and repeats are kept; see ``canonical``.
    """
    kept = lines.where((F.length("value") > 0) & ~F.col("value").startswith("#"))
    t = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    parsed = kept.select(F.get(t, F.lit(0)).try_cast("bigint").alias("src"), F.get(t, F.lit(1)).try_cast("bigint").alias("dst"))
    return parsed.where("src is not null and dst is not null and src <> dst")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Canonical edges of a text file."""
    return canonical(parse_edges(spark.read.text(path)))


def canonical(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, as src < dst, without self-loops and nulls."""
    pair = edges.select(F.least("src", "dst").cast("bigint").alias("src"), F.greatest("src", "dst").cast("bigint").alias("dst"))
    return pair.where("src < dst").distinct()


def arcs(edges: DataFrame) -> DataFrame:
    """u, v: canonical edges in both directions."""
    return edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(edges.select(F.col("dst").alias("u"), F.col("src").alias("v")))


def empty_graph(spark: SparkSession) -> DataFrame:
    """A graph without edges."""
    return spark.createDataFrame([], "src bigint, dst bigint")


def first_appearance(edges: DataFrame, order: str) -> DataFrame:
    """id, vid: dense numbers by first line (column ``order``), then by column; for reproducing tie-breaks.

    Vertices are dealt by ranges of their place and numbered in each, after the sizes of the ranges before.
    """
    from pyspark.sql import Window

    from knotwork.sources.scratch import saved

    seen = edges.select(F.explode(F.array(F.struct(F.col(order).alias("line"), F.lit(0).alias("col"), F.col("src").alias("id")), F.struct(F.col(order).alias("line"), F.lit(1).alias("col"), F.col("dst").alias("id")))).alias("x"))
    first = seen.groupBy("x.id").agg(F.min(F.struct("x.line", "x.col")).alias("at"))
    dealt = saved(first.repartitionByRange("at").withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))  # a row for each range
    past = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("past"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("at"))
    return dealt.withColumn("place", place).join(F.broadcast(past), "part").select("id", (F.col("place") - 1 + F.col("past")).cast("bigint").alias("vid"))


def parse_queries(lines: DataFrame) -> DataFrame:
    """line, seed, model, param, restrict, ok of a table of lines (columns ``line`` and ``value``).

    A line is ``seed model param [id,id,...]``. ``ok`` is false for malformed lines and unknown models; comments
    and empty lines are left out. Tokens of the restriction that are not integers are dropped.
    """
    kept = lines.where((F.length(F.trim("value")) > 0) & ~F.col("value").startswith("#"))
    t = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    ids = F.filter(F.transform(F.split(F.get(t, F.lit(3)), ","), lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())
    out = kept.select("line", F.get(t, F.lit(0)).try_cast("bigint").alias("seed"), F.get(t, F.lit(1)).alias("model"), F.get(t, F.lit(2)).try_cast("double").alias("param"), ids.alias("restrict"))
    good = F.col("seed").isNotNull() & F.col("param").isNotNull() & F.col("model").isin(*MODELS)
    return out.withColumn("ok", F.coalesce(good, F.lit(False)))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Parsed queries of a text file; ``line`` numbers grow with position."""
    return parse_queries(spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), "value"))


def read_communities(spark: SparkSession, path: str) -> DataFrame:
    """id, community of a text file with two integers a line."""
    t = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    return spark.read.text(path).select(F.get(t, F.lit(0)).try_cast("bigint").alias("id"), F.get(t, F.lit(1)).try_cast("int").alias("community")).where("id is not null and community is not null")


def result_lines(results: DataFrame) -> DataFrame:
    """One key=value line per query: seed, model, param, size, time, valid, timeout, nodes (original ids)."""
    return results.select(
        F.format_string(
            "seed=%d model=%s param=%s size=%d time=%.6f valid=%d timeout=%d nodes=%s",
            F.col("seed"), F.col("model"), F.col("param").cast("string"), F.col("size"), F.col("time_sec"),
            F.col("valid").cast("int"), F.col("timed_out").cast("int"), F.array_join(F.col("nodes").cast("array<string>"), ","),
        ).alias("value")
    )


def saved_results(results: DataFrame) -> DataFrame:
    """Results of a batch, computed once."""
    from knotwork.sources.scratch import saved

    return saved(results)


def write_results(results: DataFrame, path: str) -> None:
    """``result_lines`` as text files."""
    result_lines(results).write.mode("overwrite").text(path)


def report_lines(result: DataFrame) -> DataFrame:
    """key=value lines of one solver result: algorithm, tau, size, time, valid, branches, nodes (original ids)."""
    keys = (("algorithm", F.col("algo")), ("tau", F.col("tau")), ("size", F.col("size")), ("time", F.col("time_sec")), ("valid", F.col("valid").cast("int")), ("branches", F.col("branches")), ("nodes", F.array_join(F.col("nodes").cast("array<string>"), ",")))
    return result.select(F.explode(F.array(*[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in keys])).alias("value"))


def human_report(result: DataFrame) -> DataFrame:
    """Lines for readers: algorithm, size, validity, time, branches and the members (original ids)."""
    rows = (("Algorithm", F.col("algo")), ("tau", F.col("tau")), ("Size", F.col("size")), ("Valid", F.when(F.col("valid"), "yes").otherwise("no")), ("Time", F.format_string("%.4f s", F.col("time_sec"))), ("Branches", F.col("branches")), ("Nodes", F.array_join(F.col("nodes").cast("array<string>"), " ")))
    return result.select(F.explode(F.array(*[F.concat(F.rpad(F.lit(k), 10, " "), F.lit(": "), v.cast("string")) for k, v in rows])).alias("value"))


def write_report(result: DataFrame, path: str) -> None:
    """``report_lines`` as text; folders are made as needed."""
    report_lines(result).coalesce(1).write.mode("overwrite").text(path)
