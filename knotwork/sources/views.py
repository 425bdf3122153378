"""Graphs derived from the test tables, as DataFrames, and the same as DuckDB SQL (columns a, b)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.sources.edges import canonical


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that trade more than the average pair of differing nations does."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).where("c_nationkey <> s_nationkey")
    w = pairs.groupBy(F.least("c_nationkey", "s_nationkey").alias("src"), F.greatest("c_nationkey", "s_nationkey").alias("dst")).agg(F.count("*").alias("w"))
    return canonical(w.crossJoin(F.broadcast(w.agg(F.avg("w").alias("mean")))).where("w > mean"))  # one row on the right


def supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that share more orders than the mean plus one deviation. An order has few suppliers, so pairs are bounded."""
    own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s")).distinct()
    pairs = own.join(own.select("o", F.col("s").alias("t")), "o").where("s < t").groupBy(F.col("s").alias("src"), F.col("t").alias("dst")).agg(F.count("*").alias("w"))
    cut = pairs.agg((F.avg("w") + F.stddev_samp("w")).alias("cut"))
    return canonical(pairs.crossJoin(F.broadcast(cut)).where("w > cut"))  # one row on the right


def user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users seen together in two or more buckets of five minutes."""
    own = table(spark, sf_dir, "events").select(F.col("user_id").alias("u"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 300).alias("k")).distinct()
    pairs = own.join(own.select("k", F.col("u").alias("t")), "k").where("u < t").groupBy(F.col("u").alias("src"), F.col("t").alias("dst")).agg(F.count("*").alias("w"))
    return canonical(pairs.where("w >= 2"))


VIEWS = {"nation": nation, "supplier": supplier, "user": user}

_NATION_SQL = """select a::bigint a, b::bigint b from (select *, avg(w) over () m from (select least(c_nationkey, s_nationkey) a, greatest(c_nationkey, s_nationkey) b, count(*) w
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey where c_nationkey <> s_nationkey group by 1, 2)) where w > m"""
SQL = {
    "nation": _NATION_SQL,
    "supplier": """select a, b from (select *, avg(w) over () + stddev_samp(w) over () m from (select x.s a, y.s b, count(*) w from (select distinct l_orderkey o, l_suppkey s from lineitem) x
  join (select distinct l_orderkey o, l_suppkey s from lineitem) y on x.o = y.o and x.s < y.s group by 1, 2)) where w > m""",
    "user": """select a, b from (select x.u a, y.u b, count(*) w from (select distinct user_id u, floor(epoch(ts) / 300)::bigint k from events) x
  join (select distinct user_id u, floor(epoch(ts) / 300)::bigint k from events) y on x.k = y.k and x.u < y.u group by 1, 2) where w >= 2""",
}
