"""Batch community search: the largest set around each query's seed, for all queries at once.

Regions of all queries come from one search keyed by query; each query's induced region is solved by one task, with a
deadline; results are validated again in the whole graph. Connected models are searched by growth from the seed,
others by include and exclude.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions.thresholds import model_threshold, python_threshold
from knotwork.operators import branching, graph, kernels
from knotwork.sources.scratch import saved

SOLVED = "query_id long, size long, nodes array<long>, branches long, timed_out boolean, time_sec double, least long, connected boolean"


@dataclass(frozen=True)
class Model:
    """A threshold model: ``need(param)`` gives the function size -> least degree inside, which must not fall."""

    need: Callable[[float], Callable[[int], int]]
    connected: bool = False


#: The models that are always there; more are given by name to the functions below.
MODELS = {"flexi": Model(lambda p: python_threshold("flexi", p), True), "quasi": Model(lambda p: python_threshold("quasi", p)), "kplex": Model(lambda p: python_threshold("kplex", p))}


def regions(edges: DataFrame, queries: DataFrame, hops: int, cap: int) -> DataFrame:
    """key (query), id: the capped ball around each seed, or the restriction set where one is given (with the seed)."""
    ids = graph.vertices(edges)
    known = saved(queries.join(ids.withColumnRenamed("id", "seed"), "seed", "left_semi"))
    free = known.where("restrict is null").select(F.col("query_id").alias("key"), F.col("seed").alias("id"))
    balls = graph.capped_ball(edges, free, hops, cap).select("key", "id")
    fixed = known.where("restrict is not null").select(F.col("query_id").alias("key"), F.explode(F.array_union("restrict", F.array("seed"))).alias("id")).distinct()
    return balls.unionByName(fixed.join(ids, "id", "left_semi").select("key", "id"))


def solve_region(pairs: list[tuple[int, int]], seed: int, model: Model, param: float, timeout: float, options: kernels.SolverOptions) -> tuple[list[int], int, bool]:
    """(nodes, branches, timed_out): a largest set around ``seed`` in a region of edges; at least the seed itself."""
    ids = sorted({v for p in pairs for v in p} | {seed})
    adj, at, stop = kernels.masks_of(ids, pairs), ids.index(seed), time.monotonic() + timeout
    need = model.need(param)
    run = branching.SeededSearch(adj, need, 1 << at, 1, stop, options) if model.connected else kernels.Search(adj, need, False, 1 << at, 1, stop, options)
    run.run(1 << at, (1 << len(ids)) - 1)
    return [ids[i] for i in kernels.bits(run.best)], run.branches, run.timed_out


def _solve(timeout: float, options: kernels.SolverOptions, models: dict[str, Model]):
    def run(key, rows):
        began = time.monotonic()
        seed, model, param = rows.column("seed")[0].as_py(), rows.column("model")[0].as_py(), rows.column("param")[0].as_py()
        pairs = [(a, b) for a, b in zip(rows.column("src").to_pylist(), rows.column("dst").to_pylist(), strict=True) if a is not None]
        nodes, branches, late = solve_region(pairs, seed, models[model], param, timeout, options)
        row = {"query_id": key[0].as_py(), "size": len(nodes), "nodes": nodes, "branches": branches, "timed_out": late, "time_sec": time.monotonic() - began, "least": models[model].need(param)(len(nodes)), "connected": models[model].connected}
        return pa.Table.from_pylist([row], schema=pa.schema([("query_id", pa.int64()), ("size", pa.int64()), ("nodes", pa.list_(pa.int64())), ("branches", pa.int64()), ("timed_out", pa.bool_()), ("time_sec", pa.float64()), ("least", pa.int64()), ("connected", pa.bool_())]))

    return run


def validate_sets(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """set_id, size, min_degree, n_components, valid for ``sets`` (set_id, model, param, id), counted in the whole graph.

    Empty sets have no rows and so no result; a lone vertex is valid; only flexi sets must be connected.
    """
    members = saved(sets.select("set_id", "id").distinct())
    inner = saved(graph.keyed_induced(edges, members.withColumnRenamed("set_id", "key")))
    degree = inner.select("key", F.explode(F.array("src", "dst")).alias("id")).groupBy("key", "id").agg(F.count("*").alias("degree"))
    full = members.join(degree.withColumnRenamed("key", "set_id"), ["set_id", "id"], "left").groupBy("set_id").agg(F.count("*").alias("size"), F.min(F.coalesce("degree", F.lit(0))).alias("min_degree"))
    node = saved(members.withColumn("node", F.monotonically_increasing_id()))
    a, b = node.select(F.col("set_id").alias("key"), F.col("id").alias("src"), F.col("node").alias("a")), node.select(F.col("set_id").alias("key"), F.col("id").alias("dst"), F.col("node").alias("b"))
    links = inner.join(a, ["key", "src"]).join(b, ["key", "dst"]).select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    comp = graph.components(links)
    n_comp = node.join(comp, node["node"] == comp["id"], "left").groupBy("set_id").agg(F.count_distinct(F.coalesce("comp", "node")).alias("n_components"))
    kind = sets.select("set_id", "model", "param").distinct()
    out = full.join(n_comp, "set_id").join(kind, "set_id")
    ok = (F.col("min_degree") >= model_threshold(F.col("model"), F.col("param"), F.col("size"))) & ((F.col("model") != "flexi") | (F.col("n_components") == 1))
    return out.select("set_id", "size", F.col("min_degree").cast("bigint").alias("min_degree"), "n_components", ((F.col("size") == 1) | ok).alias("valid"))


def community_search(edges: DataFrame, queries: DataFrame, hops: int = 2, cap: int = 3000, timeout: float = 5.0, options: kernels.SolverOptions | None = None, models: dict[str, Model] | None = None) -> DataFrame:
    """query_id, seed, model, param, size, time_sec, valid, timed_out, nodes: one row per query.

    ``queries`` has query_id, seed, model, param, restrict. A seed that is not in the graph, or a model that is neither built in nor
    in ``models``, gives size 0, not valid.
    """
    models = MODELS | (models or {})
    hops, cap = max(0, hops), max(1, cap)
    if timeout <= 0:
        raise ValueError("timeout must be positive")
    edges, queries = saved(edges), saved(queries)
    area = saved(regions(edges, queries, hops, cap))
    inner = graph.keyed_induced(edges, area).withColumnRenamed("key", "query_id")
    here = queries.where(F.col("model").isin(list(models))).join(area.select(F.col("key").alias("query_id")).distinct(), "query_id", "left_semi").select("query_id", "seed", "model", "param")
    work = here.join(inner, "query_id", "left")
    solved = saved(work.groupBy("query_id").applyInArrow(_solve(timeout, options or kernels.SolverOptions(), models), SOLVED))
    sets = solved.join(queries.select("query_id", "model", "param"), "query_id").select(F.col("query_id").alias("set_id"), "model", "param", F.explode("nodes").alias("id"))
    held = validate_sets(edges, sets).select(F.col("set_id").alias("query_id"), "min_degree", "n_components")
    ok = solved.join(held, "query_id").select("query_id", ((F.col("size") == 1) | (F.col("min_degree") >= F.col("least")) & (~F.col("connected") | (F.col("n_components") == 1))).alias("valid"))
    out = queries.join(solved, "query_id", "left").join(ok, "query_id", "left")
    return out.select("query_id", "seed", "model", "param", F.coalesce("size", F.lit(0)).cast("bigint").alias("size"), F.coalesce("time_sec", F.lit(0.0)).alias("time_sec"), F.coalesce("valid", F.lit(False)).alias("valid"), F.coalesce("timed_out", F.lit(False)).alias("timed_out"), F.coalesce("nodes", F.array().cast("array<bigint>")).alias("nodes"))


def batch_counts(results: DataFrame) -> DataFrame:
    """processed, skipped: queries with an answer, and those whose seed is not in the graph."""
    return results.agg(F.count_if(F.col("size") > 0).alias("processed"), F.count_if(F.col("size") == 0).alias("skipped"))


def recovery(results: DataFrame, truth: DataFrame) -> DataFrame:
    """query_id, n_found, n_truth, n_both, precision, recall, f1 of each result against its seed's community (id, community)."""
    own = results.join(truth.select(F.col("id").alias("seed"), "community"), "seed")
    size = truth.groupBy("community").agg(F.count("*").alias("n_truth"))
    nodes = own.select("query_id", "community", F.explode("nodes").alias("id")).join(truth.select("id", F.col("community").alias("theirs")), "id", "left")
    hits = nodes.groupBy("query_id").agg(F.count("*").alias("n_found"), F.sum((F.col("theirs") == F.col("community")).cast("bigint")).alias("n_both"))
    out = own.select("query_id", "community").join(size, "community").join(hits, "query_id")
    both = F.coalesce("n_both", F.lit(0))
    p, r = both / F.col("n_found"), both / F.col("n_truth")
    return out.select("query_id", "n_found", "n_truth", both.alias("n_both"), p.alias("precision"), r.alias("recall"), F.when(both > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))
