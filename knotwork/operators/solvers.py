"""Global solvers: peeling heuristics and exact search for the largest set under a threshold model.

A graph of at most ``KERNEL_EDGES`` edges is brought to the driver once and shipped to tasks: one task for the sequential
work (peeling, order), then a fan-out of the search over root seeds. Larger graphs are reduced by DataFrame jobs (cores,
components, peeling in rounds) until a part fits a task; what does not is searched in balls around each seed. No whole graph and
no component of unknown size goes to one task.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions.thresholds import check_tau, python_threshold
from knotwork.operators import branching, graph, kernels, local, peeling
from knotwork.operators.kernels import SolverOptions
from knotwork.operators.local import group_pairs, in_task, small_pairs
from knotwork.sources.edges import arcs
from knotwork.sources.scratch import saved

#: Vertices of a seed's scope that are searched on bit sets (n * n / 8 bytes); a larger scope counts as not searched.
MASK_VERTICES = 20_000
#: Root seeds of the first wave; later waves double.
WAVE = 64

RESULT = "algo string, tau double, size long, valid boolean, timed_out boolean, branches long, conn_checks long, time_sec double, nodes array<long>"
_FOUND = "nodes array<long>, late boolean"
_SEARCHED = "nodes array<long>, branches long, checks long, late boolean, trace array<struct<depth:int,width:int,n:long>>"


def _result(spark: SparkSession, algo: str, tau: float, nodes: list[int], valid: bool, began: float, branches=0, checks=0, timed_out=False) -> DataFrame:
    return spark.createDataFrame([(algo, float(tau), len(nodes), valid, timed_out, branches, checks, time.monotonic() - began, sorted(nodes))], RESULT)


def _named(g: peeling.Neighbours, members) -> list[int]:
    return sorted(g.ids[v] for v in members)


def check_set(edges: DataFrame, nodes: list[int], tau: float, need: Callable[[int], int] | None = None) -> bool:
    """Whether the nodes are a connected set with the degrees that its size asks for, counted in the graph itself."""
    if len(nodes) < 2:
        return bool(nodes)
    need = need or python_threshold("flexi", tau)
    members = edges.sparkSession.createDataFrame([(v,) for v in nodes], "id long")
    inner = saved(graph.induced(edges, members))
    if (pairs := small_pairs(inner)) is not None:
        g = peeling.Neighbours(pairs)
        return len(g) == len(nodes) and g.feasible(range(len(g)), need)
    least = graph.subset_degrees(inner, members).agg(F.min("degree")).first()[0]
    return least >= need(len(nodes)) and bool(graph.is_connected(inner, members).first()[0])


# ---- heuristics
def _level_edges(edges: DataFrame, core: DataFrame, k: int) -> DataFrame:
    return graph.induced(edges, core.where(F.col("core") >= k).select("id"))


def _large_scope(edges: DataFrame, need: Callable[[int], int], lower_fallback: bool) -> tuple[DataFrame, DataFrame | None]:
    """(edges of the scope, vertices of the seed or None), as ``peeling.seed_and_scope``, by jobs.

    The largest component shrinks as the level grows, so the least level that qualifies is found by halving.
    """
    core = saved(graph.core_numbers(edges))
    top = core.agg(F.max("core")).first()[0]
    lo, hi, seed = 2, top + 1, None
    while lo < hi:
        k = (lo + hi) // 2
        part = saved(graph.largest_component(_level_edges(edges, core, k)))
        if need(part.count()) <= k:
            hi, seed = k, part
        else:
            lo = k + 1
    if seed is None and not lower_fallback:
        return saved(_level_edges(edges, core, top - 1)), None
    if seed is None:
        seed, hi = saved(graph.largest_component(_level_edges(edges, core, top))), 1
    around = saved(_level_edges(edges, core, hi - 1))
    comp = saved(graph.components(around))
    own = comp.join(seed, "id", "left_semi").select("comp").limit(1)
    return saved(graph.induced(around, comp.join(F.broadcast(own), "comp", "left_semi").select("id"))), seed  # one row


def _large_peel(edges: DataFrame, need: Callable[[int], int], kernel: Callable, floor: int = 0) -> tuple[list[int], bool]:
    """(nodes, late): rounds that drop the lower half of the missing degrees and keep the largest component, until what is
    left is feasible or fits ``kernel``, a function of a graph in a task."""
    now = saved(edges)
    while not now.isEmpty():
        if (pairs := small_pairs(now)) is not None:
            row = in_task(now.sparkSession, pairs, kernel, _FOUND)[0]
            return list(row["nodes"]), row["late"]
        main = saved(graph.induced(now, graph.largest_component(now)))
        degree = saved(graph.degrees(main))
        n, low = degree.agg(F.count("*"), F.min("degree")).first()
        if n <= floor:
            break
        if low >= need(n):
            return [r["id"] for r in degree.select("id").collect()], False  # the result itself
        now = saved(graph.induced(main, degree.where(F.col("degree") > low + (need(n) - 1 - low) // 2).select("id")))
    return [], False


def _heuristic(edges: DataFrame, tau: float, algo: str, timeout: float, need: Callable[[int], int] | None = None) -> tuple[list[int], bool]:
    """(nodes, late) of npa, fpa or mgpp."""
    need = need or python_threshold("flexi", tau)
    spark = edges.sparkSession

    def work(g):
        stop = time.monotonic() + timeout
        found, late = peeling.greedy(g, need, tau, deadline=stop) if algo == "mgpp" else getattr(peeling, algo)(g, need, stop)
        return [{"nodes": _named(g, found), "late": late}]

    if (pairs := small_pairs(edges)) is not None:
        row = in_task(spark, pairs, work, _FOUND)[0]
        return list(row["nodes"]), row["late"]
    edges = saved(edges)
    if algo == "mgpp":
        return _large_greedy(edges, need, tau, work, timeout)
    scope, seed = _large_scope(edges, need, algo == "npa")
    best = [r["id"] for r in seed.collect()] if algo == "fpa" and seed is not None else []  # the incumbent itself

    def rest(g):
        found, late = peeling.peel(g, set(range(len(g))), need, len(best), algo == "fpa", time.monotonic() + timeout)
        return [{"nodes": _named(g, found or ()), "late": late}]

    found, late = _large_peel(scope, need, rest, len(best))
    return (found if len(found) > len(best) else best), late


def _large_greedy(edges: DataFrame, need: Callable[[int], int], tau: float, work: Callable, timeout: float) -> tuple[list[int], bool]:
    """Components that fit a task are peeled side by side, one task each; the larger ones in rounds."""
    comp = saved(edges.join(graph.components(edges).withColumnRenamed("id", "src"), "src").select("comp", "src", "dst"))
    size = saved(comp.groupBy("comp").agg(F.count("*").alias("m")))

    def each(rows):
        found = work(peeling.Neighbours(group_pairs(rows)))
        return pa.Table.from_pylist(found, schema=pa.schema([("nodes", pa.list_(pa.int64())), ("late", pa.bool_())]))

    fits = comp.join(size.where(F.col("m") <= local.KERNEL_EDGES), "comp", "left_semi")
    found = saved(fits.groupBy("comp").applyInArrow(each, _FOUND))
    best, late = _best(found), not found.where("late").isEmpty()
    for row in size.where(F.col("m") > local.KERNEL_EDGES).orderBy(F.desc("m")).toLocalIterator():  # each has over KERNEL_EDGES edges
        got, over = _large_peel(comp.where(F.col("comp") == row["comp"]).select("src", "dst"), need, work, len(best))
        best, late = (got if len(got) > len(best) else best), late or over
    return best, late


def _best(found: DataFrame) -> list[int]:
    """The largest node set of a table of sets; of equal ones the least by its ids. One row reaches the driver."""
    row = found.where(F.size("nodes") > 0).orderBy(F.desc(F.size("nodes")), "nodes").limit(1).collect()
    return list(row[0]["nodes"]) if row else []


def npa(edges: DataFrame, tau: float, timeout: float = 300.0) -> DataFrame:
    """Peeling around the core seed, never across a cut vertex, ties to the least id."""
    began = time.monotonic()
    nodes, late = _heuristic(edges, check_tau(tau), "npa", timeout)
    return _result(edges.sparkSession, "npa", tau, nodes, check_set(edges, nodes, tau), began, timed_out=late)


def fpa(edges: DataFrame, tau: float, timeout: float = 300.0) -> DataFrame:
    """As ``npa`` with ties by arrival; a feasible core seed is the incumbent and ends the peeling at its size."""
    began = time.monotonic()
    nodes, late = _heuristic(edges, check_tau(tau), "fpa", timeout)
    return _result(edges.sparkSession, "fpa", tau, nodes, check_set(edges, nodes, tau), began, timed_out=late)


def mgpp(edges: DataFrame, tau: float, timeout: float = 300.0) -> DataFrame:
    """Greedy peeling of each component by itself, without regard to connectivity."""
    began = time.monotonic()
    nodes, late = _heuristic(edges, check_tau(tau), "mgpp", timeout)
    return _result(edges.sparkSession, "mgpp", tau, nodes, check_set(edges, nodes, tau), began, timed_out=late)


def spread_balls(edges: DataFrame, seeds: int, hops: int, cap: int) -> DataFrame:
    """key, id: the capped balls of up to ``seeds`` vertices of degree 2 or more.

    A seed is the vertex of largest degree (then least id) that no earlier seed's ball holds. A round takes the next
    vertices by that order; those in a ball of an earlier one of the round are dropped, so the seeds are those of taking
    one at a time.
    """
    spark = edges.sparkSession
    left = degree = saved(graph.degrees(edges).where("degree >= 2"))
    balls, run, batch = spark.createDataFrame([], "key long, id long"), 0, 4
    while run < seeds:
        order = [r["id"] for r in left.orderBy(F.desc("degree"), "id").limit(min(batch, seeds - run)).collect()]
        if not order:
            break
        top = spark.createDataFrame([(v, v) for v in order], "key long, id long")
        found = graph.capped_ball(edges, top, hops, cap)
        inside = {tuple(r) for r in found.join(F.broadcast(top.select("id")), "id", "left_semi").select("key", "id").collect()}  # at most seeds squared
        taken = []
        for v in order:
            if not any((u, v) in inside for u in taken):
                taken.append(v)
        balls = saved(balls.unionByName(found.where(F.col("key").isin(taken)).select("key", "id")))
        left = saved(degree.join(balls.select("id").distinct(), "id", "left_anti"))
        run, batch = run + len(taken), 2 * len(taken)
    return balls


def _multi_seed(edges: DataFrame, tau: float, seeds: int, hops: int, cap: int, timeout: float) -> tuple[list[int], bool]:
    need = python_threshold("flexi", tau)
    if (pairs := small_pairs(edges)) is not None:

        def whole(g):
            found, late = peeling.multi_seed(g, need, tau, seeds, hops, cap, time.monotonic() + timeout)
            return [{"nodes": _named(g, found), "late": late}]

        row = in_task(edges.sparkSession, pairs, whole, _FOUND)[0]
        return list(row["nodes"]), row["late"]
    edges = saved(edges)
    best, late = _heuristic(edges, tau, "fpa", timeout)
    inner = graph.keyed_induced(edges, spread_balls(edges, seeds, hops, cap))

    def each(rows):
        g = peeling.Neighbours(group_pairs(rows))
        found, over = peeling.greedy(g, need, tau, deadline=time.monotonic() + timeout)
        return pa.Table.from_pylist([{"nodes": _named(g, found), "late": over}], schema=pa.schema([("nodes", pa.list_(pa.int64())), ("late", pa.bool_())]))

    found = saved(inner.groupBy("key").applyInArrow(each, _FOUND))  # a ball has at most ``cap`` vertices
    got = _best(found)
    return (got if len(got) > len(best) else best), late or not found.where("late").isEmpty()


def multi_seed(edges: DataFrame, tau: float, seeds: int = 40, hops: int = 2, cap: int = 5000, timeout: float = 300.0) -> DataFrame:
    """The best of ``fpa`` and greedy peeling in balls around vertices of high degree, each outside all earlier balls."""
    began = time.monotonic()
    nodes, late = _multi_seed(edges, check_tau(tau), seeds, hops, cap, timeout)
    return _result(edges.sparkSession, "multiseed", tau, nodes, check_set(edges, nodes, tau), began, timed_out=late)


# ---- exact search
def _pruned(g: peeling.Neighbours, least: int) -> list[tuple[int, int]]:
    """Edges (as ids) of the core of degree ``least``."""
    core = peeling.core_numbers(g)
    return [(g.ids[v], g.ids[w]) for v in range(len(g)) if core[v] >= least for w in g.near[v] if v < w and core[w] >= least]


def _prepared(pairs: list[tuple[int, int]], need: Callable[[int], int], tau: float, options: SolverOptions, timeout: float):
    """A task that makes the warm start and says which vertices are left, in the order in which seeds are taken."""

    def work(g):
        stop, best = time.monotonic() + timeout, list(pairs[0]) if pairs else []
        if options.warm_start and pairs:
            for found, _ in (peeling.multi_seed(g, need, tau, deadline=stop), peeling.npa(g, need, stop)):
                if len(found) > len(best) and g.feasible(found, need):
                    best = _named(g, found)
            left = peeling.Neighbours(_pruned(g, need(len(best) + 1)) if options.degree_rule else pairs)
            found, _ = peeling.greedy(left, need, tau, deadline=stop)
            if len(found) > len(best) and left.feasible(found, need):
                best = _named(left, found)
        left = peeling.Neighbours(_pruned(g, need(len(best) + 1)) if options.degree_rule else pairs)
        return [{"best": best, "order": [left.ids[v] for v in peeling.degeneracy_order(left)[0]]}]

    return work


def search_seed(g: peeling.Neighbours, rank: list[int], seed: int, need: Callable[[int], int], floor: int, deadline: float, options: SolverOptions) -> tuple[branching.PrefixSearch | None, list[int]]:
    """(search, its vertices): all sets of over ``floor`` vertices whose least-ranked one is ``seed``; None if the scope is too large for bit sets."""
    scope = {seed}
    front, hops = [seed], kernels.radius_bound(len(g), need, floor + 1) if options.diameter_rule else len(g)
    while front and hops:
        front = sorted({w for v in front for w in g.near[v] if rank[w] > rank[seed] and w not in scope})
        scope.update(front)
        hops -= 1
    least = need(floor + 1) if options.degree_rule else 0
    weak = [v for v in scope if sum(w in scope for w in g.near[v]) < least]
    while weak and seed in scope:
        v = weak.pop()
        if v in scope:
            scope.remove(v)
            weak += [w for w in g.near[v] if w in scope and sum(x in scope for x in g.near[w]) < least]
    if seed not in scope or len(scope) <= floor:
        return branching.PrefixSearch([], need, 0, floor), []
    if len(scope) > MASK_VERTICES:
        return None, []
    own = sorted(scope)
    at = {v: i for i, v in enumerate(own)}
    adj = [sum(1 << at[w] for w in g.near[v] if w in scope) for v in own]
    run = branching.PrefixSearch(adj, need, 0, floor, deadline, options)
    run.run(1 << at[seed], (1 << len(own)) - 1)
    return run, own


def _row(g: peeling.Neighbours, run, own: list[int]) -> dict:
    if run is None:
        return {"nodes": [], "branches": 0, "checks": 0, "late": True, "trace": []}
    return {"nodes": [g.ids[own[i]] for i in kernels.bits(run.best)], "branches": run.branches, "checks": run.checks, "late": run.timed_out, "trace": [{"depth": d, "width": w, "n": n} for (d, w), n in run.trace.items()]}


_ROWS = pa.schema([("nodes", pa.list_(pa.int64())), ("branches", pa.int64()), ("checks", pa.int64()), ("late", pa.bool_()), ("trace", pa.list_(pa.struct([("depth", pa.int32()), ("width", pa.int32()), ("n", pa.int64())])))])


def _waves(spark: SparkSession, pairs, order: list[int], best: list[int], need, options: SolverOptions, stop: float, trace: Counter) -> tuple[list[int], int, int, bool]:
    """(nodes, branches, checks, late) of the search over all seeds, in waves that start from the best so far."""
    keep = set(order)
    shared = spark.sparkContext.broadcast(([p for p in pairs if p[0] in keep and p[1] in keep], order))  # at most KERNEL_EDGES
    place, wave, branches, checks, late = 0, WAVE, 0, 0, False
    while place < len(order) and not late:
        seeds = spark.range(place, min(len(order), place + wave), numPartitions=min(wave, 2 * spark.sparkContext.defaultParallelism))

        def work(batches, floor=len(best), left_s=max(0.0, stop - time.monotonic())):
            pairs, order = shared.value
            g, size, deadline = peeling.Neighbours(pairs), floor, time.monotonic() + left_s
            rank = [0] * len(g)
            for i, v in enumerate(order):
                if v in g.at:  # a vertex whose neighbours all went is alone
                    rank[g.at[v]] = i
            for batch in batches:
                for i in batch.column("id").to_pylist():
                    if order[i] in g.at:
                        run, own = search_seed(g, rank, g.at[order[i]], need, size, deadline, options)
                        size = max(size, run.best_size if run else 0)
                        yield pa.RecordBatch.from_pylist([_row(g, run, own)], schema=_ROWS)

        for row in seeds.mapInArrow(work, _SEARCHED).collect():  # a row for each of at most a wave's seeds
            best = list(row["nodes"]) if len(row["nodes"]) > len(best) else best
            branches, checks, late = branches + row["branches"], checks + row["checks"], late or row["late"]
            trace.update({(t["depth"], t["width"]): t["n"] for t in row["trace"]})
        place, wave = place + wave, wave * 2
    shared.unpersist()
    return best, branches, checks, late


def _large_search(rest: DataFrame, best: list[int], need, options: SolverOptions, timeout: float, trace: Counter) -> tuple[list[int], int, int, bool]:
    """The search in a graph that fits no task: each seed's ball among the vertices after it is one."""
    rank = saved(graph.core_numbers(rest))
    both = arcs(rest).join(rank.select(F.col("id").alias("u"), F.struct("core", "id").alias("ru")), "u").join(rank.select(F.col("id").alias("v"), F.struct("core", "id").alias("rv")), "v")
    n, floor = rank.count(), len(best)
    hops = kernels.radius_bound(n, need, floor + 1) if options.diameter_rule else n
    later = saved(both.select("u", "v", "ru", "rv"))
    seeds = rank.select(F.col("id").alias("key"), "id", F.struct("core", "id").alias("rk"))
    seen = saved(seeds.withColumn("hop", F.lit(0)))
    for h in range(hops):
        step = seen.where(F.col("hop") == h).join(later, F.col("id") == F.col("u")).where("rv > rk").select("key", F.col("v").alias("id"), "rk").distinct()
        fresh = saved(step.join(seen.select("key", "id"), ["key", "id"], "left_anti").withColumn("hop", F.lit(h + 1)))
        if fresh.isEmpty():
            break
        seen = saved(seen.unionByName(fresh))
    big = seen.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > floor)
    over = not big.where(F.col("n") > MASK_VERTICES).isEmpty()
    balls = seen.join(big.where(F.col("n") <= MASK_VERTICES).select("key"), "key", "left_semi").select("key", "id")
    inner = graph.keyed_induced(rest, balls)

    def each(key, rows):
        g = peeling.Neighbours(group_pairs(rows))
        seed = key[0].as_py()
        if seed not in g.at:
            return pa.Table.from_pylist([], schema=_ROWS)
        order = [1] * len(g)
        order[g.at[seed]] = 0
        return pa.Table.from_pylist([_row(g, *search_seed(g, order, g.at[seed], need, floor, time.monotonic() + timeout, options))], schema=_ROWS)

    found = saved(inner.groupBy("key").applyInArrow(each, _SEARCHED))
    got = _best(found)
    branches, checks, late = found.agg(F.coalesce(F.sum("branches"), F.lit(0)), F.coalesce(F.sum("checks"), F.lit(0)), F.coalesce(F.max("late"), F.lit(False))).first()
    for row in found.select(F.explode("trace").alias("t")).groupBy("t.depth", "t.width").agg(F.sum("t.n").alias("n")).collect():
        trace[row["depth"], row["width"]] += row["n"]
    return (got if len(got) > len(best) else best), branches, checks, over or late


def _exact(edges: DataFrame, tau: float, options: SolverOptions, timeout: float, need: Callable[[int], int]) -> tuple[list[int], int, int, bool, Counter]:
    spark, stop, trace = edges.sparkSession, time.monotonic() + timeout, Counter()
    pairs = small_pairs(edges)
    if pairs is None:
        edges = saved(edges)
        best = list(edges.select("src", "dst").first())
        if options.warm_start:
            for nodes, _ in (_multi_seed(edges, tau, 40, 2, 5000, timeout), _heuristic(edges, tau, "npa", timeout, need)):
                best = nodes if len(nodes) > len(best) else best
        rest = graph.k_core(edges, need(len(best) + 1)) if options.degree_rule else edges
        pairs = small_pairs(rest)
        if pairs is None:
            return (*_large_search(rest, best, need, options, timeout, trace), trace)
        options_left = SolverOptions(**{**options.__dict__, "warm_start": False})
        row = in_task(spark, pairs, _prepared(pairs, need, tau, options_left, timeout), "best array<long>, order array<long>")[0] if pairs else {"order": []}
        return (*_waves(spark, pairs, list(row["order"]), best, need, options, stop, trace), trace)
    if not pairs:
        return [], 0, 0, False, trace
    row = in_task(spark, pairs, _prepared(pairs, need, tau, options, timeout), "best array<long>, order array<long>")[0]
    return (*_waves(spark, pairs, list(row["order"]), list(row["best"]), need, options, stop, trace), trace)


def exact(edges: DataFrame, tau: float, options: SolverOptions | None = None, timeout: float = 300.0, need: Callable[[int], int] | None = None) -> DataFrame:
    """A largest flexi-clique, by search from root seeds in waves.

    After the warm start the graph is cut to the core of the next size's threshold. Seed i searches the sets whose
    least-ranked vertex it is; each wave starts from the best set so far. A set found is checked in the graph. ``need``
    puts another threshold (size -> least degree, not falling) in place of that of ``tau``.
    """
    check_tau(tau)
    began, need = time.monotonic(), need or python_threshold("flexi", tau)
    nodes, branches, checks, late, _ = _exact(edges, tau, options or SolverOptions(), timeout, need)
    return _result(edges.sparkSession, "ebac", tau, nodes, check_set(edges, nodes, tau, need), began, branches, checks, late)


def search_trace(edges: DataFrame, tau: float, options: SolverOptions | None = None, timeout: float = 300.0) -> DataFrame:
    """depth (members chosen), width (children), n (nodes) of the exact search."""
    options = SolverOptions(**{**(options or SolverOptions()).__dict__, "trace": True})
    trace = _exact(edges, check_tau(tau), options, timeout, python_threshold("flexi", tau))[-1]
    return edges.sparkSession.createDataFrame([(d, w, n) for (d, w), n in sorted(trace.items())], "depth int, width int, n long")


# ---- listings
def bitmask(edges: DataFrame, model: str, param: float, seed: int | None = None, limit: int = 22) -> DataFrame:
    """size, nodes, branches (sets listed), checks (sets tested for connection): the largest feasible set among all subsets of a
    graph of at most ``limit`` vertices, as one column plan.

    Every subset is a number; a vertex's degree in it is a bit count, so the enumeration runs in generated code and
    splits over tasks. Connected sets only for flexi. A missing seed gives 0, a lone one 1.
    """
    spark = edges.sparkSession
    pairs = [tuple(r) for r in edges.limit(limit * limit).collect()]  # bounded by the limit on vertices
    ids = sorted({v for p in pairs for v in p})
    if len(ids) > limit:
        raise ValueError(f"{len(ids)} vertices are too many to list all subsets")
    if not ids or seed is not None and seed not in ids:
        return spark.createDataFrame([(0, [], 0, 0)], _LISTED)
    adj = kernels.masks_of(ids, pairs)
    x, k = F.col("id"), F.bit_count(F.col("id"))
    need = python_threshold(model, param)
    table = F.array(*[F.lit(need(n)) for n in range(len(ids) + 1)])
    sets = spark.range(1, 1 << len(ids))
    if seed is not None:
        sets = sets.where(x.bitwiseAND(F.lit(1 << ids.index(seed))) != 0)
    sets = sets.select("id", k.cast("int").alias("k"), F.get(table, k.cast("int")).alias("need"))
    for v, mask in enumerate(adj):
        sets = sets.where((x.bitwiseAND(F.lit(1 << v)) == 0) | (F.bit_count(x.bitwiseAND(F.lit(mask))) >= F.col("need")) | (F.col("k") == 1))
    if model == "flexi":
        # reach from the lowest bit, as often as there are vertices; only feasible sets get here
        masks = F.array(*[F.struct(F.lit(1 << v).cast("bigint").alias("bit"), F.lit(m).cast("bigint").alias("near")) for v, m in enumerate(adj)])
        grow = lambda acc: F.aggregate(masks, acc, lambda a, m: F.when(a.bitwiseAND(m["bit"]) != 0, a.bitwiseOR(m["near"].bitwiseAND(x))).otherwise(a))
        all_of = F.aggregate(F.sequence(F.lit(1), F.col("k")), x.bitwiseAND(-x), lambda a, _: grow(a))
        linked = (F.col("k") - 1 <= F.col("need") * 2) | (all_of == x)  # with half of the others as neighbours, any two share one
    else:
        linked = F.lit(True)
    found = sets.agg(F.max(F.when(linked, F.struct("k", (-x).alias("id")))).alias("top"), F.count("*").alias("checks"))
    members = F.filter(F.array(*[F.when((-F.col("top.id")).bitwiseAND(F.lit(1 << v)) != 0, F.lit(i)) for v, i in enumerate(ids)]), lambda v: v.isNotNull())
    return found.select(F.coalesce("top.k", F.lit(0)).cast("bigint").alias("size"), F.coalesce(members, F.array().cast("array<bigint>")).cast("array<bigint>").alias("nodes"), F.lit(1 << len(ids)).cast("bigint").alias("branches"), F.col("checks"))


_LISTED = "size long, nodes array<long>, branches long, checks long"


def set_enumeration(edges: DataFrame, tau: float, limit: int = 60) -> DataFrame:
    """size, nodes, branches, checks: the largest flexi-clique by level-synchronous set enumeration; a level is a DataFrame of (chosen, later).

    Each round adds one later vertex to every chosen set. Only bounds prune: a member's degree in chosen and later
    must reach the threshold of a better size. Sets are masks, so graphs are of at most ``limit`` vertices.
    """
    check_tau(tau)
    spark = edges.sparkSession
    pairs = [tuple(r) for r in edges.limit(limit * limit).collect()]  # bounded by the limit on vertices
    ids = sorted({v for p in pairs for v in p})
    if len(ids) > limit:
        raise ValueError(f"{len(ids)} vertices are too many for masks")
    adj = kernels.masks_of(ids, pairs)
    need = python_threshold("flexi", tau)
    start, _ = peeling.greedy(peeling.Neighbours(pairs), need, tau)
    top, best, branches, checks = sum(1 << v for v in start), len(start), 0, 0
    near = F.array(*[F.lit(m).cast("bigint") for m in adj])
    every = F.sequence(F.lit(0), F.lit(len(ids) - 1))
    one = lambda v: F.call_function("shiftleft", F.lit(1).cast("bigint"), v)
    level = spark.range(1).select(F.lit(0).cast("bigint").alias("s"), F.lit((1 << len(ids)) - 1).cast("bigint").alias("c"))
    for k in range(1, len(ids) + 1):
        grown = level.select("s", "c", F.explode(F.filter(every, lambda v: F.col("c").bitwiseAND(one(v)) != 0)).alias("v"))
        # v is chosen, and only vertices after it stay candidates
        level = grown.select(F.col("s").bitwiseOR(one(F.col("v"))).alias("s"), F.col("c").bitwiseAND(F.bitwise_not(one(F.col("v") + 1) - 1)).alias("c"))
        both = F.col("s").bitwiseOR(F.col("c"))
        members = F.filter(every, lambda v: F.col("s").bitwiseAND(one(v)) != 0)
        least = F.lit(need(max(k, best + 1)))
        fits = F.forall(members, lambda v: F.bit_count(F.get(near, v).bitwiseAND(F.col("s").bitwiseOR(F.col("c")))) >= least)
        level = saved(level.where((F.bit_count(both) > best) & fits))
        done = F.forall(members, lambda v: F.bit_count(F.get(near, v).bitwiseAND(F.col("s"))) >= F.lit(need(k)))
        grow = lambda acc: F.aggregate(every, acc, lambda a, v: F.when(a.bitwiseAND(one(v)) != 0, a.bitwiseOR(F.get(near, v).bitwiseAND(F.col("s")))).otherwise(a))
        linked = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.col("s").bitwiseAND(-F.col("s")), lambda a, _: grow(a)) == F.col("s")
        n, tested, found = level.agg(F.count("*"), F.count_if(done), F.min(F.when(done & linked, F.col("s")))).first()
        if not n:
            break
        branches, checks = branches + n, checks + tested
        if k > best and found is not None:
            best, top = k, found
    return spark.createDataFrame([(best, [ids[v] for v in kernels.bits(top)], branches, checks)], _LISTED)


ALGORITHMS = {"npa": npa, "fpa": fpa, "mgpp": mgpp, "multiseed": multi_seed, "ebac": exact}


def max_subgraph(edges: DataFrame, tau: float = 0.9, algo: str = "ebac", **options) -> DataFrame:
    """A solver's result row: algo, tau, size, valid, timed_out, branches, conn_checks, time_sec, nodes (original ids)."""
    if algo in ("se", "naive"):
        began = time.monotonic()
        row = (set_enumeration(edges, tau, **options) if algo == "se" else bitmask(edges, "flexi", check_tau(tau), **options)).first()
        return _result(edges.sparkSession, algo, tau, list(row["nodes"]), check_set(edges, list(row["nodes"]), tau), began, row["branches"], row["checks"])
    if algo not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algo!r}; one of {', '.join([*ALGORITHMS, 'se', 'naive'])}")
    return ALGORITHMS[algo](edges, tau, **options)


# ---- cut vertices
def _skeleton(edges: DataFrame) -> DataFrame:
    """A part of the graph with the same cut vertices and at most two edges a vertex: a breadth-first forest, and one of the rest."""
    out = None
    for _ in range(2):
        roots = graph.components(edges).where("id = comp").select(F.col("comp").alias("key"), "id")
        seen = graph.bfs(edges, roots).select("id", "hop")
        both = arcs(edges).join(seen.select(F.col("id").alias("u"), F.col("hop").alias("hu")), "u").join(seen.select(F.col("id").alias("v"), F.col("hop").alias("hv")), "v")
        tree = saved(both.where("hu = hv - 1").groupBy("v").agg(F.min("u").alias("u")).select(F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")))
        out = tree if out is None else out.unionByName(tree)
        edges = saved(edges.join(tree, ["src", "dst"], "left_anti"))
    return saved(out)


def cut_vertices(edges: DataFrame) -> DataFrame:
    """id of the articulation points.

    Components that fit a task are searched side by side. A larger one is first cut to two forests, and vertices without
    two neighbours in it go; what is left of it must fit a task (``KERNEL_EDGES`` times 16), else an error is raised.
    """
    spark = edges.sparkSession

    def each(pairs):
        g = peeling.Neighbours(pairs)
        return _named(g, peeling.cut_vertices(g))

    if (pairs := small_pairs(edges)) is not None:
        return spark.createDataFrame([(v,) for v in in_task(spark, pairs, lambda g: [{"nodes": _named(g, peeling.cut_vertices(g)), "late": False}], _FOUND)[0]["nodes"]], "id long")
    comp = saved(edges.join(graph.components(edges).withColumnRenamed("id", "src"), "src").select("comp", "src", "dst"))
    size = saved(comp.groupBy("comp").agg(F.count("*").alias("m")))
    large = size.where(F.col("m") > local.KERNEL_EDGES)
    if not large.isEmpty():
        thin = _skeleton(comp.join(large, "comp", "left_semi").select("src", "dst"))
        thin = thin.join(graph.components(thin).withColumnRenamed("id", "src"), "src").select("comp", "src", "dst")
        comp = saved(comp.join(large, "comp", "left_anti").select("comp", "src", "dst").unionByName(thin))
        most = comp.groupBy("comp").agg(F.count("*").alias("m")).agg(F.max("m")).first()[0]
        if most > max(local.KERNEL_EDGES, 1) * 16:
            raise ValueError(f"a component keeps {most} edges, too many for one task")
    found = comp.groupBy("comp").applyInArrow(lambda rows: pa.table({"id": pa.array(each(group_pairs(rows)), pa.int64())}), "id long")
    return found
