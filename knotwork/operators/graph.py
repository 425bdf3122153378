"""Graph primitives as DataFrame plans.

Edges are canonical (src < dst, long). Loops write each round to shared storage, so a plan never grows with the
rounds and a lost executor loses nothing. No primitive gathers a neighbourhood into one row or task. Iterative primitives
hand a graph of at most ``local.KERNEL_EDGES`` edges to one task instead, which saves the rounds of jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.operators import peeling
from knotwork.operators.local import small_pairs, task_table
from knotwork.sources.edges import arcs
from knotwork.sources.scratch import discard, saved

#: Links from which on the least neighbours are a table of their own, so that Spark can split a hub's rows in the join.
HUB_LINKS = 20_000


def vertices(edges: DataFrame) -> DataFrame:
    """id of every vertex."""
    return arcs(edges).select(F.col("u").alias("id")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """id, degree."""
    return arcs(edges).groupBy(F.col("u").alias("id")).agg(F.count("*").alias("degree"))


def summary(edges: DataFrame) -> DataFrame:
    """n, m, min_degree, max_degree of a graph, in one row."""
    d = degrees(edges)
    return d.agg(F.count("*").alias("n"), F.floor(F.coalesce(F.sum("degree"), F.lit(0)) / 2).alias("m"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"))


def degree_histogram(edges: DataFrame) -> DataFrame:
    """degree, n_vertices."""
    return degrees(edges).groupBy("degree").agg(F.count("*").alias("n_vertices"))


def running_histogram(edges: DataFrame) -> DataFrame:
    """degree, n_vertices, n_below (of smaller degree), n_from (of that degree or more). One row per distinct degree."""
    h = degree_histogram(edges)
    up = Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, 0)
    return h.select("degree", "n_vertices", F.coalesce(F.sum("n_vertices").over(up), F.lit(0)).alias("n_below"), F.sum("n_vertices").over(down).alias("n_from"))


def top_degrees(edges: DataFrame, k: int = 40, least: int = 2) -> DataFrame:
    """The ``k`` vertices of largest degree (then least id), of at least ``least``."""
    return degrees(edges).where(F.col("degree") >= least).orderBy(F.desc("degree"), "id").limit(k)


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends in ``members`` (id): two semi-joins."""
    a = members.select(F.col("id").alias("src"))
    b = members.select(F.col("id").alias("dst"))
    return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi").select("src", "dst")


def subset_degrees(edges: DataFrame, members: DataFrame) -> DataFrame:
    """id, degree inside ``members``; members without neighbours there have 0."""
    inside = degrees(induced(edges, members))
    return members.select("id").distinct().join(inside, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def has_edge(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """u, v, linked for ``pairs`` (u, v)."""
    known = arcs(edges).distinct().withColumn("linked", F.lit(True))
    return pairs.select("u", "v").join(known, ["u", "v"], "left").select("u", "v", F.coalesce("linked", F.lit(False)).alias("linked"))


def non_neighbors(edges: DataFrame, of: int, members: DataFrame) -> DataFrame:
    """Members other than ``of`` that are not linked with it."""
    near = arcs(edges).where(F.col("u") == of).select(F.col("v").alias("id"))
    return members.select("id").where(F.col("id") != of).join(near, "id", "left_anti")


def components(edges: DataFrame, small: bool = True) -> DataFrame:
    """id, comp (least id of the component), by alternating large and small stars until nothing changes.

    Each round replaces links by links to smaller neighbours; the rounds grow with the logarithm of a component's size.
    Without ``small`` no graph goes to one task.
    """
    if small and (pairs := small_pairs(edges)) is not None:

        def whole():
            g = peeling.Neighbours(pairs)
            return [{"id": g.ids[v], "comp": g.ids[min(part)]} for part in g.parts(set(range(len(g)))) for v in part]

        return task_table(edges.sparkSession, whole, "id long, comp long")
    state, seen = saved(edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).where("a > b")), None
    while True:
        mark = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())
        if mark == seen:
            break
        seen = mark
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        old = [state]
        if mark[0] >= HUB_LINKS:
            least = saved(least)
            old.append(least)
        far = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        far = far.unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        low = far.groupBy("a").agg(F.min("b").alias("m"))
        state = saved(far.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        discard(*old)
    return state.select(F.col("a").alias("id"), F.col("b").alias("comp")).unionByName(state.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct())


def component_sizes(edges: DataFrame) -> DataFrame:
    """comp, size."""
    return components(edges).groupBy("comp").agg(F.count("*").alias("size"))


def largest_component(edges: DataFrame) -> DataFrame:
    """id of the largest component; of equal ones the one with the least id."""
    comp = saved(components(edges))
    best = comp.groupBy("comp").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "comp").limit(1).select("comp")
    return comp.join(F.broadcast(best), "comp", "left_semi").select("id")  # one row


def is_connected(edges: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """connected: whether the graph, or the part on ``members``, has at most one component; lone members count as one each."""
    if members is not None:
        edges = induced(edges, members)
    n = components(edges).agg(F.count_distinct("comp").alias("k"), F.count("*").alias("n"))
    if members is None:
        return n.select((F.col("k") <= 1).alias("connected"))
    total = members.select("id").distinct().agg(F.count("*").alias("total"))
    return n.crossJoin(F.broadcast(total)).select((F.col("k") + F.col("total") - F.col("n") <= 1).alias("connected"))  # one row each


def k_core(edges: DataFrame, k: int) -> DataFrame:
    """Edges of the k-core: vertices below ``k`` go, until none is left."""
    if (pairs := small_pairs(edges)) is not None:

        def whole():
            g = peeling.Neighbours(pairs)
            core = peeling.core_numbers(g)
            return [{"src": g.ids[v], "dst": g.ids[w]} for v in range(len(g)) if core[v] >= k for w in g.near[v] if v < w and core[w] >= k]

        return task_table(edges.sparkSession, whole, "src long, dst long")
    now, m = edges, None
    while True:
        now = saved(now)
        left = now.count()
        if left == m or left == 0:
            return now
        m = left
        now = induced(now, degrees(now).where(F.col("degree") >= k))


def core_numbers(edges: DataFrame) -> DataFrame:
    """id, core: each vertex takes the H-index of its neighbours' values until none changes.

    Neighbours are counted by value (at most the vertex's own) before they are ranked, so a hub is never one group of
    rows.
    """
    if (pairs := small_pairs(edges)) is not None:

        def whole():
            g = peeling.Neighbours(pairs)
            return [{"id": v, "core": k} for v, k in zip(g.ids, peeling.core_numbers(g), strict=True)]

        return task_table(edges.sparkSession, whole, "id long, core long")
    both = saved(arcs(edges))
    core = saved(both.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("core")))
    down = Window.partitionBy("id").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    while True:
        own = core.withColumnRenamed("core", "own")
        near = both.join(core.select(F.col("id").alias("v"), "core"), "v").join(own.withColumnRenamed("id", "u"), "u")
        byvalue = near.groupBy(F.col("u").alias("id"), F.least("core", "own").alias("t")).agg(F.count("*").alias("c"))
        rank = byvalue.withColumn("c", F.sum("c").over(down))
        new = rank.groupBy("id").agg(F.max(F.least("t", "c")).alias("core"))
        new = saved(new.join(own, "id"))
        changed = not new.where("core <> own").isEmpty()
        core = new.select("id", "core")
        if not changed:
            return core


def bfs(edges: DataFrame, sources: DataFrame, hops: int | None = None) -> DataFrame:
    """key, id, hop for ``sources`` (key, id): hop distances of each key's search, at most ``hops``.

    A neighbour of hop h is in hop h - 1, h or h + 1, so a new front is only held against the last two.
    """
    both = arcs(edges)
    fronts = [saved(sources.select("key", "id").distinct())]
    while hops is None or len(fronts) <= hops:
        past = fronts[-1] if len(fronts) == 1 else fronts[-1].unionByName(fronts[-2])
        step = fronts[-1].join(both, fronts[-1]["id"] == both["u"]).select("key", F.col("v").alias("id")).distinct()
        new = saved(step.join(past, ["key", "id"], "left_anti"))
        if new.isEmpty():
            break
        fronts.append(new)
    out = fronts[0].withColumn("hop", F.lit(0))
    for h, front in enumerate(fronts[1:], 1):
        out = out.unionByName(front.withColumn("hop", F.lit(h)))
    return saved(out) if len(fronts) > 8 else out


def capped_ball(edges: DataFrame, sources: DataFrame, hops: int = 2, cap: int = 3000) -> DataFrame:
    """key, id, hop, rank: each key's first ``cap`` vertices in the order (hop, rank of the parent, id).

    The parent is the neighbour one hop nearer with the least rank. A hop's candidates are first cut to ``cap`` in shares
    of a key, then ranked within it, so no task gets more than a cap of each share; ids beyond the cap are left out of later hops.
    """
    both = arcs(edges)
    seen = saved(sources.select("key", "id").distinct().withColumns({"hop": F.lit(0), "rank": F.lit(1).cast("bigint")}))
    for h in range(hops):
        front = seen.where(F.col("hop") == h)
        step = front.join(both, front["id"] == both["u"]).groupBy("key", F.col("v").alias("id")).agg(F.min("rank").alias("parent"))
        new = step.join(seen.select("key", "id"), ["key", "id"], "left_anti").withColumn("share", F.pmod(F.xxhash64("id"), F.lit(64)))
        new = new.withColumn("place", F.row_number().over(Window.partitionBy("key", "share").orderBy("parent", "id"))).where(F.col("place") <= cap)
        count = seen.groupBy("key").agg(F.count("*").alias("have"))
        order = Window.partitionBy("key").orderBy("parent", "id")
        new = new.withColumn("place", F.row_number().over(order)).join(count, "key").select("key", "id", F.lit(h + 1).alias("hop"), (F.col("place") + F.col("have")).alias("rank")).where(F.col("rank") <= cap)
        new = saved(new)
        if new.isEmpty():
            break
        seen = saved(seen.unionByName(new))
    return seen


def keyed_induced(edges: DataFrame, regions: DataFrame) -> DataFrame:
    """key, src, dst: for each key the edges with both ends in its region (key, id)."""
    left = regions.select("key", F.col("id").alias("src")).join(edges, "src")
    return left.join(regions.select("key", F.col("id").alias("dst")), ["key", "dst"], "left_semi").select("key", "src", "dst")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """src, dst, w of a spanning forest of greatest weights, of edges with a weight ``w``.

    Each part of the forest takes its heaviest edge to another part, until there is none; parts at least halve each round.
    """
    now = saved(edges.select("src", "dst", "w", F.col("src").alias("a"), F.col("dst").alias("b")))
    taken = None
    while not now.isEmpty():
        ends = now.select(F.col("a").alias("part"), F.struct("w", (-F.col("src")).alias("s"), (-F.col("dst")).alias("d")).alias("e")).unionByName(now.select(F.col("b").alias("part"), F.struct("w", (-F.col("src")).alias("s"), (-F.col("dst")).alias("d")).alias("e")))
        best = ends.groupBy("part").agg(F.max("e").alias("e")).select((-F.col("e.s")).alias("src"), (-F.col("e.d")).alias("dst"), "e.w").distinct()
        best = saved(best)
        taken = best if taken is None else saved(taken.unionByName(best))
        comp = saved(components(taken.select("src", "dst")))
        a, b = comp.select(F.col("id").alias("src"), F.col("comp").alias("a")), comp.select(F.col("id").alias("dst"), F.col("comp").alias("b"))
        now = saved(now.select("src", "dst", "w").join(a, "src").join(b, "dst").where("a <> b"))
    return edges.select("src", "dst", "w").limit(0) if taken is None else taken


def core_levels(edges: DataFrame, cores: DataFrame, tau: float) -> DataFrame:
    """k, size (of the largest component of the k-core), need (floor(size ** tau)), ok (need <= k): all levels at once.

    Levels are nested, so a forest of the edges that last longest connects each of them as all its edges do.
    """
    from knotwork.functions.thresholds import floor_pow

    if (pairs := small_pairs(edges)) is not None:

        def whole():
            g = peeling.Neighbours(pairs)
            return [{"k": k, "size": n} for k, n in peeling.level_sizes(g, peeling.core_numbers(g)).items() if k >= 2]

        sizes = task_table(edges.sparkSession, whole, "k long, size long")
        return sizes.select("k", "size", floor_pow(F.col("size"), tau).alias("need")).withColumn("ok", F.col("need") <= F.col("k"))
    c1, c2 = cores.select(F.col("id").alias("src"), F.col("core").alias("c1")), cores.select(F.col("id").alias("dst"), F.col("core").alias("c2"))
    live = edges.join(c1, "src").join(c2, "dst").select("src", "dst", F.least("c1", "c2").alias("w")).where("w >= 2")
    # a forest's edge lives on levels 2..w: components per level are found on (level, vertex) pairs in one search
    levels = saved(spanning_forest(live).select("src", "dst", F.explode(F.sequence(F.lit(2).cast("bigint"), "w")).alias("k")))
    ids = saved(levels.select("k", F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("node", F.monotonically_increasing_id()))
    a = ids.select("k", F.col("id").alias("src"), F.col("node").alias("a"))
    b = ids.select("k", F.col("id").alias("dst"), F.col("node").alias("b"))
    paired = levels.join(a, ["k", "src"]).join(b, ["k", "dst"]).select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    comp = components(paired)
    sizes = comp.join(ids, comp["id"] == ids["node"]).groupBy("k", "comp").agg(F.count("*").alias("size")).groupBy("k").agg(F.max("size").alias("size"))
    return sizes.select("k", "size", floor_pow(F.col("size"), tau).alias("need")).withColumn("ok", F.col("need") <= F.col("k"))
