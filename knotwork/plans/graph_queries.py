"""The registered graph queries and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from knotwork.functions import thresholds as th
from knotwork.operators import community, dynamic, graph, solvers
from knotwork.sources import edges as io
from knotwork.sources.scratch import saved
from knotwork.sources.views import SQL, VIEWS, table

TAUS = (0.5, 0.6, 0.75, 0.8, 0.9)
QUERIES, ORACLES = {}, {}


def query(view: str | None = None, sql: str | None = None, sql_view: str | None = None):
    """Register a function; with a view it gets that graph's edges, else (spark, sf_dir). The SQL may be over a view of its own."""

    def add(f):
        name = f.__name__

        def run(spark, sf_dir):
            return f(saved(VIEWS[view](spark, sf_dir))) if view else f(spark, sf_dir)

        run.__doc__, run.__name__ = f.__doc__, name
        QUERIES[name] = run
        if sql:
            ORACLES[name] = f"with recursive e as ({SQL[sql_view or view]}), d as (select a u, b v from e union all select b, a from e) {sql}" if view else sql
        return f

    return add


# fmt: off
G = "supplier"
_DEG = "g as (select u id, count(*) degree from d group by u)"
_CC = "r(s, t) as (select distinct u, u from d union select r.s, d.v from r join d on d.u = r.t), cc as (select s id, min(t) comp from r group by s)"
_TAUS = ", ".join(f"({t}::double)" for t in TAUS)


# ---- thresholds -------------------------------------------------------------------------------------------------
def _taus(spark):
    return spark.createDataFrame([(t,) for t in TAUS], "tau double")  # a fixed list of five


def _grid(spark, n, name="k"):
    return spark.range(n).select(F.col("id").alias(name)).crossJoin(F.broadcast(_taus(spark)))


@query(sql=f"select k::bigint k, tau, case when k <= 0 then 0 else floor(pow(k, tau)) end::bigint v from range(0, 2000) t(k), (values {_TAUS}) x(tau)")
def floor_pow_lut(spark, sf_dir):
    """floor(k ** tau)."""
    return _grid(spark, 2000).select("k", "tau", th.floor_pow(F.col("k"), F.col("tau")).alias("v"))


@query(sql=f"""select k::bigint best, tau, (case when m > 0 and pow(m, 1 / tau) > k + 1 then m - 1 when pow(m + 1, 1 / tau) <= k + 1 then m + 1 else m end)::bigint v
  from (select k, tau, floor(pow(k + 1, tau)) m from range(0, 2000) t(k), (values {_TAUS}) x(tau))""")
def theta_lut(spark, sf_dir):
    """Degree needed to beat a best size."""
    return _grid(spark, 2000, "best").select("best", "tau", th.theta(F.col("best"), F.col("tau")).cast("bigint").alias("v"))


@query(sql="""select k::bigint k, l::bigint l, (case when l <= 0 then 1 when k <= 0 then l + 1 when l <= 2 or k = 1 then k + l else k + l + 1 + (l // 3) * (k - 2) end)::bigint v
  from range(-1, 60) a(k), range(-1, 60) b(l)""")
def nfunc_lut(spark, sf_dir):
    """Fewest vertices for a least degree and a diameter."""
    both = spark.range(-1, 60).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(-1).cast("bigint"), F.lit(59).cast("bigint"))).alias("l"))
    return both.select("k", "l", th.min_order(F.col("k"), F.col("l")).alias("v"))


@query(sql=f"select k::bigint x, tau, (case when k <= 0 then 0 else floor(least(2147483647::double, pow(k, 1 / tau))) end)::bigint v from range(0, 300) t(k), (values {_TAUS}) x(tau)")
def floor_root_lut(spark, sf_dir):
    """Largest size for a degree."""
    return _grid(spark, 300, "x").select("x", "tau", th.floor_root(F.col("x"), F.col("tau")).alias("v"))


_MODELS = (("flexi", 0.8), ("flexi", 0.9), ("quasi", 0.5), ("quasi", 0.8), ("kplex", 2.0), ("kplex", 3.0))


@query(sql=f"""select n::bigint n, model, param, (case when n <= 1 then 0 when model = 'flexi' then floor(pow(n, param)) when model = 'quasi' then ceil(param * (n - 1) - 1e-9) else greatest(0, n - round(param)) end)::bigint v
  from range(0, 500) t(n), (values {", ".join(f"('{m}', {p}::double)" for m, p in _MODELS)}) x(model, param)""")
def model_threshold_lut(spark, sf_dir):
    """Degree needed under each model."""
    grid = spark.range(500).select(F.col("id").alias("n")).crossJoin(F.broadcast(spark.createDataFrame(_MODELS, "model string, param double")))  # six fixed rows
    return grid.select("n", "model", "param", th.model_threshold(F.col("model"), F.col("param"), F.col("n")).alias("v"))


@query(sql=f"""select k::bigint degree, tau, smax::bigint smax, (smax - 1 - floor(pow(smax, tau)))::bigint dbar from
  (select k, tau, greatest(1, least(floor(least(2147483647::double, pow(k + 1, 1 / tau))), 100)) smax from range(0, 300) t(k), (values {_TAUS}) x(tau))""")
def saturation_lut(spark, sf_dir):
    """Largest set and most strangers for a degree, in a scope of 100."""
    return _grid(spark, 300, "degree").select("degree", "tau", th.most_members(F.col("degree"), F.lit(100), F.col("tau")).alias("smax"), th.most_strangers(F.col("degree"), F.lit(100), F.col("tau")).alias("dbar"))


# ---- edges and degrees ------------------------------------------------------------------------------------------
@query(sql=f"""select d::bigint degree, tau, (case when d > 0 then floor(pow(d, 1 / tau)) else 0 end)::bigint v from range(0, 300) t(d), (values {_TAUS}) x(tau)""")
def component_cap_lut(spark, sf_dir):
    """Size from which on a component of a least degree is not peeled."""
    return _grid(spark, 300, "degree").select("degree", "tau", th.component_cap("degree", "tau").alias("v"))


@query(sql="select d::bigint degree, s::bigint size, m::boolean member, (20 - (s - m::int - d))::bigint v from range(0, 12) t(d), range(0, 12) x(s), range(0, 2) y(m) where d <= s")
def margin_lut(spark, sf_dir):
    """Strangers that a vertex may still get, of twenty, by the set's size and its neighbours there."""
    rows = spark.range(12).withColumnRenamed("id", "degree").crossJoin(F.broadcast(spark.range(12).withColumnRenamed("id", "size"))).crossJoin(F.broadcast(spark.range(2).select((F.col("id") == 1).alias("member"))))  # 288 rows
    return rows.where("degree <= size").select("degree", "size", "member", th.margin(F.lit(20), "size", "member", "degree").cast("bigint").alias("v"))


@query(G, "select a src, b dst from e")
def edges_canonical(e):
    """Each edge once."""
    return e


@query(G, "select u, v from d")
def edges_symmetric(e):
    """Each edge in both directions."""
    return io.arcs(e)


@query(G, "select (least(a, b) << 32) | greatest(a, b) as key from e")
def edge_keys(e):
    """Both ends of every edge in one number."""
    return e.select(th.edge_key("dst", "src").alias("key"))


@query(G, ", x(u, v) as (select i, j from range(0, 12) t(i), range(0, 12) s(j)) select x.u::bigint u, x.v::bigint v, count(d.u) > 0 as linked from x left join d using (u, v) group by x.u, x.v")
def has_edge(e):
    """Whether pairs of the first twelve ids are edges."""
    pairs = e.sparkSession.range(144).select(F.floor(F.col("id") / 12).alias("u"), (F.col("id") % 12).alias("v"))
    return graph.has_edge(e, pairs)


@query(G, ", s as (select distinct u id from d where u % 2 = 0), g as (select s.id, count(x.u) degree from s left join (select u from d where v % 2 = 0) x on x.u = s.id group by s.id) select floor(pow(min(degree) + 1, 1 / 0.8::double))::bigint cap from g")
def set_size_cap(e):
    """Largest set that the degrees inside the even ids leave room for, tau 0.8."""
    return graph.subset_degrees(e, _even(e)).agg(F.min("degree").alias("m")).select(th.floor_root(F.col("m") + 1, 0.8).alias("cap"))


@query(sql="select id::bigint id, (row_number() over (order by id) - 1)::bigint vid from (select n_nationkey id from nation union select n_regionkey + 100 from nation)")
def first_appearance(spark, sf_dir):
    """Dense numbers of nations and regions by their first line, where the lines are in order of id."""
    n = table(spark, sf_dir, "nation")
    lines = n.select(F.col("n_nationkey").alias("line"), F.col("n_nationkey").cast("bigint").alias("src"), F.col("n_nationkey").cast("bigint").alias("dst"))
    more = n.select((F.col("n_regionkey") + 1000).alias("line"), (F.col("n_regionkey") + 100).cast("bigint").alias("src"), (F.col("n_regionkey") + 100).cast("bigint").alias("dst"))
    return io.first_appearance(lines.unionByName(more), "line")


@query(G, f", {_DEG} select count(*)::bigint n, (sum(degree) // 2)::bigint m, min(degree)::bigint min_degree, max(degree)::bigint max_degree from g")
def graph_summary(e):
    """Counts and degree range."""
    return graph.summary(e)


@query(G, f", {_DEG} select id, degree::bigint degree from g")
def vertex_degree(e):
    """Degree of every vertex."""
    return graph.degrees(e)


@query(G, f", {_DEG} select degree::bigint degree, count(*)::bigint n_vertices from g group by degree")
def degree_histogram(e):
    """Vertices by degree."""
    return graph.degree_histogram(e)


_RUN = f", {_DEG}, h as (select degree, count(*) c from g group by degree)"


@query(G, f"{_RUN} select degree::bigint degree, c::bigint n_vertices, coalesce(sum(c) over (order by degree rows between unbounded preceding and 1 preceding), 0)::bigint n_below from h")
def degree_prefix_sum(e):
    """Vertices of smaller degree."""
    return graph.running_histogram(e).select("degree", "n_vertices", "n_below")


@query(G, f"{_RUN} select degree::bigint degree, c::bigint n_vertices, sum(c) over (order by degree desc rows unbounded preceding)::bigint n_from from h")
def degree_suffix_sum(e):
    """Vertices of that degree or more."""
    return graph.running_histogram(e).select("degree", "n_vertices", "n_from")


@query(G, f", {_DEG} select id, degree::bigint degree from g where degree >= 2 order by degree desc, id limit 40")
def degree_top40(e):
    """The 40 vertices of largest degree."""
    return graph.top_degrees(e)


@query(G, f", {_DEG} select id, degree::bigint degree, rank() over (order by degree desc)::bigint place from g")
def degree_rank(e):
    """Rank of each vertex by degree, from ranks of distinct degrees."""
    h = graph.running_histogram(e)
    return graph.degrees(e).join(h.select("degree", (F.col("n_from") - F.col("n_vertices") + 1).alias("place")), "degree").select("id", "degree", "place")


def _even(e):
    return graph.vertices(e).where("id % 2 = 0")


@query(G, ", s as (select distinct u id from d where u % 2 = 0) select s.id, count(x.u)::bigint degree from s left join (select u from d where v % 2 = 0) x on x.u = s.id group by s.id")
def subset_degree(e):
    """Degrees inside the even ids."""
    return graph.subset_degrees(e, _even(e))


@query(G, "select a src, b dst from e where a % 2 = 0 and b % 2 = 0")
def induced_subgraph(e):
    """Edges inside the even ids."""
    return graph.induced(e, _even(e))


@query(G, "select distinct u id from d where u <> 1 and u not in (select v from d where u = 1)")
def non_neighbors(e):
    """Vertices not linked with vertex 1."""
    return graph.non_neighbors(e, 1, graph.vertices(e))


# ---- cores, components, distances -------------------------------------------------------------------------------
def _core_sql(k):
    return f""", c(r, u, v) as (select 0, u, v from d union all select r + 1, u, v from (select r, u, v, count(*) over (partition by u) du, count(*) over (partition by v) dv from c) where du >= {k} and dv >= {k} and r < 40)"""


@query(G, f"{_core_sql(8)} select u src, v dst from c where r = 40 and u < v")
def kcore_k(e):
    """Edges of the 8-core."""
    return graph.k_core(e, 8)


_CORES = """, ks as (select range k from range(1, 40)), c(k, r, u, v) as (select k, 0, u, v from d, ks union all select k, r + 1, u, v from
  (select k, r, u, v, count(*) over (partition by k, u) du, count(*) over (partition by k, v) dv from c) where du >= k and dv >= k and r < 40),
  cores as (select u id, max(k) core from c where r = 40 group by u)"""


@query(G, f"{_CORES} select id, core::bigint core from cores")
def core_numbers(e):
    """Core number of every vertex."""
    return graph.core_numbers(e)


@query(G, f"{_CORES} select max(core)::bigint degeneracy from cores")
def degeneracy(e):
    """The largest core number."""
    return graph.core_numbers(e).agg(F.max("core").alias("degeneracy"))


@query(G, f"{_CORES} select tau, max(k)::bigint bound from (select max(core) m from cores), range(1, 2000) t(k), (values {_TAUS}) x(tau) where floor(pow(k, tau)) <= m group by tau")
def degeneracy_bound(e):
    """Largest size that the degeneracy allows, by tau."""
    top = graph.core_numbers(e).agg(F.max("core").alias("m"))
    return _taus(e.sparkSession).crossJoin(F.broadcast(top.where("m is not null"))).select("tau", th.largest_size(F.col("m"), F.col("tau")).alias("bound"))  # one row


@query(G, f", {_CC} select id, comp from cc")
def connected_components(e):
    """Component of every vertex."""
    return graph.components(e)


@query(G, f", {_CC} select comp, count(*)::bigint size from cc group by comp")
def component_sizes(e):
    """Vertices by component."""
    return graph.component_sizes(e)


@query(G, f", {_CC} select id from cc where comp = (select comp from cc group by comp order by count(*) desc, comp limit 1)")
def largest_component(e):
    """Vertices of the largest component."""
    return graph.largest_component(e)


@query(G, f", {_CC} select count(distinct comp) <= 1 connected from cc")
def is_connected(e):
    """Whether there is one component."""
    return graph.is_connected(e)


@query(G, f"{_core_sql(7)}, x as (select u, v from c where r = 40), r2(s, t) as (select distinct u, u from x union select r2.s, x.v from r2 join x on x.u = r2.t) select distinct t id from r2 where s = (select min(u) from x)")
def seed_core_component(e):
    """Component of the 7-core around its least vertex."""
    core = graph.k_core(e, 7)
    comp = saved(graph.components(core))
    return comp.where(F.col("comp") == F.col("comp")).join(F.broadcast(comp.agg(F.min("id").alias("comp"))), "comp", "left_semi").select("id")  # one row


_BFS = "b(t, h) as (select 1::bigint, 0 union select d.v, b.h + 1 from b join d on d.u = b.t where b.h < {})"


@query(G, f", {_BFS.format(4)} select t id, min(h)::integer hop from b group by t")
def bfs_hops(e):
    """Hops from vertex 1, at most 4."""
    return graph.bfs(e, e.sparkSession.createDataFrame([(0, 1)], "key long, id long"), 4).select("id", "hop")


@query(G, f", {_BFS.format(2)} select distinct t id from b")
def ball_2hop(e):
    """Vertices within two hops of vertex 1."""
    return graph.bfs(e, e.sparkSession.createDataFrame([(0, 1)], "key long, id long"), 2).select("id")


@query(G, """, o1 as materialized (select v id, count(*) over (order by v) n from d where u = 1), k1 as (select id, 1 hop, n + 1 rk from o1 where n < 30),
  h2 as (select d.v id, min(k1.rk) p from k1 join d on d.u = k1.id where d.v <> 1 and d.v not in (select id from k1) group by d.v),
  o2 as materialized (select id, count(*) over (order by p, id) n from h2), k2 as (select id, 2 hop, n + 1 + (select count(*) from k1) rk from o2)
  select 1::bigint id, 0::integer hop, 1::bigint rank union all select id, hop, rk::bigint from k1 union all select id, hop, rk::bigint from k2 where rk <= 30""")
def ball_capped(e):
    """The first 30 vertices around vertex 1, in search order."""
    return graph.capped_ball(e, e.sparkSession.createDataFrame([(0, 1)], "key long, id long"), 2, 30).select("id", "hop", "rank")


_CUT = """, n as (select distinct u from d), r(x, s, t) as (select n.u, m.u, m.u from n join n m on m.u <> n.u union select r.x, r.s, d.v from r join d on d.u = r.t where d.v <> r.x),
  lab as (select x, s, min(t) c from r group by x, s), cut as (select x from (select l.x, count(distinct l.c) k from lab l join d on d.u = l.x and d.v = l.s group by l.x) where k > 1)"""


@query("nation", f"{_CUT} select x id from cut")
def articulation_points(e):
    """Cut vertices, one task per component."""
    return solvers.cut_vertices(e)


@query("nation", f"{_CUT} select count(*) > 0 is_cut from cut where x = 5")
def is_articulation(e):
    """Whether vertex 5 is a cut vertex: its neighbours without it lie in more than one component."""
    near = io.arcs(e).where("u = 5").select(F.col("v").alias("id"))
    comp = graph.components(e.where("src <> 5 and dst <> 5"))
    return near.join(comp, "id", "left").agg((F.count_distinct(F.coalesce("comp", "id")) > 1).alias("is_cut"))


# ---- bounds, validation, levels ---------------------------------------------------------------------------------
@query(G, f"""{_RUN}, s as (select degree, sum(c) over (order by degree desc rows unbounded preceding) from_ from h)
  select tau, max(k)::bigint bound from range(1, 2000) t(k), (values {_TAUS}) x(tau) where coalesce((select max(from_) from s where degree >= floor(pow(k, tau))), 0) >= k group by tau""")
def size_upper_bound(e):
    """Largest s with at least s vertices of the degree that s asks for, by tau: the best over degrees of the lesser of suffix count and largest size."""
    h = graph.running_histogram(e).select("degree", "n_from")
    met = h.crossJoin(F.broadcast(_taus(e.sparkSession)))  # five rows
    return met.groupBy("tau").agg(F.max(F.least("n_from", th.largest_size(F.col("degree"), F.col("tau")))).alias("bound"))


_SETS = ((1, "flexi", 0.8, (0, 1, 2, 3, 4, 5)), (2, "quasi", 0.5, (0, 1, 2, 3, 4, 5, 6, 7)), (3, "kplex", 4.0, (5, 6, 7, 8, 9)), (4, "flexi", 0.5, (10,)), (5, "flexi", 0.3, (1, 5, 9, 13, 17, 21)))
_SET_ROWS = [(s, m, p, v) for s, m, p, ids in _SETS for v in ids]


@query("nation", f""", x(set_id, model, param, id) as (values {", ".join(f"({s}, '{m}', {p}::double, {v})" for s, m, p, v in _SET_ROWS)}),
  i as (select p.set_id, p.id u, q.id v from x p join x q using (set_id) join d on d.u = p.id and d.v = q.id),
  r(set_id, s, t) as (select set_id, id, id from x union select r.set_id, r.s, i.v from r join i on i.set_id = r.set_id and i.u = r.t),
  nc as (select set_id, count(distinct c) n_components from (select set_id, s, min(t) c from r group by all) group by set_id),
  g as (select x.set_id, x.model, x.param, x.id, count(i.v) degree from x left join i on i.set_id = x.set_id and i.u = x.id group by all),
  z as (select set_id, model, param, count(*) size, min(degree) md from g group by all)
  select z.set_id::bigint set_id, size::bigint size, md::bigint min_degree, n_components::bigint n_components,
  size = 1 or (md >= case model when 'flexi' then floor(pow(size, param)) when 'quasi' then ceil(param * (size - 1) - 1e-9) else greatest(0, size - round(param)) end and (model <> 'flexi' or n_components = 1)) as valid from z join nc using (set_id)""")
def validate_sets(e):
    """Degrees, components and verdict of given sets."""
    return community.validate_sets(e, e.sparkSession.createDataFrame(_SET_ROWS, "set_id long, model string, param double, id long"))


@query(G, f"""{_CORES}, lk as (select k from ks where k between 2 and (select max(core) from cores)), ek as (select lk.k, d.u, d.v from lk, d join cores x on x.id = d.u join cores y on y.id = d.v where x.core >= lk.k and y.core >= lk.k),
  rk(k, s, t) as (select distinct k, u, u from ek union select rk.k, rk.s, ek.v from rk join ek on ek.k = rk.k and ek.u = rk.t), ck as (select k, s, min(t) comp from rk group by k, s),
  sz as (select k, max(n) size from (select k, comp, count(*) n from ck group by k, comp) group by k)
  select k::bigint k, size::bigint size, floor(pow(size, 0.8::double))::bigint need, floor(pow(size, 0.8::double)) <= k as ok from sz""")
def core_level_scan(e):
    """Largest component of every core level and whether its size's threshold is met, tau 0.8."""
    return graph.core_levels(e, saved(graph.core_numbers(e)), 0.8)


@query(G, f"{_core_sql(9)} select u id, count(*)::bigint degree from c where r = 40 group by u")
def global_prune_theta(e):
    """Vertices left at the threshold of a best size of 15, tau 0.8 (9)."""
    need = e.sparkSession.range(1).select(th.floor_pow(F.lit(16), F.lit(0.8)).alias("n")).first()[0]
    return graph.degrees(graph.k_core(e, need))


# ---- exact search -----------------------------------------------------------------------------------------------
#: The nation graph has at most so many vertices; the SQL lists all their subsets.
NATIONS = 25
_ADJ = "adj as (select " + ", ".join(f"coalesce(bit_or(case when u = {i} then (1::bigint) << v end), 0) m{i}" for i in range(NATIONS)) + " from d)"


def _subsets_sql(need, seed=None):
    degrees = " and ".join(f"((x >> {i}) & 1 = 0 or bit_count(x & m{i}) >= need)" for i in range(NATIONS))
    mine = f"(x >> {seed}) & 1 = 1 and " if seed is not None else ""
    return f"select coalesce(max(k), {1 if seed is not None else 0})::bigint size from (select x, bit_count(x) k, {need.replace('k', 'bit_count(x)')} need from range(1, (1::bigint) << {NATIONS}) t(x)), adj where {mine}{degrees}"


def _bitmask_sql(need, seed=None):
    return f", {_ADJ} {_subsets_sql(need, seed)}"


_F8, _F9, _Q8, _K2 = "floor(pow(k, 0.8::double))", "floor(pow(k, 0.9::double))", "ceil(0.8::double * (k - 1) - 1e-9)", "greatest(0, k - 2)"


@query("nation", _bitmask_sql(_F8))
def exact_flexi_bitmask(e):
    """Largest flexi-clique (0.8) by listing all subsets."""
    return solvers.bitmask(e, "flexi", 0.8, limit=NATIONS).select("size")


@query("nation", _bitmask_sql(_Q8))
def exact_quasi(e):
    """Largest quasi-clique (0.8)."""
    return solvers.bitmask(e, "quasi", 0.8, limit=NATIONS).select("size")


@query("nation", _bitmask_sql(_K2))
def exact_kplex(e):
    """Largest 2-plex."""
    return solvers.bitmask(e, "kplex", 2.0, limit=NATIONS).select("size")


@query("nation", _bitmask_sql(_F8, 3))
def exact_seeded_flexi(e):
    """Largest flexi-clique (0.8) with vertex 3."""
    return solvers.bitmask(e, "flexi", 0.8, 3, limit=NATIONS).select("size")


@query("nation", _bitmask_sql(_Q8, 3))
def exact_seeded_quasi(e):
    """Largest quasi-clique (0.8) with vertex 3."""
    return solvers.bitmask(e, "quasi", 0.8, 3, limit=NATIONS).select("size")


@query("nation", _bitmask_sql(_K2, 3))
def exact_seeded_kplex(e):
    """Largest 2-plex with vertex 3."""
    return solvers.bitmask(e, "kplex", 2.0, 3, limit=NATIONS).select("size")


@query("nation", _bitmask_sql(_F8))
def exact_flexi_se(e):
    """Largest flexi-clique (0.8) by set enumeration."""
    return solvers.set_enumeration(e, 0.8).select("size")


@query("nation", _bitmask_sql(_F8))
def exact_flexi_cp(e):
    """Largest flexi-clique (0.8) by branch and bound from root seeds."""
    return solvers.exact(e, 0.8).select("size")


# ---- heuristics -------------------------------------------------------------------------------------------------
# Sets are numbers again, and a[i] is vertex i's neighbours. Each round of the recursion takes one vertex away.
_NEED = "floor(pow(bit_count(x), 0.8::double))"
_ALL = f"range(0, {NATIONS})"
_LISTS = f"al as (select list(coalesce(m, 0) order by i) a from (select i, m from (select unnest({_ALL}) i) left join (select u, bit_or((1::bigint) << v) m from d group by u) on u = i))"
#: Whether the set y holds together: from its lowest vertex, as many steps as there are vertices.
_HOLDS = f"list_reduce(list_prepend(y & -y, list_transform({_ALL}, lambda q: q::bigint)), lambda r, q: r | (y & list_aggregate(list_transform({_ALL}, lambda j: case when (r >> j) & 1 = 1 then a[j + 1] else 0 end), 'bit_or'))) = y"


def _free(code):
    """The least ``code`` of the vertices i that no others need to hold together."""
    return f"list_min(list_transform({_ALL}, lambda i: case when (x >> i) & 1 = 1 and x & a[i + 1] <> 0 and ({_HOLDS.replace('y', '(x & ~((1::bigint) << i))')}) then {code} end))"


_LOW = f"list_min(list_transform({_ALL}, lambda i: case when (x >> i) & 1 = 1 then bit_count(x & a[i + 1])::bigint end))"
_SCOPE = f"""{_CORES}, {_LISTS}, lk as (select k from ks where k <= (select max(core) from cores)), ek as (select lk.k, d.u, d.v from lk, d join cores x on x.id = d.u join cores y on y.id = d.v where x.core >= lk.k and y.core >= lk.k),
  rk(k, s, t) as (select distinct k, u, u from ek union select rk.k, rk.s, ek.v from rk join ek on ek.k = rk.k and ek.u = rk.t), ck as (select k, s, min(t) comp from rk group by k, s),
  big as (select k, comp, n from (select k, comp, count(*) n, row_number() over (partition by k order by count(*) desc, comp) r from ck group by k, comp) where r = 1),
  lev as (select min(k) k from big where k >= 2 and floor(pow(n, 0.8::double)) <= k),
  sd as (select ck.s from ck join big using (k, comp) where ck.k = (select k from lev)), seed as (select coalesce(bit_or((1::bigint) << s), 0) m, count(*) n from sd),
  scope as (select bit_or((1::bigint) << s) x from ck where k = (select greatest(k - 1, 1) from lev) and comp = (select comp from ck where k = (select greatest(k - 1, 1) from lev) and s = (select min(s) from sd)))"""
_NPA = f"""pn(x, low, code) as (select x, {_LOW}, {_free("bit_count(x & a[i + 1])::bigint * 32 + i")} from scope, al union all
  select x, {_LOW}, {_free("bit_count(x & a[i + 1])::bigint * 32 + i")} from (select x & ~((1::bigint) << (code % 32)) x from pn where low < {_NEED} and code is not null), al),
  npa as (select coalesce(max(bit_count(x)), 0)::bigint size from pn where low >= {_NEED})"""
_KEYED = _free("(bit_count(x & a[i + 1])::bigint * 100000 + keys[i + 1]) * 32 + i")
_FPA = f"""pf(x, keys, stamp, low, code) as (select x, keys, {NATIONS}, {_LOW}, {_KEYED} from (select x, list_transform({_ALL}, lambda i: i::bigint) keys from scope), al union all
  select x, keys, stamp, {_LOW}, {_KEYED} from (select x & ~((1::bigint) << (code % 32)) x, stamp + bit_count(x & a[code % 32 + 1]) stamp,
    list_transform({_ALL}, lambda j: case when (x & a[code % 32 + 1]) >> j & 1 = 1 then stamp + bit_count(x & a[code % 32 + 1] & (((1::bigint) << j) - 1)) else keys[j + 1] end) keys
    from pf, al where low < {_NEED} and code is not null and bit_count(x) > (select n from seed)), al),
  fpa as (select greatest(coalesce(max(bit_count(x)), 0), (select n from seed))::bigint size from pf where low >= {_NEED})"""
_GREEDY = f"""pg(x, code) as (select x, {_LOW} * 32 + list_min(list_transform({_ALL}, lambda i: case when (x >> i) & 1 = 1 and bit_count(x & a[i + 1]) = {_LOW.replace("lambda i", "lambda h").replace("(x >> i)", "(x >> h)").replace("a[i + 1]", "a[h + 1]")} then i end))
    from (select bit_or((1::bigint) << u) x from d), al union all
  select x, {_LOW} * 32 + list_min(list_transform({_ALL}, lambda i: case when (x >> i) & 1 = 1 and bit_count(x & a[i + 1]) = {_LOW.replace("lambda i", "lambda h").replace("(x >> i)", "(x >> h)").replace("a[i + 1]", "a[h + 1]")} then i end))
    from (select x & ~((1::bigint) << (code % 32)) x from pg where code // 32 < {_NEED}), al),
  greedy as (select coalesce(max(bit_count(x)), 0)::bigint size from pg where code // 32 >= {_NEED} and x <> 0)"""


def _sized(found):
    return found.select("size", "valid", (F.size("nodes") == F.col("size")).alias("named"))


def _sized_sql(name):
    return f"select size, size > 0 as valid, true as named from {name}"


@query("nation", f"{_SCOPE}, {_NPA} {_sized_sql('npa')}")
def npa(e):
    """Core peeling that spares cut vertices."""
    return _sized(solvers.npa(e, 0.8))


@query("nation", f"{_SCOPE}, {_FPA} {_sized_sql('fpa')}")
def fpa(e):
    """Core peeling by arrival with the core as floor."""
    return _sized(solvers.fpa(e, 0.8))


# The nation graph is one component, whole within two hops of its first seed; a set of 0.8 among 25 vertices is connected.
@query("nation", f", {_LISTS}, {_GREEDY} {_sized_sql('greedy')}")
def mgpp(e):
    """Greedy peeling of components."""
    return _sized(solvers.mgpp(e, 0.8))


@query("nation", f"{_SCOPE}, {_FPA}, {_GREEDY} {_sized_sql('(select greatest(fpa.size, greedy.size) size from fpa, greedy)')}")
def multiseed(e):
    """Greedy peeling in balls around high degrees."""
    return _sized(solvers.multi_seed(e, 0.8))


# ---- community search -------------------------------------------------------------------------------------------
def _asked(e, rows):
    return e.sparkSession.createDataFrame(rows, "query_id long, seed long, model string, param double, restrict array<long>")


_BATCH = [(i, s, m, p, None) for i, (s, m, p) in enumerate([(3, "flexi", 0.8), (7, "flexi", 0.9), (3, "quasi", 0.8), (11, "quasi", 0.8), (3, "kplex", 2.0), (11, "kplex", 2.0)])]
_FOR = {"flexi0.8": _F8, "flexi0.9": _F9, "quasi0.8": _Q8, "kplex2.0": _K2}


def _batch_sql(rows):
    # hops beyond the diameter make the region the seed's component, so subsets of the whole graph with the seed decide
    return f", {_ADJ} " + " union all ".join(f"select {i}::bigint query_id, {s}::bigint seed, size, true as valid from ({_subsets_sql(_FOR[f'{m}{p}'], s)})" for i, s, m, p, _ in rows)


@query("nation", _batch_sql(_BATCH))
def community_batch(e):
    """Largest sets around seeds under three models, in one batch."""
    return community.community_search(e, _asked(e, _BATCH), hops=8, timeout=60.0).select("query_id", "seed", "size", "valid")


_INSIDE = tuple(range(0, 20, 2)) + (3,)


@query("nation", f""", x as (select unnest([{", ".join(map(str, sorted(_INSIDE)))}]) id), adj as (select u, bit_or((1::bigint) << v) m from d where u in (select id from x) and v in (select id from x) group by u),
  all_ as (select bit_or((1::bigint) << id) w from x), s as (select t.x, bit_count(t.x) k from range(1, (1::bigint) << 20) t(x), all_ where t.x & ~w = 0 and (t.x >> 3) & 1 = 1),
  ok as (select s.x, k from s join adj on ((s.x >> u) & 1) = 1 group by s.x, k having min(bit_count(s.x & m)) >= {_K2} and count(*) = k)
  select 0::bigint query_id, coalesce(max(k), 1)::bigint size, true as valid from ok""")
def community_restricted(e):
    """Largest 2-plex around vertex 3 inside a given set."""
    return community.community_search(e, _asked(e, [(0, 3, "kplex", 2.0, list(_INSIDE))]), timeout=60.0).select("query_id", "size", "valid")


@query("nation", "select 9::bigint query_id, 999::bigint seed, 0::bigint size, false as valid, false as timed_out")
def community_missing_seed(e):
    """A seed that is not in the graph."""
    return community.community_search(e, _asked(e, [(9, 999, "flexi", 0.8, None)])).select("query_id", "seed", "size", "valid", "timed_out")


@query(sql="""with x(query_id, id) as (select r_regionkey, n_nationkey from region, nation where n_nationkey % 5 <= r_regionkey),
  t as (select n_nationkey id, n_regionkey c from nation), z as (select query_id, min(id) seed, count(*) nf from x group by 1), s as (select z.*, t.c from z join t on t.id = seed),
  b as (select s.query_id, any_value(s.nf) nf, any_value(s.c) c, sum((t.c = s.c)::bigint) nb from s join x using (query_id) join t on t.id = x.id group by 1),
  w as (select c, count(*) nt from t group by c)
  select b.query_id::bigint query_id, nf::bigint n_found, nt::bigint n_truth, nb::bigint n_both, nb / nf as precision, nb / nt as recall,
  case when nb > 0 then 2 * (nb / nf) * (nb / nt) / (nb / nf + nb / nt) else 0 end::double f1 from b join w using (c)""")
def community_recovery(spark, sf_dir):
    """Precision, recall and F1 of given result sets against regions."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    found = r.join(n, F.col("n_nationkey") % 5 <= F.col("r_regionkey")).groupBy(F.col("r_regionkey").cast("bigint").alias("query_id")).agg(F.sort_array(F.collect_list(F.col("n_nationkey").cast("bigint"))).alias("nodes"))  # 25 nations
    found = found.withColumn("seed", F.get("nodes", F.lit(0)))
    return community.recovery(found, n.select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_regionkey").alias("community")))


# ---- dynamic connectivity ---------------------------------------------------------------------------------------
_OPS = [(i, "delete" if i % 3 == 2 else "insert", 1000 + (7 * i) % 12, (5 * i + 3) % 12 + (1000 if i % 2 else 0)) for i in range(24)]
_LIVES = f""", o(seq, op, u, v) as (values {", ".join(f"({i}, '{o}', {min(u, v)}::bigint, {max(u, v)}::bigint)" for i, o, u, v in _OPS)}),
  t as (select seq q from o), k as (select q, u, v, max_by(op, seq) op from (select q, a u, b v, -1 seq, 'insert' op from t, e union all select q, u, v, seq, op from t, o where seq <= q) where u <> v group by all),
  l as (select q, u, v from k where op = 'insert' union all select q, v, u from k where op = 'insert'),
  n as (select q, id from t, (select a id from e union select b from e union select u from o union select v from o)), r(q, s, t) as (select q, id, id from n union select r.q, r.s, l.v from r join l on l.q = r.q and l.u = r.t)"""


def _told(e):
    return e.sparkSession.createDataFrame(_OPS, "seq long, op string, u long, v long")


@query(G, f"{_LIVES} select q::bigint seq, count(distinct c)::bigint n_components from (select q, s, min(t) c from r group by q, s) group by q")
def dynamic_components(e):
    """Component count of the graph and twelve further vertices after each of 24 edge operations."""
    return dynamic.component_counts(e, _told(e), block=10)


_PAIRS = [(i, i, 1000 + i % 12, (i * 5) % 12 + (1000 if i % 3 else 0)) for i in range(24)]


@query(G, f"{_LIVES}, x(ask, q, u, v) as (values {', '.join(map(str, _PAIRS))}) select ask::bigint ask, x.q::bigint seq, x.u = x.v or count(r.t) > 0 as connected from x left join r on r.q = x.q and r.s = x.u and r.t = x.v group by ask, x.q, x.u, x.v")
def dynamic_connected(e):
    """Whether pairs of vertices are connected after given edge operations."""
    return dynamic.connected_after(e, _told(e), e.sparkSession.createDataFrame(_PAIRS, "ask long, seq long, u long, v long"), block=10)


# ---- text formats -----------------------------------------------------------------------------------------------
_LINES = ["# comment", "", "1 2", "2\t1", "3 3", "4 5 extra", "x y", "6", "7  8 ", "5 4", "9 9999999999"]


@query(sql="select * from (values (1::bigint, 2::bigint), (4, 5), (7, 8), (9, 9999999999)) t(src, dst)")
def edge_text_parse(spark, sf_dir):
    """Edges of a dirty edge list."""
    return io.canonical(io.parse_edges(spark.createDataFrame([(x,) for x in _LINES], "value string")))


_ASKS = ["# c", "3 flexi 0.8", "4 quasi 0.5 1,2,,x,7", "5 other 1", "bad", "6 kplex 2"]


@query(sql="""select * from (values (1::bigint, 3::bigint, 'flexi', 0.8::double, '', true), (2, 4, 'quasi', 0.5, '1,2,7', true), (3, 5, 'other', 1.0, '', false), (4, null, null, null, '', false), (5, 6, 'kplex', 2.0, '', true)) t(line, seed, model, param, restrict, ok)""")
def query_text_parse(spark, sf_dir):
    """Queries of a query list, malformed ones marked."""
    lines = spark.createDataFrame(list(enumerate(_ASKS)), "line long, value string")
    return io.parse_queries(lines).withColumn("restrict", F.coalesce(F.array_join(F.col("restrict").cast("array<string>"), ","), F.lit("")))
# fmt: on
