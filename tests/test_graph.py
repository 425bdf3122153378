import random
import time
from itertools import combinations

import pytest

from knotwork.functions.thresholds import python_threshold
from knotwork.__main__ import main
from knotwork.functions import udtf
from knotwork.operators import branching, community, dynamic, graph, kernels, local, peeling, solvers
from knotwork.plans import graph_queries
from knotwork.sources import edges as io
from knotwork.sources.samples import dolphin_pairs, dolphins
from knotwork.streaming import components as stream

GRAPHS = {
    "k5": list(combinations(range(5), 2)),
    "path": [(0, 1), (1, 2), (2, 3)],
    "bowtie": [(0, 1), (0, 2), (1, 2), (2, 3), (2, 4), (3, 4)],
    "two": [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5)],
    "star": [(0, i) for i in range(1, 6)],
}
SIZES = [("k5", 0.5, 5), ("k5", 0.9, 5), ("path", 0.8, 2), ("path", 0.5, 3), ("path", 0.3, 4), ("bowtie", 0.8, 3), ("bowtie", 0.6, 5), ("two", 0.6, 3), ("star", 0.3, 6), ("star", 0.5, 3), ("star", 0.8, 2)]


@pytest.fixture(scope="module")
def df(spark):
    return lambda pairs: io.canonical(spark.createDataFrame(pairs, "src long, dst long"))


SWITCHES = [{}, *({k: False} for k in ("degree_rule", "diameter_rule", "size_bound", "saturation", "sibling_break", "followers", "global_rule")), *({"order": x} for x in ("degree_asc", "degree_desc", "random"))]


def some_graph(seed, most=9):
    r = random.Random(seed)
    n, p = r.randint(3, most), r.uniform(0.15, 0.9)
    return n, [e for e in combinations(range(n), 2) if r.random() < p] or [(0, 1)]


def searched(pairs, tau, kind=branching.PrefixSearch, **options):
    ids = sorted({v for p in pairs for v in p})
    adj = kernels.masks_of(ids, pairs)
    need, options = python_threshold("flexi", tau), kernels.SolverOptions(**options)
    run = kernels.Search(adj, need, True, options=options) if kind is kernels.Search else kind(adj, need, options=options)
    rest = (1 << len(ids)) - 1
    for v in range(len(ids)):
        run.run(1 << v, rest)
        rest &= ~(1 << v)
    return run.best_size


def listed(n, pairs, tau, seed=None):
    adj, need = kernels.masks_of(list(range(n)), pairs), python_threshold("flexi", tau)
    return max((x.bit_count() for x in range(1, 1 << n) if (seed is None or x >> seed & 1) and kernels.feasible(adj, x, need, True)), default=0)


# ---- plain versions of the peeling heuristics, from their definitions
class Plain:
    def __init__(self, pairs, tau):
        self.near = {}
        for a, b in pairs:
            self.near.setdefault(a, set()).add(b)
            self.near.setdefault(b, set()).add(a)
        self.tau, self.need = tau, python_threshold("flexi", tau)

    def parts(self, inside):
        out, left = [], set(inside)
        while left:
            got, front = set(), [min(left)]
            while front:
                v = front.pop()
                if v not in got:
                    got.add(v)
                    front += self.near[v] & left
            out.append(got)
            left -= got
        return sorted(out, key=min)

    def degree(self, v, inside):
        return len(self.near[v] & inside)

    def feasible(self, inside):
        return len(inside) > 1 and len(self.parts(inside)) == 1 and all(self.degree(v, inside) >= self.need(len(inside)) for v in inside)

    def core(self, k):
        now = set(self.near)
        while weak := {v for v in now if self.degree(v, now) < k}:
            now -= weak
        return now

    def seed(self):
        top = max(k for k in range(1, len(self.near)) if self.core(k))
        for k in range(2, top + 1):
            part = max(self.parts(self.core(k)), key=len)
            if self.need(len(part)) <= k:
                return k, part, top
        return None, set(), top

    def around(self, part, k):
        return next(p for p in self.parts(self.core(k)) if part <= p)

    def npa(self):
        k, part, top = self.seed()
        part = part or max(self.parts(self.core(top)), key=len)
        now = self.around(part, (k or 1) - 1)
        while len(now) > 1:
            if self.feasible(now):
                return now
            free = [v for v in now if len(self.parts(now - {v})) == 1]
            now = now - {min(free, key=lambda v: (self.degree(v, now), v))}
        return set()

    def fpa(self):
        k, part, top = self.seed()
        now = self.around(part, k - 1) if k else self.core(top - 1)
        best = part if part and self.feasible(part) else set()
        came = {v: i for i, v in enumerate(sorted(now))}
        stamp = len(came)
        while len(now) > len(best):
            if min(self.degree(v, now) for v in now) >= self.need(len(now)):
                return now
            n = len(self.parts(now))
            free = [v for v in now if self.near[v] & now and len(self.parts(now - {v})) == n]
            if not free:
                break
            v = min(free, key=lambda v: (self.degree(v, now), came[v]))
            now = now - {v}
            for w in sorted(self.near[v] & now):
                came[w] = stamp = stamp + 1
        return best

    def greedy(self, inside):
        best, queue = set(), sorted(self.parts(inside), key=lambda p: -len(p))
        while queue:
            now = set(queue.pop(0))
            low = min(self.degree(v, now) for v in now)
            if len(now) <= len(best) or (int(low ** (1 / self.tau)) if low else 0) <= len(best):
                continue
            while now:
                v = min(now, key=lambda v: (self.degree(v, now), v))
                if self.degree(v, now) >= self.need(len(now)):
                    parts = self.parts(now)
                    if len(parts) == 1:
                        best = now if len(now) > len(best) else best
                    else:
                        queue += [p for p in parts if len(p) > len(best)]
                    break
                now.remove(v)
        return best

    def multi_seed(self, cap=5000):
        best, covered = self.fpa(), set()
        for v in sorted(self.near, key=lambda v: (-len(self.near[v]), v)):
            if v in covered or len(self.near[v]) < 2:
                continue
            ball, layer = [v], [v]
            for _ in range(2):
                fresh = []
                for u in layer:
                    for w in sorted(self.near[u]):
                        if w not in ball and len(ball) < cap:
                            ball.append(w)
                            fresh.append(w)
                layer = fresh
            covered |= set(ball)
            if len(ball) > len(best):
                found = self.greedy(set(ball))
                best = found if len(found) > len(best) else best
        return best


def test_peeling_is_brute_force():
    graphs = [some_graph(s, 22)[1] for s in range(150)] + list(GRAPHS.values()) + [dolphin_pairs()]
    for i, pairs in enumerate(graphs):
        for tau in ((0.3, 0.5, 0.6, 0.7, 0.8, 0.9)[i % 6], 0.75) if len(pairs) != 159 else (0.5, 0.7, 0.9):
            plain, g, need = Plain(pairs, tau), peeling.Neighbours(pairs), python_threshold("flexi", tau)
            named = lambda found: {g.ids[v] for v in found[0]}  # noqa: B023, E731
            assert named(peeling.npa(g, need)) == plain.npa()
            assert named(peeling.fpa(g, need)) == plain.fpa()
            assert named(peeling.greedy(g, need, tau)) == plain.greedy(set(plain.near))
            assert named(peeling.multi_seed(g, need, tau)) == plain.multi_seed()


def test_peeling_of_a_large_graph_is_quick():
    r = random.Random(1)
    pairs = list({tuple(sorted(r.sample(range(20_000), 2))) for _ in range(80_000)}) + [(i, i + 1) for i in range(20_000, 24_000)] + [(0, 20_000)]
    found, late = peeling.npa(peeling.Neighbours(pairs), python_threshold("flexi", 0.9), time.monotonic() + 60)
    assert not late
    _, late = peeling.npa(peeling.Neighbours(pairs), python_threshold("flexi", 0.9), 0)
    assert late


def test_search_is_brute_force_with_every_switch():
    for s in range(200):
        n, pairs = some_graph(s)
        tau = (0.3, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)[s % 7]
        adj, need, want = kernels.masks_of(list(range(n)), pairs), python_threshold("flexi", tau), listed(n, pairs, tau)
        for options in SWITCHES:
            assert searched(pairs, tau, **options) == max(want, 1)
            run = branching.SeededSearch(adj, need, 1, 1, options=kernels.SolverOptions(**options))
            run.run(1, (1 << n) - 1)
            assert run.best_size == listed(n, pairs, tau, 0)
        assert searched(pairs, tau, kernels.Search) == max(want, 1)


def test_followers_fall_with_a_vertex():
    run = branching.SeededSearch(kernels.masks_of(list(range(6)), GRAPHS["two"]), lambda n: n - 1, best_size=2)
    assert run.followers(0, 0b111111) == 0b000110


@pytest.mark.parametrize(("algo", "tau", "size"), [("ebac", 0.9, 5), ("npa", 0.9, 5), ("fpa", 0.9, 5), ("multiseed", 0.9, 5)])
def test_dolphins(spark, algo, tau, size):
    row = solvers.max_subgraph(dolphins(spark), tau, algo).first()
    assert (row["size"], row["valid"], row["timed_out"], len(row["nodes"])) == (size, True, False, size)


def test_trace_counts_the_nodes_of_the_search(spark):
    got = solvers.search_trace(dolphins(spark), 0.7, kernels.SolverOptions(warm_start=False)).collect()
    assert got and all(r.depth >= 1 and r.width >= 1 and r.n >= 1 for r in got)


@pytest.mark.parametrize("seed", [3])
def test_one_task_equals_rounds_of_jobs(spark, df, monkeypatch, seed):
    pairs = some_graph(seed, 9)[1] + [(30, 31), (31, 32), (30, 32)]
    e = df(pairs)
    rows = lambda x: sorted(map(tuple, x.collect()))
    every = lambda: [rows(f) for f in (graph.components(e), graph.core_numbers(e), graph.k_core(e, 2), graph.core_levels(e, graph.core_numbers(e), 0.7))]
    small, best = every(), solvers.exact(e, 0.7).first()["size"]
    monkeypatch.setattr(local, "KERNEL_EDGES", 0)
    assert every() == small
    row = solvers.exact(e, 0.7).first()
    assert (row["size"], row["valid"], row["timed_out"]) == (best, True, False)
    for f in (solvers.npa, solvers.fpa, solvers.mgpp, solvers.multi_seed):
        row = f(e, 0.7).first()
        assert row["size"] <= best and row["valid"] == (row["size"] > 0)


def test_a_giant_component_is_cut_to_forests(df, monkeypatch):
    pairs = [(a, b) for a, b in combinations(range(14), 2)] + [(13, 20), (20, 21), (21, 22), (20, 22), (22, 30), (30, 31), (31, 32), (30, 32)]
    monkeypatch.setattr(local, "KERNEL_EDGES", 10)
    assert sorted(r.id for r in solvers.cut_vertices(df(pairs)).collect()) == [13, 20, 22, 30]
    monkeypatch.setattr(local, "KERNEL_EDGES", 1)
    with pytest.raises(ValueError, match="too many"):
        solvers.cut_vertices(df([(a, 10 + b) for a in range(2) for b in range(20)]))
    found, late = solvers._large_peel(df(pairs), python_threshold("flexi", 0.9), None)
    assert (sorted(found), late) == (list(range(14)), False)


@pytest.mark.parametrize(("name", "tau", "size"), SIZES)
def test_search_sizes(name, tau, size):
    pairs = GRAPHS[name]
    assert searched(pairs, tau) == size
    for options in SWITCHES:
        assert searched(pairs, tau, **options) == size


@pytest.mark.parametrize(("name", "tau", "size"), SIZES[::3])
def test_solvers_agree(df, name, tau, size):
    e = df(GRAPHS[name])
    assert solvers.bitmask(e, "flexi", tau).first()[0] == size
    assert solvers.set_enumeration(e, tau).first()[0] == size
    for algo in ("ebac", "se", "naive"):
        row = solvers.max_subgraph(e, tau, algo).first()
        assert (row["size"], row["valid"], len(row["nodes"])) == (size, True, size)
        assert algo != "naive" or row["branches"] > 0 and row["conn_checks"] > 0


def test_quasi_and_kplex_ignore_connection(df):
    e = df(GRAPHS["two"])
    assert solvers.bitmask(e, "quasi", 0.4).first()[0] == 6 and solvers.bitmask(e, "kplex", 4.0).first()[0] == 6


def test_empty_graph(spark, df):
    e = io.empty_graph(spark)
    assert graph.core_numbers(e).count() == graph.components(e).count() == 0
    assert solvers.npa(e, 0.5).first()["size"] == solvers.exact(e, 0.5).first()["size"] == 0
    with pytest.raises(ValueError, match="tau"):
        solvers.npa(e, 1.5)


def test_cut_vertices_and_cores():
    assert peeling.cut_vertices(peeling.Neighbours(GRAPHS["path"])) == {1, 2}
    assert peeling.core_numbers(peeling.Neighbours(GRAPHS["bowtie"])) == [2] * 5
    for s in range(40):
        g = peeling.Neighbours(some_graph(s, 12)[1])
        every = set(range(len(g)))
        assert peeling.cut_vertices(g) == {v for v in every if len(g.parts(every - {v})) > len(g.parts(every))}


def test_sinks_round_trip(spark, tmp_path):
    row = spark.createDataFrame([(3, "flexi", 0.5, 2, 0.25, True, False, [1, 3])], "seed long, model string, param double, size long, time_sec double, valid boolean, timed_out boolean, nodes array<long>")
    io.write_results(row, str(tmp_path / "deep/out"))
    assert spark.read.text(str(tmp_path / "deep/out")).first()[0] == "seed=3 model=flexi param=0.5 size=2 time=0.250000 valid=1 timeout=0 nodes=1,3"
    path = tmp_path / "e.txt"
    path.write_text("# c\r\n1 2\r\n2\t1\r\n\r\n3 3\r\n4 5 6\r\n")
    assert sorted(map(tuple, io.read_edges(spark, str(path)).collect())) == [(1, 2), (4, 5)]


def test_dynamic_counts(spark, df):
    ops = spark.createDataFrame([(0, "insert", 0, 1), (1, "insert", 1, 2), (2, "insert", 1, 0), (3, "delete", 0, 1), (4, "delete", 5, 6), (5, "insert", 3, 3), (6, "insert", 0, 2)], "seq long, op string, u long, v long")
    for block in (2, 100):
        got = [r[1] for r in dynamic.component_counts(df([(3, 4)]), ops, 5, block).orderBy("seq").collect()]
        assert got == [3, 2, 2, 3, 3, 3, 2]


def test_stream_tracks_components(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, 2), (3, 4)], "src long, dst long").coalesce(1).write.parquet(source)
    read = lambda: spark.readStream.schema("src long, dst long").parquet(source)
    stream.track_components(read(), str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([(4, 2)], "src long, dst long").coalesce(1).write.mode("append").parquet(source)
    stream.track_components(read(), str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "state/v=1")).select("id", "comp").collect()} == {(1, 1), (2, 1), (3, 1), (4, 1)}


def test_missing_seed_and_restriction(spark, df):
    asks = spark.createDataFrame([(0, 2, "flexi", 0.8, None), (1, 77, "flexi", 0.8, None), (2, 2, "kplex", 1.0, [2, 3, 4, 99])], "query_id long, seed long, model string, param double, restrict array<long>")
    got = {r.query_id: (r["size"], r.valid) for r in community.community_search(df(GRAPHS["bowtie"]), asks).collect()}
    assert got == {0: (3, True), 1: (0, False), 2: (3, True)}


def test_size_bounds_have_no_cap(spark, df):
    wide = [(0, i) for i in range(1, 2600)] + [(1, i) for i in range(2, 2600)]
    for pairs in (wide, list(combinations(range(61), 2)), GRAPHS["bowtie"]):
        adj = {}
        for a, b in pairs:
            adj.setdefault(a, set()).add(b)
            adj.setdefault(b, set()).add(a)
        ids = sorted(adj)
        top = max(peeling.core_numbers(peeling.Neighbours(pairs)))
        degrees = sorted((len(x) for x in adj.values()), reverse=True)
        e = df(pairs)
        low = dict(graph_queries.degeneracy_bound(e).collect())
        high = dict(graph_queries.size_upper_bound(e).collect())
        for tau in graph_queries.TAUS:
            need = python_threshold("flexi", tau)
            fits = [k for k in range(2, 6000) if need(k) <= top]
            assert low[tau] == max(fits) < 5999
            assert high[tau] == max(k for k in range(1, len(degrees) + 1) if k == 1 or degrees[k - 1] >= need(k))


def test_seeds_lie_outside_earlier_balls(df):
    hub = [(a, 45 + b) for a in range(45) for b in range(45)]  # all degrees above the clique's, no set above 2 at tau 0.9
    clique = [(200 + a, 200 + b) for a, b in combinations(range(10), 2)]
    row = solvers.multi_seed(df(hub + clique), 0.9).first()
    assert (row["size"], row["valid"]) == (10, True)
    trail = [(i, i + 1) for i in range(12)] + [(3, 20), (4, 21), (9, 22)]
    near = {v: {b if a == v else a for a, b in trail if v in (a, b)} for v in {v for p in trail for v in p}}
    covered, want = set(), []
    for v in sorted(near, key=lambda v: (-len(near[v]), v)):
        if v not in covered and len(near[v]) >= 2 and len(want) < 3:
            want.append(v)
            covered |= {v} | near[v] | {x for w in near[v] for x in near[w]}
    assert sorted({r.key for r in solvers.spread_balls(df(trail), 3, 2, 5000).collect()}) == sorted(want)


def test_exact_and_heuristic_queries_run_on_every_nation(spark, tmp_path):
    strong = list(combinations((3, 7, 20, 21, 22, 23, 24), 2)) + [(3, 11), (7, 11), (11, 24)]
    trades = [(a, b) for a, b in strong for _ in range(3)] + [(a, 12) for a in range(10)]
    table = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    table("customer", [(v, v) for v in range(25)], "c_custkey long, c_nationkey int")
    table("supplier", [(v, v) for v in range(25)], "s_suppkey long, s_nationkey int")
    table("orders", [(i, a) for i, (a, _) in enumerate(trades)], "o_orderkey long, o_custkey long")
    table("lineitem", [(i, b) for i, (_, b) in enumerate(trades)], "l_orderkey long, l_suppkey long")
    ids = sorted({v for p in strong for v in p})
    adj = kernels.masks_of(ids, strong)

    def largest(model, param, seed=None):
        need = python_threshold(model, param)
        sets = [x for x in range(1, 1 << len(ids)) if seed is None or x >> ids.index(seed) & 1]
        return max(x.bit_count() for x in sets if kernels.feasible(adj, x, need, model == "flexi"))

    run = lambda name: graph_queries.QUERIES[name](spark, str(tmp_path))
    best = largest("flexi", 0.8)
    assert best >= 7
    for name in ("exact_flexi_bitmask", "exact_flexi_se", "exact_flexi_cp"):
        assert run(name).first()["size"] == best
    assert [run(f"exact_{m}").first()["size"] for m in ("quasi", "kplex")] == [largest("quasi", 0.8), largest("kplex", 2.0)]
    assert [run(f"exact_seeded_{m}").first()["size"] for m in ("flexi", "quasi", "kplex")] == [largest("flexi", 0.8, 3), largest("quasi", 0.8, 3), largest("kplex", 2.0, 3)]
    for name in ("npa", "fpa", "mgpp", "multiseed"):
        row = run(name).first()
        assert (row["valid"], row["named"]) == (True, True) and 2 <= row["size"] <= best
    got = {r.query_id: r["size"] for r in run("community_batch").collect()}
    assert got == {q: largest(m, p, s) for q, s, m, p, _ in graph_queries._BATCH}


def test_models_of_one_s_own(spark, df):
    triangle = community.Model(lambda p: lambda n: 0 if n < 2 else min(int(p), n - 1), connected=True)
    asks = spark.createDataFrame([(0, 0, "triangle", 2.0, None), (1, 0, "unknown", 2.0, None)], "query_id long, seed long, model string, param double, restrict array<long>")
    got = {r.query_id: (r["size"], r.valid) for r in community.community_search(df(GRAPHS["bowtie"]), asks, models={"triangle": triangle}).collect()}
    assert got == {0: (5, True), 1: (0, False)}
    assert solvers.exact(df(GRAPHS["bowtie"]), 0.8, need=lambda n: 0 if n < 2 else min(2, n - 1)).first()["size"] == 5


def test_table_function(spark, df):
    udtf.register(spark)
    rows = spark.createDataFrame([(q, 0, m, p, a, b) for q, m, p in ((0, "flexi", 0.8), (1, "kplex", 2.0)) for a, b in GRAPHS["bowtie"]], "query_id long, seed long, model string, param double, src long, dst long")
    rows.createOrReplaceTempView("region_rows")
    got = {r.query_id: r["size"] for r in spark.sql("select * from solve_region(table(region_rows) partition by query_id)").collect()}
    assert got == {0: 3, 1: listed_kplex(GRAPHS["bowtie"], 2, 0)}


def listed_kplex(pairs, k, seed):
    ids = sorted({v for p in pairs for v in p})
    adj, need = kernels.masks_of(ids, pairs), python_threshold("kplex", k)
    return max(x.bit_count() for x in range(1 << len(ids)) if x >> seed & 1 and kernels.feasible(adj, x, need, False))


def test_command_line(spark, tmp_path, capsys):
    edges, queries = tmp_path / "e.txt", tmp_path / "q.txt"
    edges.write_text("".join(f"{a} {b}\n" for a, b in GRAPHS["bowtie"]))
    queries.write_text("2 flexi 0.8\n77 flexi 0.8\nbad line\n2 kplex 1 2,3,4\n")
    assert main(["solve", "--file", str(edges), "--tau", "0.6", "--out", str(tmp_path / "r")], spark) == 0
    assert "Size      : 5" in capsys.readouterr().out
    assert {r.value.split("=")[0] for r in spark.read.text(str(tmp_path / "r")).collect()} == {"algorithm", "tau", "size", "time", "valid", "branches", "nodes"}
    assert main(["batch", "--file", str(edges), "--queries", str(queries), "--out", str(tmp_path / "b")], spark) == 0
    assert capsys.readouterr().out.strip() == "processed=2 skipped=2"
    assert spark.read.text(str(tmp_path / "b")).count() == 3


def test_communities_and_first_lines(spark, tmp_path):
    path = tmp_path / "c.txt"
    path.write_text("1 7\n2\t7\n# no\n3 8 9\nx 1\n")
    assert sorted(map(tuple, io.read_communities(spark, str(path)).collect())) == [(1, 7), (2, 7), (3, 8)]
    rows = spark.createDataFrame([(0, 9, 4), (1, 4, 2), (2, 9, 1)], "line long, src long, dst long")
    assert sorted(map(tuple, io.first_appearance(rows, "line").collect())) == [(1, 3), (2, 2), (4, 1), (9, 0)]


def test_connected_after_operations(spark, df):
    r, ops, asks = random.Random(3), [], []
    for i in range(60):
        ops.append((i, r.choice(["insert", "insert", "delete"]), *r.sample(range(9), 2)))
        asks.append((i, i, *r.sample(range(9), 2)))
    base = [(0, 1), (2, 3), (3, 4), (7, 8)]
    made = spark.createDataFrame(ops, "seq long, op string, u long, v long")
    for block in (7, 1000):
        got = {x.ask: x.connected for x in dynamic.connected_after(df(base), made, spark.createDataFrame(asks, "ask long, seq long, u long, v long"), block).collect()}
        counts = {x.seq: x.n_components for x in dynamic.component_counts(df(base), made, 9, block).collect()}
        edges = {frozenset(p) for p in base}
        for i, op, u, v in ops:
            edges = edges | {frozenset((u, v))} if op == "insert" else edges - {frozenset((u, v))}
            g = peeling.Neighbours([tuple(e) for e in edges])
            parts = [{g.ids[x] for x in part} for part in g.parts(set(range(len(g))))]
            assert counts[i] == len(parts) + 9 - len(g)
            assert got[i] == any({asks[i][2], asks[i][3]} <= part for part in parts)


def test_users_seen_together(spark):
    seen = spark.createDataFrame([(w, u) for w, users in enumerate([(1, 2, 3), (1, 2), (3, 4), (2, 3)]) for u in users], "window long, user_id long")
    assert sorted(map(tuple, stream.co_occurrence_edges(seen).collect())) == [(1, 2)]
