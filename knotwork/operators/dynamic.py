"""Components of a graph under a sequence of edge insertions and deletions.

Every edge lives over intervals of the sequence. The sequence is cut into blocks; a block's task gets the edges alive in
it and answers its operations by divide and conquer over time with a union-find that can go back. Edges that
live through the whole sequence are contracted before, by a search for components, so blocks get none of them; those that
live through a block are joined first there. Blocks run in parallel.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.operators import graph
from knotwork.sources.scratch import saved

BLOCK = 4096


def lifetimes(base: DataFrame, ops: DataFrame) -> DataFrame:
    """a, b, start, stop: the spans of operations after which an edge is there (stop exclusive, null for ever).

    ``base`` has src, dst; ``ops`` has seq, op (insert or delete), u, v. Loops, repeated insertions and deletions of
    missing edges change nothing.
    """
    given = base.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.lit(-1).cast("bigint").alias("seq"), F.lit(True).alias("on"))
    told = ops.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), F.col("seq").cast("bigint").alias("seq"), (F.col("op") == "insert").alias("on"))
    rows = given.unionByName(told).where("a < b")
    w = Window.partitionBy("a", "b").orderBy("seq")
    rows = rows.withColumn("was", F.coalesce(F.lag("on").over(w), F.lit(False))).where("on <> was")
    return rows.withColumn("stop", F.lead("seq").over(w)).where("on").select("a", "b", F.col("seq").alias("start"), "stop")


class Forest:
    """Union-find by size that can take back its latest unions."""

    def __init__(self):
        self.up, self.size, self.log, self.joins = {}, {}, [], 0

    def find(self, x):
        """The root of ``x``."""
        while self.up.get(x, x) != x:
            x = self.up[x]
        return x

    def union(self, x, y):
        """Join two trees; counted in ``joins`` if they were two."""
        x, y = self.find(x), self.find(y)
        if x == y:
            return
        if self.size.get(x, 1) < self.size.get(y, 1):
            x, y = y, x
        self.up[y] = x
        self.size[x] = self.size.get(x, 1) + self.size.get(y, 1)
        self.log.append((x, y))
        self.joins += 1

    def back(self, mark: int):
        """Undo all unions after the first ``mark``."""
        while len(self.log) > mark:
            x, y = self.log.pop()
            self.up[y] = y
            self.size[x] -= self.size.get(y, 1)
            self.joins -= 1


def _count(block: int):
    def run(key, spans, ops):
        first = key[0].as_py() * block
        rows = ops.to_pylist()
        seqs = sorted({r["seq"] for r in rows if r["ask"] is None})
        at = {s: i for i, s in enumerate(seqs)}
        asks: dict[int, list[dict]] = {}
        for r in rows:
            if r["ask"] is not None and r["seq"] in at:
                asks.setdefault(at[r["seq"]], []).append(r)
        forest, edges, out = Forest(), [], []
        for a, b, start, stop in zip(*[spans.column(c).to_pylist() for c in ("a", "b", "start", "stop")], strict=True):
            lo = at.get(start, 0) if start >= first else 0
            hi = at[stop] if stop is not None and stop in at else len(seqs)
            if lo == 0 and hi == len(seqs):
                forest.union(a, b)
            elif lo < hi:
                edges.append((a, b, lo, hi))
        todo = [(0, len(seqs), edges, None)] if seqs else []
        while todo:
            lo, hi, own, mark = todo.pop()
            if mark is not None:
                forest.back(mark)
                continue
            mark = len(forest.log)
            rest = []
            for e in own:
                if e[2] <= lo and hi <= e[3]:
                    forest.union(e[0], e[1])
                else:
                    rest.append(e)
            if hi - lo == 1:
                out.append({"seq": seqs[lo], "ask": None, "joins": forest.joins, "linked": None})
                out += [{"seq": seqs[lo], "ask": r["ask"], "joins": None, "linked": forest.find(r["u"]) == forest.find(r["v"])} for r in asks.get(lo, ())]
                forest.back(mark)
                continue
            mid = (lo + hi) // 2
            todo.append((lo, hi, (), mark))
            todo.append((mid, hi, [e for e in rest if e[3] > mid], None))
            todo.append((lo, mid, [e for e in rest if e[2] < mid], None))
        return pa.Table.from_pylist(out, schema=pa.schema([("seq", pa.int64()), ("ask", pa.int64()), ("joins", pa.int64()), ("linked", pa.bool_())]))

    return run


def _answered(base: DataFrame, ops: DataFrame, asks: DataFrame | None, block: int) -> tuple[DataFrame, DataFrame]:
    """(answers, comp): seq, ask, joins, linked; and id, comp of what edges that last for ever connect."""
    spans = saved(lifetimes(base, ops))
    fixed = (F.col("start") < 0) & F.col("stop").isNull()
    comp = saved(graph.components(spans.where(fixed).select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    label = lambda rows, c: rows.join(comp.select(F.col("id").alias(c), F.col("comp").alias(f"{c}_comp")), c, "left").withColumn(c, F.coalesce(f"{c}_comp", c)).drop(f"{c}_comp")
    spans = saved(label(label(spans.where(~fixed), "a"), "b").where("a <> b"))
    top = ops.agg(F.max("seq")).first()[0]
    last = -1 if top is None else top // block
    lo = F.floor(F.greatest("start", F.lit(0)) / block)
    hi = F.coalesce(F.floor((F.col("stop") - 1) / block), F.lit(last)) if last >= 0 else F.lit(-1)
    live = spans.where(lo <= hi).select("a", "b", "start", "stop", F.explode(F.sequence(lo, F.greatest(lo, hi))).alias("block"))
    keyed = ops.select("seq", F.lit(None).cast("bigint").alias("ask"), "u", "v")
    if asks is not None:
        keyed = keyed.unionByName(label(label(asks.select("seq", "ask", "u", "v"), "u"), "v"))
    keyed = keyed.withColumn("block", F.floor(F.col("seq") / block))
    return live.groupBy("block").cogroup(keyed.groupBy("block")).applyInArrow(_count(block), "seq long, ask long, joins long, linked boolean"), comp


def component_counts(base: DataFrame, ops: DataFrame, n: int | None = None, block: int = BLOCK) -> DataFrame:
    """seq, n_components after each operation; ``n`` vertices, by default all that any edge or operation names."""
    ops = saved(ops.select("seq", "op", "u", "v"))
    if n is None:
        ends = base.select(F.explode(F.array("src", "dst")).alias("id")).unionByName(ops.select(F.explode(F.array("u", "v")).alias("id")))
        n = ends.distinct().count()
    found, comp = _answered(base, ops, None, block)
    joined = comp.agg(F.count("*") - F.count_distinct("comp")).first()[0]
    return found.select("seq", (F.lit(n - joined) - F.col("joins")).cast("bigint").alias("n_components"))


def connected_after(base: DataFrame, ops: DataFrame, asks: DataFrame, block: int = BLOCK) -> DataFrame:
    """ask, seq, connected for ``asks`` (ask, seq, u, v): whether u and v are connected after the operation ``seq``.

    Asks about operations that are not there have no answer.
    """
    ops = saved(ops.select("seq", "op", "u", "v"))
    return _answered(base, ops, asks, block)[0].where("ask is not null").select("ask", "seq", F.col("linked").alias("connected"))
