"""Embedding near-dedup: collision counting over sorted one-dimensional projections.

Vectors of equal label and dimension are compared by cosine. Each has ``PROJECTIONS`` projections on random
directions. In a tile (a block of queries and a block of vectors) every projection is sorted, a window is centred on
each query's value, and the vectors in it collide; pairs with at least as many collisions as all but one in
``1 / MISS`` pairs at the threshold have (the binomial count is calibrated for that) are verified in double precision.

Equal vectors are one class with a count, so copies cost nothing. Labels with more classes than ``CELL`` are cut into
grid cells on the first projections, one more axis for each doubling; a query also visits the cells within ``HALO``
of its value, so a linked pair is lost on an axis with a probability below one in a thousand. Cells are worked in tiles of
bounded size, whatever their size. A tile returns sums of link counts and a spanning forest, never all its pairs.

Defined results: a vector that is null, empty, zero, or holds null or non-finite components, or has a null label, has
no links, is its own component and is kept; vectors of different dimension do not link; repeated rows count as other
vectors; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.links import components
from knotwork.llm.scratch import materialize

THRESHOLD = 0.98
PROJECTIONS = 24
#: Part of the pairs at the threshold that fall in a query's window on one projection.
INSIDE = 0.9
MISS = 0.002
CELL = 16_384
TILE = 2_048
#: Width of a cell, and how far a query looks beyond its own, in units of the vectors' spread on a projection.
WIDTH = 2.0
HALO = 3.3


def calibrated(projections: int = PROJECTIONS, inside: float = INSIDE, miss: float = MISS) -> int:
    """The largest count that a pair at the threshold falls short of with a probability of at most ``miss``."""
    below = 0.0
    for count in range(projections + 1):
        below += math.comb(projections, count) * inside**count * (1 - inside) ** (projections - count)
        if below > miss:
            return count
    return projections


def _quantile(p: float) -> float:
    """x with P(|N(0, 1)| <= x) = p."""
    low, high = 0.0, 10.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erf(mid / math.sqrt(2)) < p else (low, mid)
    return high


def directions(dim: int, projections: int = PROJECTIONS) -> np.ndarray:
    """The fixed random directions of a dimension."""
    return np.random.default_rng(dim).standard_normal((dim, projections))


def _unit(vectors: np.ndarray) -> np.ndarray:
    # scaled first, so that neither huge nor tiny components overflow in the norm
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _dealt(axes: int, reach: float):
    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            vectors = batch.column("embedding").to_pylist()
            rows, cells, home = [], [], []
            for i, v in enumerate(vectors):
                x = _unit(np.array([v], np.float64)) @ directions(len(v))[:, :axes] if axes else np.zeros((1, 0))
                own = np.floor(x[0] / WIDTH).astype(int)
                spots = [()]
                for k in range(axes):
                    first, last = math.floor((x[0, k] - reach) / WIDTH), math.floor((x[0, k] + reach) / WIDTH)
                    spots = [(*s, c) for s in spots for c in range(first, last + 1)]
                for s in spots:
                    rows.append(i)
                    cells.append(",".join(map(str, s)))
                    home.append(s == tuple(own.tolist()))
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*[taken.column(c) for c in ("label", "dim", "cid", "n", "embedding")], pa.array(cells), pa.array(home)], names=["label", "dim", "cid", "n", "embedding", "cell", "home"])

    return run


def _tile(threshold: float):
    delta = math.sqrt(2 * (1 - threshold))
    window, least = _quantile(INSIDE) * delta, calibrated()

    def run(key, rows):
        q, h = key[3].as_py(), key[4].as_py()
        cid, n = rows.column("cid").to_numpy(), rows.column("n").to_numpy()
        vectors = _unit(np.array(rows.column("embedding").to_pylist(), np.float64))
        at, home = rows.column("part").to_numpy(), rows.column("home").to_numpy(zero_copy_only=False)
        asks, held = np.flatnonzero(at == q), np.flatnonzero((at == h) & home)
        empty = pa.table({"cid": pa.array([], pa.int64()), "root": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        if not len(asks) or not len(held):
            return empty
        seen = vectors @ directions(vectors.shape[1])
        order = [np.argsort(seen[held, j], kind="stable") for j in range(PROJECTIONS)]
        lines = [seen[held, j][o] for j, o in enumerate(order)]
        first, second = [], []
        for i in asks:
            hits = np.zeros(len(held), np.uint8)
            for j in range(PROJECTIONS):
                a, b = np.searchsorted(lines[j], (seen[i, j] - window, seen[i, j] + window))
                hits[order[j][a:b]] += 1
            near = held[hits >= least]
            near = near[(vectors[near] @ vectors[i] >= threshold) & (cid[near] != cid[i])]
            first.append(np.full(len(near), i))
            second.append(near)
        first, second = np.concatenate(first), np.concatenate(second)
        links = np.bincount(first, weights=n[second], minlength=len(cid)).astype(np.int64)
        label = np.arange(len(cid))
        while len(first):
            low = label.copy()
            np.minimum.at(low, first, label[second])
            np.minimum.at(low, second, label[first])
            low = low[low]
            if (low == label).all():
                break
            label = low
        own = np.flatnonzero(links > 0)
        tied = np.flatnonzero(label != np.arange(len(cid)))
        return pa.table({
            "cid": pa.array(np.concatenate([cid[own], cid[tied]])),
            "root": pa.array(np.concatenate([cid[own], cid[label[tied]]])),
            "n": pa.array(np.concatenate([links[own], np.zeros(len(tied), np.int64)])),
        })

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("bigint").alias("label"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    rows = rows.withColumns({"k1": F.when(F.col("good"), F.xxhash64("embedding")), "k2": F.when(F.col("good"), F.xxhash64(F.lit(2), "embedding"))})
    classes = rows.where("good").groupBy("label", "k1", "k2").agg(F.first("embedding").alias("embedding"), F.count("*").alias("n"), F.min("vec_id").alias("rep"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("cid"), F.size("embedding").alias("dim"), "*"), "vector-classes")
    largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    axes = min(PROJECTIONS, max(0, math.ceil(math.log2(largest / CELL)))) if largest else 0
    reach = HALO * math.sqrt(2 * (1 - threshold))
    dealt = classes.select("label", "dim", "cid", "n", "embedding").mapInArrow(_dealt(axes, reach), "label long, dim int, cid long, n long, embedding array<double>, cell string, home boolean")
    dealt = materialize(dealt, "vector-cells")
    sizes = dealt.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
    placed = dealt.join(sizes, ["label", "dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    # a row asks in the tiles of its own part, and is held, at home, in those of every part
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    tiles = F.array_distinct(F.concat(F.transform(every, lambda x: F.struct(F.col("part").alias("q"), x.alias("h"))), F.when(F.col("home"), F.transform(every, lambda x: F.struct(x.alias("q"), F.col("part").alias("h")))).otherwise(F.array().cast("array<struct<q:int,h:int>>"))))
    spread = placed.select("label", "dim", "cell", "cid", "n", "embedding", "home", "part", F.explode(tiles).alias("t")).select("*", "t.q", "t.h").drop("t")
    found = materialize(spread.groupBy("label", "dim", "cell", "q", "h").applyInArrow(_tile(threshold), "cid long, root long, n long"), "vector-links")
    links = found.groupBy("cid").agg(F.sum("n").alias("links"))
    tree = components(found.where("cid != root").select(F.col("cid").alias("a"), F.col("root").alias("b")))
    named = classes.select("cid", "label", "k1", "k2", "n", "rep").join(links, "cid", "left").join(tree.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    names = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(names, "root").select("label", "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    linked = rows.where("good").select("vec_id", "label", "k1", "k2").join(named, ["label", "k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE_SQL = f"""
with v as (select row_number() over () r, vec_id, embedding::double[] e, label from embeddings),
g as (select * from v where label is not null and e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
p as (select a.r a, b.r b, a.vec_id av, b.vec_id bv from g a join g b on a.label = b.label and a.r <> b.r and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach as (select * from (with recursive c(s, t) as (select distinct a, a from p union select c.s, p.b from c join p on p.a = c.t) select * from c)),
k as (select s, min(v.vec_id) comp from reach join v on v.r = t group by s),
n as (select a, count(*) links from p group by a)
select v.vec_id, coalesce(n.links, 0)::bigint n_links, coalesce(k.comp, v.vec_id)::bigint component_id, v.vec_id = coalesce(k.comp, v.vec_id) kept
from v left join k on k.s = v.r left join n on n.a = v.r
"""
