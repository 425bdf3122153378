"""N-gram Jaccard join: an index of count vectors whose leaves are R-trees, then exact verification.

A document's set is its distinct n-word shingles. Shingles are hashed to groups, more of them for larger sets, and a set is
the point of its group counts; points of unlike numbers of groups are compared by the smaller, as each group is
part of one there. The overlap of two sets is at most the sum of the coordinate minima of their points, and that of a set and
any set in a box at most the sum of the minima with the box's upper corner.

The top of the index deals points to buckets without losing a pair. Sets of like size are cut into ``k`` blocks by
a second hash; the content of a block, a point in a subspace, is the bucket's key. Two sets that link differ in at most
E shingles (E follows from sizes and threshold), hence in at most E blocks. A set with more than E blocks that are not
empty shares one of these with every set it links with, so it emits those alone; a set with fewer emits its empty blocks
too, which, as k > E, meets the others of that kind. k is chosen so that hardly any set is of that kind. Equal
sets are one class throughout; a class meets others once.

Keys travel as sorted arrays, one per range of keys. A batch names each key's least member leader and sends only the
leader to the key's range, the others to any range, so a key gets at most one entry a batch however many sets
hold it. Members are first compared with their leaders (a number of pairs linear in the buckets, which settles
groups of near copies). Buckets whose members are then still in several components are joined as R-trees on the
count vectors, in blocks of members; a block verifies the pairs within the bound on the shingles at once, passes over
pairs that it has already connected, and returns a forest of links: fewer rows than it has members.

Defined results: null or wordless texts have an empty set and link with nothing; with fewer words than a shingle the
whole sequence is one; equal rows link with each other; a null id counts for no component's name unless all
are null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.links import components
from knotwork.llm.scratch import discard, guarded, materialize

#: Groups of a set: a power of two, at least so many, and enough for at most so many shingles in each on average.
GROUPS, PER_GROUP = 64, 8
#: Sizes in one class differ by at most this factor.
RATIO = 1.4
#: Classes whose keys may be broadcast (about 40 bytes each); with more, texts are joined by shuffle.
BROADCAST_CLASSES = 400_000
#: Rows that repeat a set, as many as may be broadcast (8 bytes each); with more, keys are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Ranges of keys: at least so many, and one for each so many keys. Keys that are sorted at once.
RANGES, RANGE_KEYS, PACK_KEYS = 128, 200_000, 500_000
#: Members of a bucket that one task joins with as many others, and bytes of their shingles.
MEMBERS, TILE_BYTES = 512, 16 << 20
#: Members of a cluster that one task verifies, and bytes of their shingles; larger ones are verified by buckets.
CLUSTER, CLUSTER_BYTES = 2048, 32 << 20
LEAF = 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_M1, _M2, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """Word -> 64-bit hash, for the words met lately."""

    def __missing__(self, word):
        if len(self) >= 100_000:
            self.clear()
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = found
        return found


def shingle_sets(texts: list[str | None], n: int, hashes: _Hashes) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = [t.encode("utf-8", "surrogatepass").translate(_LOWER).split() if t else [] for t in texts]
    out = []
    for own in words:
        if not own:
            out.append(np.zeros(0, np.uint64))
            continue
        h = np.fromiter(map(hashes.__getitem__, own), np.uint64, len(own))
        width = min(n, len(h))
        s = _mix(h[: len(h) - width + 1] + np.uint64(width))
        for j in range(1, width):
            s = _mix(s * _G + h[j : len(h) - width + 1 + j])
        out.append(np.unique(s))
    return out


class Sizes:
    """Size classes, and the number of blocks of each, for a threshold of p / q."""

    def __init__(self, p: int, q: int):
        self.p, self.q = p, q
        self.known: dict[int, int] = {}

    def group(self, n: int) -> int:
        """The class of size ``n``."""
        g = int(math.log(n) / math.log(RATIO))
        while self.first(g + 1) <= n:
            g += 1
        while self.first(g) > n:
            g -= 1
        return g

    def first(self, g: int) -> int:
        """The least size of class ``g``."""
        return math.ceil(RATIO**g)

    def differ(self, g: int) -> int:
        """Most shingles in which two linked sets differ when the larger is of class ``g``."""
        return 2 * (self.first(g + 1) - 1) * (self.q - self.p) // (self.q + self.p)

    def blocks(self, g: int) -> int:
        """Number of blocks of class ``g``: above what linked sets may differ in, by far more than stay empty."""
        if g not in self.known:
            k = self.differ(g) + 1
            empty = k * math.exp(-(self.first(g + 1) - 1) / k)
            self.known[g] = k + min(math.ceil(1.5 * empty + 4 * math.sqrt(empty)), k)
        return self.known[g]

    def apart(self, n: int, g: int) -> int:
        """Most shingles in which a set of ``n`` differs from one of class ``g`` or less with which it links."""
        return (n + min(n * self.q // self.p, self.first(g + 1) - 1)) * (self.q - self.p) // (self.q + self.p)

    def groups(self, n: int) -> list[int]:
        """The classes in which a set of ``n`` meets others: its own, and those above where a linked one may be."""
        return list(range(self.group(n), self.group(n * self.q // self.p) + 1))

    def linked(self, a: int, b: int, both: int) -> bool:
        """Whether sets of sizes a and b with ``both`` in common reach the threshold."""
        return self.q * both >= self.p * (a + b - both)


def signatures(s: np.ndarray, sizes: Sizes) -> np.ndarray:
    """The bucket keys of a set."""
    out = []
    for g in sizes.groups(len(s)):
        if sizes.differ(g) == 0:
            continue  # only equal sets link here
        k = sizes.blocks(g)
        seed = np.uint64((g * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        mixed = _mix(s ^ seed)
        block = (mixed >> np.uint64(32)) % np.uint64(k)
        order = np.argsort(block, kind="stable")
        ordered = block[order]
        cut = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        content = np.add.reduceat(_mix(mixed + _G)[order], cut)
        out.append(_mix(_mix(content) + ordered[cut] * _G + seed))
        if len(cut) <= sizes.apart(len(s), g):
            empty = np.setdiff1d(np.arange(k, dtype=np.uint64), ordered[cut])
            out.append(_mix(empty * _G + _mix(np.array([seed]))))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def class_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        a, b = _mix(s ^ _G).sum(dtype=np.uint64), _mix(s + _M2).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int((b + np.uint64(len(s))).astype(np.int64))


def counts(s: np.ndarray) -> np.ndarray:
    """The point of a set: counts by group."""
    n = max(GROUPS, 1 << max(0, -(-len(s) // PER_GROUP) - 1).bit_length())
    return np.bincount((s >> np.uint64(20)) % np.uint64(1 << 30) // np.uint64((1 << 30) // n), minlength=n).astype("<u2")


def same_groups(points: list[np.ndarray]) -> np.ndarray:
    """Points as rows of one table, by the least number of groups among them."""
    n = min((len(p) for p in points), default=GROUPS)
    return np.array([p if len(p) == n else p.reshape(n, -1).sum(axis=1) for p in points], np.int32).reshape(len(points), n)


def _points(column) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2") for x in column.to_pylist()]


def _column(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def _first_pass(n: int, sizes: Sizes):
    def run(batches):
        hashes = _Hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = shingle_sets(part.column("text").to_pylist(), n, hashes)
                keys = [class_key(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("th"), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), _column([counts(s).tobytes() for s in sets]), _column([signatures(s, sizes).astype("<u8").tobytes() if len(s) else b"" for s in sets])],
                    names=["doc_id", "th", "n", "c1", "c2", "point", "sigs"],
                )

    return run


def _second_pass(n: int):
    def run(batches):
        hashes = _Hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = [(c, s) for c, k1, k2, s in zip(part.column("cid").to_pylist(), part.column("c1").to_pylist(), part.column("c2").to_pylist(), shingle_sets(part.column("text").to_pylist(), n, hashes), strict=True) if class_key(s) == (k1, k2)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c for c, _ in rows], pa.int64()), _column([s.astype("<u8").tobytes() for _, s in rows])],
                    names=["cid", "shingles"],
                )

    return run


_PACKED = "range long, base long, sigs binary, offs binary, leads binary"
_MET = "sig long, cid long, leader long"


def _pack(n_ranges: int):
    """Keys of many sets -> for each range of keys: the keys, and for each the least row of the batch that has it.

    The other rows of a key go, with that leader, to the range that follows from their own number.
    """
    names = [x.split(" ")[0] for x in _PACKED.split(", ")]

    def entries(base: int, ranges: np.ndarray, sigs: np.ndarray, offs: np.ndarray, leads: np.ndarray | None):
        edges = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1], [True]]))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield int(ranges[lo]), base, sigs[lo:hi].astype("<u8").tobytes(), offs[lo:hi].astype("<u4").tobytes(), b"" if leads is None else leads[lo:hi].astype("<u4").tobytes()

    def packed(base: int, offs: np.ndarray, sigs: np.ndarray):
        order = np.lexsort((offs, sigs))
        sigs, offs = sigs[order], offs[order]
        first = np.concatenate([[True], sigs[1:] != sigs[:-1]])
        yield from entries(base, ((sigs[first] >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)).astype(np.int64), sigs[first], offs[first], None)
        if not first.all():
            lead = offs[np.flatnonzero(first)[np.cumsum(first) - 1]][~first]
            sigs, offs = sigs[~first], offs[~first]
            ranges = (_mix(offs.astype(np.uint64)) % np.uint64(n_ranges)).astype(np.int64)
            order = np.argsort(ranges, kind="stable")
            yield from entries(base, ranges[order], sigs[order], offs[order], lead[order])

    def run(batches):
        for batch in batches:
            rows, held = batch.column("row").to_numpy(), batch.column("sigs")
            size = np.asarray(pc.binary_length(held)) // 8
            group = np.stack([rows >> 31, np.cumsum(size) // PACK_KEYS])
            cuts = np.flatnonzero(np.concatenate([[True], (group[:, 1:] != group[:, :-1]).any(axis=0), [True]])) if len(rows) else []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                base = int(rows[lo]) >> 31 << 31
                sigs = np.frombuffer(b"".join(held.slice(lo, hi - lo).to_pylist()), "<u8")
                if len(sigs):
                    out = list(zip(*packed(base, np.repeat((rows[lo:hi] - base).astype(np.uint32), size[lo:hi]), sigs), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), *map(_column, out[2:])], names=names)

    return run


def _meet(key, rows):
    """The members of the keys that several rows have, each with a leader; ``rows`` is a range of keys."""
    base, leads = rows.column("base").to_numpy(), rows.column("leads").to_pylist()
    sigs = [np.frombuffer(x, "<u8") for x in rows.column("sigs").to_pylist()]
    ids = [np.frombuffer(x, "<u4") + b for x, b in zip(rows.column("offs").to_pylist(), base, strict=True)]
    known = [i for i, x in enumerate(leads) if x]
    open_ = [i for i, x in enumerate(leads) if not x]
    out = [(sigs[i], ids[i], np.frombuffer(leads[i], "<u4") + base[i]) for i in known]
    if open_:
        sig, own = np.concatenate([sigs[i] for i in open_]), np.concatenate([ids[i] for i in open_])
        order = np.lexsort((own, sig))
        sig, own = sig[order], own[order]
        first = np.concatenate([[True], sig[1:] != sig[:-1]])
        lead = own[np.flatnonzero(first)[np.cumsum(first) - 1]]
        out.append((sig[~first], own[~first], lead[~first]))
    sig, own, lead = (np.concatenate([x[k] for x in out]).astype(np.int64) for k in range(3))
    return pa.table({"sig": sig, "cid": own, "leader": lead})


def _bounded(sizes: Sizes):
    """Pairs that the sum of coordinate minima leaves."""

    def run(batches):
        for batch in batches:
            good = []
            for pair in zip(_points(batch.column("a_point")), _points(batch.column("b_point")), strict=True):
                p = same_groups(pair)
                both = int(p.min(axis=0).sum())
                good.append(sizes.linked(*p.sum(axis=1).tolist(), both))
            good = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], names=["a", "b"])

    return run


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def _verify(sizes: Sizes):
    def run(batches):
        for batch in batches:
            a, b, out = batch.column("a"), batch.column("b"), []
            for i in range(batch.num_rows):
                sa, sb = (np.frombuffer(batch.column(c)[i].as_py(), "<u8") for c in ("a_shingles", "b_shingles"))
                if sizes.linked(len(sa), len(sb), _overlap(sa, sb)):
                    out.append(i)
            rows = pa.array(out, pa.int64())
            yield pa.RecordBatch.from_arrays([a.take(rows), b.take(rows)], names=["a", "b"])

    return run


class RTree:
    """A packed R-tree over count vectors: halves of the widest coordinate down to leaves of LEAF points."""

    def __init__(self, points: np.ndarray, labels: np.ndarray):
        self.points, self.labels, self.size = points, labels, points.sum(axis=1)
        self.root = self._node(np.arange(len(points)))

    def _node(self, own: np.ndarray) -> dict:
        p = self.points[own]
        label = self.labels[own]
        node = {"own": own, "high": p.max(axis=0), "least": int(self.size[own].min()), "label": int(label[0]) if (label == label[0]).all() else None, "parts": []}
        if len(own) > LEAF:
            widest = int((node["high"] - p.min(axis=0)).argmax())
            order = own[np.argsort(p[:, widest], kind="stable")]
            node["parts"] = [self._node(x) for x in np.array_split(order, 2)]
        return node

    def join(self, other: RTree, sizes: Sizes):
        """Pairs (i of self, j of other) of different labels whose bound reaches the threshold."""
        stack = [(self.root, other.root)]
        while stack:
            x, y = stack.pop()
            if x["label"] is not None and x["label"] == y["label"]:
                continue
            if not sizes.linked(x["least"], y["least"], int(np.minimum(x["high"], y["high"]).sum())):
                continue
            if x["parts"] or y["parts"]:
                stack += [(u, v) for u in x["parts"] or [x] for v in y["parts"] or [y]]
                continue
            low = np.minimum(self.points[x["own"]][:, None, :], other.points[y["own"]][None, :, :]).sum(axis=2).astype(np.int64)
            na, nb = self.size[x["own"]].astype(np.int64)[:, None], other.size[y["own"]].astype(np.int64)[None, :]
            good = (sizes.q * low >= sizes.p * (na + nb - low)) & (self.labels[x["own"]][:, None] != other.labels[y["own"]][None, :])
            for i, j in zip(*np.nonzero(good), strict=True):
                yield int(x["own"][i]), int(y["own"][j])


class _Union:
    """Union-find over positions; the least of a set is its root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        """The root of ``x``."""
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def merge(self, x: int, y: int) -> None:
        """Join the sets of ``x`` and ``y``."""
        x, y = sorted((self.root(x), self.root(y)))
        self.up[y] = x


def _bucket_join(sizes: Sizes):
    """Members of two blocks of a bucket with a partner of another component within the bound.

    They come with the least member (``lead``) that partners connect them with here, and a name (``bucket``) of all those.
    """

    def run(key, rows):
        rows = rows.sort_by("cid")
        ids, comps = rows.column("cid").to_numpy(), rows.column("comp").to_numpy()
        points = same_groups(_points(rows.column("point")))
        part, (i, j) = rows.column("part").to_numpy(), (k.as_py() for k in key[1:])
        first, second = np.flatnonzero(part == i), np.flatnonzero(part == j)
        near, some = _Union(len(ids)), np.zeros(len(ids), bool)
        if len(first) and len(second):
            left = RTree(points[first], comps[first])
            right = left if i == j else RTree(points[second], comps[second])
            for x, y in left.join(right, sizes):
                some[first[x]] = some[second[y]] = True
                near.merge(int(first[x]), int(second[y]))
        own = np.flatnonzero(some)
        lead = ids[[near.root(x) for x in own.tolist()]] if len(own) else ids[own]
        name = {int(k): xxhash.xxh3_64_intdigest(ids[own][lead == k].astype("<i8").tobytes()) >> 1 for k in np.unique(lead)}
        return pa.table({"bucket": pa.array([name[k] for k in lead.tolist()], pa.int64()), "cid": ids[own], "comp": comps[own], "lead": lead})

    return run


def _forest(sizes: Sizes):
    """A forest of the links among the members of a bucket that are in different components so far."""

    def run(rows):
        ids, sets = rows.column("cid").to_numpy(), [np.frombuffer(x, "<u8") for x in rows.column("shingles").to_pylist()]
        _, label = np.unique(rows.column("comp").to_numpy(), return_inverse=True)
        linked, out = _Union(int(label.max()) + 1), []
        tree = RTree(same_groups([counts(s) for s in sets]), label)
        for x, y in tree.join(tree, sizes):
            if x < y and linked.root(int(label[x])) != linked.root(int(label[y])) and sizes.linked(len(sets[x]), len(sets[y]), _overlap(sets[x], sets[y])):
                linked.merge(int(label[x]), int(label[y]))
                out.append((int(ids[x]), int(ids[y])))
        return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

    return run


def _joined(docs: DataFrame, n: int, threshold: tuple[int, int]) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(first, named, tables): doc_id, th, n, c1, c2 of every row; c1, c2, rep, root of every class; what to discard.

    ``rep`` is the class's least (no_id, doc_id, th), where th is the text's hash: an id alone may stand for several
    texts. ``root`` is one number for each component.
    """
    sizes = Sizes(*threshold)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"))
    first = rows.mapInArrow(_first_pass(n, sizes), "doc_id long, th long, n long, c1 long, c2 long, point binary, sigs binary")
    keyed = materialize(first.withColumn("row", F.monotonically_increasing_id()), "shingle-keys")
    first = materialize(keyed.drop("sigs"), "shingle-rows")
    # equal sets are one class, named by the least row number
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("rep")
    classes = materialize(first.where("n > 0").groupBy("c1", "c2").agg(F.min("row").alias("cid"), F.first("n").alias("n"), rep), "shingle-classes")
    n_rows, n_classes = first.where("n > 0").count(), classes.count()
    if n_rows - n_classes <= BROADCAST_ROWS:  # the rows that repeat a set are few: the others' keys stay where they are
        again = first.where("n > 0").select("row").join(classes.select(F.col("cid").alias("row")), "row", "left_anti")
        once = keyed.select("row", "sigs").join(F.broadcast(again), "row", "left_anti")
    else:
        once = keyed.select("row", "sigs").join(classes.select(F.col("cid").alias("row")), "row")
    n_keys = keyed.agg(F.coalesce(F.sum(F.octet_length("sigs")), F.lit(0))).first()[0] // 8
    packed = once.mapInArrow(_pack(max(RANGES, n_keys // RANGE_KEYS)), _PACKED)
    met = materialize(packed.groupBy("range").applyInArrow(_meet, _MET), "bucket-members")
    discard(keyed)

    # every member with its leader, where the count vectors leave it open whether they link
    pairs = met.select(F.col("leader").alias("a"), F.col("cid").alias("b")).distinct()
    points = first.select("row", "point")
    side = lambda x, of, what: of.select(F.col(of.columns[0]).alias(x), F.col(what).alias(f"{x}_{what}"))
    near = pairs.join(side("a", points, "point"), "a").join(side("b", points, "point"), "b").select("a", "b", "a_point", "b_point")
    near = materialize(near.mapInArrow(_bounded(sizes), "a long, b long"), "near-pairs")
    sets = _sets(rows, classes, near.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), n)
    both = near.join(side("a", sets, "shingles"), "a").join(side("b", sets, "shingles"), "b").select("a", "b", "a_shingles", "b_shingles")
    links = materialize(both.mapInArrow(_verify(sizes), "a long, b long"), "links")
    discard(near, sets)
    found = materialize(components(links), "components")

    # buckets of three or more members that still hold several components: each set of members once, joined as R-trees
    labels = classes.select("cid", "n").join(found.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "n", F.coalesce("root", "cid").alias("comp"))
    members = met.select("sig", "cid").unionByName(met.select("sig", F.col("leader").alias("cid"))).distinct()
    members = materialize(members.join(labels, "cid").select("sig", "cid", "n", "comp"), "bucket-components")
    hashed = lambda salt: F.sum(F.xxhash64(F.lit(salt), "cid") % 1_000_000_007)
    open_ = members.groupBy("sig").agg(F.count("*").alias("size"), F.max("n").alias("most"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), hashed(1).alias("s1"), hashed(2).alias("s2")).where("lo != hi and size > 2")
    per_part = F.least(F.lit(MEMBERS), F.greatest(F.lit(1), F.floor(F.lit(TILE_BYTES / 8) / F.col("most"))))
    open_ = materialize(open_.groupBy("size", "most", "s1", "s2").agg(F.min("sig").alias("sig")).select("sig", F.ceil(F.col("size") / per_part).cast("int").alias("parts")), "open-buckets")
    own = members.join(open_, "sig").join(points.withColumnRenamed("row", "cid"), "cid").withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    pairs_of = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(F.least(x, "part").alias("i"), F.greatest(x, "part").alias("j")))
    tiles = own.select("sig", "cid", "comp", "point", "part", F.explode(pairs_of).alias("ij")).select("sig", "cid", "comp", "point", "part", "ij.i", "ij.j")
    rest = tiles.groupBy("sig", "i", "j").applyInArrow(_bucket_join(sizes), "bucket long, cid long, comp long, lead long")
    rest = materialize(rest.distinct(), "open-members")
    clusters = components(rest.select(F.col("lead").alias("a"), F.col("cid").alias("b"))).join(labels.select("cid", "n"), F.col("node") == F.col("cid"))
    small = clusters.groupBy("root").agg(F.count("*").alias("size"), F.sum("n").alias("n")).where((F.col("size") <= CLUSTER) & (F.col("n") * 8 <= CLUSTER_BYTES))
    small = clusters.join(small.select("root"), "root").select("cid", F.col("root").alias("cluster"))
    rest = rest.join(small, "cid", "left").select(F.col("cluster").isNull().alias("by_bucket"), F.coalesce("cluster", "bucket").alias("bucket"), "cid", "comp").distinct()
    rest = materialize(rest, "clusters")
    sets = _sets(rows, classes, rest.select("cid").distinct(), n)
    more = materialize(rest.join(sets, "cid").groupBy("by_bucket", "bucket").applyInArrow(_forest(sizes), "a long, b long"), "more-links")
    if not more.isEmpty():
        found = components(more.unionByName(links))
    named = classes.join(found.withColumnRenamed("node", "cid"), "cid", "left").select("c1", "c2", "rep", F.coalesce("root", "cid").alias("root"))
    return first, named, [first, classes, met, links, members, open_, rest, sets, more]


def _sets(rows: DataFrame, classes: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """cid, shingles of the classes in ``wanted`` (cid), from the texts of their representatives."""
    wanted = materialize(classes.join(wanted, "cid", "left_semi"), "wanted-classes")
    n_wanted = wanted.count()
    by_id = wanted.select("cid", "c1", "c2", F.coalesce("rep.doc_id", F.lit(-(2**63))).alias("id"), F.col("rep.th").alias("th"))
    texts = rows.select("text", F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), "th").join(F.broadcast(by_id) if n_wanted <= BROADCAST_CLASSES else by_id, ["id", "th"])
    # few texts are wanted of each part of the input: they are dealt evenly before they are cut to words
    sets = materialize(texts.select("cid", "c1", "c2", "text").hint("rebalance").mapInArrow(_second_pass(n), "cid long, shingles binary"), "shingle-sets")
    if sets.count() > n_wanted:  # a repeated row of a representative gave the same set again
        sets = materialize(sets.dropDuplicates(["cid"]), "shingle-sets")
    return sets


def jaccard_components(docs: DataFrame, n: int = 3, threshold: tuple[int, int] = (9, 10)) -> DataFrame:
    """doc_id, n_shingles, component_id of every document row; sets link from a Jaccard similarity of p / q."""
    first, named, tables = _joined(docs, n, threshold)
    name = named.groupBy("root").agg(F.min("rep.doc_id").alias("component_id"))
    named = named.join(name, "root").select("c1", "c2", "component_id")
    full = first.where("n > 0").select("doc_id", "n", "c1", "c2").join(named, ["c1", "c2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    out = materialize(full.unionByName(first.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))), "shingle-components")
    discard(*tables)
    return out


def one_of_each(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (8, 10)) -> DataFrame:
    """``docs`` with the document of least id of each component, and every document that links with none.

    Of an id's texts the least by hash counts; ids come before null. Repeated rows of the document that stays, equal in
    id and text, are one; unlike texts of one id or of none are told apart. Documents without words all stay.
    """
    _, named, tables = _joined(docs, n, threshold)
    keep = named.groupBy("root").agg(F.min("rep").alias("rep")).select(F.coalesce("rep.doc_id", F.lit(-(2**63))).alias("id"), F.col("rep.th").alias("th"))
    keep = materialize(keep.distinct(), "kept-texts")
    discard(*tables)
    rows, restore = guarded(docs)
    rows = rows.withColumn("empty", ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    kept = rows.where("not empty").join(keep, ["id", "th"], "left_semi")
    again = kept.groupBy("id", "th").agg(F.count("*").alias("n")).where("n > 1").select("id", "th")
    once = kept.join(again, ["id", "th"], "left_anti")
    twice = kept.join(again, ["id", "th"], "left_semi").dropDuplicates(["id", "th"])
    return restore(once.unionByName(twice).unionByName(rows.where("empty")))
