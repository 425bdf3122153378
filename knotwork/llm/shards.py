"""Sharding by extendible hashing: only oversized buckets split on another bit.

A document's key is the MD5 of its id; a bucket is a prefix of the key's bits. Bytes are summed once per fine
prefix (partial sums before the shuffle); the sizes of all shorter prefixes are sums of those. A document's
shard is the shortest prefix whose bucket fits ``max_bytes``. Fine buckets that still do not fit go on to the
next ``step`` bits, until all fit or the key's bits are used up. Directory and sizes stay distributed tables.

Defined results: null and empty texts have 0 bytes; a null id has the key of the empty string; rows with equal id
share a key; a bucket that cannot fit since one key alone is too large is split to that key's last bit and
flagged ``oversized``; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.llm.scratch import materialize

MAX_BYTES = 1 << 20
#: Bits of the key that can be used, from the first 15 hexadecimal digits.
BITS = 60


def key(doc_id: Column) -> Column:
    """The key as a number of ``BITS`` bits."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("bigint")


def _prefix(k: Column, depth: Column) -> Column:
    return F.call_function("shiftright", k, (F.lit(BITS) - depth).cast("int"))


def directory(cells: DataFrame, max_bytes: int, step: int) -> DataFrame:
    """prefix, depth, shard_bytes, shard_docs of the leaves, from cells (k, n_bytes, n_docs; any number to a key)."""
    total = cells.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    top, deep = 0, min(BITS, max(1, math.ceil(math.log2(max(2, total / max_bytes)))) + step)
    leaves, rest = None, cells
    while True:
        fine = rest.groupBy(_prefix(F.col("k"), F.lit(deep)).alias("p")).agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_docs").alias("n_docs"))
        levels = fine.select(F.explode(F.sequence(F.lit(top), F.lit(deep))).alias("depth"), "p", "n_bytes", "n_docs")
        levels = levels.groupBy("depth", F.call_function("shiftright", F.col("p"), F.lit(deep) - F.col("depth")).alias("prefix")).agg(F.sum("n_bytes").alias("shard_bytes"), F.sum("n_docs").alias("shard_docs"))
        levels = materialize(levels, "shard-levels")
        big = levels.where((F.col("shard_bytes") > max_bytes) & (F.col("depth") < BITS))
        fits = levels.where((F.col("shard_bytes") <= max_bytes) | (F.col("depth") == BITS))
        # a leaf is a bucket that fits whose parent did not; the root has no parent
        parent = big.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
        found = fits.join(parent, ["depth", "prefix"], "left_semi")
        if top == 0:
            found = found.unionByName(fits.where("depth = 0"))
        leaves = found if leaves is None else leaves.unionByName(found)
        over = big.where(F.col("depth") == deep).select("prefix")
        if deep == BITS or over.isEmpty():
            return leaves.select("prefix", "depth", "shard_bytes", "shard_docs", (F.col("shard_bytes") > max_bytes).alias("oversized"))
        rest = rest.join(over, _prefix(F.col("k"), F.lit(deep)) == F.col("prefix"), "left_semi")
        top, deep = deep, min(BITS, deep + step)


def assign_shards(docs: DataFrame, max_bytes: int = MAX_BYTES, step: int = 6) -> DataFrame:
    """doc_id, n_bytes, shard_id (its bits as text), depth, shard_bytes, shard_docs, oversized: one row per document row."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("bigint").alias("n_bytes"))
    rows = materialize(rows.withColumn("k", key(F.col("doc_id"))), "shard-keys")
    cells = rows.groupBy("k").agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_docs"))
    leaves = directory(materialize(cells, "shard-cells"), max_bytes, step)
    # each leaf meets its documents on (depth, prefix) at the few depths in use
    depths = [r[0] for r in leaves.select("depth").distinct().sort("depth").collect()]  # at most 61 numbers
    tried = rows.select("doc_id", "n_bytes", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(F.col("k"), F.lit(d)).alias("prefix")) for d in depths]) if depths else F.array(F.struct(F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("prefix")))).alias("at")).select("doc_id", "n_bytes", "at.*")
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth"), F.lit("0")))
    return tried.join(leaves, ["depth", "prefix"]).select("doc_id", "n_bytes", bits.alias("shard_id"), F.col("depth").cast("bigint").alias("depth"), "shard_bytes", "shard_docs", "oversized")


ORACLE_SQL = f"""
with d as (select doc_id, coalesce(strlen(text), 0)::bigint n_bytes, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, {BITS // 4}))::bigint k from documents),
lv as (select unnest(range(0, {BITS + 1})) depth),
s as (select depth, k >> ({BITS} - depth) prefix, sum(n_bytes) b, count(*) n from d, lv where depth <= 24 or depth = {BITS} group by all),
c as (select d.doc_id, d.n_bytes, d.k, min(s.depth) depth from d join s on s.prefix = d.k >> ({BITS} - s.depth) where s.b <= {MAX_BYTES} or s.depth = {BITS} group by all)
select doc_id, n_bytes, case when c.depth = 0 then '' else right(lpad(bin(prefix), 64, '0'), c.depth::int) end shard_id, c.depth::bigint as depth, s.b::bigint shard_bytes, s.n::bigint shard_docs, s.b > {MAX_BYTES} oversized
from c join s on s.depth = c.depth and s.prefix = c.k >> ({BITS} - c.depth)
"""
