"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

Native DataFrame functions only. Test items are partitioned by the size of their shingle set. Each item's
sketch is its ``k`` shingles of least hash (bottom-k MinHash), with ``k`` set by its partition: a document
that holds at least ``threshold`` of an item of at most ``u`` shingles misses at most floor((1 - threshold) * u)
of them, so ``k`` = that number plus one finds every such document, however long. Documents that hold a
sketch shingle are candidates; their containment is then counted exactly over all of the item's shingles.

Words are runs of letters and digits, lower-cased. Defined results: null or wordless texts and items match
nothing; an item of fewer words than a shingle is one shingle of its own length; rows with equal id and text
are one document or item; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.llm.scratch import guarded, materialize

SHINGLE = 5
THRESHOLD = 0.8
#: Item shingles that may be broadcast, at about 40 bytes each; larger benchmarks are joined by shuffle.
BROADCAST_SHINGLES = 500_000


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _grams(words: Column, n: int) -> Column:
    """Hashes of all runs of ``n`` words; none where there are fewer."""
    last = F.size(words) - n
    at = lambda i, j: F.get(words, i + j)
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.lit(n), *[at(i, j) for j in range(n)]))).otherwise(F.array().cast("array<bigint>"))


def item_shingles(items: DataFrame, n: int = SHINGLE) -> DataFrame:
    """item_id, n_words (length of its shingles), n_item (set size), shingle: one row per distinct shingle."""
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), _words(F.col("text").cast("string")).alias("w")).where("size(w) > 0").distinct()
    grams = F.lit(None).cast("array<bigint>")
    for k in range(n, 0, -1):
        grams = F.when(F.size("w") >= k, _grams(F.col("w"), k)).otherwise(F.lit(None)) if k == n else F.coalesce(grams, F.when(F.size("w") == k, _grams(F.col("w"), k)))
    rows = rows.select("item_id", F.least(F.size("w"), F.lit(n)).alias("n_words"), F.array_distinct(grams).alias("g"))
    return rows.select(F.xxhash64("item_id", F.array_sort("g")).alias("item"), "item_id", "n_words", F.size("g").alias("n_item"), "g").distinct()


def sketches(items: DataFrame, threshold: float) -> DataFrame:
    """item, shingle: the bottom-k shingles of each item, ``k`` by the upper size of its power-of-two partition."""
    upper = F.least(F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n_item").cast("double")))), F.col("n_item") * F.lit(2.0))
    k = F.floor(upper * (1 - threshold) + 1e-9).cast("int") + 1
    order = lambda g: F.array_sort(F.transform(g, lambda x: F.struct(F.xxhash64(F.lit("rank"), x).alias("r"), x.alias("x"))))
    return items.select("item", F.explode(F.slice(order(F.col("g")), F.lit(1), k)).alias("s")).select("item", F.col("s.x").alias("shingle"))


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment for every document and item with containment of at least ``threshold``."""
    sets = materialize(item_shingles(items, n), "item-shingles")
    sizes = [r[0] for r in sets.select("n_words").distinct().sort("n_words").collect()]  # at most n values
    total = sets.agg(F.coalesce(F.sum("n_item"), F.lit(0))).first()[0]
    small = F.broadcast if total <= BROADCAST_SHINGLES else lambda x: x
    text = F.col("text").cast("string")
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), text.alias("text"))

    def shingled(rows: DataFrame) -> DataFrame:
        words = rows.select("doc_id", "th", _words(F.col("text")).alias("w"))
        grams = [_grams(F.col("w"), k) for k in sizes] or [F.array().cast("array<bigint>")]
        return words.select("doc_id", "th", F.explode(F.concat(*grams)).alias("shingle"))

    hits = shingled(keyed).join(small(sketches(sets, threshold).select("shingle", "item").distinct()), "shingle").select("doc_id", "th", "item").distinct()
    hits = materialize(hits, "leak-candidates")
    some = hits.select(F.coalesce("doc_id", F.lit(-1)).alias("d"), "th").distinct()
    again = keyed.join(some, (F.coalesce(keyed.doc_id, F.lit(-1)) == some.d) & (keyed.th == some.th), "left_semi")
    wanted = small(sets.select("item", F.explode("g").alias("shingle")))
    shared = shingled(again).join(wanted, "shingle").groupBy("doc_id", "th", "item").agg(F.count_distinct("shingle").alias("n_shared"))
    of = sets.select("item", "item_id", "n_item")
    found = shared.join(small(of), "item").where(F.col("n_shared") >= F.ceil(F.col("n_item") * threshold - 1e-9))
    return found.select("doc_id", "th", "item_id", F.col("n_item").cast("bigint").alias("n_item"), F.col("n_shared").cast("bigint").alias("n_shared"), (F.col("n_shared") / F.col("n_item")).alias("containment"))


def leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Contaminated (document, item) pairs, by document id."""
    return contained_items(docs, items, **options).drop("th").distinct()


def without_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that contain a test item; their columns are kept."""
    bad = contained_items(docs, items, **options).select(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), "th").distinct()
    rows, restore = guarded(docs)
    return restore(rows.join(bad, ["id", "th"], "left_anti"))


_WORDS_SQL = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
ORACLE_SQL = f"""
with i as (select distinct item_id, {_WORDS_SQL} w from benchmark where text is not null),
ig as (select item_id, least(len(w), {SHINGLE}) n, list_distinct(list_transform(range(0, greatest(len(w) - {SHINGLE}, 0) + 1), lambda k: array_to_string(w[k+1:k+{SHINGLE}], ' '))) g from i where len(w) > 0),
is_ as (select item_id, n, len(g) n_item, unnest(g) s from ig),
ns as (select distinct n from ig),
d as (select distinct doc_id, {_WORDS_SQL} w from documents where text is not null),
ds as (select distinct doc_id, n, unnest(list_transform(range(0, len(w) - n + 1), lambda k: array_to_string(w[k+1:k+n], ' '))) s from d, ns where len(w) >= n)
select doc_id, item_id, n_item::bigint n_item, count(*)::bigint n_shared, count(*) / n_item containment
from ds join is_ using (n, s) group by doc_id, item_id, n_item having count(*) >= ceil(n_item * {THRESHOLD} - 1e-9)
"""
