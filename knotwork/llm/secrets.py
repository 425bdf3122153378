"""Secret scans: spans of credentials, with corpus-wide ownership frequency of each value.

Native DataFrame functions only. A first pass over the texts finds the matches of each pattern per row, as the
lengths of the text between them, their own lengths and a hash of the value; no texts are kept. Running sums give the
positions. Hashes of the values are then aggregated over the corpus by distinct repositories and owners.
Values that many owners or repositories share are copied examples; values of few look live. Base spans always
stay; wider candidates (random-looking tokens without a keyword) are added only when their value is owner-specific.

Defined results: null or empty text has no spans; null repository or owner counts as one unknown one;
equal rows are scanned each on its own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.llm.scratch import discard, materialize

# The base patterns of the contract, in its order of kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Wider candidates: long runs of token characters; they need a lower-case letter, an upper-case one and a digit.
WIDE = r"[A-Za-z0-9+/_=-]{20,}"
MIN_ASSIGN = 6
KINDS = ("assign", "access", "hex", "wide")
#: Values that may be broadcast, at about 60 bytes each; more are joined by shuffle.
BROADCAST_VALUES = 200_000


def _matches(text: Column, pattern: str, kind: int, good: Callable[[Column], Column], value_group: int = 0) -> Column:
    """Array of (kind, gap, n, value_hash) of the leftmost non-overlapping matches, the hash null unless the value is good.

    ``gap`` is the length of the text since the match before, ``n`` the match's, in code points.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    zipped = F.zip_with(gaps, F.arrays_zip(found.alias("found"), values.alias("value")), lambda gap, x: F.struct(F.lit(kind).alias("kind"), F.length(gap).alias("gap"), F.length(x["found"]).alias("n"), F.when(good(x["value"]), F.md5(x["value"])).alias("value_hash")))
    # the pattern runs once on texts without a match, and none of the array work is done for them
    return F.when(text.rlike(pattern), zipped).otherwise(F.array().cast("array<struct<kind:int,gap:int,n:int,value_hash:string>>"))


def candidate_matches(text: Column) -> Column:
    """The matches of all patterns in ``text``, kind after kind."""
    body, every = F.coalesce(text, F.lit("")), lambda x: F.lit(True)
    long = lambda x: F.length(x) >= MIN_ASSIGN
    random = lambda x: x.rlike("[0-9]") & x.rlike("[a-z]") & x.rlike("[A-Z]")
    return F.concat(_matches(body, ASSIGN, 0, long, 2), _matches(body, ACCESS, 1, every), _matches(body, HEX, 2, every), _matches(body, WIDE, 3, random))


def located(found: DataFrame) -> DataFrame:
    """row, kind, start, end, value_hash of all good matches (row, matches); wide ones only where they overlap no base span."""
    each = found.select("row", F.posexplode("matches").alias("i", "m")).select("row", "i", "m.*").repartition("row")
    upto = F.sum(F.col("gap") + F.col("n")).over(Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    spans = each.select("row", "kind", (upto - F.col("n")).alias("start"), upto.alias("end"), "value_hash").where("value_hash is not null")
    # a wide span is clear if no base span that starts before its end ends after its start
    base = F.col("kind") < 3
    before = Window.partitionBy("row").orderBy(F.when(base, F.col("start")).otherwise(F.col("end")), base).rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(base, F.col("end"))).over(before)
    return spans.withColumn("reach", reach).where(base | F.col("reach").isNull() | (F.col("reach") <= F.col("start"))).drop("reach")


def _digest(spans: Column) -> Column:
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def value_ownership(spans: DataFrame) -> DataFrame:
    """value_hash -> n_spans, n_repos, n_owners over the corpus; one row per repository and owner is summed first."""
    once = spans.groupBy("value_hash", "repo", "owner").agg(F.count("*").alias("n"))
    by_owner = once.groupBy("value_hash", "owner").agg(F.sum("n").alias("n"))
    owners = by_owner.groupBy("value_hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_spans"))
    repos = once.groupBy("value_hash", "repo").agg(F.lit(1).alias("one")).groupBy("value_hash").agg(F.count("*").alias("n_repos"))
    return owners.join(repos, "value_hash")


def scan_secrets(docs: DataFrame, repo: str | Column = "source", owner: str | Column = "source", max_owners: int = 1, max_repos: int = 3) -> DataFrame:
    """One row per document row: doc_id, base and added spans, and how many values look live or copied.

    A value is live when at most ``max_owners`` owners hold it in at most ``max_repos`` repositories, else an example;
    ``repo`` and ``owner`` are columns or expressions. Result columns: doc_id, base and added (arrays of start, kind, end, value_hash,
    n_spans, n_repos, n_owners, live), n_live, n_example.
    """
    named = lambda c: F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
    found = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), named(repo).alias("repo"), named(owner).alias("owner"), candidate_matches(F.col("text").cast("string")).alias("matches"))
    found = materialize(found, "secret-matches")  # the row numbers are fixed from here on
    some = found.where("size(matches) > 0")
    spans = materialize(located(some).join(some.select("row", "repo", "owner"), "row"), "secret-spans")
    owned = value_ownership(spans).withColumn("live", (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos))
    owned = materialize(owned, "secret-values")  # a table by itself, so that a value with very many copies can be split in the join
    judged = spans.join(F.broadcast(owned) if owned.count() <= BROADCAST_VALUES else owned, "value_hash")
    span = F.struct("start", "kind", "end", "value_hash", "n_spans", "n_repos", "n_owners", "live")
    judged = judged.groupBy("row").agg(
        F.collect_list(F.when(F.col("kind") < 3, span)).alias("base"),
        F.collect_list(F.when((F.col("kind") == 3) & F.col("live"), span)).alias("added"),
        F.sum(F.col("live").cast("bigint")).alias("n_live"),
        F.sum((~F.col("live")).cast("bigint")).alias("n_example"),
    )
    judged = materialize(judged, "secret-verdicts")
    discard(spans, owned)
    none = F.array().cast(judged.schema["base"].dataType)
    return found.select("row", "doc_id").join(judged, "row", "left").select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added"), *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_live", "n_example")])


def secret_report(docs: DataFrame, **options) -> DataFrame:
    """The digest columns of scan_secrets()."""
    found = scan_secrets(docs, **options)
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_digest(F.col("base")), 256).alias("base_sha256"),
        _digest(F.concat("base", "added")).alias("spans"),
        "n_live",
        "n_example",
    )


def _duck_spans(pattern: str, kind: int, group: int) -> str:
    return f"""list_transform(range(1, len(m{kind}) + 1), lambda i: {{'s': list_sum(list_transform(g{kind}[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m{kind}[1:i-1], lambda y: length(y))), 0), 'k': {kind}, 'n': length(m{kind}[i]), 'v': v{kind}[i]}})"""


def _quoted(x: str) -> str:
    return x.replace("'", "''")


_PATTERNS = ((ASSIGN, 2), (ACCESS, 0), (HEX, 0), (WIDE, 0))
ORACLE_SQL = f"""
with d as (select row_number() over () r, doc_id, coalesce(text, '') t, coalesce(source, '') o from documents),
m as (select r, doc_id, o, {", ".join(f"regexp_extract_all(t, '{_quoted(p)}', 0) m{k}, regexp_extract_all(t, '{_quoted(p)}', {g}) v{k}, string_split_regex(t, '{_quoted(p)}') g{k}" for k, (p, g) in enumerate(_PATTERNS))} from d),
s as (select r, doc_id, o, list_filter({_duck_spans(ASSIGN, 0, 2)}, lambda x: length(x.v) >= {MIN_ASSIGN}) || {_duck_spans(ACCESS, 1, 0)} || {_duck_spans(HEX, 2, 0)} b,
  list_filter({_duck_spans(WIDE, 3, 0)}, lambda x: regexp_matches(x.v, '[0-9]') and regexp_matches(x.v, '[a-z]') and regexp_matches(x.v, '[A-Z]')) w0 from m),
c as (select r, doc_id, o, b, list_filter(w0, lambda w: len(list_filter(b, lambda x: x.s < w.s + w.n and w.s < x.s + x.n)) = 0) w from s),
e as (select r, o, unnest(b || w) x from c),
f as (select x.v v, count(distinct o) <= 1 live from e group by 1),
j as (select e.r, list(e.x) filter (e.x.k = 3 and f.live) a, sum(f.live::bigint) n_live, sum((not f.live)::bigint) n_example from e join f on e.x.v = f.v group by 1),
z as (select c.doc_id, c.b, c.b || coalesce(j.a, []) allspans, coalesce(j.n_live, 0)::bigint n_live, coalesce(j.n_example, 0)::bigint n_example from c left join j using (r))
select doc_id, len(list_filter(b, lambda x: x.k = 0))::bigint n_assign, len(list_filter(b, lambda x: x.k = 1))::bigint n_access, len(list_filter(b, lambda x: x.k = 2))::bigint n_hex,
  sha256(array_to_string(list_transform(list_sort(list_transform(b, lambda x: {{'s': x.s::bigint, 'k': x.k, 'n': x.n::bigint}})), lambda x: ['assign','access','hex','wide'][x.k + 1] || ':' || x.s || ':' || (x.s + x.n)), ',')) base_sha256,
  array_to_string(list_transform(list_sort(list_transform(allspans, lambda x: {{'s': x.s::bigint, 'k': x.k, 'n': x.n::bigint}})), lambda x: ['assign','access','hex','wide'][x.k + 1] || ':' || x.s || ':' || (x.s + x.n)), ',') spans,
  n_live, n_example
from z
"""
