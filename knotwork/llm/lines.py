"""Line dedup: winnowing over line hashes, joined fingerprints, runs extended to both sides.

Native DataFrame functions only. A run is a sequence of consecutive non-blank lines. From each line two
minimal runs of at least ``min_words`` words are taken, one to the right and one to the left. In each the line
of least hash (the last of equal ones) is the run's fingerprint; every repeated run of ``min_words`` words
holds such a run, so equal text selects equal fingerprints whatever stands around it. Fingerprint positions
are joined over the corpus; where a fingerprint occurs at one position only, its runs are done. The rest are
extended from the fingerprint to both ends of their runs and matched by the hashes of the whole run; the
earliest occurrence (by doc_id, then position) stays and the lines of later ones are deleted.

So a line is deleted exactly if it lies in a run of at least ``min_words`` words that also starts earlier in the
corpus. Each deleted line's content stays at its first occurrence.

Defined results: null text stays null and empty text empty, without lines to delete; blank lines stay and do not
interrupt a run; rows with equal id and text are one document (they do not repeat each other); a null id
comes first in the order; an empty table gives no rows; other columns of the documents are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.llm.scratch import discard, guarded, materialize

#: Passages of over 50 words are found, as far as they are whole lines.
MIN_WORDS = 50
#: Repeated fingerprints that may be broadcast, at 8 bytes each; more are joined by shuffle.
BROADCAST_MARKS = 500_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_table(docs: DataFrame) -> DataFrame:
    """d, t (the document), pos, blank, h (hash), words: one row per line of every document."""
    one = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("d"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("t"),
        F.posexplode(_lines(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("pos", "line"),
    )
    words = F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    one = one.select("d", "t", "pos", F.xxhash64("line").alias("h"), F.hash("line").alias("h2"), words.alias("words"))
    return one.groupBy("d", "t", "pos").agg(F.first("h").alias("h"), F.first("h2").alias("h2"), F.first("words").alias("words"))


def run_table(lines: DataFrame, min_words: int) -> DataFrame:
    """d, t, at, side (1: to the right, -1: to the left), far (its other end), f (fingerprint), f_at, run (hashes): the minimal runs of each line."""
    rows = lines.where("words > 0")
    by_doc = Window.partitionBy("d", "t").orderBy("pos")
    rows = rows.withColumn("upto", F.sum("words").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("before", F.col("upto") - F.col("words"))
    right = Window.partitionBy("d", "t").orderBy("before").rangeBetween(0, min_words - 1)
    left = Window.partitionBy("d", "t").orderBy("upto").rangeBetween(-(min_words - 1), 0)

    def over(w, side: int) -> Column:
        key = F.min(F.struct("h", (-F.col("pos")).alias("p"))).over(w)
        return F.struct(
            F.lit(side).alias("side"),
            (F.max("pos") if side > 0 else F.min("pos")).over(w).alias("far"),
            F.sum("words").over(w).alias("total"),
            key["h"].alias("f"),
            (-key["p"]).alias("f_at"),
            F.collect_list(F.struct("h", "h2")).over(w).alias("hashes"),
        )

    both = rows.select("d", "t", F.col("pos").alias("at"), F.array(over(right, 1), over(left, -1)).alias("r")).select("d", "t", "at", F.explode("r").alias("r")).select("d", "t", "at", "r.*").where(F.col("total") >= min_words)
    return both.select("d", "t", "at", "side", "far", "f", "f_at", F.xxhash64("hashes", F.size("hashes")).alias("run"), F.hash("hashes").alias("run2"))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """d, t, gone: for each document with deletions, the sorted positions of its deleted lines."""
    lines = line_table(docs)
    runs = materialize(run_table(lines, min_words), "line-runs")
    marks = runs.groupBy("f").agg(F.min(F.struct("d", "t", "f_at")).alias("a"), F.max(F.struct("d", "t", "f_at")).alias("b")).where("a != b").select("f")
    marks = materialize(marks, "line-marks")  # as `first` below, so that a hot key's rows can be split in the join
    shared = runs.join(F.broadcast(marks) if marks.count() <= BROADCAST_MARKS else marks, "f", "left_semi")
    # which line of a run comes first does not depend on the side from which it was reached
    start = F.least("at", "far")
    shared = shared.select("d", "t", start.alias("lo"), F.greatest("at", "far").alias("hi"), "run", "run2")
    first = shared.groupBy("run", "run2").agg(F.min(F.struct("d", "t", "lo")).alias("first"), F.max(F.struct("d", "t", "lo")).alias("last")).where("first != last").select("run", "run2", "first")
    first = materialize(first, "line-first")  # so that a run with very many copies can be split
    later = shared.join(first, ["run", "run2"]).where(F.struct("d", "t", "lo") > F.col("first")).select("d", "t", "lo", "hi").distinct()
    # the union of the runs of each document, as positions: each start carries the furthest end so far
    w = Window.partitionBy("d", "t").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    best = later.groupBy("d", "t", "lo").agg(F.max("hi").alias("hi"))
    fresh = best.withColumn("seen", F.coalesce(F.max("hi").over(w), F.lit(-1)))
    spans = fresh.select("d", "t", F.greatest("lo", F.col("seen") + 1).alias("lo"), "hi").where("lo <= hi")
    gone = materialize(spans.groupBy("d", "t").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("gone")), "line-gone")
    discard(runs, marks, first)
    return gone


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later repeated runs deleted from ``text``, plus n_lines and n_removed (both long)."""
    gone = repeated_lines(docs, min_words).withColumnsRenamed({"d": "id", "t": "th"})
    rows, restore = guarded(docs)
    both = rows.join(gone.hint("merge"), ["id", "th"], "left")  # deletions grow with the corpus
    text, lines = F.col("text"), _lines(F.col("text"))
    # between two deleted spans the lines stay; a blank line inside a span stays as well
    kept = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size("gone")),
            lambda k: F.concat(
                F.when(k > 0, F.filter(F.slice(lines, F.get("gone", k - 1)["lo"] + 1, F.get("gone", k - 1)["hi"] - F.get("gone", k - 1)["lo"] + 1), lambda x: ~x.rlike(r"[^\x20\x09-\x0D]"))).otherwise(F.array().cast("array<string>")),
                F.slice(
                    lines,
                    F.when(k > 0, F.get("gone", k - 1)["hi"] + 2).otherwise(F.lit(1)),
                    F.greatest(F.coalesce(F.get("gone", k)["lo"], F.size(lines)) - F.when(k > 0, F.get("gone", k - 1)["hi"] + 1).otherwise(F.lit(0)), F.lit(0)),
                ),
            ),
        )
    )
    kept = F.when(F.col("gone").isNotNull(), kept).otherwise(lines)
    both = both.withColumn("kept", kept)
    return restore(
        both,
        text=F.when(F.col("gone").isNotNull(), F.array_join("kept", "\n")).otherwise(text),
        n_lines=F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("bigint"),
        n_removed=F.when(F.col("gone").isNull(), 0).otherwise(F.size(lines) - F.size("kept")).cast("bigint"),
    )


def line_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_removed, text_md5 (of the text that stays)."""
    found = dedup_lines(docs, **options)
    return found.select(F.col("doc_id").cast("bigint").alias("doc_id"), "n_lines", "n_removed", F.md5("text").alias("text_md5"))


ORACLE_SQL = rf"""
with d as (select row_number() over () r, doc_id, text, string_split(text, chr(10)) ls from documents),
l0 as (select r, doc_id, unnest(ls) line, generate_subscripts(ls, 1) pos from d),
l as (select *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) w from l0),
n as (select *, sum(w) over (partition by r order by pos) upto from l where w > 0),
f as (select r, doc_id, pos lo, max(pos) over x hi, sum(w) over x total, list(line) over x c from (select *, upto - w before from n) window x as (partition by r order by before range between 0 preceding and {MIN_WORDS - 1} following)),
b as (select r, doc_id, min(pos) over x lo, pos hi, sum(w) over x total, list(line) over x c from n window x as (partition by r order by upto range between {MIN_WORDS - 1} preceding and 0 following)),
runs as (select distinct r, doc_id, lo, hi, c from (from f union all from b) where total >= {MIN_WORDS}),
k as (select c, min((doc_id, lo)) first from runs group by c),
g as (select r, lo, hi from runs join k using (c) where (doc_id, lo) > first),
x as (select distinct r, unnest(range(lo, hi + 1)) pos from g),
y as (select l.r, string_agg(line, chr(10) order by pos) filter (where x.pos is null or w = 0) txt, count(*) n_lines, count(*) filter (where x.pos is not null and w > 0) n_removed, count(*) filter (where x.pos is null or w = 0) n_kept from l left join x using (r, pos) group by l.r)
select doc_id, coalesce(n_lines, 0)::bigint n_lines, coalesce(n_removed, 0)::bigint n_removed, case when text is not null then md5(coalesce(txt, '')) end text_md5 from d left join y using (r)
"""
