"""Corpus pipeline: identified languages, lines once, one of each near-duplicate group, no test items, packed.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of documents. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from knotwork.llm import decontaminate, langid, lines, ngram_join, packing
from knotwork.llm.scratch import materialize, table


def language_id(spark, docs, sf_dir):
    """Documents with a language that holds most of their letters stay."""
    return langid.keep_identified(docs)


def line_dedup(spark, docs, sf_dir):
    """Later repeated runs of lines go; a document goes when no word of it is left after that."""
    found = lines.dedup_lines(docs)
    gone = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    found = found.where(~F.coalesce(gone, F.lit(False)))
    return found.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("bigint")).select(*docs.columns)


def ngram_jaccard_join(spark, docs, sf_dir):
    """One document of each group of near-duplicates stays (five words, similarity 0.8)."""
    return ngram_join.one_of_each(docs)


def benchmark_decontamination(spark, docs, sf_dir):
    """Documents that contain a test item go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark, docs, sf_dir):
    """All that is left, packed into sequences."""
    return packing.packing_report(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: SQL can express neither the first stage nor the last; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The pieces that the stages make of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
