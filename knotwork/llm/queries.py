"""The queries of the corpus operators, each over its whole tables, and their DuckDB SQL."""

from __future__ import annotations

from knotwork.llm import decontaminate, langid, lines, neardup_vectors, ngram_join, packing, quality, secrets, shards, urls
from knotwork.llm.scratch import table


def op10_secret_scans(spark, sf_dir):
    """Secrets of every document, with the repository owning it taken from ``source``."""
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op1_packing(spark, sf_dir):
    """All documents packed into sequences, by source."""
    return packing.packing_report(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark, sf_dir):
    """Lines kept and removed of every document."""
    return lines.line_report(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark, sf_dir):
    """Component of every document under links of 3-word shingle sets."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark, sf_dir):
    """Every pair of a document and a test item that it contains."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language_id(spark, sf_dir):
    """Predicted language of every document."""
    return langid.language_report(table(spark, sf_dir, "documents"))


def op6_embedding_neardup(spark, sf_dir):
    """Links, component and verdict of every vector."""
    return neardup_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_quality_classifier(spark, sf_dir):
    """Quality and toxicity of every document."""
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sharding(spark, sf_dir):
    """Shard of every document, by text bytes."""
    return shards.assign_shards(table(spark, sf_dir, "documents"))


def op9_url_filters(spark, sf_dir):
    """Verdict on every page's url; the list holds the urls of spam-farm hosts."""
    pages = table(spark, sf_dir, "pages")
    return urls.judge_urls(pages, urls.spam_list(pages))


def queries():
    """Name -> callable(spark, sf_dir)."""
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql():
    """Name -> DuckDB SQL of the queries that SQL can express."""
    return {
        "op2_line_dedup": lines.ORACLE_SQL,
        "op4_benchmark_decontamination": decontaminate.ORACLE_SQL,
        "op6_embedding_neardup": neardup_vectors.ORACLE_SQL,
        "op8_sharding": shards.ORACLE_SQL,
        "op9_url_filters": urls.ORACLE_SQL,
        "op10_secret_scans": secrets.ORACLE_SQL,
    }
