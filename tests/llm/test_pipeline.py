import shutil
import tempfile

import corpus_pipeline
from tests.llm.conftest import ODD
from tests.llm.test_model_ops import speech
from tests.llm.test_text_ops import brute_lines, brute_links


def test_stages_take_effect(make, spark):
    rows = [(i, speech("aabbcc"[2 * (i % 3) :][:2], i, 90), "aabbcc"[2 * (i % 3) :][:2], f"s{i % 3}") for i in range(60)]
    passage = speech("aa", 500, 60)
    item = speech("aa", 600, 30)
    rows += [(70, rows[0][1], "aa", "s"), (71, speech("aa", 71, 50) + "\n" + passage, "aa", "s"), (72, speech("aa", 72, 50) + "\n" + passage, "aa", "s"), (73, rows[1][1] + " ba", "bb", "s"), (74, speech("aa", 74, 40) + " " + item, "aa", "s"), (75, "12 34", "aa", "s"), *ODD[2:5]]
    folder = tempfile.mkdtemp()
    make(rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = stage(spark, docs, folder)
        assert docs.columns == make([]).columns
        seen.append((name, before, [(r.doc_id, r.text) for r in docs.collect()]))
    after = {name: dict(x) for name, _, x in seen}
    assert set(after["language_id"]) == set(range(60)) | {70, 71, 72, 73, 74}
    _, before, left = seen[1]
    want = brute_lines(before, 50)
    assert dict(left) == {d: t for (d, _), t in want.items() if t.strip()} and after["line_dedup"][72] == speech("aa", 72, 50) and 70 not in after["line_dedup"]
    _, before, left = seen[2]
    assert sorted(i for i, _ in left) == sorted({name for _, n, name in brute_links(before, 5, 8, 10)}) and 73 not in after["ngram_jaccard_join"]
    assert set(after["ngram_jaccard_join"]) - set(after["benchmark_decontamination"]) == {74}
    pieces = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(after["benchmark_decontamination"])
    shutil.rmtree(folder)


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= names
