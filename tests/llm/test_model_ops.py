import random
from collections import Counter

import numpy as np
import pytest

from knotwork.llm import langid, neardup_vectors, quality
from tests.llm.conftest import ODD

PARTS = {"aa": ["ba", "no", "ri", "ta"], "bb": ["sch", "tz", "ung", "pf"], "cc": ["éa", "oix", "eau", "que"]}


def speech(lang, seed, n):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(PARTS[lang]) for _ in range(r.randint(2, 4))) for _ in range(n))


# ---- language ID
def test_language_held_out_and_spans(make):
    rows = [(i, speech("aabbcc"[2 * (i % 3) :][:2], i, 30), "aabbcc"[2 * (i % 3) :][:2], "s") for i in range(300)]
    rows += [(1000, "привет мир это текст", None, "s"), (1001, "123 !?", "aa", "s"), *ODD[:1], (1002, "", "aa", "s")]
    docs = make(rows)
    got = {r.doc_id: r for r in langid.language_report(docs).collect()}
    held = [i for i in range(300) if got[i].held_out]
    assert 60 < len(held) < 140 and all(got[i].lang_pred == rows[i][2] for i in range(300))
    assert got[1001].lang_pred == got[1002].lang_pred == got[None].lang_pred == "und" and got[1001].score == 0
    assert got[1000].lang_pred in ("aa", "bb", "cc") and 0 <= got[1000].score <= 1
    mixed = make([(1, speech("aa", 7, 20) + ". " + speech("bb", 8, 30) + "\n" + speech("aa", 9, 20), None, "s")])
    spans = langid.identify(mixed, langid.train(docs), ["doc_id"]).collect()[0]
    text = mixed.collect()[0].text
    assert [s.lang for s in spans.spans] == ["aa", "bb", "aa"] and spans.spans[0].start == 0
    assert text[spans.spans[1].start : spans.spans[1].end] == speech("bb", 8, 30)


def test_language_switch_needs_evidence(make):
    docs = make([(i, speech("aabbcc"[2 * (i % 3) :][:2], i, 30), "aabbcc"[2 * (i % 3) :][:2], "s") for i in range(150)])
    model = langid.train(docs)
    one = make([(1, speech("aa", 1, 10) + " pf " + speech("aa", 2, 10), None, "s")])
    assert [s.lang for s in langid.identify(one, model, ["doc_id"]).collect()[0].spans] == ["aa"]


def test_language_of_very_long_and_mixed_texts(make):
    rows = [(i, speech("aabbcc"[2 * (i % 3) :][:2], i, 30), "aabbcc"[2 * (i % 3) :][:2], "s") for i in range(150)]
    model = langid.train(make(rows))
    long = speech("aa", 500, 40_000)
    asked = make([(1, long, None, "s"), (2, "ba" * 300_000, None, "s"), (3, "9 " * 300_000, None, "s"), (4, long[:1000] + speech("bb", 1, 2000), None, "s")])
    got = {r.doc_id: r for r in langid.identify(asked, model, ["doc_id"]).collect()}
    assert (got[1].lang_pred, len(got[1].spans)) == ("aa", 1) and got[1].spans[0].end == len(long)
    assert got[3].lang_pred == "und" and got[4].lang_pred == "bb"
    three = make([*rows, (900, " ".join(speech(x, 900, n) for x, n in (("aa", 48), ("bb", 46), ("cc", 12))), None, "s")])
    assert 900 in {r.doc_id for r in langid.keep_identified(three).collect()}
    assert langid.keep_identified(make([(1, "some words", None, "s"), (2, None, None, "s")])).count() == 2  # nothing could be learned


def test_viterbi_is_brute_force():
    from itertools import product

    model = langid.Model(["a", "b"], {(x, k): np.random.default_rng(5 + i).integers(0, 9, len(langid.SCRIPT_NAMES) if k == 2 else 1 << langid.BITS) for i, x in enumerate("ab") for k in range(3)})
    w = langid.Words(["to be or not to be that is it", "", "x", "Ünd так 中文 mixed 9 words"])
    scores, label = model.word_scores(w), model.labels(w)
    for d in range(4):
        s = scores[w.first[d] : w.first[d + 1]]
        if len(s):
            value = lambda p: sum(s[i, k] for i, k in enumerate(p)) - langid.PENALTY * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
            best = max(map(value, product((0, 1), repeat=len(s))))
            assert value(label[w.first[d] : w.first[d + 1]].tolist()) == pytest.approx(best, abs=1e-3)


def test_language_without_labels_and_filter(make):
    docs = make([(i, "some words", None, "s") for i in range(5)])
    assert {r.lang_pred for r in langid.language_report(docs).collect()} == {"und"}
    assert langid.language_report(make([])).count() == 0
    rows = [(i, speech("aabb"[2 * (i % 2) :][:2], i, 20), "aabb"[2 * (i % 2) :][:2], "s") for i in range(60)]
    kept = langid.keep_identified(make([*rows, *ODD[2:5]]))
    assert kept.columns == make([]).columns and Counter(r.doc_id for r in kept.collect()) == Counter(range(60))


# ---- embeddings
def brute_vectors(rows):
    ok = [v is not None and la is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, la in rows]
    up, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links[a] += 1
                    links[b] += 1
                    up[max(find(a), find(b))] = min(find(a), find(b))
    name = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            name[find(k)] = min(i, name.get(find(k), i))
    return Counter((i, links[k], name.get(find(k)), i == name.get(find(k))) for k, (i, *_) in enumerate(rows))


@pytest.mark.parametrize("cell", [16_384, 40])
def test_vectors_are_brute_force(spark, cell, monkeypatch):
    monkeypatch.setattr(neardup_vectors, "CELL", cell)
    if cell < 100:
        monkeypatch.setattr(neardup_vectors, "TILE", 16)
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        base = rng.standard_normal(32)
        for k in range(4):
            v = base + rng.standard_normal(32) * (0, 0.02, 0.1, 0.4)[k]
            rows.append((len(rows), (v * (1 + k)).tolist(), i % 2))
    hot = rng.standard_normal(32).tolist()
    rows += [(1000 + i, hot, 1) for i in range(30)] + [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 32, 1), (2003, [None] + [1.0] * 31, 1), (2004, [float("nan")] + [1.0] * 31, 1), (2005, [float("inf")] + [1.0] * 31, 1), (2006, hot, None), (2006, hot, None), (2007, hot[:16], 1), (None, hot, 1), (2008, (np.array(hot) * 1e200).tolist(), 1)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, cid int, part string")
    got = Counter(tuple(r) for r in neardup_vectors.near_duplicates(df).collect())
    want = brute_vectors([(i, None if v is None else [x / 1e200 if x is not None and abs(x) > 1e100 and np.isfinite(x) else x for x in v], la) for i, v, la in rows])
    assert got == want


def test_vectors_empty_and_recall(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert neardup_vectors.near_duplicates(empty).count() == 0
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):  # pairs just above the threshold
        x = rng.standard_normal(64)
        y = rng.standard_normal(64)
        y -= (y @ x) / (x @ x) * x
        y *= np.linalg.norm(x) / np.linalg.norm(y)
        rows += [(2 * i, x.tolist(), 0), (2 * i + 1, (0.981 * x + np.sqrt(1 - 0.981**2) * y).tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = neardup_vectors.near_duplicates(df).where("n_links > 0").count()
    assert found >= 0.98 * 800


# ---- quality
def test_quality_learns_and_scores_all(make, spark):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        bad, toxic = i % 5 == 0, i % 7 == 0
        text = speech("aa", i, 60)
        text = " ".join(f"{w.upper()}!!" for w in text.split()) if bad else text
        text += f" {r.choice(['zork', 'blarg'])}" if toxic else ""
        rows.append((i, text, "en", "junk" if bad and i % 2 else "web"))
        if i % 3:
            labels.append((i, 0 if bad else 1, 1 if toxic else 0))
    labels += [(1, 1, 0), (1, None, None), (None, 1, 1), (99999, 1, 1)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality.score_documents(make([*rows, *ODD]), known).collect()}
    out = [i for i in range(900) if i % 3 == 0]
    assert np.mean([(got[i].quality >= 0.5) == bool(i % 5) for i in out]) > 0.97
    assert np.mean([(got[i].toxic >= 0.5) == (i % 7 == 0) for i in out]) > 0.97
    assert quality.score_documents(make([*rows, *ODD]), known).count() == len(rows) + len(ODD)


def test_quality_without_labels(make, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(x.quality, x.toxic) for x in quality.score_documents(make(ODD), none).collect()} == {(0.5, 0.5)}
    one = spark.createDataFrame([(i, 1, 0) for i in range(1, 7)], "doc_id long, quality int, toxic int")
    assert {(x.quality, x.toxic) for x in quality.score_documents(make(ODD), one).collect()} == {(1.0, 0.0)}
    assert quality.score_documents(make([]), one).count() == 0


def test_quality_pseudo_labels_help(make, spark):
    # the source tells most documents' class; of the many words each says a little, and few are in the labelled sample
    def doc(i):
        r = random.Random(i)
        good = r.random() < 0.5
        words = [f"{'good' if (r.random() < 0.75) == good else 'bad'}{r.randrange(1500)}" for _ in range(30)]
        return good, (i, " ".join(words), "en", ("s1" if good else "s2") if r.random() < 0.9 else f"other{i}")

    docs = [doc(i) for i in range(3000)]
    rows, labels = make([row for _, row in docs]), spark.createDataFrame([(i, int(docs[i][0]), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    # judged by text alone: no source tells
    odd = [i for i in range(300, 3000) if docs[i][1][3].startswith("other")]
    loss, wrong = [], []
    for rounds in (0, 2):
        got = {x.doc_id: x.quality for x in quality.score_documents(rows, labels, rounds=rounds).collect()}
        p = np.clip([got[i] if docs[i][0] else 1 - got[i] for i in odd], 1e-6, 1)
        loss.append(-np.mean(np.log(p)))
        wrong.append(np.mean(p < 0.5))
    assert loss[1] < loss[0] and wrong[1] < wrong[0]


def test_quality_of_very_long_texts(make, spark):
    rows = [(i, ("fine prose here. " if i % 2 else "bad junk there! ") * 20, "en", "s") for i in range(60)] + [(90, "fine prose here. " * 60_000, "en", "s"), (91, "x" * 1_000_000, "en", "s")]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality.score_documents(make(rows), labels).collect()}
    assert got[90].quality > 0.5 and len(got) == 62
