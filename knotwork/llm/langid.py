"""Language ID of mixed-language text: script ranges, per-word scores, Viterbi with a switching penalty.

Words are runs of letters, lower-cased. A word's script (by code point ranges) narrows its candidate
languages to those seen in that script in training; each candidate gets the log-probability of the word's
character trigrams and of the whole word (hashed tables with add-one smoothing), relative to the best and cut off at
``CLIP``, so one odd word cannot decide. A Viterbi pass over a document's words, which pays ``PENALTY`` for each
change of language, labels every word; equal neighbours form spans. Documents of a batch step through the
recurrence together as numpy columns. The prediction is the language with most letters (the first by name of
equals) and the score is its share of them.

Training counts are taken on the executors from at most about ``max_train`` labelled documents (chosen by a hash
of the id, a stated bound) and summed before they reach the driver: two tables of 2**BITS entries a language.

Defined results: null text or text without a letter is ``und`` with score 0 and no spans, and so is everything where
no labelled text exists; documents with null language are never trained on; repeated rows are judged each on its own;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 16
CLIP = 6.0
PENALTY = 9.0
MAX_TRAIN = 20_000
#: Characters that are scored together, and rows that are read at once; they bound the memory of a task.
CHUNK, ROWS = 500_000, 2_000
UND = "und"

# First and last code points of scripts, from the Unicode block list; all else is script 0.
SCRIPTS = (
    (0x0041, 0x024F, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"), (0x0530, 0x058F, "Armenian"),
    (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x077F, "Arabic"), (0x0900, 0x097F, "Devanagari"), (0x0980, 0x09FF, "Bengali"),
    (0x0B80, 0x0BFF, "Tamil"), (0x0C00, 0x0C7F, "Telugu"), (0x0E00, 0x0E7F, "Thai"), (0x10A0, 0x10FF, "Georgian"),
    (0x1100, 0x11FF, "Hangul"), (0x1E00, 0x1EFF, "Latin"), (0x1F00, 0x1FFF, "Greek"), (0x3040, 0x30FF, "Kana"),
    (0x3400, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"),
)
SCRIPT_NAMES = ("other", *dict.fromkeys(x[2] for x in SCRIPTS))


class Alphabet:
    """Lower-case letter (0: not a letter) and script of every code point; built once in each worker."""

    _made = None

    def __init__(self):
        self.letter = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            if (c := chr(i)).isalpha():
                low = c.lower()
                self.letter[i] = ord(low) if len(low) == 1 else i
        self.script = np.zeros(0x110000, np.uint8)
        for first, last, name in SCRIPTS:
            self.script[first : last + 1] = SCRIPT_NAMES.index(name)

    @classmethod
    def get(cls) -> Alphabet:
        """The worker's own copy."""
        cls._made = cls._made or cls()
        return cls._made


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(64 - BITS - 3)) & np.uint64((1 << BITS) - 1)


class Words:
    """The words of some texts: where each begins and ends, its script, and the hashes of its trigrams and itself."""

    def __init__(self, texts: list[str]):
        table = Alphabet.get()
        joined = "\n".join(texts) + "\n"
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        low = table.letter[code]
        letter = low > 0
        edge = np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8))
        self.begin, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_at = np.concatenate([[0], np.cumsum(sizes)])
        #: First word of each text, and their number.
        self.first = np.searchsorted(self.begin, self.text_at)
        self.n_words = np.diff(self.first)
        self.letters = self.end - self.begin
        at = np.flatnonzero(letter)
        wide = np.concatenate([[0], low, [0]]).astype(np.uint64)
        self.trigrams = _mixed((wide[at] * np.uint64(0x1F123BB5) + wide[at + 1]) * np.uint64(0x5851F42D4C957F2D) + wide[at + 2] * np.uint64(0x2545F4914F6CDD1D)).astype(np.int32)
        self.cut = np.concatenate([[0], np.cumsum(self.letters)])[:-1]
        if len(self.begin):
            place = (np.arange(len(at)) - np.repeat(self.cut, self.letters)).astype(np.uint64)
            self.whole = _mixed(np.add.reduceat((wide[at + 1] + np.uint64(7)) * (place * np.uint64(0x9E3779B1) + np.uint64(0x85EBCA77)) ** np.uint64(3), self.cut)).astype(np.int32)
            self.script = table.script[code[self.begin]]
        else:
            self.whole, self.script = np.zeros(0, np.int32), np.zeros(0, np.uint8)


def _chunks(texts: list[str]):
    """(first, last) of runs of texts with about CHUNK characters."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _count(batches):
    counts: dict[str, list[np.ndarray]] = {}
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        for lang in set(langs):
            own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
            for a, b in _chunks(own):
                w = Words(own[a:b])
                c = counts.setdefault(lang, [np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64), np.zeros(len(SCRIPT_NAMES), np.int64)])
                c[0] += np.bincount(w.trigrams, minlength=1 << BITS)
                c[1] += np.bincount(w.whole, minlength=1 << BITS)
                c[2] += np.bincount(w.script, minlength=len(SCRIPT_NAMES))
    for lang, tables in counts.items():
        for kind, c in enumerate(tables):
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "kind", "at", "n"])


class Model:
    """Languages, their two tables of log-probabilities, and the scripts in which they were seen."""

    def __init__(self, langs: list[str], counts: dict[tuple[str, int], np.ndarray]):
        self.langs = langs
        n = 1 << BITS
        log = lambda c: np.log((c + 0.5) / (c.sum() + 0.5 * n)).astype(np.float32)
        self.trigram = [log(counts[x, 0]) for x in langs]
        self.whole = [log(counts[x, 1]) for x in langs]
        seen = np.array([counts[x, 2] for x in langs], dtype=float).reshape(len(langs), len(SCRIPT_NAMES))
        seen = seen >= np.maximum(1, 1e-3 * seen.sum(axis=1, keepdims=True))
        self.allowed = np.where(seen.any(axis=0), seen, True).T  # script, language

    def word_scores(self, w: Words) -> np.ndarray:
        """Words by languages."""
        out = np.empty((len(w.begin), len(self.langs)), np.float32)
        for k in range(len(self.langs)):
            out[:, k] = np.add.reduceat(self.trigram[k][w.trigrams], w.cut) + self.whole[k][w.whole]
        out[~self.allowed[w.script]] = -np.inf
        return np.maximum(out - out.max(axis=1, keepdims=True), -CLIP)

    def labels(self, w: Words) -> np.ndarray:
        """The language of each word, by Viterbi over each text."""
        n = len(w.begin)
        if n == 0:
            return np.zeros(0, np.int16)
        scores = self.word_scores(w)
        order = np.argsort(-w.n_words, kind="stable")
        length = w.n_words[order]
        first = w.first[:-1][order]
        came = np.zeros((n, len(self.langs)), np.int16)
        active = np.searchsorted(-length, 0, side="left")
        v = scores[first[:active]].astype(np.float64)
        ends = np.zeros(len(order), np.int64)
        own = np.arange(len(self.langs), dtype=np.int16)
        live = active
        for t in range(1, int(length[0]) if len(length) else 0):
            still = int(np.searchsorted(-length, -t, side="left"))
            if still < live:
                ends[still:live] = v[still:live].argmax(axis=1)
                live = still
            prev = v[:live]
            top = prev.argmax(axis=1)
            switched = prev[np.arange(live), top] - PENALTY
            stay = prev >= switched[:, None]
            rows = first[:live] + t
            came[rows] = np.where(stay, own, top[:, None])
            v[:live] = np.where(stay, prev, switched[:, None]) + scores[rows]
        ends[:live] = v[:live].argmax(axis=1)
        out = np.zeros(n, np.int16)
        state = ends.copy()
        live = 0
        for t in range(int(length[0]) - 1 if len(length) else -1, -1, -1):
            live = int(np.searchsorted(-length, -t, side="left"))
            rows = first[:live] + t
            out[rows] = state[:live]
            state[:live] = came[rows, state[:live]]
        return out


def train(docs: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fit on about ``max_train`` documents of ``docs`` (text, lang) with both given."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    total = rows.select("lang").count()
    if total > max_train:
        rows = rows.where(F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1_000_000)) < int(1e6 * max_train / total))
    summed = rows.select("text", "lang").mapInArrow(_count, "lang string, kind int, at int, n long").groupBy("lang", "kind", "at").agg(F.sum("n").alias("n"))
    got = summed.toArrow().to_pandas()
    langs = sorted(got["lang"].unique().tolist())
    counts = {(x, k): np.zeros(len(SCRIPT_NAMES) if k == 2 else 1 << BITS, np.int64) for x in langs for k in range(3)}
    for (lang, kind), part in got.groupby(["lang", "kind"]):
        counts[lang, kind][part["at"].to_numpy()] = part["n"].to_numpy()
    return Model(langs, counts)


RESULT = "lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>"


def _predict(model: Model, keys: list[str], spans: bool, text: str = "__text"):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def judge(texts: list[str]):
        """(language, score, spans or None) of each text."""
        if not model.langs:
            yield from [(UND, 0.0, [] if spans else None)] * len(texts)
            return
        w = Words(texts)
        label = model.labels(w)
        doc = np.repeat(np.arange(len(texts)), w.n_words)
        by = np.zeros((len(texts), len(model.langs)))
        np.add.at(by, (doc, label), w.letters)
        total, best = by.sum(axis=1), by.argmax(axis=1)
        mine = [[] if spans else None for _ in texts]
        if spans:
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])
            at = np.flatnonzero(new)
            last = np.concatenate([at[1:], [len(doc)]])[: len(at)] - 1
            for d, s, e, k in zip(doc[at].tolist(), w.begin[at].tolist(), w.end[last].tolist(), label[at].tolist(), strict=True):
                mine[d].append({"start": s - int(w.text_at[d]), "end": e - int(w.text_at[d]), "lang": model.langs[k]})
        score = by.max(axis=1) / np.maximum(total, 1)
        yield from ((model.langs[k] if n else UND, x, own) for k, n, x, own in zip(best.tolist(), total.tolist(), score.tolist(), mine, strict=True))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [t or "" for t in part.column(text).to_pylist()]
                order = sorted(range(len(texts)), key=lambda i: len(texts[i]))  # texts of like length step together
                found = [None] * len(texts)
                for a, b in _chunks([texts[i] for i in order]):
                    for i, x in zip(order[a:b], judge([texts[i] for i in order[a:b]]), strict=True):
                        found[i] = x
                pred, score, own = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(own, kind)], names=[*keys, "lang_pred", "score", "spans"])

    return run


def identify(docs: DataFrame, model: Model, keys: list[str], spans: bool = True) -> DataFrame:
    """The columns ``keys`` of ``docs`` with lang_pred, score and spans (code points, end exclusive) of its ``text``."""
    rows = docs.select(*[F.col(f"`{k}`") for k in keys], F.col("text").cast("string").alias("__text"))
    schema = ", ".join(f"`{k}` {t}" for k, t in rows.dtypes if k != "__text")
    return rows.mapInArrow(_predict(model, keys, spans), f"{schema}, {RESULT}")


def fold(doc_id=None):
    """crc32 of the id as text, mod 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3


def language_report(docs: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from the documents not held out."""
    model = train(docs.where(fold() != 1), max_train)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (fold() == 1).alias("held_out"), "text")
    return identify(rows, model, ["doc_id", "held_out"], spans=False).drop("spans")


def keep_identified(docs: DataFrame, min_score: float = 0.2, max_train: int = MAX_TRAIN) -> DataFrame:
    """``docs`` without documents that are ``und`` or whose letters are spread so that no language has ``min_score`` of them.

    Text in several languages stays. Where no language could be learned, all documents stay.
    """
    model = train(docs.where(fold() != 1), max_train)
    if not model.langs:
        return docs
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = f"c{names.index('text')}"
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    judged = rows.mapInArrow(_predict(model, rows.columns, False, text), f"{schema}, {RESULT}")
    return judged.where((F.col("lang_pred") != UND) & (F.col("score") >= min_score)).select(*rows.columns).toDF(*names)
