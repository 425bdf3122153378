"""Quality classifier by co-training of a text view and a metadata view.

The text view is a logistic regression on hashed words and word beginnings (present or not), a few shape measures of
the text, and the mean log-odds of its words; the metadata view is one on the document's source, language and
length. Both are fitted on a bounded sample of labelled rows. In each round each view judges all documents outside
that sample; those of which it is confident (beyond a cut at which its precision on rows held back for this reaches
``PRECISION``, for each class by itself) become pseudo-labels for the other view. They reach it as counts of its words by
pseudo-class over the whole corpus, summed before they come to the driver: the log-odds of every word, and so the
regression's features, are taken from labels and pseudo-labels together. Then a last regression, on labels held back for
it, calibrates both views' scores into one, so a view that knows nothing gets no weight. One such pair is trained
for quality and one for toxicity, and all documents are scored. Each text is read once, into a table of features.

Bound of what is fitted on: about ``LABELLED`` labelled documents, chosen by a hash of the id, whole texts. Everything
else covers all rows.

Defined results: null text counts as empty, null source and language as values of their own; without any labels, or with
labels of one class alone, every score is that class's frequency (0.5 without labels); a document labelled more than
once has the mean, rounded; repeated rows are scored each on its own; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.scratch import materialize

LABELLED = 8_000
BITS = 16
PREFIX = 4
ROUNDS = 2
#: Tried for each view; the least loss on held-back labels decides.
PENALTIES = (1e-2, 1e-3, 1e-4)
PRECISION = 0.97
#: What a pseudo-label counts for.
WORTH = 0.5
SHAPES = 8
META = 256
WIDTHS = (1 << BITS, META)
NAMES = ("quality", "toxic")
#: Labelled rows by hash of the id: of ten parts one is for the penalties, one for the cuts, two for the calibration.
PARTS, PENALTY, CUTS, CALIBRATION = 10, (0,), (1,), (2, 3)


class _Slots(dict):
    """Word -> its slot, and above that the slot of its first PREFIX letters."""

    def __missing__(self, word):
        if len(self) >= 100_000:
            self.clear()
        whole, start = (xxhash.xxh32_intdigest(x.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for x in (word, f"{word[:PREFIX]}-"))
        found = whole | start << BITS
        if len(word) <= 64:
            self[word] = found
        return found


def text_features(text: str, slots: _Slots) -> tuple[np.ndarray, list[float]]:
    """(distinct word slots, shape measures between about 0 and 1) of a whole text."""
    words = text.lower().split()
    own = np.fromiter((slots[w.strip(".,;:!?\"'()")] for w in words), np.int64, len(words))
    own = np.unique(np.concatenate([own & ((1 << BITS) - 1), own >> BITS])).astype(np.int32)
    n, m = max(1, len(text)), max(1, len(words))
    upper = sum(map(str.isupper, text.split())) / m
    odd = sum(text.count(c) for c in "|#*%$&!<>{}[]\\~^") / m
    shapes = [
        min(1.0, math.log1p(len(words)) / 12),
        upper,
        min(1.0, odd),
        len(set(words)) / m,
        min(1.0, len(text) / m / 20),
        min(1.0, text.count("\n") / m * 5),
        sum(text.count(c) for c in "0123456789") / n,
        min(1.0, (text.count(".") + text.count(",")) / m),
    ]
    return own, shapes


def meta_features(source, lang, n_chars) -> list[int]:
    """Slots of the metadata: source, language, and length on a log scale."""
    kinds = (f"s{source}", f"l{lang}", f"n{int(math.log2(max(1, n_chars or 1)))}")
    return [xxhash.xxh32_intdigest(k.encode("utf-8", "surrogatepass")) % META for k in kinds]


def _features(batches):
    slots = _Slots()
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            text = [text_features(t or "", slots) for t in part.column("text").to_pylist()]
            meta = [meta_features(*x) for x in zip(*[part.column(c).to_pylist() for c in ("source", "lang", "n_chars")], strict=True)]
            packed = [pa.array([np.asarray(x, kind).tobytes() for x in own], pa.binary()) for own, kind in (([w for w, _ in text], "<u2"), ([v for _, v in text], "<f4"), (meta, "<u2"))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *packed], names=["doc_id", "words", "shapes", "meta"])


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Rows:
    """Sparse 0/1 features in rows, with dense columns beside them."""

    def __init__(self, slots: list[np.ndarray], dense: np.ndarray, width: int):
        self.slots = np.concatenate([*slots, np.zeros(0, np.int32)]).astype(np.int64)
        self.row = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
        self.dense, self.width = dense, width

    def part(self, rows: np.ndarray) -> Rows:
        """The rows at ``rows`` (ascending)."""
        out = Rows([], self.dense[rows], self.width)
        place = np.full(len(self.dense), -1)
        place[rows] = np.arange(len(rows))
        keep = place[self.row] >= 0
        out.slots, out.row = self.slots[keep], place[self.row[keep]]
        return out

    def beside(self, column: np.ndarray) -> Rows:
        """The same rows with one more dense column."""
        out = Rows([], np.column_stack([self.dense, column]), self.width)
        out.slots, out.row = self.slots, self.row
        return out

    def mean(self, value: np.ndarray) -> np.ndarray:
        """The sum of the slots' values by the root of their number, for each row."""
        n = np.bincount(self.row, minlength=len(self.dense))
        return np.bincount(self.row, weights=value, minlength=len(self.dense)) / np.sqrt(np.maximum(n, 1))

    def dot(self, w: np.ndarray) -> np.ndarray:
        """Scores of all rows, without the intercept."""
        return np.bincount(self.row, weights=w[self.slots], minlength=len(self.dense)) + self.dense @ w[self.width :]

    def only(self, use: np.ndarray) -> Rows:
        """The same rows with the slots in ``use`` alone."""
        out = Rows([], self.dense, self.width)
        keep = use[self.slots]
        out.slots, out.row = self.slots[keep], self.row[keep]
        return out

    def back(self, r: np.ndarray) -> np.ndarray:
        """The transpose applied to residuals."""
        return np.concatenate([np.bincount(self.slots, weights=r[self.row], minlength=self.width), self.dense.T @ r])


def fit(rows: Rows, y: np.ndarray, weight: np.ndarray, penalty: float, scale: np.ndarray | None = None, steps: int = 80) -> np.ndarray:
    """Weights and intercept of an L2-penalised logistic regression, by Adam on all rows.

    ``scale`` stretches each slot, so that a slot of strong association needs little weight.
    """
    size = rows.width + rows.dense.shape[1]
    by = np.concatenate([np.ones(rows.width) if scale is None else scale, np.ones(size - rows.width)])
    w = np.zeros(size + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    total = max(weight.sum(), 1e-9)
    for t in range(1, steps + 1):
        r = weight * (_sigmoid(rows.dot(w[:-1] * by) + w[-1]) - y)
        g = np.concatenate([rows.back(r) * by, [r.sum()]]) / total
        g[: rows.width] += penalty * w[: rows.width]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    w[:-1] *= by
    return w


class Odds:
    """Log-odds of slots from counts by class; at most 3 either way, 0 within their own standard error."""

    def __init__(self, rows: Rows, y: np.ndarray, given: np.ndarray | None):
        count = lambda of: np.bincount(rows.slots[of[rows.row]], minlength=rows.width).astype(float)
        self.counts = [count(y == 0), count(y == 1)]
        self.totals = [float((y == 0).sum()), float((y == 1).sum())]
        if given is not None:  # by class: the slots' counts, and at the end the number of documents
            for k in (0, 1):
                self.counts[k] += WORTH * given[k, :-1]
                self.totals[k] += WORTH * given[k, -1]

    def ratio(self, without: int | None = None) -> np.ndarray:
        """The log-odds of class 1; ``without`` one document of that class, for the documents that were counted."""
        less = [float(without == k) for k in (0, 1)]
        n = [np.maximum(c - x, 0) + 1 for c, x in zip(self.counts, less, strict=True)]
        r = np.log(n[1] / max(self.totals[1] - less[1] + 2, 1)) - np.log(n[0] / max(self.totals[0] - less[0] + 2, 1))
        return np.where(np.abs(r) >= np.sqrt(1 / n[0] + 1 / n[1]), np.clip(r, -3, 3), 0.0)


class View:
    """One view's regression: the slots' weights, stretched by their log-odds, and that of the mean log-odds."""

    def __init__(self, rows: Rows, y: np.ndarray, fitted: np.ndarray, tried: np.ndarray, given: np.ndarray | None, penalties=PENALTIES):
        own = rows.part(fitted)
        odds = Odds(own, y[fitted], given)
        self.odds = odds.ratio()
        # a row that was counted is judged by the others alone
        apart = np.where(y[fitted][own.row] == 1, odds.ratio(1)[own.slots], odds.ratio(0)[own.slots])
        slim = own.beside(own.mean(apart)).only(self.odds != 0)
        rest, found = self.shown(rows.part(tried)), []
        for penalty in penalties:
            m = fit(slim, y[fitted], np.ones(len(fitted)), penalty, self.odds)
            p = np.clip(_sigmoid(rest.dot(m[:-1]) + m[-1]), 1e-6, 1 - 1e-6)
            found.append((-float(np.mean(np.log(np.where(y[tried] == 1, p, 1 - p)))) if len(tried) else 0.0, penalty, m))
        _, self.penalty, self.weights = min(found, key=lambda x: x[:2])

    def shown(self, rows: Rows) -> Rows:
        """``rows`` as the regression sees them."""
        return rows.beside(rows.mean(self.odds[rows.slots])).only(self.odds != 0)

    def logit(self, rows: Rows) -> np.ndarray:
        """The score of each row."""
        return self.shown(rows).dot(self.weights[:-1]) + self.weights[-1]


def _cut(p: np.ndarray, y: np.ndarray) -> float:
    """The least score from which the share of y is at least PRECISION; over 1 where there is none."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(right >= max(PRECISION, (1 + y.mean()) / 2)) if len(y) else []
    return float(p[order][good[-1]]) if len(good) and good[-1] >= 9 else 2.0


class Judge:
    """The views of one label, their cuts, and their calibration."""

    def __init__(self, views: list[Rows], y: np.ndarray, part: np.ndarray, given: list[np.ndarray] | None = None):
        """``part`` is each row's (doc's) tenth; ``given`` for each view the pseudo-labels' counts by class."""
        known = ~np.isnan(y)
        self.prior = float(y[known].mean()) if known.any() else 0.5
        self.views = self.mix = None
        if known.sum() < 20 or self.prior in (0.0, 1.0):
            return
        at = lambda parts: np.flatnonzero(known & np.isin(part, parts))
        fitted, tried, cuts, last = (at(x) for x in (range(max(CALIBRATION) + 1, PARTS), PENALTY, CUTS, CALIBRATION))
        if len(fitted) < 2 or not 0 < y[fitted].mean() < 1 or not len(last):
            return
        given = given or [None] * len(views)
        self.first = [View(v, y, fitted, tried, g) for v, g in zip(views, given, strict=True)]
        p = [_sigmoid(m.logit(v.part(cuts))) for m, v in zip(self.first, views, strict=True)]
        self.cuts = [(_cut(1 - x, 1 - y[cuts]), _cut(x, y[cuts])) for x in p]
        # scores come from views fitted on all rows but those of the calibration
        most = np.sort(np.concatenate([fitted, tried, cuts]))
        self.views = [View(v, y, most, most[:0], g, (m.penalty,)) for v, m, g in zip(views, self.first, given, strict=True)]
        z = self.logits([v.part(last) for v in views])
        self.mix = fit(Rows([np.zeros(0, np.int32)] * len(last), z, 0), y[last], np.ones(len(last)), 1e-3, steps=300)

    def logits(self, views: list[Rows]) -> np.ndarray:
        """The views' scores of each row, in columns."""
        return np.clip(np.stack([m.logit(v) for v, m in zip(views, self.views, strict=True)], axis=1), -15, 15)

    def sure(self, views: list[Rows], k: int) -> np.ndarray:
        """The class of each row of which view ``k`` is confident, else -1."""
        p = _sigmoid(self.first[k].logit(views[k]))
        no, yes = self.cuts[k]
        return np.where(p >= yes, 1, np.where(1 - p >= no, 0, -1))

    def score(self, views: list[Rows]) -> np.ndarray:
        """The probability of the label for each row."""
        if self.views is None:
            return np.full(len(views[0].dense), self.prior)
        return _sigmoid(self.logits(views) @ self.mix[:-1] + self.mix[-1])


def _views(batch) -> list[Rows]:
    """Both views of a batch of the feature table."""
    words, shapes, meta = ([np.frombuffer(x, kind) for x in batch.column(c).to_pylist()] for c, kind in (("words", "<u2"), ("shapes", "<f4"), ("meta", "<u2")))
    return [Rows(words, np.array(shapes, float).reshape(len(words), SHAPES), WIDTHS[0]), Rows(meta, np.zeros((len(meta), 0)), WIDTHS[1])]


def _sampled(rows: DataFrame, most: int) -> DataFrame:
    total = rows.count()
    return rows if total <= most else rows.where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1_000_000)) < int(1e6 * most / total))


def feature_table(docs: DataFrame) -> DataFrame:
    """doc_id, words, shapes, meta (packed numbers) of every document, written once."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("bigint").alias("n_chars"))
    return materialize(rows.mapInArrow(_features, "doc_id long, words binary, shapes binary, meta binary"), "quality-features")


def _pseudo(judges: dict[str, Judge]):
    """For each label and view the slots' counts by the class that the other view is sure of; slot ``width`` counts documents."""

    def run(batches):
        sums = {(x, k): np.zeros((2, WIDTHS[k] + 1), np.int64) for x in judges for k in (0, 1)}
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                views = _views(batch.slice(at, 1000))
                for x, judge in judges.items():
                    for k, v in enumerate(views):
                        sure = judge.sure(views, 1 - k)
                        for y in (0, 1):
                            sums[x, k][y, :-1] += np.bincount(v.slots[sure[v.row] == y], minlength=v.width)
                            sums[x, k][y, -1] += int((sure == y).sum())
        for (x, k), own in sums.items():
            y, slot = np.nonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(y), pa.string()), pa.array(np.full(len(y), k, np.int32)), pa.array(y.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(own[y, slot])], names=["label", "view", "class", "slot", "n"])

    return run


def train(features: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> dict[str, Judge]:
    """The judges of quality and toxicity, after ``rounds`` exchanges of pseudo-labels over all of ``features``."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic")).where("doc_id is not null")
    known = known.groupBy("doc_id").agg(*[F.round(F.avg(x)).alias(x) for x in NAMES])
    chosen = materialize(_sampled(known, labelled), "quality-sample")
    # the sample is bounded by a parameter, so the features stay where they are
    got = features.join(F.broadcast(chosen), "doc_id").withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(PARTS))).orderBy("doc_id", "words").toArrow()
    views, part = _views(got), got.column("part").to_numpy()
    y = {x: np.array([np.nan if v is None else v for v in got.column(x).to_pylist()], float) for x in NAMES}
    judges = {x: Judge(views, y[x], part) for x in NAMES}
    rest = features.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti")
    for _ in range(rounds):
        live = {x: j for x, j in judges.items() if j.views is not None}
        if not live:
            break
        sums = rest.mapInArrow(_pseudo(live), "label string, view int, class int, slot int, n long").groupBy("label", "view", "class", "slot").agg(F.sum("n").alias("n")).toPandas()
        given = {x: [np.zeros((2, w + 1)) for w in WIDTHS] for x in live}
        for (x, k), own in sums.groupby(["label", "view"]):
            given[x][k][own["class"], own["slot"]] = own["n"]
        judges |= {x: Judge(views, y[x], part, given[x]) for x in live}
    return judges


def _score(judges: dict[str, Judge]):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                views = _views(part)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(judges[x].score(views)) for x in NAMES]], names=["doc_id", *NAMES])

    return run


def score_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, quality, toxic (probabilities) and keep (good and not toxic) of every document."""
    features = feature_table(docs)
    scored = features.mapInArrow(_score(train(features, labels, **options)), "doc_id long, quality double, toxic double")
    return scored.withColumn("keep", (F.col("quality") >= 0.5) & (F.col("toxic") < 0.5))
