"""Packing: mixture-controlled deficit round-robin over source queues.

Each document becomes its tokenizer's ids and an end id. A source's documents are one queue, whose length and
positions follow from sums by part file. The queues are served in lanes of about ``LANE`` tokens: a lane gets
of each queue the tokens from its share of all lanes before to its share with this one, rounded down, so what a
lane owes is carried to the next as a fraction of a token, and no lane's mixture departs further the later it
comes. Documents are cut where a lane ends. In a lane every window of ``WINDOW`` tokens (a whole number of
sequences) adds a source's share of the window to its deficit and serves that many tokens, cutting documents freely;
a source that is owed too little for a piece waits with its deficit. Sources with less than a 512th of a lane are not
cut that fine: they take turns, in some lanes each. A lane's tokens follow the ones before it without a gap,
so only the very last sequence is padded.

With a given mixture the sources' shares of a window are its weights. When a queue runs dry the others share its
room by their weights: lanes are cut anew from there. Sources without a weight come last, by their sizes.

Defined results: null text is an empty document, which is the end id alone; a null source is a queue of its own
(that of ''); repeated rows are packed each on its own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.llm.scratch import materialize

SEQUENCE = 2048
WINDOW = 16 * SEQUENCE
LANE = 1 << 20
END = 1
#: Pieces shorter than this are not cut for the sake of a deficit.
LEAST_PIECE = 64
#: Lanes, or part files, whose sums one task adds up.
SPAN = 4096
#: A source's tokens in one lane are not cut below this part of a lane.
FINEST = 512
#: Rows of sums that may be broadcast, at about 50 bytes each; more are joined by shuffle.
BROADCAST_SUMS = 500_000
# Fixed value: the pattern by which byte-level BPE with 50,257 ids cuts text into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_chars() -> dict[str, int]:
    """Character -> byte of byte-level BPE files: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in own}
    rest = (b for b in range(256) if b not in set(own))
    return table | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts as bytes of 16- or 32-bit numbers.

    A text that holds a special token's string goes through the tokenizer file's own encoder.
    """

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            own = json.load(file)
        self.path, self.whole = path, None
        special = [t["content"] for t in own.get("added_tokens", ())]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        back = _byte_chars()
        ranks = {bytes(back[c] for c in token): k for token, k in own["model"]["vocab"].items() if token not in special}
        self.kind = np.dtype("<u2" if max([*ranks.values(), *(t["id"] for t in own.get("added_tokens", ()))]) < 1 << 16 else "<u4")
        self.plain = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def get(cls, path: str) -> Encoder:
        """The worker's encoder for a tokenizer file."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def encode(self, text: str) -> bytes:
        """The ids of ``text``."""
        if self.special and self.special.search(text):
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.path)
            ids = self.whole.encode(text, add_special_tokens=False).ids
        else:
            ids = self.plain.encode_ordinary(text)
        packed = array("H" if self.kind.itemsize == 2 else "I", ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()


def default_tokenizer() -> str:
    """Path of the byte-level BPE file among the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def vocabulary_size(path: str) -> int:
    """One more than the largest id of a tokenizer file."""
    with open(path, encoding="utf-8") as file:
        own = json.load(file)
    return 1 + max([*own["model"]["vocab"].values(), *(t["id"] for t in own.get("added_tokens", ()))])


def _tokenize(path: str, end: int):
    """Ids of texts, with the tokens of the same source before them in the partition."""

    def run(batches):
        encoder = Encoder.get(path)
        last = np.array([end], encoder.kind).tobytes()
        past: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = [encoder.encode(t or "") + last for t in part.column("text").to_pylist()]
                n, before = [len(x) // encoder.kind.itemsize for x in ids], []
                for source, k in zip(part.column("source").to_pylist(), n, strict=True):
                    before.append(past.get(source, 0))
                    past[source] = before[-1] + k
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), pa.array(n, pa.int64()), pa.array(before, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "source", "n", "here", "ids"])

    return run


def tokenized(docs: DataFrame, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """part, doc_id, source, n, here, ids: the documents' ids, written once; ``here``: the source's tokens before, in the part."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("text").cast("string").alias("text"))
    ids = rows.mapInArrow(_tokenize(tokenizer or default_tokenizer(), end), "doc_id long, source string, n long, here long, ids binary")
    return materialize(ids.withColumn("part", F.spark_partition_id().cast("bigint")), "token-ids")


def _prefix_sums(sums: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """``sums`` with ``before``: the sum of ``value`` over smaller ``at``, in spans of them and then over spans."""
    spans = sums.groupBy(*by, F.floor(F.col(at) / SPAN).alias("span")).agg(F.sum(value).alias("s"))
    spans = spans.withColumn("past", F.coalesce(F.sum("s").over(Window.partitionBy(*by).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
    inside = Window.partitionBy(*by, "span").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    rows = sums.withColumn("span", F.floor(F.col(at) / SPAN))
    rows = rows.withColumn("inner", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(spans, [*by, "span"]).withColumn("before", F.col("inner") + F.col("past")).drop("inner", "past", "span")


def phases(totals: dict[str, int], weights: dict[str, float], lane_tokens: int) -> tuple[list[tuple], int]:
    """([(source, x0, tokens, lane0, lanes)], next lane): the queues of a mixture, cut anew whenever one runs dry.

    From its token ``x0`` on, a source has ``tokens`` in the ``lanes`` lanes from ``lane0``.
    """
    left, done, out, lane = {s: n for s, n in totals.items() if n}, dict.fromkeys(totals, 0), [], 0
    while left:
        dry = min(left, key=lambda s: (left[s] / weights[s], s))
        time = left[dry] / weights[dry]
        given = {s: n if s == dry else min(n, int(weights[s] * time)) for s, n in left.items()}
        lanes = max(1, -(-sum(given.values()) // lane_tokens))
        out += [(s, done[s], n, lane, lanes) for s, n in given.items() if n]
        lane += lanes
        done = {s: done[s] + given.get(s, 0) for s in done}
        left = {s: n - given[s] for s, n in left.items() if n > given[s]}
    return out, lane


def segments(totals: DataFrame, mixture: dict[str, float] | None, lane_tokens: int) -> DataFrame:
    """source, x0, tokens, lane0, lanes, cuts, shift of each queue's segments, from totals (source, tokens).

    A segment's tokens are cut into ``cuts`` parts of equal size (larger by a token at first); part j goes to lane
    lane0 + j * lanes // cuts + shift.
    """
    spark = totals.sparkSession
    weights = {s: float(w) for s, w in (mixture or {}).items() if w > 0}
    named = {r["source"]: r["tokens"] for r in totals.where(F.col("source").isin(list(weights))).collect()} if weights else {}  # at most the mixture's
    known, lane = phases(named, weights, lane_tokens)
    rest = totals.where(~F.col("source").isin(list(weights))) if weights else totals
    lanes = max(1, -(-rest.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0] // lane_tokens))
    rest = rest.select("source", F.lit(0).cast("bigint").alias("x0"), "tokens", F.lit(lane).cast("bigint").alias("lane0"), F.lit(lanes).cast("bigint").alias("lanes"))
    if known:
        rest = rest.unionByName(spark.createDataFrame(known, "source string, x0 long, tokens long, lane0 long, lanes long"))
    rows = rest.withColumn("cuts", F.greatest(F.lit(1), F.least("lanes", F.expr(f"tokens div {max(LEAST_PIECE, lane_tokens // FINEST)}"))).cast("bigint"))
    return rows.withColumn("shift", F.pmod(F.xxhash64("source"), F.expr("lanes div cuts")))


def lane_pieces(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` (source, before: the queue's tokens before, n, ...) cut where lanes end: with lane, start, length and pos (in the queue)."""
    near = rows.join(cuts, "source").where("before < x0 + tokens and before + n > x0")
    near = near.withColumns({"q": F.expr("tokens div cuts"), "r": F.expr("tokens % cuts"), "lo": F.expr("greatest(before - x0, 0)"), "hi": F.expr("least(before + n - x0, tokens) - 1")})
    cut = lambda x: F.expr(f"if({x} < r * (q + 1), {x} div (q + 1), r + ({x} - r * (q + 1)) div q)")
    near = near.withColumn("j", F.explode(F.sequence(cut("lo"), cut("hi"))))
    edge = lambda j: F.expr(f"x0 + ({j}) * q + least({j}, r)")
    near = near.withColumns({"lane": F.expr("lane0 + (j * lanes) div cuts + shift"), "pos": F.greatest("before", edge("j"))})
    near = near.withColumns({"start": F.col("pos") - F.col("before"), "length": F.least(F.col("before") + F.col("n"), edge("j + 1")) - F.col("pos")})
    return near.drop("x0", "tokens", "lane0", "lanes", "cuts", "shift", "q", "r", "lo", "hi", "j", "before")


class Lane:
    """Deficit round-robin over the queues of a lane; yields (piece, start, length, position).

    A queue is a list of (piece, tokens). Each source's share is its part of the lane, so all run dry together.
    """

    def __init__(self, queues: list[list[tuple[int, int]]], base: int, window: int):
        self.queues, self.at, self.window = queues, base, window
        self.left = [sum(n for _, n in q) for q in queues]
        total = sum(self.left) or 1
        self.shares = [n / total for n in self.left]
        self.deficits = [0.0] * len(queues)
        self.head = [(0, 0)] * len(queues)  # the next piece of each queue and the ids of it that went out

    def grants(self, room: int) -> list[int]:
        """Tokens that each queue gets of a window's ``room``: its deficit first, then the rest by shares."""
        grant = [0] * len(self.queues)
        for s in sorted(range(len(grant)), key=lambda s: (-self.deficits[s], s)):
            due = min(int(self.deficits[s]), self.left[s], room)
            if due >= LEAST_PIECE or due == self.left[s] > 0:
                grant[s] = due
                room -= due
        while room > 0 and (live := [s for s in range(len(grant)) if self.left[s] > grant[s]]):
            total = sum(self.shares[s] for s in live)
            for s in sorted(live, key=lambda s: (-(self.deficits[s] - grant[s]), s)):
                even = room if total <= 0 else int(room * self.shares[s] / total) + 1
                # a queue that gets a piece here already may be rounded up by any number, others by a piece
                more = min(self.left[s] - grant[s], even if grant[s] else max(even, LEAST_PIECE), room)
                grant[s] += more
                room -= more
                total -= self.shares[s]
                if room == 0:
                    break
        return grant

    def pieces(self):
        """All pieces of the lane, window after window."""
        while any(self.left):
            room = min(self.window - self.at % self.window, sum(self.left))
            for s, share in enumerate(self.shares):
                self.deficits[s] += share * room
            for s, grant in enumerate(self.grants(room)):
                self.deficits[s] -= grant
                self.left[s] -= grant
                k, start = self.head[s]
                while grant:
                    piece, n = self.queues[s][k]
                    take = min(grant, n - start)
                    yield piece, start, take, self.at
                    self.at += take
                    grant -= take
                    start += take
                    if start == n:
                        k, start = k + 1, 0
                self.head[s] = (k, start)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, ids array<int>"


def _pack_lane(sequence: int, window: int, wide: bool, with_ids: bool):
    kind = np.dtype("<u4") if wide else np.dtype("<u2")
    types = [pa.int64()] * 7 + [pa.string(), pa.list_(pa.int32())]
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]

    def run(_key, rows, bases):
        order = np.lexsort((rows.column("pos").to_numpy(), rows.column("source").to_numpy(zero_copy_only=False)))
        doc_ids, sources, n, starts, ids = (rows.column(c).to_pylist() for c in ("doc_id", "source", "n", "start", "ids"))
        queues: dict[str, list[tuple[int, int]]] = {}
        for i in order.tolist():
            queues.setdefault(sources[i], []).append((i, len(ids[i]) // kind.itemsize))
        lane = Lane(list(queues.values()), bases.column("base")[0].as_py(), window)
        out = [[] for _ in names]
        for piece, start, length, at in lane.pieces():
            own = np.frombuffer(ids[piece], kind)
            while length:
                take = min(length, sequence - at % sequence)
                cut = own[start : start + take].astype("<u4")
                for column, value in zip(out, (doc_ids[piece], starts[piece] + start, take, zlib.crc32(cut.tobytes()), n[piece], at // sequence, at % sequence, sources[piece], cut.astype(np.int32) if with_ids else None), strict=True):
                    column.append(value)
                start, length, at = start + take, length - take, at + take
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    return run


def _small(sums: DataFrame) -> DataFrame:
    return F.broadcast(sums) if sums.count() <= BROADCAST_SUMS else sums


def pack(docs: DataFrame, tokenizer: str | None = None, mixture: dict[str, float] | None = None, sequence: int = SEQUENCE, window: int = WINDOW, lane_tokens: int = LANE, end: int = END, with_ids: bool = True) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, ids.

    ``mixture`` has the sources' weights, by default their sizes. ``ids`` is null unless ``with_ids``; a sequence is
    its pieces by offset, padded to ``sequence``.
    """
    path = tokenizer or default_tokenizer()
    wide = vocabulary_size(path) > 1 << 16
    rows = tokenized(docs, path, end)
    sums = materialize(rows.groupBy("part", "source").agg(F.sum("n").alias("tokens")), "part-sums")
    starts = materialize(_prefix_sums(sums, ["source"], "part", "tokens").select("part", "source", "before"), "part-starts")
    cuts = materialize(segments(sums.groupBy("source").agg(F.sum("tokens").alias("tokens")), mixture, lane_tokens), "queue-cuts")
    rows = rows.join(_small(starts), ["part", "source"]).withColumn("before", F.col("before") + F.col("here"))
    pieces = lane_pieces(rows.select("doc_id", "source", "n", "before", "ids"), _small(cuts))
    bases = _prefix_sums(pieces.groupBy("lane").agg(F.sum("length").alias("tokens")), [], "lane", "tokens")
    bases = materialize(bases.select("lane", F.col("before").alias("base")), "lane-bases")
    size = 4 if wide else 2
    part = F.substr("ids", (F.col("start") * size + 1).cast("int"), (F.col("length") * size).cast("int"))
    lanes = pieces.select("lane", "pos", "doc_id", "source", "n", "start", part.alias("ids")).groupBy("lane").cogroup(bases.groupBy("lane"))
    return lanes.applyInArrow(_pack_lane(sequence, window, wide, with_ids), SCHEMA)


def packing_report(docs: DataFrame, **options) -> DataFrame:
    """The pieces without their ids."""
    return pack(docs, with_ids=False, **options).drop("ids")
