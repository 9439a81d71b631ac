"""Quality classifier: random-indexing word vectors, pooled per document, and a
two-layer numpy network with temperature-calibrated probabilities.

1. Every word has a sparse random index vector (a few +-1 among ``DIM`` places,
   drawn from its hash). Its word vector is the sum of the index vectors of its
   neighbours over the whole corpus, kept per hashed word slot, so the table has
   a fixed size (``SLOTS`` x ``DIM``). Tasks emit integer partial tables, which
   are summed in two streaming steps (salted, then whole): exact in any order.
2. A document is the mean and spread of its words' vectors and the mean of
   their index vectors.
3. The network is fitted on at most ``fit_rows`` labelled documents (those with
   the least hash of their id); a fifth of them sets the temperature. Scoring
   reads every whole text once more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise.llm.common import SPACE, as_bytes, bound_batches, crc_of_id, kept, table

SLOTS = 1 << 15
DIM = 32
NONZERO = 2
REACH = 2
BLOCK = 512
SALTS = 16
#: labelled documents that the network is fitted on, at most
FIT_ROWS = 20_000
HIDDEN = 32
#: bytes of the texts that are cut into words at a time
SLICE_BYTES = 1 << 20
#: words whose vectors are gathered at a time
SLICE = 1 << 13

#: a token is a run of word bytes or a run of marks
SPACE_BYTE, WORD_BYTE, MARK_BYTE = 0, 1, 2
BYTE_KIND = np.array([SPACE_BYTE if b in SPACE else WORD_BYTE if b >= 128 or chr(b).isalnum() else MARK_BYTE for b in range(256)],
                     np.uint8)
SHOUT, AGAIN = 0, 1  # slots of the marks "in capitals" and "same word again"
FEATURES = 3 * DIM + 2


def _codes(words: pa.Array) -> np.ndarray:
    """2 * slot of each word, plus 1 for words in capitals."""
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    data = words.buffers()[2].to_pybytes()
    raw = np.frombuffer(data, np.uint8)
    low, bounds = data.lower(), ends.tolist()
    slot = np.array([xxhash.xxh64_intdigest(low[i:j], 7) for i, j in zip(bounds, bounds[1:])], np.uint64) % np.uint64(SLOTS - 2)
    upper, lower = (np.append(0, np.cumsum((raw >= ord(a)) & (raw <= ord(z))))[ends] for a, z in ("AZ", "az"))
    shout = (np.diff(ends) > 1) & (np.diff(upper) > 0) & (np.diff(lower) == 0)
    return 2 * (2 + slot.astype(np.int64)) + shout


def slots_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(slots of the texts' tokens, tokens of each text); a mark follows a word
    in capitals or said again. Each distinct token is hashed once."""
    data = b"\n".join([*texts, b""])
    if not data:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    kind = BYTE_KIND[np.frombuffer(data, np.uint8)]
    cuts = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(kind)]])
    real = np.flatnonzero(kind[cuts[:-1]] != SPACE_BYTE)
    runs = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
    code = _codes(runs.dictionary)[runs.indices.to_numpy()[real]]
    ends = np.searchsorted(cuts[real], np.cumsum([len(t) + 1 for t in texts]))
    slot, shout = code >> 1, code & 1
    again = np.append(False, slot[1:] == slot[:-1])[:len(slot)]
    again[ends[:-1][ends[:-1] < len(slot)]] = False
    after = np.cumsum(1 + shout + again)
    out = np.full(after[-1] if len(after) else 0, AGAIN)
    at = after - 1 - shout - again
    out[at], out[at[shout > 0] + 1] = slot, SHOUT
    return out, np.diff(np.append(0, after)[ends], prepend=0)


def token_slots(text: bytes) -> np.ndarray:
    """Slots of a text's tokens and marks."""
    return slots_of([text])[0]


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of every slot's non-zero entries."""
    rng = np.random.default_rng(11)
    places = np.argsort(rng.random((SLOTS, DIM)), axis=1)[:, :NONZERO]
    return places.astype(np.int64), rng.choice(np.array([-1.0, 1.0]), (SLOTS, NONZERO))


def _slices(texts: Iterator[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(slots, tokens of each document) of whole documents, about SLICE_BYTES."""
    some, n = [], 0
    for t in texts:
        some.append(t)
        n += len(t)
        if n >= SLICE_BYTES:
            yield slots_of(some)
            some, n = [], 0
    if some:
        yield slots_of(some)


def _neighbour_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places, signs = kept("quality", index_vectors)
    total = np.zeros(SLOTS * DIM)
    # a slice takes the texts of many batches: each sum is as long as the table
    for slots, sizes in _slices(t.as_py() for batch in batches for t in batch.column(0)):
        doc, row = np.repeat(np.arange(len(sizes)), sizes), slots * DIM
        near = [doc[o:] == doc[:-o] for o in range(1, REACH + 1)]
        for k in range(NONZERO):
            place, sign = np.take(places[:, k], slots), np.take(signs[:, k], slots)
            for o, same in enumerate(near, 1):
                total += np.bincount(row[:-o] + place[o:], sign[o:] * same, SLOTS * DIM)
                total += np.bincount(row[o:] + place[:-o], sign[:-o] * same, SLOTS * DIM)
    yield _blocks(dict(enumerate(total.astype(np.int64).reshape(-1, BLOCK * DIM))))


def _blocks(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    sums = {b: s for b, s in sums.items() if s.any()}
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())],
                                      ["block", "sums"])


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, s in zip(batch.column(0), batch.column(1)):
            x = np.frombuffer(s.as_buffer(), np.int64)
            sums[b.as_py()] = sums[b.as_py()] + x if b.as_py() in sums else x.copy()
    yield _blocks(sums)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit word vectors by slot, from all of ``docs``."""
    schema, n = "block int, sums binary", SLOTS // BLOCK
    part = docs.select(as_bytes(text_col)).mapInArrow(_neighbour_sums, schema)
    salted = part.withColumn("salt", F.pmod(F.xxhash64("sums"), F.lit(SALTS))).repartition("block", "salt")
    whole = salted.select("block", "sums").mapInArrow(_add_blocks, schema).repartition(n, "block").mapInArrow(_add_blocks, schema)
    out = np.zeros((n, BLOCK * DIM))
    for b, sums in whole.collect():  # SLOTS x DIM numbers, whatever the corpus
        out[b] = np.frombuffer(sums, np.int64)
    out = out.reshape(SLOTS, DIM)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(size > 0, size, 1)).astype(np.float32)


def pooled(texts: Iterator[bytes], vectors: np.ndarray) -> np.ndarray:
    """Feature rows of the documents."""
    places, signs = kept("quality", index_vectors)
    out = [np.zeros((0, FEATURES))]
    for slots, sizes in _slices(texts):
        rows = np.zeros((len(sizes), FEATURES))
        some = np.flatnonzero(sizes)
        if len(some):
            own = sizes[some, None]
            rows[some, :2 * DIM] = _sums(slots, sizes[some], vectors) / own
            rows[:, DIM:2 * DIM] = np.sqrt(np.maximum(rows[:, DIM:2 * DIM] - rows[:, :DIM] ** 2, 0))
            place = np.repeat(np.arange(len(some)) * DIM, sizes[some])
            index = sum(np.bincount(place + places[slots, k], signs[slots, k], len(some) * DIM) for k in range(NONZERO))
            rows[some, 2 * DIM:3 * DIM] = index.reshape(-1, DIM) / own
        rows[:, -2], rows[:, -1] = np.log1p(sizes), sizes == 0
        out.append(rows)
    return np.concatenate(out)


def _sums(slots: np.ndarray, sizes: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Sums over each document's words of their vectors and of the squares,
    gathered for about SLICE words at a time; no document is empty."""
    ends = np.cumsum(sizes)
    out = np.empty((len(sizes), 2 * DIM), np.float32)
    room = np.empty((2, SLICE + sizes.max(), DIM), np.float32)
    lo = 0
    while lo < len(sizes):
        first = ends[lo] - sizes[lo]
        hi = int(np.searchsorted(ends, first + SLICE)) + 1
        begin, n = ends[lo:hi] - sizes[lo:hi] - first, ends[lo:hi][-1] - first
        own, squares = room[0, :n], room[1, :n]
        np.take(vectors, slots[first:first + n], axis=0, out=own, mode="clip")
        np.multiply(own, own, out=squares)
        np.add.reduceat(own, begin, axis=0, out=out[lo:hi, :DIM])
        np.add.reduceat(squares, begin, axis=0, out=out[lo:hi, DIM:])
        lo = hi
    return out


class Network:
    """Two layers (tanh, logistic) on standardised features, with temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, calibrate: np.ndarray, epochs: int = 60, l2: float = 1e-4):
        self.prior = float(y.mean()) if len(y) else 0.5
        fit = ~calibrate
        self.trained = bool(fit.any()) and 0 < y[fit].mean() < 1
        if not self.trained:
            return
        self.mean, self.scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-6
        rng = np.random.default_rng(3)
        self.w = [rng.normal(0, FEATURES ** -0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN),
                  rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
        moment, speed, t = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w], 0
        z, target = self._standard(x[fit]), y[fit]
        steps = max(epochs * len(z) // 128, 600)
        for t in range(1, steps + 1):
            own = rng.integers(0, len(z), 128)
            a = np.tanh(z[own] @ self.w[0] + self.w[1])
            err = (1 / (1 + np.exp(-(a @ self.w[2] + self.w[3]))) - target[own]) / len(own)
            back = err[:, None] * self.w[2] * (1 - a * a)
            grads = [z[own].T @ back + l2 * self.w[0], back.sum(axis=0), a.T @ err + l2 * self.w[2], err.sum(keepdims=True)]
            rate = 3e-3 * (1 - t / (steps + 1))
            for p, g, m, v in zip(self.w, grads, moment, speed):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        self.temperature = 1.0
        if calibrate.any():
            logit, target = self._logits(x[calibrate]), y[calibrate]
            loss = lambda s: np.logaddexp(0, np.where(target > 0.5, -logit, logit) / s).mean()
            self.temperature = float(min(np.geomspace(0.25, 8, 120), key=loss))

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self._standard(x) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self._logits(x) / self.temperature, -30, 30)))


def quality_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, label: str = "quality",
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``held_out`` and ``score``, the calibrated probability of
    label 1.

    Labels are learned from rows whose id has crc32 mod 5 other than 0 and a
    label of 0 or 1 (the least, if an id has several); nothing but the text is
    an input. A null text is empty and is scored too; a null id is never
    labelled. Repeated rows get the same score. With no labels, or one class
    only, every score is the share of label 1 (0.5 without labels). An empty
    table stays empty; other columns pass through, ``held_out`` and ``score``
    are replaced. Word vectors come from all of ``docs``. A very long text is pooled
    whole; an id with several texts is learned from by the least of them.
    """
    bound_batches(docs.sparkSession)
    vectors = word_vectors(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    @F.arrow_udf("array<double>")
    def features(texts: pa.Array) -> pa.Array:
        x = pooled((t.as_py() for t in texts), shared.value)
        return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))

    known = (labels.select(F.col(id_col).alias("__id"), F.col(label).alias("__y")).filter("__id is not null and __y in (0, 1)")
             .filter(crc_of_id("__id") % 5 != 0).groupBy("__id").agg(F.min("__y").alias("__y"))
             .orderBy(F.xxhash64("__id"), "__id").limit(fit_rows))
    # one row an id (the least text), so that repeated ids stay within the bound
    rows = (docs.select(F.col(id_col).alias("__id"), as_bytes(text_col).alias("__t")).join(F.broadcast(known), "__id")
            .groupBy("__id", "__y").agg(F.min("__t").alias("__t"))
            .select("__id", "__y", features("__t").alias("x"), (crc_of_id("__id") % 5 == 1).alias("c")).collect())
    rows.sort(key=lambda r: (r[0], r.x))
    net = Network(np.array([r.x for r in rows]).reshape(-1, FEATURES), np.array([r[1] for r in rows], float),
                  np.array([r.c for r in rows], bool))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(net.score(pooled((t.as_py() for t in texts), shared.value)))

    return docs.withColumns({"held_out": crc_of_id(id_col) % 5 == 0, "score": score(as_bytes(text_col))})


def op6_quality(spark: SparkSession, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    got = quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
