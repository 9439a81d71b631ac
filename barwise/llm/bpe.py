"""Byte-level BPE encoding and decoding with a contiguous rank array.

A short word is a list of part boundaries (here: the id that each part has) and
the ranks of adjacent parts, side by side. The least rank is found by a scan,
its boundary deleted and the two neighbouring ranks refreshed, until no rank is
left. Words above ``LONG_WORD`` bytes take the same merges from a heap, since a
scan per merge would be quadratic. Ids of frequent words are remembered, up to
``MEMO`` words a worker.

The vocabulary (about 1 MB) is read once on the driver and sent to the tasks.
"""

from __future__ import annotations

import heapq
import json
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise.llm.common import bound_batches, free_names, kept, table

LONG_WORD = 256
MEMO = 1 << 17
NONE = 1 << 60


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Vocabulary:
    """Tables of a byte-level BPE file in the tokenizers library's JSON form."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of, ids = _byte_chars(), spec["model"]["vocab"]
        self.pattern = pattern
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in ids.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.first = [0] * 256
        for c, b in byte_of.items():
            self.first[b] = ids[c]
        self.merge = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(
            m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])}


class Encoder:
    def __init__(self, vocab: Vocabulary):
        self.v = vocab
        self.words = regex.compile(vocab.pattern).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, vocab.special)) + ")").split if vocab.special else None
        self.memo = _Memo(self)

    def word(self, word: bytes) -> tuple[int, ...]:
        if len(word) > LONG_WORD:
            return self._long_word(word)
        merge, none = self.v.merge, (NONE, 0)
        parts = [self.v.first[b] for b in word]
        ranks = [merge.get(p, none)[0] for p in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            parts[i] = merge[parts[i], parts[i + 1]][1]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = merge.get((parts[i - 1], parts[i]), none)[0]
            if i < len(ranks):
                ranks[i] = merge.get((parts[i], parts[i + 1]), none)[0]
        return tuple(parts)

    def _long_word(self, word: bytes) -> tuple[int, ...]:
        merge, n = self.v.merge, len(word)
        parts = [self.v.first[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, m[1], parts[i], parts[i + 1]) for i in range(n - 1) if (m := merge.get((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, to, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = to, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n and (m := merge.get((parts[x], parts[after[x]]))):
                    heapq.heappush(heap, (m[0], x, m[1], parts[x], parts[after[x]]))
        return tuple(p for p in parts if p >= 0)

    def encode(self, text: str) -> np.ndarray:
        out, of = [], self.memo.__getitem__
        for k, piece in enumerate(self.split(text) if self.split else [text]):
            if k % 2:
                out.append(array("i", [self.v.special[piece]]).tobytes())
            else:
                out += map(of, self.words(piece))
        return np.frombuffer(b"".join(out), np.int32)


class _Memo(dict):
    """Ids of words as the bytes of 32-bit integers, which take less than tuples."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        ids = array("i", self.encoder.word(word.encode())).tobytes()
        if len(word) <= LONG_WORD:
            if len(self) >= MEMO:
                self.clear()
            self[word] = ids
        return ids


def _encoder(vocab: Vocabulary) -> Encoder:
    """The worker's encoder, which remembers words from batch to batch."""
    latest: list[Encoder] = kept("bpe", list)
    if not latest or latest[0].v is not vocab:
        latest[:] = [Encoder(vocab)]
    return latest[0]


def _lists(rows: list, kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0] + [len(r) for r in rows], dtype=np.int32)
    values = np.concatenate(rows) if ends[-1] else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def _ids(texts: pa.Array, vocab: Vocabulary) -> pa.ListArray:
    e = _encoder(vocab)
    return _lists([e.encode(t.as_py()) for t in texts], pa.int32())


def _texts(lists: pa.ListArray, vocab: Vocabulary) -> pa.Array:
    piece = vocab.bytes_of.__getitem__
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    return pa.array([b"".join(map(piece, flat[e - s:e].tolist())).decode("utf-8", "replace")
                     for s, e in zip(sizes.tolist(), ends.tolist())], pa.string())


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col`` (array<int>), the BPE ids of the whole text.

    Special tokens written out in a text get their own id. A null or empty text
    has no ids. Repeated rows are encoded alike; an empty table stays empty;
    other columns pass through, one named ``ids_col`` is replaced.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path, pattern))

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        return _ids(texts, shared.value)

    return docs.withColumn(ids_col, ids(F.coalesce(F.col(text_col), F.lit(""))))


def decode(docs: DataFrame, path: str, pattern: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with ``text_col``, the text of the ids (null ids: empty); bytes
    that are no UTF-8 become U+FFFD."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path, pattern))

    @F.arrow_udf("string")
    def text(lists: pa.Array) -> pa.Array:
        return _texts(lists, shared.value)

    return docs.withColumn(text_col, text(F.coalesce(F.col(ids_col), F.array().cast("array<int>"))))


def round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids",
               decoded_col: str = "decoded") -> DataFrame:
    """``decode(encode(docs))`` in one pass: a task has one worker with one
    vocabulary, and the texts and ids don't go back to the executor between."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path, pattern))

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def both(texts: pa.Array) -> pa.Array:
        ids = _ids(texts, shared.value)
        return pa.StructArray.from_arrays([ids, _texts(ids, shared.value)], ["ids", "decoded"])

    got, = free_names(docs, "__bpe")
    return docs.withColumn(got, both(F.coalesce(F.col(text_col), F.lit("")))).withColumns(
        {ids_col: F.col(f"{got}.ids"), decoded_col: F.col(f"{got}.decoded")}).drop(got)


def with_digests(encoded: DataFrame, *more: str) -> DataFrame:
    return encoded.select(
        "doc_id", *more, F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def encode_decode(docs: DataFrame) -> DataFrame:
    import public_tokenizers as public
    path = public.path("byte_bpe_50k.json")
    return round_trip(docs, path, public.PATTERN)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digests(encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text")))
