"""Conversations between groups of documents and buckets of keys.

Documents are dealt into groups by id. In each round a group asks about its
distinct keys, one message a bucket; a bucket joins what all groups said of a
key and answers each of them. A key costs at most one entry a group, however
many documents hold it, so a hot key can't overload its bucket, and answers are
arrays in the order of the question: keys don't travel back.

The whole conversation is one lazy plan: the dealt documents and each round's
answers are shuffled once, into the same partitions, and every later round reads
the same exchanges.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwise.llm.common import as_bytes, mix64

MESSAGE = "dest int, src int, tag int, keys binary, vals binary"
_KIND = pa.schema([("dest", pa.int32()), ("src", pa.int32()), ("tag", pa.int32()), ("keys", pa.binary()), ("vals", pa.binary())])
#: a null id sorts behind every id
NO_ID = np.iinfo(np.int64).max
#: kinds that are packed byte plane by byte plane: the high bytes are alike
PLANES = (np.dtype(np.float32),)
COUNTS = (np.dtype(np.uint64), np.dtype(np.uint32))


def deal(docs: DataFrame, id_col: str, text_col: str, group_bytes: int) -> tuple[DataFrame, int]:
    """(gid, doc_id, text as bytes) and the number of groups, which follows the
    size of the documents (two a core at least): messages are groups x buckets,
    so more shuffle partitions must not make more of either."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("text"))
    spark = docs.sparkSession
    # counted, not estimated: an estimate multiplies with every join before it
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(2 * spark.sparkContext.defaultParallelism, -(-size // group_bytes))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id", F.lit("deal")))
    return narrow.select(F.pmod(key, F.lit(groups)).cast("int").alias("gid"), "doc_id", "text"), groups


def documents(group: pa.Table) -> tuple[list, list[bytes]]:
    """Ids (None where missing) and texts of a group in an order that doesn't
    depend on how its rows arrived."""
    ids, texts = group.column("doc_id").to_pylist(), group.column("text").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (NO_ID if ids[i] is None else ids[i], texts[i]))
    return [ids[i] for i in order], [texts[i] for i in order]


def messages(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[]] * 5
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _KIND)], schema=_KIND)


def rows_of(table: pa.Table, *tags: int) -> list[tuple]:
    """(src, tag, keys, vals) in order of src; keys and vals as bytes."""
    rows = zip(table.column("src").to_pylist(), table.column("tag").to_pylist(),
               table.column("keys").to_pylist(), table.column("vals").to_pylist())
    return sorted((r for r in rows if not tags or r[1] in tags), key=lambda r: r[:2])


def pack(a: np.ndarray) -> bytes:
    if a.dtype in COUNTS:  # only the low bytes that any value has
        width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
        low = np.ascontiguousarray(a.reshape(-1).view(np.uint8).reshape(-1, a.dtype.itemsize)[:, :width].T)
        return bytes([width]) + zlib.compress(low.tobytes(), 1)
    raw = a.tobytes()
    if a.dtype in PLANES:
        raw = np.frombuffer(raw, np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()
    return zlib.compress(raw, 1)


def unpack(b: bytes, kind=np.float64) -> np.ndarray:
    kind = np.dtype(kind)
    if kind in COUNTS:
        low = np.frombuffer(zlib.decompress(b[1:]), np.uint8).reshape(b[0], -1)
        full = np.zeros((low.shape[1], kind.itemsize), np.uint8)
        full[:, :b[0]] = low.T
        return full.view(kind).ravel()
    raw = zlib.decompress(b)
    if kind in PLANES:
        raw = np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T.tobytes()
    return np.frombuffer(raw, kind)


def zigzag(a: np.ndarray) -> np.ndarray:
    """Signed whole numbers as uint64, small ones by few bytes."""
    return ((a << 1) ^ (a >> 63)).view(np.uint64)


def unzigzag(a: np.ndarray) -> np.ndarray:
    return (a >> np.uint64(1)).view(np.int64) ^ -(a & np.uint64(1)).view(np.int64)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted uint64 as the low bytes of their differences; the highest of these
    bytes are mostly zero and are compressed."""
    if not len(keys):
        return b""
    step = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(step.max()).bit_length() + 7) // 8)
    low = step.view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + low[:, :-1].tobytes() + zlib.compress(low[:, -1].tobytes(), 1)


def _unpack_keys(b: bytes, n: int) -> np.ndarray:
    if not b:
        return np.zeros(0, np.uint64)
    width, full = b[0], np.zeros((n, 8), np.uint8)
    end = 1 + n * (width - 1)
    full[:, :width - 1] = np.frombuffer(b[1:end], np.uint8).reshape(n, width - 1)
    full[:, width - 1] = np.frombuffer(zlib.decompress(b[end:]), np.uint8)
    return np.cumsum(full.view(np.uint64).ravel(), dtype=np.uint64)


def spread(high: np.ndarray, low: np.ndarray, n_high: int, n_low: int) -> tuple[np.ndarray, int]:
    """Evenly spread uint64 keys of pairs of numbers below ``n_high`` and ``n_low``,
    and how many low bits of the keys are zero: a permutation of the smallest
    power of two that holds all pairs, so that dense numbers make short messages.
    A space beyond 64 bits is hashed instead."""
    high, low = high.astype(np.uint64), low.astype(np.uint64)
    bits = max(2, (n_high * n_low - 1).bit_length())
    if bits > 64:
        return mix64(mix64(high + np.uint64(0x9E3779B97F4A7C15)) + low), 0
    mask, half = np.uint64((1 << bits) - 1), np.uint64(bits // 2)
    x = high * np.uint64(n_low) + low
    for odd in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        x = (x * np.uint64(odd)) & mask
        x ^= x >> half
    return x << np.uint64(64 - bits), 64 - bits


def _borders(buckets: int) -> np.ndarray:
    return np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(_borders(buckets), keys, side="right")


def ask_sums(gid: int, tag: int, keys: np.ndarray, vals: np.ndarray, buckets: int, shift: int = 0) -> list[tuple]:
    """Questions for the sums of ``vals`` (a row a key) over all groups; ``keys``
    are sorted, distinct, evenly spread uint64, their low ``shift`` bits zero in
    every group. Every bucket gets a message."""
    down = np.uint64(shift)
    cuts = np.concatenate([[0], np.searchsorted(keys, _borders(buckets)), [len(keys)]])
    out = []
    for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
        base = np.uint64((b << 64) // buckets)
        out.append((b, gid, tag, _pack_keys((keys[lo:hi] >> down) - (base >> down)), pack(vals[lo:hi])))
    return out


#: kind of signed whole numbers, sent as ``zigzag``
SIGNED = "signed"
#: added to the tag of an answer that numbers the frequent keys
NUMBERS = 100


def answer_sums(rows: list[tuple], width: int, kind=np.float64, said: Callable | None = None,
                brief: bool = False, often: int | None = None, pick: Callable | None = None) -> list[tuple]:
    """Answers to ``ask_sums`` of one tag: the sums in the order asked, and in
    ``keys`` what ``said`` makes of the bucket's sums. If ``brief``, a key of one
    group alone is answered by zeros: the group knows its sums. With ``often`` a
    second answer (tag + ``NUMBERS``) numbers the bucket's keys with a sum of at
    least that from 1; 0 for the others. ``pick`` makes the answer of the sums."""
    asked = [unpack(v, np.uint64 if kind is SIGNED else kind).reshape(-1, width) for *_, v in rows]
    keys = [_unpack_keys(k, len(v)) for (_, _, k, _), v in zip(rows, asked)]
    uniq, at = np.unique(np.concatenate(keys), return_inverse=True)
    vals = np.concatenate(asked)
    if kind is SIGNED:
        vals = unzigzag(vals.ravel()).reshape(-1, width)
    sums = np.stack([np.bincount(at, vals[:, c], len(uniq)) for c in range(width)], axis=1) if len(uniq) else np.zeros((0, width))
    about = said(sums[:, 0]) if said else b""
    frequent = sums[:, 0] >= often if often else None
    number = np.where(frequent, np.cumsum(frequent), 0).astype(np.uint32) if often else None
    if brief:
        sums[np.bincount(at, minlength=len(uniq)) == 1] = 0
    out, n = [], 0
    for (src, tag, _, _), k in zip(rows, keys):
        own = sums[at[n:n + len(k)]]
        out.append((src, -1, tag, about, pack(pick(own) if pick else own.astype(kind))))
        if often:
            out.append((src, -1, tag + NUMBERS, b"", pack(number[at[n:n + len(k)]])))
        n += len(k)
    return out


def heard_sums(rows: list[tuple], width: int, kind=np.float64) -> np.ndarray:
    """Sums for a group's keys, in their order, from the answers of all buckets
    (``rows`` in order of bucket)."""
    return np.concatenate([unpack(v, kind).reshape(-1, width) for *_, v in rows]) if rows else np.zeros((0, width))


def converse(dealt: DataFrame, groups: int, rounds: list[tuple[Callable, Callable]], finish: Callable, schema: str) -> DataFrame:
    """``rounds``: (ask, answer) pairs. ask(gid, group, answers) and
    answer(bucket, rows) return message tuples; finish(gid, group, answers)
    returns an Arrow table of ``schema``. ``answers`` are those of all rounds so
    far: each round's exchange is written once and read by all later ones."""
    dealt, heard = dealt.repartition(groups, "gid"), None
    for ask, answer in rounds:
        said = (_by_group(dealt, heard, _asking(ask), MESSAGE).groupBy("dest").applyInArrow(_answering(answer), MESSAGE)
                .repartition(groups, "dest"))
        heard = said if heard is None else heard.union(said)
    return _by_group(dealt, heard, finish, schema)


def _by_group(dealt: DataFrame, heard: DataFrame | None, f: Callable, schema: str) -> DataFrame:
    if heard is None:
        return dealt.groupBy("gid").applyInArrow(lambda key, t: f(key[0].as_py(), t, []), schema)
    return dealt.groupBy("gid").cogroup(heard.groupBy("dest")).applyInArrow(
        lambda key, t, m: f(key[0].as_py(), t, rows_of(m)), schema)


def _asking(ask: Callable) -> Callable:
    return lambda gid, group, heard: messages(ask(gid, group, heard))


def _answering(answer: Callable) -> Callable:
    def respond(key, t):
        bucket = key[0].as_py()
        return messages([(dest, bucket, tag, k, v) for dest, _, tag, k, v in answer(bucket, rows_of(t))])

    return respond
