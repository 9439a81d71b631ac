"""SimHash near-dedup with a Gray-order hierarchical index.

1. One 64-bit fingerprint per document (majority of the XXH64 bits of its word
   shingles). Equal fingerprints are folded to one row with the least id.
2. Fingerprints at ``max_bits`` or fewer differing bits agree on two of
   ``max_bits + 2`` bit blocks, so every pair of blocks deals them into buckets
   by an equi-key; buckets of one are dropped. A bucket above ``BUCKET`` rows is
   salted, and its salts meet two by two, so no task gets a whole hot bucket.
3. Each task sorts its buckets by Gray rank, builds the hierarchical index and
   emits links that span what is near, never all pairs.
4. Connected components over the links (large-star / small-star).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise.llm.common import LOWER, as_bytes, bound_batches, cut, spread_join, table
from barwise.llm.components import connected_components
from barwise.llm.gray_index import link_buckets

#: rows of a bucket above which it is salted
BUCKET = 4096
#: rows gathered before a task links the complete buckets among them
CHUNK = 50_000


def simhash(text: bytes, words_per_shingle: int) -> int:
    """Fingerprint of a text's bytes as a signed 64-bit integer; no words: 0."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= words_per_shingle:
        got = xxhash.xxh64_digest(b" ".join(words), seed=42)
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.append(0, ends[:-1] + 1)
        digest, k = xxhash.xxh64_digest, words_per_shingle
        got = b"".join([digest(joined[i:j], 42)
                        for i, j in zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())])
    bits = np.unpackbits(np.frombuffer(got, np.uint8).reshape(-1, 8), axis=1)
    major = bits.sum(axis=0, dtype=np.int64) * 2 > len(bits)
    return int.from_bytes(np.packbits(major).tobytes(), "big", signed=True)


def fingerprint(text_col, words_per_shingle: int):
    @F.arrow_udf("bigint")
    def fp(texts: pa.Array) -> pa.Array:
        return pa.array([simhash(t.as_py(), words_per_shingle) for t in texts], pa.int64())

    return fp(as_bytes(text_col))


def _block_masks(max_bits: int) -> list[int]:
    """Masks (signed) of every pair of blocks; with two spare blocks, near
    fingerprints agree on one pair at least."""
    n = max_bits + 2
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    masks = [x | y for x, y in combinations(blocks, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _link(max_bits: int):
    def emit(fp: list, key: list) -> pa.RecordBatch:
        a, b = link_buckets(np.concatenate(fp), np.concatenate(key), max_bits)
        return pa.RecordBatch.from_arrays(
            [pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], ["a", "b"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; the last bucket waits for its rest."""
        fps, keys, n, last, number = [], [], 0, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            new = np.zeros(batch.num_rows, bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            new[0] = last is not None and last != tuple(c[0] for c in cols)
            key = number + np.cumsum(new)
            number, last = int(key[-1]), tuple(c[-1] for c in cols)
            fps.append(batch.column(4).to_numpy(zero_copy_only=False).astype(np.uint64))
            keys.append(key)
            n += batch.num_rows
            if n >= CHUNK:
                f, k = np.concatenate(fps), np.concatenate(keys)
                done = k < number
                yield emit([f[done]], [k[done]])
                fps, keys, n = [f[~done]], [k[~done]], int((~done).sum())
        if n:
            yield emit(fps, keys)

    return link


def near_links(fps: DataFrame, max_bits: int, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) spanning the classes of the distinct fingerprints ``fp``."""
    masks = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(m).alias("m")) for i, m in enumerate(_block_masks(max_bits))])
    keyed = (fps.select("fp", F.explode(masks).alias("k"))
             .select("fp", F.col("k.t").alias("t"), F.col("fp").bitwiseAND(F.col("k.m")).alias("key")))
    sizes = keyed.groupBy("t", "key").agg(F.count("fp").alias("n")).filter("n > 1").withColumn(
        "salts", F.ceil(F.col("n") / bucket).cast("int"))
    shared = spread_join(keyed, sizes, ["t", "key"])
    salt = F.pmod(F.xxhash64("fp", F.lit("salt")), F.col("salts")).cast("int")
    mates = F.when(F.col("salts") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0), F.col("salts") - 1), lambda s: s != F.col("salt")),
                    lambda s: F.struct(F.least(s, F.col("salt")).alias("i"), F.greatest(s, F.col("salt")).alias("j"))))
    dealt = (shared.withColumn("salt", salt).select("t", "key", F.explode(mates).alias("p"), "fp")
             .select("t", "key", "p.i", "p.j", "fp"))
    rows = dealt.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")
    return rows.mapInArrow(_link(max_bits), "a long, b long")


def rooted_fingerprints(docs: DataFrame, words_per_shingle: int = 4, max_bits: int = 4,
                        id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp), one row per row of ``docs``, and (fp, least, root) with the
    smallest id of each distinct fingerprint and the root of its component."""
    bound_batches(docs.sparkSession)
    fps = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint(text_col, words_per_shingle).alias("fp")))
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(near_links(distinct.select("fp"), max_bits)).toDF("fp", "root")
    return fps, distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame, words_per_shingle: int = 4, max_bits: int = 4,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id), one row per row of ``docs``.

    ``component_id`` is the smallest id among the documents reachable over links
    of at most ``max_bits`` differing bits. Null, empty and wordless texts have
    fingerprint 0, linked like any other. Repeated rows share a component. Rows
    without an id get the component of what they link to (null if no linked row
    has an id). A very long text is read whole; ties between ids can't change a
    component. An empty table gives an empty table; other columns are not read.
    """
    fps, rooted = rooted_fingerprints(docs, words_per_shingle, max_bits, id_col, text_col)
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(spread_join(rooted, ids, ["root"]).select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash_components(docs, words_per_shingle=4, max_bits=4).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
