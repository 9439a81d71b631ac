"""Benchmark decontamination: an FM-index per shard of training text.

The test phrases (windows of consecutive words of each item) are the stated
query set: they go to every task, in blocks of a bounded size; after the first
the documents are searched once more a block. A task cuts its
documents into shards, maps words to phrase-word ids, indexes what can hold a
phrase (runs of known words no shorter than the shortest phrase), searches all
phrases backward, locates their occurrences by sampled suffix positions and
merges the spans. The documents are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise.llm.common import as_bytes, bound_batches, cut, free_names, table
from barwise.llm.fm_index import FMIndex

#: words of a shard, above which the next document begins another
SHARD_WORDS = 1 << 20
#: most characters of benchmark text that are sent to every task at a time
MAX_QUERY_CHARS = 4_000_000

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                  for b in range(256))
RESULT = ("struct<n_words:bigint,n_hit:bigint,items:array<bigint>,"
          "spans:array<struct<start:bigint,end:bigint>>,text:string>")
#: what one block of the benchmark found: items, and runs of hit words
HITS = "struct<items:array<bigint>,runs:array<struct<start:bigint,end:bigint>>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_KINDS = {
    RESULT: pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64())),
                       ("spans", _SPANS), ("text", pa.string())]),
    HITS: pa.struct([("items", pa.list_(pa.int64())), ("runs", _SPANS)])}


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


class Phrases:
    """Distinct windows of the items, as rows of word ids from 1."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int):
        self.ids: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = {}
        for item, text in items:
            w = [self.ids.setdefault(x, len(self.ids) + 1) for x in words_of(text)]
            for i in range(max(1, len(w) - window + 1) if w else 0):
                found.setdefault(tuple(w[i:i + window]), set()).add(item)
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.rows = np.zeros((len(found), int(self.lengths.max(initial=0))), np.int64)
        for k, p in enumerate(found):
            self.rows[k, :len(p)] = p
        self.items = [sorted(x for x in v if x is not None) for v in found.values()]
        self.shortest = int(self.lengths.min(initial=0))


def occurrences(ids: np.ndarray, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(position, phrase) of every phrase in the word ids; 0 is no phrase word."""
    gaps = np.flatnonzero(np.concatenate([[True], ids == 0, [True]])) - 1
    start, size = gaps[:-1] + 1, np.diff(gaps) - 1
    start, size = start[size >= p.shortest], size[size >= p.shortest]
    if not len(start) or not len(p.rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    run = np.repeat(np.arange(len(start)), size + 1)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
    at = start[run] + nth - 1  # a separator stands before each run
    s = np.where(nth == 0, 0, ids[at])
    index = FMIndex(s, len(p.ids) + 1)
    lo, hi = index.search(p.rows, p.lengths)
    n = hi - lo
    phrase = np.repeat(np.arange(len(n)), n)
    rows = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return at[index.locate(rows)], phrase


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end (exclusive) of the runs of hit words."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _spans(text: bytes, hit: np.ndarray) -> tuple[list[dict], bytes]:
    """Removal spans in code points (end exclusive) and the text without them;
    a run of hit words goes with what stands between them."""
    where = [m.span() for m in WORD.finditer(text)]
    begin, end = _runs(hit)
    spans, kept, last, chars = [], [], 0, 0
    for a, b in zip((where[i][0] for i in begin), (where[i - 1][1] for i in end)):
        kept.append(text[last:a])
        chars += len(text[last:a].decode("utf-8", "replace"))
        size = len(text[a:b].decode("utf-8", "replace"))
        spans.append({"start": chars, "end": chars + size})
        chars, last = chars + size, b
    return spans, b"".join(kept) + text[last:]


def shard_hits(texts: list[bytes], p: Phrases, earlier: list[dict | None]) -> Iterator[tuple[list, np.ndarray]]:
    """Items and hit words (a flag a word) of each text, with those that
    ``earlier`` blocks found."""
    words = [words_of(t) for t in texts]
    ids, ends, n = [], [], 0
    for w in words:
        ids.append(np.fromiter(map(p.ids.get, w, repeat(0)), np.int64, len(w)))
        ids.append(np.zeros(1, np.int64))
        n += len(w) + 1
        ends.append(n)
    at, phrase = occurrences(np.concatenate(ids) if ids else np.zeros(0, np.int64), p)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + p.lengths[phrase], -1)
    hit = np.cumsum(cover) > 0
    doc = np.searchsorted(ends, at, side="right")
    found: dict[int, set] = {}
    for d, k in zip(doc.tolist(), phrase.tolist()):
        found.setdefault(d, set()).update(p.items[k])
    for d, old in enumerate(earlier):
        own, items = hit[ends[d] - 1 - len(words[d]):ends[d] - 1], found.get(d, set())
        if old is not None:
            items |= set(old["items"])
            for r in old["runs"]:
                own[r["start"]:r["end"]] = True
        yield sorted(items), own


def shard_runs(texts: list[bytes], p: Phrases, earlier: list[dict | None]) -> list[dict]:
    return [{"items": items, "runs": [{"start": a, "end": b} for a, b in zip(*map(np.ndarray.tolist, _runs(hit)))]}
            for items, hit in shard_hits(texts, p, earlier)]


def shard_result(texts: list[bytes], p: Phrases, earlier: list[dict | None]) -> list[dict]:
    out = []
    for t, (items, hit) in zip(texts, shard_hits(texts, p, earlier)):
        row = {"n_words": len(hit), "n_hit": int(hit.sum()), "items": items, "spans": [], "text": None}
        if row["n_hit"]:
            row["spans"], kept = _spans(t, hit)
            row["text"] = kept.decode("utf-8", "replace")
        out.append(row)
    return out


#: (items, window, phrases), the latest first: a worker is used for many tasks.
#: The items are held, so that no other list can have their identity.
_LATEST: list[tuple[list, int, Phrases]] = []


def phrases_of(items: list, window: int) -> Phrases:
    for k, (known, size, p) in enumerate(_LATEST):
        if known is items and size == window:
            _LATEST.insert(0, _LATEST.pop(k))
            return p
    del _LATEST[1:]
    _LATEST.insert(0, (items, window, Phrases(items, window)))
    return _LATEST[0][2]


def _search(shared, window: int, kind: str, of_shard: Callable):
    @F.arrow_udf(kind)
    def found(texts: pa.Array, earlier: pa.Array) -> pa.Array:
        p = phrases_of(shared.value, window)
        out, shard, old, n = [], [], [], 0
        for t, e in zip(texts, earlier):
            shard.append(t.as_py())
            old.append(e.as_py())
            n += len(shard[-1])
            if n >= 6 * SHARD_WORDS:
                out += of_shard(shard, p, old)
                shard, old, n = [], [], 0
        return pa.array(out + of_shard(shard, p, old), _KINDS[kind])

    return found


def _blocks(rows: DataFrame, max_chars: int) -> Iterator[list[tuple]]:
    """The (item, text) rows in blocks of ``max_chars`` bytes; a longer item is a
    block of its own."""
    block, n = [], 0
    for item, text in rows.toLocalIterator():
        if block and n + len(text) > max_chars:
            yield block
            block, n = [], 0
        block.append((item, bytes(text)))
        n += len(text)
    yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with the words inside any benchmark phrase cut out of
    ``text_col``, plus n_words, n_hit, items (ids of the items with a phrase in
    the document) and spans (what was removed, in code points).

    A phrase is ``window`` consecutive words of an item, or the whole of a
    shorter one; words are ASCII letters, lower-cased, digits and non-ASCII. A
    null text has no words and stays null; items without words have no phrase;
    an item without an id removes its phrases but is not listed. Repeated items
    and documents are treated alike. A benchmark above ``MAX_QUERY_CHARS`` is
    searched block by block, with the documents written to the shared checkpoint
    folder between; the result is the same. Empty tables are fine on either side. Other
    columns pass through; ones named like a result column are replaced. A very long
    text is searched whole; of overlapping phrases each counts for its item.
    """
    bound_batches(docs.sparkSession)
    size = benchmark.agg(F.sum(F.length(item_text))).first()[0] or 0
    phrases = benchmark.select(F.col(item_col).cast("long"), as_bytes(item_text))
    blocks = (_blocks(phrases, MAX_QUERY_CHARS) if size > MAX_QUERY_CHARS
              else iter([[(r[0], bytes(r[1])) for r in phrases.collect()]]))

    def search(df: DataFrame, block: list, earlier, *how):
        shared = df.sparkSession.sparkContext.broadcast(sorted(set(block), key=str))
        return _search(shared, window, *how)(as_bytes(text_col), earlier)

    before, result = free_names(docs, "__earlier", "__r")
    r, earlier, block = docs, F.lit(None).cast(HITS), next(blocks)
    for after in blocks:
        # cut: a task holds the phrases of one block only
        r = cut(r.withColumn(before, search(r, block, earlier, HITS, shard_runs)))
        earlier, block = F.col(before), after
    r = r.withColumn(result, search(r, block, earlier, RESULT, shard_result))
    new = ["n_words", "n_hit", "items", "spans"]
    cols = [F.coalesce(f"{result}.text", c).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in new]
    return r.select(*cols, *[F.col(f"{result}.{c}").alias(c) for c in new])


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"),
                        table(spark, sf_dir, "benchmark").select("item_id", "text"))
    items = F.array_sort(F.col("items").cast("array<string>"))
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                      F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))
