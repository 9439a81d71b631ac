"""Language-model scoring with a probabilistic suffix tree over words.

The tree's alphabet: words found ``MIN_CONTEXT`` times in the training documents,
however large the corpus, and one symbol for all rarer words. The root is the
smoothed word distribution of the training documents. A context of one or
two frequent words is a node if it is as frequent as that and passes a
divergence test: over its occurrences, each scored without itself
(leave-one-out), its next-symbol distribution must beat that of its suffix by
``MIN_GAIN`` nats a token. A node's distribution is its counts smoothed by its
suffix's, with the weight in ``WEIGHTS`` that does best in the test. A text is
scored by the longest retained suffix before each token; a rare word has its
share of the rare symbol, a word never seen the root's share of unseen words.

Counts and test sums are gathered over all training documents by conversations
of document groups with key buckets (``exchange``): words; symbol pairs; tests of
one-word contexts and triples; tests of two-word contexts. Only distinct keys of
a group are sent, so frequent words cost one entry a group; a triple isn't sent
when no other group has its last two symbols. Buckets number the frequent words
and pairs densely, so that the keys of pairs and triples are a few bytes long.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from barwise.llm import exchange as X
from barwise.llm.common import LOWER, SPACE, mix64, table

ALPHA = 0.1
MIN_CONTEXT = 8
MIN_GAIN = 0.02
WEIGHTS = (1.0, 30.0)
#: gains are summed in whole parts of a nat: sums don't depend on their order
GAIN_UNIT = 1 << 16
FOLDS = 10
#: bytes of text of a group: about 1.5 million words
GROUP_BYTES = 10 << 20
#: bytes of a word that is hashed by itself, more than
LONG = 32
#: words hashed at a time: they stay in the cache
STRETCH = 1 << 13
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
IS_SPACE = np.isin(np.arange(256), list(SPACE))
END = np.uint64(xxhash.xxh64_intdigest(b"", 5))


def held_out(doc_id: int | None) -> bool:
    """Left out of the training: a tenth of the ids, and rows without one."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def _hashes(data: bytes, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the tokens of ``data`` (eight bytes of any kind follow the
    last), eight bytes at a time over all of them; long ones by XXH64."""
    eight = np.ndarray(len(data) - 7, np.uint64, data, strides=(1,))
    out = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for lo in range(0, len(size), STRETCH):
        own = lo + np.flatnonzero(size[lo:lo + STRETCH] <= LONG)
        for at in range(0, LONG, 8):
            own = own[size[own] > at]
            out[own] = mix64(out[own] ^ (eight[begin[own] + at] & LOW_BYTES[np.minimum(size[own] - at, 8)]))
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = xxhash.xxh64_intdigest(data[begin[k]:begin[k] + size[k]], 5)
    return out


def tokenize(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted hashes of the distinct tokens, place of each token in them, tokens
    a text): words with A-Z lower-cased, then the end."""
    data = b" ".join([b"", *texts, b" " * 8]).translate(LOWER)
    space = IS_SPACE[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    begin, size = edges[::2], edges[1::2] - edges[::2]
    text_ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    sizes = np.diff(np.searchsorted(begin, text_ends), prepend=0) + 1
    tokens = np.full(len(begin) + len(texts) + 1, END)
    inner = np.ones(len(tokens), bool)
    inner[np.cumsum(sizes) - 1] = inner[-1] = False
    tokens[inner] = _hashes(data, begin, size)
    place, words = pd.factorize(tokens)
    order = np.argsort(words)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return words[order], rank[place[:-1]], sizes


def _distinct(high: np.ndarray, low: np.ndarray, n_high: int, n_low: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(sorted keys of the distinct pairs, place of each pair, shift)."""
    place, uniq = pd.factorize(high * n_low + low) if n_high * n_low < 1 << 63 else pd.factorize(X.spread(high, low, n_high, n_low)[0])
    keys, shift = (X.spread(uniq // n_low, uniq % n_low, n_high, n_low) if n_high * n_low < 1 << 63 else (uniq, 0))
    order = np.argsort(keys)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return keys[order], rank[place], shift


def _contexts(at: np.ndarray, number: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(sorted keys of the numbered things found in ``at``, place of each, shift)."""
    found = np.zeros(len(number), bool)
    found[at] = True
    found = np.flatnonzero(found)
    keys, shift = X.spread(number[found], np.zeros(len(found), np.int64), max(n, 1), 1)
    order = np.argsort(keys)
    place = np.zeros(len(number), np.int32)
    place[found[order]] = np.arange(len(order), dtype=np.int32)
    return keys[order], place[at], shift


class Book:
    """Tokens of a group of documents and what the conversation said of them."""

    def __init__(self, group: pa.Table, buckets: int):
        self.ids, texts = X.documents(group)
        self.buckets = buckets
        self.words, self.word, self.sizes = tokenize(texts)
        del texts
        self.held = np.array([held_out(i) for i in self.ids])
        self.train = np.repeat(~self.held, self.sizes)
        self.begin = np.cumsum(self.sizes) - self.sizes

    def counts(self, number: np.ndarray, at, n: int) -> np.ndarray:
        """Occurrences in training documents of the things numbered ``number``
        at the tokens ``at``."""
        return np.bincount(number[self.train[at]], minlength=n).astype(np.uint64)[:, None]

    def _numbers(self, heard: list[tuple], tag: int, keys: np.ndarray) -> np.ndarray:
        """Dense numbers of the frequent keys over all buckets, -1 for the others."""
        own = X.heard_sums([r for r in heard if r[1] == tag + X.NUMBERS], 1, np.uint32)[:, 0].astype(np.int64)
        return np.where(own > 0, (own - 1) * self.buckets + X.bucket_of(keys, self.buckets), -1)

    def hear_words(self, heard: list[tuple]) -> None:
        own = [r for r in heard if r[1] == 1]
        about = np.array([X.unpack(k) for _, _, k, _ in own])
        distinct, self.total, often, often_total = about.sum(axis=0)
        said = _heard_counts(own)
        mine = self.counts(self.word, slice(None), len(self.words))[:, 0]
        self.count = np.where(said > 0, said, mine)
        weight = self.total + ALPHA * (distinct + 1)
        self.root = (self.count + ALPHA) / weight
        rare = 1 - (often_total + ALPHA * often) / weight
        # symbols: the frequent words, numbered densely, and the rare symbol
        number = self._numbers(heard, 1, self.words)
        self.n_words = int(about[:, 2].max()) * self.buckets
        self.frequent = number >= 0
        self.number = number
        self.symbol = np.where(self.frequent, number, self.n_words)
        self.symbol_root = np.where(self.frequent, self.root, rare)
        # pairs: after a frequent word of the same document
        first = np.zeros(len(self.word), bool)
        first[self.begin] = True
        self.one = np.flatnonzero(~first[1:] & self.frequent[self.word[:-1]]) + 1
        self.pairs, at, self.pair_shift = _distinct(
            number[self.word[self.one - 1]], self.symbol[self.word[self.one]], max(self.n_words, 1), self.n_words + 1)
        self.pair = np.full(len(self.word), -1, np.int32)
        self.pair[self.one] = at

    def hear_pairs(self, heard: list[tuple]) -> None:
        own = [r for r in heard if r[1] == 2]
        said = _heard_counts(own)
        self.n_pair = np.where(said > 0, said, self.counts(self.pair[self.one], self.one, len(self.pairs))[:, 0])
        number = self._numbers(heard, 2, self.pairs)
        self.n_pairs = int(max((X.unpack(k)[2] for _, _, k, _ in own), default=0)) * self.buckets
        # two-word contexts: both words frequent, and the pair as well
        back = self.one[1:][self.one[1:] - 1 == self.one[:-1]]
        self.two = back[number[self.pair[back - 1]] >= 0]
        self.ones, self.one_context, self.one_shift = _contexts(self.word[self.one - 1], self.number, self.n_words)
        self.twos, self.two_context, self.two_shift = _contexts(self.pair[self.two - 1], number, self.n_pairs)
        uv = number[self.pair[self.two - 1]]
        self.triples, self.triple, self.triple_shift = _distinct(
            uv, self.symbol[self.word[self.two]], max(self.n_pairs, 1), self.n_words + 1)
        # shared: other groups may have the triple, as they have its last two symbols
        self.n_triple = self.counts(self.triple, self.two, len(self.triples))[:, 0].astype(np.float64)
        self.shared = np.zeros(len(self.triples), bool)
        self.shared[self.triple] = said[self.pair[self.two]] > 0
        self.prob = self.symbol_root[self.word]

    def gains(self, at: np.ndarray, context: np.ndarray, n: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Leave-one-out gains (a column a weight) over the suffix's probability
        at the training tokens of ``at``, less ``MIN_GAIN`` a token, summed by
        context number; ``n``: counts of context and symbol, ``of``: of the context."""
        out = np.zeros((int(context.max(initial=-1)) + 1, len(WEIGHTS)))
        ok = self.train[at]
        below = self.prob[at[ok]]
        for c, w in enumerate(WEIGHTS):
            gain = np.log((n[ok] - 1 + w * below) / ((of[ok] - 1 + w) * below))
            out[:, c] = np.bincount(context[ok], gain - MIN_GAIN, len(out))
        return X.zigzag(np.rint(out.ravel() * GAIN_UNIT).astype(np.int64)).reshape(out.shape)

    def _of_one(self):
        return self.one, self.one_context, self.n_pair[self.pair[self.one]], self.count[self.word[self.one - 1]]

    def _of_two(self):
        return self.two, self.two_context, self.n_triple[self.triple], self.n_pair[self.pair[self.two - 1]]

    def first_gains(self) -> np.ndarray:
        return self.gains(*self._of_one())

    def hear_first(self, heard: list[tuple]) -> None:
        self._descend(*self._of_one(), [r for r in heard if r[1] == 3])
        said = _heard_counts([r for r in heard if r[1] == 4])
        self.n_triple[self.shared] = np.where(said > 0, said, self.n_triple[self.shared])

    def second_gains(self) -> np.ndarray:
        return self.gains(*self._of_two())

    def hear_second(self, heard: list[tuple]) -> None:
        self._descend(*self._of_two(), [r for r in heard if r[1] == 5])

    def _descend(self, at, context, n, of, heard) -> None:
        """Where the context is a node, its distribution replaces its suffix's."""
        if not len(at):
            return
        chosen = X.heard_sums(heard, 1, np.uint8)[:, 0][context]
        node = np.flatnonzero(chosen)
        weight = np.array(WEIGHTS)[chosen[node] - 1]
        self.prob[at[node]] = (n[node] + weight * self.prob[at[node]]) / (of[node] + weight)

    def scores(self) -> tuple[np.ndarray, np.ndarray]:
        """log10 probabilities of the documents by the root and by the tree."""
        base = np.log10(self.root[self.word])
        tree = np.log10(self.prob) + base - np.log10(self.symbol_root[self.word])
        return np.add.reduceat(base, self.begin), np.add.reduceat(tree, self.begin)


def _heard_counts(rows: list[tuple]) -> np.ndarray:
    return X.heard_sums(rows, 1, np.uint64)[:, 0].astype(np.float64)


def _answer(rows: list[tuple]) -> list[tuple]:
    """Sums by tag; to the question for words also what ``_words_and_tokens`` says."""
    out = []
    for tag in sorted({r[1] for r in rows}):
        own = [r for r in rows if r[1] == tag]
        out += (X.answer_sums(own, len(WEIGHTS), X.SIGNED, pick=_chosen) if tag in (3, 5)
                else X.answer_sums(own, 1, np.uint64, _words_and_tokens, brief=True, often=MIN_CONTEXT) if tag in (1, 2)
                else X.answer_sums(own, 1, np.uint64, brief=True))
    return out


def _chosen(gains: np.ndarray) -> np.ndarray:
    """A byte a context: the weight's place from 1 where the best one passes the
    test, else 0."""
    return np.where(gains.max(axis=1) > 0, gains.argmax(axis=1) + 1, 0).astype(np.uint8)


def _words_and_tokens(counts: np.ndarray) -> bytes:
    """Distinct training words and their tokens, of all and of the frequent."""
    often = counts[counts >= MIN_CONTEXT]
    return X.pack(np.array([np.count_nonzero(counts), counts.sum(), len(often), often.sum()], np.float64))


def suffix_tree_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score),
    one row per row of ``docs``; the scores are log10 probabilities of the
    text's words and its end under the root alone and under the tree.

    A null or empty text is its end only. Rows without an id are held out.
    Repeated rows are counted and scored each; a very long text is tokenised whole. An empty table gives an empty
    table; other columns are not read. With nothing to train on every token is
    an unseen word of probability 1.
    """
    dealt, groups = X.deal(docs, id_col, text_col, group_bytes)

    def count_words(gid, group, _):
        b = Book(group, groups)
        return X.ask_sums(gid, 1, b.words, b.counts(b.word, slice(None), len(b.words)), groups)

    def count_pairs(gid, group, heard):
        b = Book(group, groups)
        b.hear_words(heard)
        return X.ask_sums(
            gid, 2, b.pairs, b.counts(b.pair[b.one], b.one, len(b.pairs)), groups, b.pair_shift)

    def test_one(gid, group, heard):
        b = Book(group, groups)
        b.hear_words(heard)
        b.hear_pairs(heard)
        n = b.n_triple[b.shared].astype(np.uint64)[:, None]
        return (X.ask_sums(gid, 3, b.ones, b.first_gains(), groups, b.one_shift)
                + X.ask_sums(gid, 4, b.triples[b.shared], n, groups, b.triple_shift))

    def test_two(gid, group, heard):
        b = Book(group, groups)
        b.hear_words(heard)
        b.hear_pairs(heard)
        b.hear_first(heard)
        return X.ask_sums(gid, 5, b.twos, b.second_gains(), groups, b.two_shift)

    def score(_, group, heard):
        b = Book(group, groups)
        b.hear_words(heard)
        b.hear_pairs(heard)
        b.hear_first(heard)
        b.hear_second(heard)
        base, tree = b.scores()
        known = np.add.reduceat((b.count[b.word] > 0).astype(np.int64), b.begin)
        return pa.table({
            "doc_id": pa.array(b.ids, pa.int64()), "held_out": pa.array(b.held), "n_tokens": pa.array(b.sizes),
            "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(b.ids), int(b.total), np.int64)),
            "base_score": pa.array(base), "score": pa.array(tree)})

    rounds = [(ask, lambda _, rows: _answer(rows)) for ask in (count_words, count_pairs, test_one, test_two)]
    return X.converse(dealt, groups, rounds, score,
                      "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                      "base_score double, score double")


def op5_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
