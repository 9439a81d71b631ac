import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from barwise.llm import exchange as X
from barwise.llm import suffix_tree_lm as L
from conftest import SF_MID
from llm_helpers import docs_of


def tokens(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def brute(rows):
    held = [i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    seqs = [tokens(t) for _, t in rows]
    words = Counter(w for h, s in zip(held, seqs) if not h for w in s)
    total, distinct = sum(words.values()), len(words)
    least = 8
    while least < 1e-5 * total:
        least *= 2
    root = lambda w: (words[w] + L.ALPHA) / (total + L.ALPHA * (distinct + 1))
    rare = 1 - sum(root(w) for w, c in words.items() if c >= least)
    symbols = [[w if words[w] >= least else "<rare>" for w in s] for s in seqs]
    n = [Counter(), Counter(), Counter()]
    for h, s in zip(held, symbols):
        for k in range(3):
            n[k].update(tuple(s[i - k:i + 1]) for i in range(k, len(s)) if not h)

    def context(s, i, k):
        c = tuple(s[i - k:i])
        return c if i >= k and "<rare>" not in c and n[k - 1][c] >= least else None

    def nodes(k, below):
        gain = defaultdict(lambda: [0.0] * len(L.WEIGHTS))
        for h, s in zip(held, symbols):
            for i in range(k, len(s)):
                if not h and (ctx := context(s, i, k)):
                    p, c, m = below(s, i), n[k][(*ctx, s[i])], n[k - 1][ctx]
                    for j, w in enumerate(L.WEIGHTS):
                        gain[ctx][j] += math.log((c - 1 + w * p) / ((m - 1 + w) * p))
        return {c: L.WEIGHTS[g.index(max(g))] for c, g in gain.items() if max(g) > L.MIN_GAIN * n[k - 1][c]}

    def prob(k, kept, below):
        def p(s, i):
            q, ctx = below(s, i), context(s, i, k)
            return (n[k][(*ctx, s[i])] + kept[ctx] * q) / (n[k - 1][ctx] + kept[ctx]) if ctx in kept else q
        return p
    p0 = lambda s, i: rare if s[i] == "<rare>" else root(s[i])
    one = nodes(1, p0)
    p1 = prob(1, one, p0)
    two = nodes(2, p1)
    p2 = prob(2, two, p1)
    out = []
    for (i, _), h, s, y in zip(rows, held, seqs, symbols):
        tree = sum(math.log10(p2(y, k)) + (math.log10(root(s[k]) / rare) if y[k] == "<rare>" else 0) for k in range(len(s)))
        out.append((i, h, len(s), sum(words[w] > 0 for w in s), total, sum(math.log10(root(w)) for w in s), tree))
    return out, one, two


def same(got, want):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want, key=str)):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-5)


def corpus():
    rng = random.Random(4)
    rows = []
    for i in range(80):
        s = []
        while len(s) < rng.randint(0, 120):
            s.append(rng.choice(["a", "B", "the", "é", "x", "y"]))
            if s[-1] == "the":
                s += [rng.choice(["cat", "cat", "dog"]), "sat"]
            if s[-2:] == ["x", "y"]:
                s.append("zebra")
        rows.append((i, " ".join(s)))
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    want, one, two = brute(rows)
    assert one and two
    same(L.suffix_tree_scores(docs_of(spark, rows)).collect(), want)


def test_edge_cases(spark):
    rows = corpus()[:30] + [(100, None), (100, ""), (101, "never seen WORDS"), (None, "the cat sat"), (102, "word " * 50000),
                            (103, "a\x0bb\rc"), (103, "a\x0bb\rc")]
    df = docs_of(spark, [(i, t, 2.0) for i, t in rows], "doc_id long, text string, score double")
    same(L.suffix_tree_scores(df).collect(), brute(rows)[0])
    assert L.suffix_tree_scores(docs_of(spark, [])).count() == 0
    only = [(None, "no training")]
    same(L.suffix_tree_scores(docs_of(spark, only)).collect(), brute(only)[0])


def test_query_beats_the_base_on_held_out_texts(spark):
    got = L.op5_suffix_tree_lm(spark, SF_MID).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()]
    same(got, brute(rows)[0])
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_a_word_seen_ten_times_is_a_context_at_any_size(spark):
    train = [i for i in range(40) if not L.held_out(i)]
    rows = [(i, "alpha beta") for i in train[:10]] + [(train[11], "filler " * 900_000), (None, "alpha beta")]
    got = [r for r in L.suffix_tree_scores(docs_of(spark, rows)).collect() if r.doc_id is None]
    assert got[0].train_tokens > 800_000 and got[0].score > got[0].base_score + 8


def test_counts_survive_packing():
    for kind in (np.uint64, np.float32, np.float64, np.int64, np.uint8):
        for n in (0, 1, 1000):
            a = (np.arange(n) ** 4).astype(kind)
            assert (X.unpack(X.pack(a), kind) == a).all()


def test_tokens_against_a_loop(monkeypatch):
    monkeypatch.setattr(L, "STRETCH", 7)
    rng = random.Random(8)
    texts = ["".join(rng.choices("aB1 \t\n\x0b\x0c\r!?\x00\x1cé\x85", k=rng.randint(0, 60))) for _ in range(300)]
    texts += ["", " ", "AA aa aA", "q" * 31, "q" * 32, "q" * 33, "Q" * 33, "q" * 100, "x" * 8, "x" * 9, "x" * 16, "x" * 8 + " x", ""]
    words, place, sizes = L.tokenize([t.encode() for t in texts])
    want = [tokens(t) for t in texts]
    assert sizes.tolist() == [len(w) for w in want]
    named = dict(zip(sum(want, []), words[place].tolist()))
    assert words[place].tolist() == [named[w] for w in sum(want, [])] and len(set(named.values())) == len(named) == len(words)
    assert (words[1:] > words[:-1]).all()
    # the same words in other texts: groups must agree
    other, at, _ = L.tokenize([t.encode() for t in reversed(texts)])
    assert (other == words).all() and other[at].tolist() == [named[w] for w in sum(reversed(want), [])]
    for none in ([], [b""], [b" ", b""]):
        words, place, sizes = L.tokenize(none)
        assert len(words) == 1 and sizes.tolist() == [1] * len(none) == (place + 1).tolist()


def test_hashes_fill_the_range_evenly():
    words, place, _ = L.tokenize([" ".join(f"{i:x} word{i} number{i}ofmany" for i in range(40_000)).encode()])
    assert len(words) == 120_001
    share = np.bincount(X.bucket_of(words, 64), minlength=64) / len(words) * 64
    assert 0.85 < share.min() and share.max() < 1.15


def test_words_are_not_hashed_one_by_one(monkeypatch):
    calls, one = [], L.xxhash.xxh64_intdigest
    monkeypatch.setattr(L.xxhash, "xxh64_intdigest", lambda *a: calls.append(a) or one(*a))
    words, _, _ = L.tokenize([" ".join(f"w{i}" for i in range(1000)).encode(), b"z" * 40])
    assert len(words) == 1002 and len(calls) <= 1
