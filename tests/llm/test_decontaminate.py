import hashlib
import pickle
import random
import re

import numpy as np

from barwise.llm import decontaminate as D
from barwise.llm.fm_index import FMIndex, suffix_array
from conftest import SF_SMALL
from llm_helpers import docs_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = WORD.findall(low(t))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[k:k + window]), set()).add(i)
    sizes = {len(w) for w in wins}
    out = []
    for i, t in docs:
        w = WORD.findall(low(t))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (ids := wins.get(tuple(w[k:k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= {x for x in ids if x is not None}
        out.append((i, len(w), len(hit), sorted(found)))
    return out


def test_index_against_scan():
    rng = np.random.default_rng(0)
    for n, sigma in [(1, 2), (5, 2), (200, 3), (2000, 30)]:
        s = rng.integers(0, sigma, n)
        s[0] = 0
        fm = FMIndex(s, sigma)
        pats = [rng.integers(1, sigma, rng.integers(1, 5)).tolist() for _ in range(40)]
        rows = np.zeros((len(pats), 4), np.int64)
        for k, p in enumerate(pats):
            rows[k, :len(p)] = p
        lo, hi = fm.search(rows, np.array([len(p) for p in pats]))
        for p, a, b in zip(pats, lo, hi):
            want = [i for i in range(n - len(p) + 1) if s[i:i + len(p)].tolist() == p]
            assert sorted(fm.locate(np.arange(a, b)).tolist()) == want
    assert sorted(suffix_array(np.array([0, 1, 1, 1, 0, 1, 1])).tolist()) == list(range(7))


def test_edge_cases(spark):
    rng = random.Random(4)
    vocab = ["a", "B", "cé", "d9", "Ö", "zz"]
    text = lambda n: rng.choice([" ", "--", ", "]).join(rng.choice(vocab) for _ in range(n))
    items = [(10, text(14)), (2, text(3)), (2, text(12)), (None, "solo phrase"), (5, None), (6, "... "), (33, text(10))]
    docs = [(i, text(rng.randint(0, 300))) for i in range(60)] + [
        (100, None), (101, ""), (102, "x " * 30000 + items[0][1]), (103, "Solo, PHRASE!"), (103, "Solo, PHRASE!"),
        (None, items[6][1]), (104, "pre " + items[0][1].upper().replace("CÉ", "Cé") + " post")]
    bench = docs_of(spark, items, "item_id long, text string")
    df = docs_of(spark, [(i, t, 1, "s") for i, t in docs], "doc_id long, text string, n_hit int, spans string")
    got = D.decontaminate(df, bench).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=str) == sorted(brute(docs, items), key=str)
    texts = {r.doc_id: r for r in got}
    for i, t in docs:
        if i is not None and i != 103:
            left = t
            for s in reversed(texts[i].spans):
                left = left[:s.start] + left[s.end:]
            assert left == texts[i].text
    assert texts[103].text == "!" and texts[100].text is None
    assert D.decontaminate(df, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert D.decontaminate(df.limit(0), bench).count() == 0


def test_query_matches_brute_force(spark):
    read = lambda n, i: [(r[i], r.text) for r in spark.read.parquet(f"{SF_SMALL}/{n}.parquet").collect()]
    want = {i: (n, h, len(x), hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest(), h > 0)
            for i, n, h, x in brute(read("documents", "doc_id"), read("benchmark", "item_id"))}
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
           for r in D.op9_decontaminate(spark, SF_SMALL).collect()}
    assert got == want and any(v[4] for v in want.values())


def test_phrases_of_a_dropped_benchmark_are_never_used():
    for k in range(50):
        items = pickle.loads(pickle.dumps([(k, f"only in {k}".encode())]))
        assert D.phrases_of(items, 10).items == [[k]]
        assert len(D.phrases_of(items, 2).rows) == 2
        assert D.phrases_of(items, 10) is D.phrases_of(items, 10) and len(D._LATEST) <= 2
        del items


def test_two_benchmarks_in_one_session(spark):
    docs = [(1, "one two three four"), (2, "five six seven eight")]
    df = docs_of(spark, docs)
    for items, window in [([(7, "two three")], 10), ([(8, "six seven")], 10), ([(9, "three four five six")], 2)]:
        got = D.decontaminate(df, docs_of(spark, items, "item_id long, text string"), window).collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got) == brute(docs, items, window)


def test_a_large_benchmark_is_searched_in_blocks(spark, monkeypatch):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice(["a", "b", "ö", "d"]) for _ in range(n))
    items = [(i, text(rng.randint(0, 9))) for i in range(12)] + [(None, "ö ö"), (3, None), (50, text(60))]
    docs = [(i, text(rng.randint(0, 80))) for i in range(40)] + [(90, None), (91, "")]
    bench, df = docs_of(spark, items, "item_id long, text string"), docs_of(spark, docs)
    key = lambda r: r.doc_id
    whole = sorted(D.decontaminate(df, bench, 3).collect(), key=key)
    monkeypatch.setattr(D, "MAX_QUERY_CHARS", 60)
    got = D.decontaminate(df, bench, 3)
    assert sorted(got.collect(), key=key) == whole and got.columns == ["doc_id", "text", "n_words", "n_hit", "items", "spans"]
    assert [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in whole] == brute(docs, items, 3)


def test_clashing_names(spark):
    docs = docs_of(spark, [(1, "a b c d", 5, 6)], "doc_id long, text string, __r int, __earlier int")
    bench = docs_of(spark, [(9, "b c")], "item_id long, text string")
    r = D.decontaminate(docs, bench).collect()[0]
    assert (r["__r"], r["__earlier"], r.n_hit, r["items"]) == (5, 6, 2, [9])
