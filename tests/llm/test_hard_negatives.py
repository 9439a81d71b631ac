import math

import numpy as np
import pytest
from conftest import SF_MID, SF_SMALL
from llm_helpers import docs_of
from oracle_check import compare, duck_connect

from barwise.llm.hard_negatives import OP12_SQL, Block, Shard, hard_negatives, op12_hard_negatives, search, spanning_tree

SCHEMA = "vec_id long, embedding array<double>, label int, block int, shard int"


def brute(rows, is_anchor, n_pos=5, n_neg=3):
    ok = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(c is None or not math.isfinite(c) for c in v):
            continue
        own = (label, [math.floor(256 * c) if abs(c) < 1e290 else int(256 * c) for c in v])
        ok[i] = min(ok.get(i, own), own)
    out = []
    for a in filter(is_anchor, ok):
        label, v = ok[a]
        score = {i: sum(p * q for p, q in zip(v, w)) for i, (_, w) in ok.items() if i != a and len(w) == len(v)}
        pos = sorted((-s, i) for i, s in score.items() if ok[i][0] == label)[:n_pos]
        for s, p in pos:
            neg = sorted((-t, i) for i, t in score.items() if ok[i][0] != label and 50 * -s <= 100 * t <= 95 * -s)[:n_neg]
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i) in enumerate(neg)]
    return sorted(out)


def test_spanning_tree_is_minimal():
    x = np.array([[0.0], [10], [1], [11], [3]])
    order, parent, length = spanning_tree(x)
    place = {int(o): n for n, o in enumerate(order)}
    assert all(p < 0 or place[int(p)] < place[i] for i, p in enumerate(parent))
    assert sorted(length.tolist()) == [0, 1, 1, 2, 7]


@pytest.mark.parametrize("spread", [0.02, 0.5, 2.0])
def test_bounds_spare_scores_but_lose_nothing(spread):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(5, 6))
    x = np.floor(256 * (centres[rng.integers(0, 5, 3000)] + spread * rng.normal(size=(3000, 6))))
    ids, labels = np.arange(3000), rng.integers(0, 4, 3000)
    shard = Shard(ids, labels, x)
    scored = []
    plain = shard.scores
    shard.scores = lambda a, at: scored.append(len(at)) or plain(a, at)
    at = np.arange(0, 3000, 50)
    s = x[at] @ x.T
    own = [sorted((-int(t), i) for i, t in enumerate(r) if labels[i] == labels[q] and i != q)[:5] for q, r in zip(at, s)]
    got = sorted(search(shard, Block(at, labels[at], x[at], [[]] * len(at)), 5, None))
    assert got == sorted((int(q), 0, i, -t) for q, best in zip(at, own) for t, i in best)
    positives = [[(n, -t) for n, (t, _) in enumerate(best)] for best in own]
    want = [(int(q), n, i, -t) for q, r, best in zip(at, s, positives) for n, p in best
            for t, i in sorted((-int(t), i) for i, t in enumerate(r) if labels[i] != labels[q] and 50 * p <= 100 * t <= 95 * p)[:3]]
    assert sorted(search(shard, Block(at, labels[at], x[at], positives), 3, (100, 50, 95))) == sorted(want)
    if spread < 0.1:
        assert sum(scored) < 0.7 * 2 * len(at) * 3000


@pytest.mark.parametrize("shard,block", [(65_536, 512), (30, 3)])
def test_edge_cases(spark, shard, block):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(-3, 6, 3) / 4).tolist(), int(rng.integers(0, 3))) for i in range(240)]
    rows += [(i, [1.0, 0.5, 0.25], i % 2) for i in range(300, 380)]
    nan, inf = float("nan"), float("inf")
    rows += [(500, None, 1), (505, [], 1), (510, [0.0, 0.0, 0.0], 1), (515, [1.0, None, 2.0], 1), (520, [nan, 1.0, 1.0], 1),
             (525, [inf, 1.0, 1.0], 1), (None, [1.0, 2.0, 3.0], 1), (530, [1.0, 2.0], 1), (535, [3.0, 2.0], 1), (536, [2.0, 2.0], 2),
             (540, [1.0], 1), (545, [1.0, 2.0, 3.0], None), (5, [1.0, 1.0, 1.0], 0), (5, [-1.0, 1.0, 1.0], 2), (550, [-1.0, -1.0, -1.0], 9)]
    df = docs_of(spark, [(*r, 0, 0) for r in rows], SCHEMA)
    a = df.filter("vec_id % 5 = 0")
    got = hard_negatives(df, a, shard_rows=shard, block_rows=block).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, lambda i: i % 5 == 0)
    assert hard_negatives(df.limit(0), a.limit(0)).count() == 0
    assert hard_negatives(df, a.limit(0)).count() == 0


def test_large_numbers(spark):
    rows = [(0, [3e6, 1.0], 0), (1, [3e6, 2.0], 0), (2, [2e6, 2.0], 1), (3, [1.9e6, 2.0], 1), (4, [2.9e6, 1.0], 0)]
    df = docs_of(spark, [(*r, 0, 0) for r in rows], SCHEMA)
    got = hard_negatives(df, df.filter("vec_id = 0")).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, lambda i: i == 0)
    wild = docs_of(spark, [(i, [1e300 * (i + 1), -1e300], i % 2, 0, 0) for i in range(4)], SCHEMA)
    assert hard_negatives(wild, wild).count() >= 0


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_matches_sql(spark, sf):
    res = compare(op12_hard_negatives(spark, sf), OP12_SQL, duck_connect(sf))
    assert res["ok"], res["problems"]
