import math

import numpy as np
import pytest

from barwise.llm.vptree import OP10_SQL, Tree, nearest_neighbours, op10_vptree
from conftest import SF_MID, SF_SMALL
from llm_helpers import docs_of
from oracle_check import compare, duck_connect

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k):
    ok = {}
    for i, v in rows:
        if i is None or not v or any(c is None or not math.isfinite(c) for c in v) or not any(v):
            continue
        v = tuple(float(np.float32(c)) for c in v)
        ok[i] = min(ok.get(i, v), v)
    out = []
    for q in ok:
        if q % 2 == 0:
            near = sorted((math.dist(ok[q], v), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:k]
            out += [(q, r + 1, i) for r, (_, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("shard,block", [(8192, 2048), (40, 7)])
def test_edge_cases(spark, shard, block):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(300)]
    rows += [(i, [1.0, 2.0, 3.0]) for i in range(300, 400)]
    rows += [(500, None), (502, []), (504, [0.0, 0.0, 0.0]), (506, [1.0, None, 2.0]), (508, [float("nan"), 1.0, 1.0]),
             (510, [float("inf"), 1.0, 1.0]), (None, [1.0, 2.0, 3.0]), (512, [1.0, 2.0]), (514, [3.0, 2.0]), (516, [1.0]),
             (2, [9.0, 9.0, 9.0]), (2, [-9.0, 9.0, 9.0])]
    df = docs_of(spark, [(i, v, 0) for i, v in rows], SCHEMA)
    got = nearest_neighbours(df, df.filter("vec_id % 2 = 0"), k=5, shard_rows=shard, block_rows=block).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == brute(rows, 5)
    assert nearest_neighbours(df.limit(0), df.limit(0)).count() == 0
    assert nearest_neighbours(df, df.limit(0)).count() == 0


def test_relaxed_factor_recall():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 8))
    x = centres[rng.integers(0, 40, 4000)] + 0.2 * rng.normal(size=(4000, 8))
    ids = np.arange(4000)
    tree = Tree(x, ids)
    exact = tree.nearest(x[:200], ids[:200], 10, 1.0)[1]
    d = np.linalg.norm(x[:200, None] - x[None], axis=2)
    d[np.arange(200), np.arange(200)] = np.inf
    assert (np.sort(exact, axis=1) == np.sort(np.argsort(d, axis=1)[:, :10], axis=1)).all()
    loose = tree.nearest(x[:200], ids[:200], 10, 0.7)[1]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(loose, exact)]) >= 0.9


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_matches_sql(spark, sf):
    res = compare(op10_vptree(spark, sf), OP10_SQL, duck_connect(sf))
    assert res["ok"], res["problems"]
