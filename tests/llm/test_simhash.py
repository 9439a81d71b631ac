import random
import re

import numpy as np
import pytest
import xxhash

from barwise.llm.components import connected_components
from barwise.llm.gray_index import gray_rank, link_buckets
from barwise.llm.simhash import near_links, op3_simhash_dedup, simhash, simhash_components
from conftest import SF_SMALL
from llm_helpers import docs_of


def slow_fp(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    sh = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def all_links(fps, bits):
    f = np.array(fps, dtype=np.uint64)
    return [(int(f[i]), int(f[j])) for i in range(len(f)) for j in
            (np.flatnonzero(np.bitwise_count(f[i] ^ f[i + 1:]) <= bits) + i + 1).tolist()]


def planted(n, seed=1):
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(3 * n):
        x = rng.choice(out)
        for b in rng.sample(range(64), rng.randint(1, 6)):
            x ^= 1 << b
        out.append(x)
    return sorted(set(out) | {0, 1, (1 << 64) - 1})


@pytest.mark.parametrize("text", ["", None, " \x0b\n", "one", "A b C", "a b c d", "É a  b\tc d E", "w x y z " * 900])
def test_fingerprint(text):
    assert simhash((text or "").encode(), 4) % (1 << 64) == slow_fp(text)


def test_gray_rank():
    n = np.arange(1000, dtype=np.uint64)
    assert (gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_index_links_all_within_buckets():
    fps = planted(60)
    fp = np.array(fps, dtype=np.uint64)
    bucket = np.arange(len(fp)) % 3
    a, b = link_buckets(fp, bucket, 4)
    where = dict(zip(fps, bucket.tolist()))
    want = [(x, y) for x, y in all_links(fps, 4) if where[x] == where[y]]
    assert classes(fps, zip(a.tolist(), b.tolist())) == classes(fps, want)


@pytest.mark.parametrize("bucket", [5, 4096])
def test_links_span_all_near_pairs(spark, bucket):
    fps = planted(80, seed=bucket)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = near_links(docs_of(spark, [(x,) for x in signed], "fp long"), 4, bucket).collect()
    got = [(r.a % (1 << 64), r.b % (1 << 64)) for r in links]
    assert classes(fps, got) == classes(fps, all_links(fps, 4))


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [
        (rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(300, 300), (7, 6)]
    got = {r.node: r.root for r in connected_components(docs_of(spark, edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == classes(nodes, [e for e in edges if e[0] != e[1]])
    assert connected_components(docs_of(spark, [], "a long, b long")).count() == 0


def check(rows, got):
    fps = {r: slow_fp(t) for r, (i, t) in enumerate(rows)}
    cls = classes(set(fps.values()), all_links(sorted(set(fps.values())), 4))
    least = {}
    for r, (i, _) in enumerate(rows):
        if i is not None:
            least[cls[fps[r]]] = min(i, least.get(cls[fps[r]], i))
    want = [(i, fps[r], least.get(cls[fps[r]])) for r, (i, _) in enumerate(rows)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_edge_cases(spark):
    base = "the quick brown fox jumps over a lazy dog near the river bank " * 20
    rows = [(5, base), (3, base + "x"), (9, base.upper()), (9, base), (None, base), (2, None), (1, ""), (8, " "),
            (None, "lonely words here now"), (7, "lonely"), (6, "long " * 50000)]
    df = docs_of(spark, [(i, t, 1, 2) for i, t in rows], "doc_id long, text string, fp int, component_id int")
    check(rows, [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash_components(df).collect()])
    assert simhash_components(docs_of(spark, [])).count() == 0


def test_query_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    check(rows, [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in op3_simhash_dedup(spark, SF_SMALL).collect()])
