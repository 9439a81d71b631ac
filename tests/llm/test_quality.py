import random
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash

from barwise.llm import quality as Q
from conftest import SF_MID
from llm_helpers import docs_of


def test_neighbour_sums_against_loops(spark):
    texts = ["a b c a!!", "", "X YY yy", None, "solo"]
    places, signs = Q.index_vectors()
    want = np.zeros((Q.SLOTS, Q.DIM))
    for t in texts:
        s = Q.token_slots((t or "").encode()).tolist()
        for i, a in enumerate(s):
            for j in range(max(0, i - Q.REACH), min(len(s), i + Q.REACH + 1)):
                if j != i:
                    want[a, places[s[j]]] += signs[s[j]]
    size = np.linalg.norm(want, axis=1, keepdims=True)
    got = Q.word_vectors(docs_of(spark, list(enumerate(texts))).repartition(3))
    assert np.allclose(got, want / np.where(size > 0, size, 1))


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in Q.op6_quality(spark, SF_MID).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_MID}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [(labels[i], r.score) for i, r in got.items() if r.held_out and i in labels]
    good, bad = [s for y, s in held if y], [s for y, s in held if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    print("held out", len(good), len(bad), "auc", auc, "accuracy", np.mean([(s >= 0.3) == y for y, s in held]))
    assert auc > 0.9 and np.mean([s >= 0.3 for s in good]) > 0.95 and np.mean([s < 0.3 for s in bad]) > 0.5


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (2, "x y z"), (2, "x y z"), (None, "x " * 40000), (3, "JUNK!! JUNK!!")]
    df = docs_of(spark, [(i, t, 9.0) for i, t in rows], "doc_id long, text string, score double")
    labels = docs_of(spark, [(1, 1, "a"), (2, None, "b"), (3, 0, "c"), (3, 1, "c"), (None, 1, "d"), (77, 1, "e")],
                     "doc_id long, quality int, text string")
    got = Q.quality_scores(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.text == "x y z"}) == 1
    none = Q.quality_scores(df, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert Q.quality_scores(df.limit(0), labels).count() == 0


def slow_slots(text):
    out, last = [], None
    for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+", text):
        slot = 2 + xxhash.xxh64_intdigest(w.lower(), 7) % (Q.SLOTS - 2)
        out += [slot, *[Q.SHOUT] * (len(w) > 1 and w.isupper()), *[Q.AGAIN] * (slot == last)]
        last = slot
    return out


def test_slots_of_many_texts_against_a_loop():
    rng = random.Random(5)
    texts = [bytes(rng.choices(b"aB1 \t\n\x0b\x0c\r!?_\x00\x1c\x85\xc3\xa9", k=rng.randint(0, 30))) for _ in range(400)]
    texts += [b"", b" ", b"AA AA aa", b"aa", b"", "ÉA éA".encode(), b""]
    slots, sizes = Q.slots_of(texts)
    want = [slow_slots(t) for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and slots.tolist() == sum(want, [])
    for same in ([], [b""], [b"", b" "], [b"A"]):
        slots, sizes = Q.slots_of(same)
        assert slots.tolist() == sum(map(slow_slots, same), []) and len(sizes) == len(same)


def test_features_against_loops():
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["one", "TWO", "!", "éa", "two"], k=rng.choice([0, 1, 7, 300, 9000]))).encode() for _ in range(40)]
    vectors = np.random.default_rng(1).normal(size=(Q.SLOTS, Q.DIM)).astype(np.float32)
    places, signs = Q.index_vectors()
    got = Q.pooled(iter(texts), vectors)
    assert got.shape == (len(texts), Q.FEATURES)
    for row, t in zip(got, texts):
        want, s = np.zeros(Q.FEATURES), slow_slots(t)
        if s:
            v, index = vectors[s].astype(float), np.zeros(Q.DIM)
            np.add.at(index, places[s].ravel(), signs[s].ravel())
            want[:-2] = np.concatenate([v.mean(axis=0), v.std(axis=0), index / len(s)])
        want[-2:] = np.log1p(len(s)), not s
        assert np.allclose(row, want, atol=1e-3)


def test_small_batches_share_their_tables(monkeypatch):
    batches = [pa.RecordBatch.from_arrays([pa.array([b"a few words here"])], ["text"]) for _ in range(50)]
    sums, drawn, count, index = [], [], np.bincount, Q.index_vectors
    monkeypatch.setattr(Q.np, "bincount", lambda a, w, n: sums.append(n) or count(a, w, n))
    monkeypatch.setattr(Q, "index_vectors", lambda: drawn.append(1) or index())
    assert len(list(Q._neighbour_sums(iter(batches)))) == 1
    assert sums.count(Q.SLOTS * Q.DIM) == 2 * Q.REACH * Q.NONZERO  # as many again for every batch before
    vectors = np.zeros((Q.SLOTS, Q.DIM), np.float32)
    for _ in range(50):
        Q.pooled(iter([b"a few words here"]), vectors)
    assert len(drawn) <= 1
