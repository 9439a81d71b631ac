import math

from barwise.llm import pipeline as P
from barwise.llm.quality import quality_scores
from conftest import SF_SMALL
from llm_helpers import docs_of
from test_decontaminate import brute as hit_words
from test_lines import brute as kept_lines
from test_simhash import all_links, classes, slow_fp
from tokenizers import Tokenizer

import public_tokenizers as public

def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def near_copies(rows):
    fps = {t: slow_fp(t) for _, t in rows}
    cls = classes(set(fps.values()), all_links(sorted(set(fps.values())), 4))
    least = {}
    for i, t in rows:
        if i is not None:
            least[cls[fps[t]]] = min(i, least.get(cls[fps[t]], i))
    seen, out = set(), []
    for i, t in rows:
        c = cls[fps[t]]
        if i is None and c not in least or i is not None and i == least.get(c) and i not in seen:
            seen.add(i)
            out.append((i, t))
    return out


def test_stage_order():
    assert [f.__name__ for _, f in P.STAGES] == ["keep_good", "drop_lines", "drop_near_copies", "cut_benchmark", "tokenize"]


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    good = P.keep_good(spark, docs, SF_SMALL)
    assert good.columns == docs.columns
    assert rows_of(good) == rows_of(quality_scores(docs, labels).filter("score >= 0.3"))
    before = rows_of(good)
    good = docs_of(spark, [tuple(r) for r in good.collect()], docs.schema)
    lines = P.drop_lines(spark, good, SF_SMALL)
    assert lines.columns == docs.columns and rows_of(lines) == sorted(((i, t) for i, t, *_ in kept_lines(before, 10)), key=str)
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    lines = docs_of(spark, [tuple(r) for r in lines.collect()], docs.schema)
    one = P.drop_near_copies(spark, lines, SF_SMALL)
    assert one.columns == docs.columns and rows_of(one) == sorted(near_copies(rows_of(lines)), key=str)
    one = docs_of(spark, [tuple(r) for r in one.collect()], docs.schema)
    clean = P.cut_benchmark(spark, one, SF_SMALL)
    hits = {i: h for i, _, h, _ in hit_words(rows_of(one), bench)}
    assert clean.columns == docs.columns and any(hits.values())
    texts = dict(rows_of(one))
    for i, t in rows_of(clean):
        assert (t == texts[i]) == (hits[i] == 0)
    assert sum(h for *_, h, _ in hit_words(rows_of(clean), bench)) <= sum(hits.values()) // 20
    want = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    for r in P.tokenize(spark, clean, SF_SMALL).join(clean.select("doc_id", "text"), "doc_id").collect():
        assert r.ids == want.encode(r.text, add_special_tokens=False).ids


def test_run_equals_the_stages(spark):
    got = P.run(spark, SF_SMALL)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF_SMALL)
    key = lambda r: r.doc_id
    assert sorted(got.collect(), key=key) == sorted(docs.collect(), key=key)


def test_edge_cases(spark):
    text = "some longer text with many different words in it, said once " * 3
    rows = [(4, text), (2, text + "x"), (2, text + "x"), (None, text), (None, "alone and without an id, a rather different text"),
            (7, None), (8, ""), (9, "z " * 30000)]
    docs = docs_of(spark, [(i, t, "s", 3, math.nan) for i, t in rows],
                   "doc_id long, text string, lang string, score int, extra double")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == docs.columns, name
        assert {(r.lang, r.score) for r in out.collect()} <= {("s", 3)}
        assert stage(spark, docs.limit(0), SF_SMALL).count() == 0
    kept = rows_of(P.drop_near_copies(spark, docs, SF_SMALL))
    assert kept == sorted(near_copies(rows), key=str)
    assert P.tokenize(spark, docs, SF_SMALL).count() == len(rows)


def test_near_copies_of_rows_without_id_and_under_repeated_ids(spark):
    a, b, c, d = ("first text of many different words, all of them its own", "zebra lion tiger bear wolf fox hare owl crow",
                  "one two three four five six seven eight nine ten", "red green blue yellow black white pink brown grey")
    assert len(classes({slow_fp(t) for t in (a, b, c, d)}, all_links(sorted(slow_fp(t) for t in (a, b, c, d)), 4))) == 4
    rows = [(None, a), (None, a), (None, a), (5, b), (5, c), (5, c), (3, d), (5, d), (None, d)]
    docs = docs_of(spark, [(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k int")
    kept = [(3, d), (5, b), (5, c), (None, a)]
    assert rows_of(P.drop_near_copies(spark, docs, SF_SMALL)) == sorted(kept, key=str)
    assert rows_of(P.drop_near_copies(spark, docs.orderBy("k", ascending=False).repartition(3), SF_SMALL)) == sorted(kept, key=str)
