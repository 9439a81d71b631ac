"""What reused Python workers hold on to."""

from types import SimpleNamespace

import pytest

from barwise.llm import bpe, common
from llm_helpers import docs_of


@pytest.fixture()
def stage(monkeypatch):
    monkeypatch.setattr(common, "_KEPT", {})
    now = SimpleNamespace(id=1)
    monkeypatch.setattr(common.TaskContext, "get", classmethod(lambda _: SimpleNamespace(stageId=lambda: now.id)))
    return now


def test_a_worker_keeps_what_the_running_stage_uses(stage):
    one, two = common.kept("one", list), common.kept("two", dict)
    assert common.kept("one", list) is one and common.kept("two", dict) is two
    stage.id = 2
    assert common.kept("one", list) is one and list(common._KEPT) == ["one"]
    assert common.kept("two", dict) is not two and common.kept("one", list) is one


def test_words_of_a_stage_go_with_the_next_operator(stage):
    import public_tokenizers as public
    vocab = bpe.Vocabulary(public.path("byte_bpe_50k.json"), public.PATTERN)
    first = bpe._encoder(vocab)
    first.encode("some words")
    assert bpe._encoder(vocab) is first and first.memo
    stage.id = 2
    common.kept("another", list)
    assert bpe._encoder(vocab) is not first


def test_round_trip_takes_one_worker_a_task(spark):
    df = bpe.encode_decode(docs_of(spark, [(1, "a"), (2, None)]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert sorted((r.doc_id, r.decoded) for r in df.collect()) == [(1, "a"), (2, "")]


def test_batches_of_texts_stay_small(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        common.bound_batches(spark)
        assert int(spark.conf.get(key)) <= 256
        spark.conf.set(key, "100")
        common.bound_batches(spark)
        assert spark.conf.get(key) == "100"
    finally:
        spark.conf.set(key, before)
