"""Size-checked broadcast and the checkpoint folder."""

from barwise.session import broadcast_if_small, ensure_checkpoint_dir, estimated_bytes


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_broadcast_only_under_limit(spark):
    small = spark.range(100).withColumnRenamed("id", "k")
    big = spark.range(1000).withColumnRenamed("id", "k")
    assert estimated_bytes(small) > 0
    hinted = big.join(broadcast_if_small(small), "k")
    assert "broadcast" in _plan(hinted).lower()
    plain = big.join(broadcast_if_small(small, limit=1), "k")
    assert "broadcast" not in _plan(plain).lower()


def test_checkpoint_dir_kept_once_set(spark):
    first = ensure_checkpoint_dir(spark)
    assert ensure_checkpoint_dir(spark) == first
