"""Driver contract: entry runs; every oracle key is a query."""

import importlib.util
import os

from conftest import ROOT


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_runs(spark):
    mod = _entry()
    df = mod.entry(spark)
    rows = df.collect()
    assert len(rows) == 5 and "sharpe_rank" in df.columns


def test_oracle_keys_subset_of_queries():
    mod = _entry()
    assert set(mod.oracle_sql()) <= set(mod.queries())
    assert len(mod.oracle_sql()) >= 60
