"""L2 over the state store: equal to the batch indicators for ordered, late,
corrected, repeated and missing bars; a batch's reads don't follow the history."""

import datetime as dt
import random

import pytest

from barwise.functions.windows import indicators
from barwise.sources import files as Fi
from barwise.streaming import stateful as Sf
from barwise.streaming import stream as St

SCHEMA = "Ticker string, Date date, Open double, High double, Low double, Close double, adj_close double, Volume double"


def _bars(key, n, step=1, seed=0):
    rnd = random.Random(seed)
    start = dt.date(2015, 1, 1)
    return [(key, start + dt.timedelta(i * step), 1.0, 2.0, 0.5,
             None if rnd.random() < 0.02 else 50.0 + rnd.random() * 20, 1.0, float(i)) for i in range(n)]


def _run(spark, drops):
    root = Fi.scratch_path(spark, "t_state")
    for rows in drops:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
        Sf.run_stateful_refresh(spark, f"{root}/in", spark.createDataFrame([], SCHEMA).schema, f"{root}/panel", f"{root}/ckpt")
    return f"{root}/panel"


def _check(spark, panel, bars):
    got = {(r.Ticker, r.Date): r for r in St.read_refreshed(spark, panel).collect()}
    want = indicators(spark.createDataFrame(bars, SCHEMA)).collect()
    assert len(got) == len(want)
    for r in want:
        g = got[r.Ticker, r.Date]
        assert tuple(g[c] for c in St.BAR_COLS) == tuple(r[c] for c in St.BAR_COLS)
        for c in St.IND_COLS:
            assert (g[c] == pytest.approx(r[c], rel=1e-9, abs=1e-12)) if r[c] is not None else g[c] is None, (r.Date, c)


def test_late_corrected_repeated_and_missing_bars(spark):
    good = _bars("A", 700) + _bars("B", 260, step=3, seed=1)
    a, b = good[:700], good[700:]
    wrong = [("A", *a[90][1:5], 999.0, 1.0, 1.0)]
    drops = [
        [r for i, r in enumerate(a[:500]) if i not in (0, 90, 130, 499)] + wrong + b[:100] + [(None, *a[0][1:]), ("A", None, *a[0][2:])],
        [a[90], a[90], a[130]] + b[100:101],          # correction, repeat, late bar
        a[500:600] + b[101:],
        [a[0], a[499]] + a[600:],                     # a bar before the first one
    ]
    # of two versions in one drop the greatest row counts
    low = ("B", *b[150][1:5], None, 1.0, b[150][7])
    drops[2] = drops[2] + [low]
    _check(spark, _run(spark, drops), good)


def test_bars_in_order_read_few_chunks(spark):
    """The rows a batch emits, hence the chunks it reads, don't grow with history."""
    bars = _bars("K", 1500)
    panel = _run(spark, [bars[:700], bars[700:720], bars[720:1480], bars[1480:]])
    rows = {n: spark.read.parquet(f"{panel}/batch={n}").count() for n in range(4)}
    assert rows == {0: 700, 1: 20, 2: 760, 3: 20}
    _check(spark, panel, bars)


class _Store:
    """State variables of one key in plain dictionaries, counting chunk reads."""

    def __init__(self):
        self.value, self.map, self.reads = None, {}, 0

    def getValueState(self, *_):
        outer = self

        class V:
            def get(self):
                return outer.value

            def update(self, v):
                outer.value = v
        return V()

    def getMapState(self, *_):
        outer = self

        class M:
            def getValue(self, k):
                outer.reads += 1
                return outer.map[k]

            def updateValue(self, k, v):
                outer.map[k] = v
        return M()


def _feed(store, rows):
    import pandas as pd
    op = Sf.PanelState()
    op.init(store)
    store.reads = 0
    return list(op.handleInputRows(("K",), iter([pd.DataFrame(rows, columns=St.BAR_COLS)]), None))


@pytest.mark.parametrize("history", [400, 4000])
def test_chunk_reads_of_a_new_bar_do_not_follow_history(history):
    store = _Store()
    bars = _bars("K", history + 1)
    _feed(store, bars[:history])
    out = _feed(store, bars[history:])
    assert store.reads <= 4
    assert sum(len(f) for f in out) <= St.LONGEST_FRAME


def test_unchanged_repeat_ends_early():
    """An equal repeat of an old bar rewrites its windows' reach, not all that follow."""
    store = _Store()
    bars = [r if r[5] is not None else (*r[:5], 60.0, *r[6:]) for r in _bars("K", 4000)]
    _feed(store, bars)
    out = _feed(store, bars[1000:1001])
    assert sum(len(f) for f in out if not f["lead_in"].any()) < 2 * St.LONGEST_FRAME + 2 * Sf.CHUNK_DAYS


def test_empty_batch(spark):
    panel = _run(spark, [[], _bars("A", 5)])
    _check(spark, panel, _bars("A", 5))
