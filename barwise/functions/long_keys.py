"""Window features over keys of any length: chunks, halos and carried states.

A per-key window is one task a key. Here the rows are numbered in (key, date)
order (``global_index``) and cut into chunks of ``chunk_rows``, wherever keys
begin and end; a key's rows are consecutive, so a long key lies in many chunks
and many short ones in one. A chunk also gets copies of the rows just before it
(the halo, as many as the longest trailing frame looks back) and after it (for
leads). Windows then run by (key, chunk): a task holds at most a chunk and its
halo. Running values are scanned in two levels: each (key, chunk) gives one state
row (product, maximum, last value, row number), states are scanned along a key's
chunks, and what has been carried in is applied to the rows.

Results are those of ``windows`` and ``bars``; (key, date) must be unique.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwise.functions import windows as Wn
from barwise.functions.exprs import ratio_minus_one
from barwise.functions.ordering import global_index
from barwise.operators.lsq import materialize_small
from barwise.schema import OHLCV

CHUNK_ROWS = 100_000
#: states of chunks that are broadcast to their rows
SMALL_STATES = 100_000
#: rows that the longest trailing frame of ``features`` / ``indicators`` looks back
FEATURES_HALO, INDICATORS_HALO = 89, 199


def cut_keys(df: DataFrame, halo: int = 0, lead: int = 0, chunk_rows: int = CHUNK_ROWS,
             key="Ticker", date="Date") -> DataFrame:
    """``df`` with ``_at`` (position in (key, date) order), ``_chunk`` and ``_own``;
    rows with ``_own`` false are copies in the halo of another chunk."""
    at, rows = F.col("_at"), F.lit(chunk_rows)
    cut = global_index(df, [key, date], "_at")
    if not halo and not lead:
        return cut.withColumn("_chunk", F.floor(at / rows)).withColumn("_own", F.lit(True))
    chunks = F.sequence(F.floor(F.greatest(at - lead, F.lit(0)) / rows), F.floor((at + halo) / rows))
    return (cut.withColumn("_chunk", F.explode(chunks))
            .withColumn("_own", F.col("_chunk") == F.floor(at / rows)))


def carried(rows: DataFrame, states: dict[str, Column], scans: dict[str, Callable[[str], Column]],
            whole: bool = False, key="Ticker") -> DataFrame:
    """Join to ``rows`` (own rows of chunks) what the chunks before theirs carry
    in. ``states``: one aggregate a (key, chunk); ``scans``: how a state column
    runs over the earlier chunks (``whole``: over all chunks) of the key."""
    frame = Window.partitionBy("_k").orderBy("_c").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing if whole else -1)
    state = rows.groupBy(F.col(key).alias("_k"), F.col("_chunk").alias("_c")).agg(
        *[agg.alias(name) for name, agg in states.items()])
    state = materialize_small(state.select("_k", "_c", *[scan(name).over(frame).alias(name) for name, scan in scans.items()]))
    # a shuffle join would deal all rows out once more, for a state a chunk
    state = F.broadcast(state) if state.count() <= SMALL_STATES else state
    same = F.col(key).eqNullSafe(F.col("_k")) & (F.col("_chunk") == F.col("_c"))
    return rows.join(state, same, "left").drop("_k", "_c")


def _own(df: DataFrame) -> DataFrame:
    return df.filter("_own")


def _done(df: DataFrame) -> DataFrame:
    return df.drop("_at", "_chunk", "_own")


def long_features(df: DataFrame, chunk_rows: int = CHUNK_ROWS, key="Ticker", date="Date") -> DataFrame:
    """``windows.features`` chunk by chunk."""
    x = cut_keys(df, FEATURES_HALO, 1, chunk_rows, key, date)
    return _done(_own(Wn.features(x, [key, "_chunk"], date)))


def long_indicators(df: DataFrame, chunk_rows: int = CHUNK_ROWS, key="Ticker", date="Date") -> DataFrame:
    """``windows.indicators`` chunk by chunk; the running product is carried."""
    k = [key, "_chunk"]
    x = Wn.add_rolling(cut_keys(df, INDICATORS_HALO, 0, chunk_rows, key, date),
                       {"SMA_50": ("mean", "Close", 50), "SMA_200": ("mean", "Close", 200)}, k, date)
    x = x.withColumn("Return", ratio_minus_one(F.col("Close"), F.lag("Close", 1).over(Wn.by_key(k, date))))
    x = _own(Wn.annualized_vol(x, "Return", 30, "Volatility_30d", k, date))
    return _done(_compounded(x, "Return", "Cumulative_Return", key, date))


def long_diff(df: DataFrame, chunk_rows: int = CHUNK_ROWS, x="Close", name=None, key="Ticker", date="Date") -> DataFrame:
    """``windows.diff`` chunk by chunk."""
    return _done(_own(Wn.diff(cut_keys(df, 1, 0, chunk_rows, key, date), x, name, [key, "_chunk"], date)))


def long_cumulative_return(df: DataFrame, chunk_rows: int = CHUNK_ROWS, r="Return", name="Cumulative_Return",
                           key="Ticker", date="Date") -> DataFrame:
    """``windows.cumulative_return`` chunk by chunk."""
    return _done(_compounded(cut_keys(df, 0, 0, chunk_rows, key, date), r, name, key, date))


def _compounded(x: DataFrame, r: str, name: str, key: str, date: str) -> DataFrame:
    growth = F.lit(1.0) + F.col(r)
    x = carried(x, {"_before": F.product(growth)}, {"_before": F.product}, key=key)
    here = F.product(growth).over(Wn.running([key, "_chunk"], date))
    return x.withColumn(name, F.when(F.col(r).isNotNull(), F.coalesce("_before", F.lit(1.0)) * here - F.lit(1.0))).drop("_before")


def long_drawdown(df: DataFrame, chunk_rows: int = CHUNK_ROWS, x="adj_close", name="drawdown", peak="running_max",
                  key="Ticker", date="Date") -> DataFrame:
    """``windows.drawdown`` chunk by chunk, with the running maximum."""
    rows = carried(cut_keys(df, 0, 0, chunk_rows, key, date), {"_before": F.max(x)}, {"_before": F.max}, key=key)
    here = F.max(x).over(Wn.running([key, "_chunk"], date))
    rows = rows.withColumn(peak, F.greatest("_before", here))  # skips nulls
    return _done(rows.withColumn(name, F.try_divide(F.col(peak) - F.col(x), F.col(peak))).drop("_before"))


def long_fill_gaps(df: DataFrame, chunk_rows: int = CHUNK_ROWS, cols=tuple(OHLCV), key="Ticker", date="Date",
                   volume="Volume") -> DataFrame:
    """``bars.fill_gaps`` chunk by chunk: the last value of the chunk, else the
    last one carried in, else the key's first."""
    rows = cut_keys(df, 0, 0, chunk_rows, key, date)
    at = {c: F.when(F.col(c).isNotNull(), F.col("_at")) for c in cols}
    states = {f"_last_{c}": F.max_by(c, at[c]) for c in cols}
    rows = carried(rows, states, {n: lambda s: F.last(s, ignorenulls=True) for n in states}, key=key)
    first = {f"_first_{c}": F.min_by(c, at[c]) for c in cols}
    rows = carried(rows, first, {n: lambda s: F.first(s, ignorenulls=True) for n in first}, whole=True, key=key)
    run = Wn.running([key, "_chunk"], date)
    out = rows.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(run), f"_last_{c}", f"_first_{c}") for c in cols})
    out = _done(out.drop(*states, *first))
    return out.na.fill({volume: 0.0}) if volume in cols else out


def long_row_index(df: DataFrame, chunk_rows: int = CHUNK_ROWS, name="row_in_key", key="Ticker", date="Date") -> DataFrame:
    """``windows.with_row_index`` without a window over a key's rows."""
    rows = carried(cut_keys(df, 0, 0, chunk_rows, key, date), {"_start": F.min("_at")}, {"_start": F.min}, whole=True, key=key)
    return _done(rows.withColumn(name, F.col("_at") - F.col("_start") + 1).drop("_start"))
