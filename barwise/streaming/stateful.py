"""L2 with the panel's past in the state store (``transformWithState``).

``refresh_panel`` in ``stream.py`` reads the stored panel in every micro-batch; its
cost grows with the history. Here a keyed state holds each key's bars, cut into
chunks of ``CHUNK_DAYS`` calendar days, each with the running product of
(1 + return) at its end. A batch reads and writes the chunks from the first changed
bar on and those of the ``LONGEST_FRAME - 1`` bars before it, nothing else: for bars
that come in order two to four chunks a key, however long the history. A late or
corrected bar reads the chunks from its date on, because the cumulative return
of every later bar depends on it; the walk ends early once no window reaches back
to a changed bar and the running product is the stored one again.

The operator emits the bars to rewrite and their lead-in; ``indicators`` is then
evaluated by Spark's own windows in the sink, in one pass over the batch. The sink
writes one folder a batch, read by ``read_refreshed``. After a lost executor or a
replay the state store goes back to the batch's start and the folder is overwritten.

Defined cases: rows without key or date are left out; of several versions of a bar
in one batch the greatest row counts (missing cells are smallest); a NaN cell is a
missing cell; a batch without rows writes an empty folder. A task holds the batch's
rows of one key, one version a date, and one chunk.
"""

from __future__ import annotations

import datetime as dt
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from barwise.functions.windows import indicators
from barwise.streaming.stream import BAR_COLS, IND_COLS, LONGEST_FRAME

#: calendar days of one state entry (at most as many bars)
CHUNK_DAYS = 128
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_CELLS = BAR_COLS[2:]
_CLOSE = _CELLS.index("Close")
_EPOCH = dt.date(1970, 1, 1)
_OUT_SCHEMA = ("Ticker string, Date date, " + ", ".join(f"{c} double" for c in _CELLS)
               + ", lead_in boolean, carry double")


def newest_versions(frames) -> dict[int, tuple]:
    """Day number -> cells of the bars in ``frames``: one version a date, the
    greatest row, missing cells smallest."""
    best: dict[int, tuple] = {}
    for frame in frames:
        cells = zip(*(frame[c].tolist() for c in _CELLS))
        for day, row in zip(frame["Date"].tolist(), cells):
            row = tuple(None if x is None or x != x else float(x) for x in row)
            n = (day - _EPOCH).days
            if n not in best or _rank(row) > _rank(best[n]):
                best[n] = row
    return best


def _rank(row: tuple) -> tuple:
    return tuple((x is not None, x or 0.0) for x in row)


def grown_by(product: float, before: float | None, close: float | None) -> float:
    """The running product after a bar; it stays where the return is missing."""
    if before is None or close is None or before == 0.0:
        return product
    return product * (1.0 + (close / before - 1.0))


class PanelState(StatefulProcessor):
    """Keeps a key's bars by chunks; emits the bars to rewrite and their lead-in."""

    def init(self, handle) -> None:
        # chunk numbers in use: one int for CHUNK_DAYS days
        self.used = handle.getValueState("used", "chunks array<int>")
        self.chunks = handle.getMapState("chunks", "chunk int", "days array<int>, cells array<double>, grown double")

    def _read(self, chunk: int) -> tuple[list[int], list[tuple], float]:
        days, cells, grown = self.chunks.getValue((chunk,))
        width = len(_CELLS)
        return list(days), [tuple(cells[i:i + width]) for i in range(0, len(cells), width)], grown

    def _write(self, chunk: int, days: list[int], rows: list[tuple], grown: float) -> None:
        self.chunks.updateValue((chunk,), (days, [x for row in rows for x in row], grown))

    def _before(self, used: list[int], at: int) -> tuple[list[tuple[int, tuple]], float]:
        """The LONGEST_FRAME - 1 bars before the chunk ``used[at]`` and the running
        product there."""
        bars: list[tuple[int, tuple]] = []
        product = 1.0
        for i in range(at - 1, -1, -1):
            days, rows, grown = self._read(used[i])
            if i == at - 1:
                product = grown
            bars = list(zip(days, rows)) + bars
            if len(bars) >= LONGEST_FRAME - 1:
                break
        return bars[-(LONGEST_FRAME - 1):], product

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = newest_versions(rows)
        if not new:
            return
        since, last = min(new), max(new)
        state = self.used.get()
        known = list(state[0]) if state else []
        used = sorted({*known, *(d // CHUNK_DAYS for d in new)})
        if len(used) != len(known):
            self.used.update((used,))
        stored = set(known)
        first = bisect_left(used, since // CHUNK_DAYS)
        tail, product = self._before(used, first)
        lead, carry = list(tail), product
        close = tail[-1][1][_CLOSE] if tail else None
        arrived: dict[int, dict[int, tuple]] = {}
        for d, row in new.items():
            arrived.setdefault(d // CHUNK_DAYS, {})[d] = row
        untouched = 0  # stored bars since the last changed one
        for at in range(first, len(used)):
            chunk = used[at]
            old_days, old_rows, old_grown = self._read(chunk) if chunk in stored else ([], [], None)
            merged = {**dict(zip(old_days, old_rows)), **arrived.get(chunk, {})}
            bars = sorted(merged.items())
            emit = []
            for d, row in bars:
                product = grown_by(product, close, row[_CLOSE])
                close = row[_CLOSE]
                if d < since:
                    lead.append((d, row))
                    carry = product
                else:
                    emit.append((d, row))
                untouched = untouched + 1 if d > last else 0
            self._write(chunk, [d for d, _ in bars], [r for _, r in bars], product)
            if lead:
                yield self._frame(key[0], lead[-(LONGEST_FRAME - 1):], True, carry)
                lead = []
            if emit:
                yield self._frame(key[0], emit, False, carry)
            if untouched >= LONGEST_FRAME and product == old_grown:
                break

    @staticmethod
    def _frame(key: str, bars: list[tuple[int, tuple]], lead_in: bool, carry: float) -> pd.DataFrame:
        out = pd.DataFrame([row for _, row in bars], columns=_CELLS, dtype="float64")
        out.insert(0, "Date", [_EPOCH + dt.timedelta(d) for d, _ in bars])
        out.insert(0, "Ticker", key)
        return out.assign(lead_in=lead_in, carry=carry)

    def close(self) -> None:
        pass


def changed_bars(stream: DataFrame) -> DataFrame:
    """Streaming: the bars whose indicators a batch changes and the bars before
    them that the windows read (``lead_in``), with the running product before the
    first changed bar (``carry``)."""
    bars = stream.filter("Ticker is not null and Date is not null").select(
        "Ticker", "Date", *(F.col(c).cast("double").alias(c) for c in _CELLS))
    return bars.groupBy("Ticker").transformWithStateInPandas(
        PanelState(), outputStructType=_OUT_SCHEMA, outputMode="Update", timeMode="None")


def write_changed(panel_path: str):
    """The ``foreachBatch`` function behind ``changed_bars``: indicators of the
    changed bars, one folder a batch. It reads the batch once."""
    def fn(batch: DataFrame, batch_id: int):
        run = Window.partitionBy("Ticker").orderBy("Date").rowsBetween(Window.unboundedPreceding, 0)
        cells = batch.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in _CELLS})
        ind = indicators(cells)
        # product over the changed bars only; the carry stands for all before them
        step = F.when(~F.col("lead_in"), F.lit(1.0) + F.col("Return"))
        ind = ind.withColumn("_p", F.product(step).over(run)).filter(~F.col("lead_in")).withColumn(
            "Cumulative_Return", F.when(F.col("Return").isNotNull(), F.col("carry") * F.col("_p") - 1.0))
        (ind.select(*BAR_COLS, *IND_COLS).withColumn("batch_id", F.lit(batch_id)).sortWithinPartitions("Ticker", "Date")
            .write.mode("overwrite").parquet(f"{panel_path}/batch={batch_id}"))
    return fn


def start_stateful_refresh(spark: SparkSession, source_path: str, schema, panel_path: str, ckpt: str, **trigger):
    """Starts L2 over the bar files at ``source_path`` and returns the running query;
    ``trigger`` as for ``DataStreamWriter.trigger`` (none: a batch as soon as files
    arrive). The state lives in the RocksDB store under ``ckpt``, a folder that the
    cluster shares; each state partition also takes some 4 MB of an executor's disk,
    so ``spark.sql.shuffle.partitions`` at the first start should suit the keys."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, STATE_STORE)
    try:
        writer = (changed_bars(spark.readStream.schema(schema).parquet(source_path)).writeStream
                  .outputMode("update").foreachBatch(write_changed(panel_path)).option("checkpointLocation", ckpt))
        return (writer.trigger(**trigger) if trigger else writer).start()
    finally:
        if before is None:
            spark.conf.unset(provider)
        else:
            spark.conf.set(provider, before)


def run_stateful_refresh(spark: SparkSession, source_path: str, schema, panel_path: str, ckpt: str):
    """One ``availableNow`` run of L2; returns the ended query."""
    query = start_stateful_refresh(spark, source_path, schema, panel_path, ckpt, availableNow=True)
    query.awaitTermination()
    return query
