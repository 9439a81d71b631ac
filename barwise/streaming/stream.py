"""Structured Streaming operators (L1, L2).

L1 ``stream_bars``: ticks -> daily OHLCV bars with a watermark, deduplicated by
event id within the watermark, tumbling one-day windows.

L2 ``refresh_panel``: a ``foreachBatch`` sink that turns arriving bars - new,
late or corrected - into dashboard indicators. Per key of the batch it rewrites
every row from the first changed date on: the window columns are computed over
those rows and the ``LONGEST_FRAME`` bars before them, and the running product of
the cumulative return goes on from the last non-NULL stored value. The panel is
a log of versions, one folder a batch, sorted by key and date; the last version
of a bar wins (``read_refreshed``). A replayed batch overwrites its own folder
and doesn't read it, so replays change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwise.functions.windows import indicators

BAR_COLS = ["Ticker", "Date", "Open", "High", "Low", "Close", "adj_close", "Volume"]
#: rows before a bar that its widest window column reads, itself included
LONGEST_FRAME = 200
IND_COLS = ["SMA_50", "SMA_200", "Return", "Volatility_30d", "Cumulative_Return"]


def stream_bars(stream: DataFrame, key: str, ts: str, price: str, id_col: str,
                delay: str = "1 day", volume: str | None = None) -> DataFrame:
    """L1: streaming daily bars.

    The watermark needs a ``timestamp``; a ``timestamp_ntz`` (wall clock) is
    cast and shifted so that its epoch value reads the wall clock in UTC. The
    one-day windows (aligned on UTC midnight) then coincide with wall-clock
    days in any session time zone, and the bar date is the wall-clock date of
    the ticks, not the window start rendered in the session zone."""
    tz = stream.sparkSession.conf.get("spark.sql.session.timeZone")
    is_ntz = dict(stream.dtypes).get(ts, "").startswith("timestamp_ntz")
    t = F.col(ts).cast("timestamp")
    # cast reads the wall clock in the session zone; from_utc_timestamp undoes
    # that, giving the epoch whose UTC reading is the wall clock
    s = stream.withColumn("_ts", F.from_utc_timestamp(t, tz) if is_ntz else t)
    s = s.withColumn("_day", F.to_date(F.col(ts)))
    s = s.withWatermark("_ts", delay).dropDuplicatesWithinWatermark([id_col])
    ordk = F.struct("_ts", id_col)
    vol = F.sum(volume).cast("double") if volume else F.count(F.lit(1)).cast("double")
    agg = s.groupBy(F.col(key).cast("string").alias("Ticker"), F.window("_ts", "1 day").alias("w")).agg(
        F.min("_day").alias("Date"),
        F.min_by(price, ordk).alias("Open"), F.max(price).alias("High"), F.min(price).alias("Low"),
        F.max_by(price, ordk).alias("Close"), vol.alias("Volume"))
    return agg.select("Ticker", "Date", "Open", "High", "Low",
                      "Close", F.col("Close").alias("adj_close"), "Volume")


def _upsert_batches(out_path: str):
    def sink(batch: DataFrame, batch_id: int):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite") \
             .parquet(f"{out_path}/batch={batch_id}")
    return sink


def latest_versions(spark: SparkSession, out_path: str, keys=("Ticker", "Date")) -> DataFrame:
    """Read an update-mode sink: the last emitted version of every key."""
    df = spark.read.option("basePath", out_path).parquet(f"{out_path}/batch=*")
    w = Window.partitionBy(*keys).orderBy(F.col("batch_id").desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "batch_id", "batch")


def run_stream_bars(spark: SparkSession, source_path: str, schema, out_path: str, ckpt: str,
                    key="event_type", ts="ts", price="value", id_col="event_id",
                    delay="1 day") -> DataFrame:
    """Run L1 over the files at ``source_path`` until they are consumed
    (``availableNow``) and return the bars."""
    src = spark.readStream.schema(schema).parquet(source_path)
    q = (stream_bars(src, key, ts, price, id_col, delay).writeStream
         .outputMode("update").foreachBatch(_upsert_batches(out_path))
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return latest_versions(spark, out_path)


def _path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_refreshed(spark: SparkSession, panel_path: str) -> DataFrame:
    """The panel of ``refresh_panel``: the last written version of every bar."""
    return latest_versions(spark, panel_path).select(*BAR_COLS, *IND_COLS)


def _stored(spark: SparkSession, panel_path: str, batch_id: int) -> DataFrame | None:
    """Latest versions from before ``batch_id`` (a replayed batch doesn't see
    itself); None while no batch is stored."""
    if not _path_exists(spark, panel_path):
        return None
    rows = spark.read.option("basePath", panel_path).parquet(f"{panel_path}/batch=*")
    w = Window.partitionBy("Ticker", "Date").orderBy(F.col("batch_id").desc())
    return (rows.filter(F.col("batch_id") < batch_id).withColumn("_rn", F.row_number().over(w))
            .filter("_rn = 1").select(*BAR_COLS, *IND_COLS))


def refresh_panel(panel_path: str, tail: int = LONGEST_FRAME):
    """L2: the ``foreachBatch`` function (see module doc)."""
    def fn(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        # one version a bar; of several in one batch the greatest row counts
        whole = F.struct(*BAR_COLS)
        new = (batch.filter("Ticker is not null and Date is not null").groupBy("Ticker", "Date")
               .agg(F.max(whole).alias("b")).select("b.*"))
        since = new.groupBy("Ticker").agg(F.min("Date").alias("_since"))
        stored = _stored(spark, panel_path, batch_id)
        if stored is None:
            ind = indicators(new)
        else:
            known = stored.join(since, "Ticker")
            past = known.filter(F.col("Date") < F.col("_since"))
            # running products at the last bar before the first change
            carry = past.groupBy("Ticker").agg(F.max_by(
                "Cumulative_Return", F.when(F.col("Cumulative_Return").isNotNull(), F.col("Date"))).alias("_carry"))
            back = Window.partitionBy("Ticker").orderBy(F.col("Date").desc())
            lead_in = past.withColumn("_rk", F.row_number().over(back)).filter(F.col("_rk") <= tail)
            later = known.filter(F.col("Date") >= F.col("_since")).join(new.select("Ticker", "Date"), ["Ticker", "Date"], "left_anti")
            bars = lead_in.select(*BAR_COLS).unionByName(later.select(*BAR_COLS)).unionByName(new)
            ind = indicators(bars).join(since, "Ticker").filter(F.col("Date") >= F.col("_since"))
            run = Window.partitionBy("Ticker").orderBy("Date").rowsBetween(Window.unboundedPreceding, 0)
            grown = F.product(F.lit(1.0) + F.col("Return")).over(run)
            ind = (ind.withColumn("_p", grown).join(carry, "Ticker", "left")
                   .withColumn("Cumulative_Return", F.when(F.col("Return").isNotNull(), F.coalesce(
                       F.lit(1.0) + F.col("_carry"), F.lit(1.0)) * F.col("_p") - 1.0)))
        (ind.select(*BAR_COLS, *IND_COLS).withColumn("batch_id", F.lit(batch_id))
            .repartitionByRange("Ticker", "Date").sortWithinPartitions("Ticker", "Date")
            .write.mode("overwrite").parquet(f"{panel_path}/batch={batch_id}"))
    return fn


def run_refresh(spark: SparkSession, source_path: str, schema, panel_path: str, ckpt: str):
    """One ``availableNow`` run of L2 over the bar files at ``source_path``."""
    src = spark.readStream.schema(schema).parquet(source_path)
    q = (src.writeStream.foreachBatch(refresh_panel(panel_path))
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
