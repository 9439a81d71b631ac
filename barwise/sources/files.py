"""File sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise.operators.bars import normalize_columns
from barwise.schema import VENDOR_COLUMNS
from barwise.session import ensure_checkpoint_dir

#: texts (lower case) that stand for a missing value
MISSING = ["", "null", "na", "n/a", "nan", "none"]

_DOUBLE_COLS = ["Open", "High", "Low", "Close", "adj_close", "Volume"]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local
    on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def _number(c):
    return F.col(c).try_cast("double")


def _date(c, fmt: str | None):
    return F.try_to_timestamp(F.col(c).cast("string"), F.lit(fmt)).cast("date") if fmt else F.col(c).try_cast("date")


def to_bar_date(c) -> F.Column:
    """The calendar date of a bar's stamp, as its wall clock shows it: a zone or
    offset behind a text ('2024-03-01 23:30:00-05:00', '...T23:30Z') is dropped,
    not applied. Dates and stamps without a zone pass; texts that hold no date are
    NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract(c.cast("string"), r"^\s*(\d{4}-\d{1,2}-\d{1,2})(?:$|[\sT])", 1).try_cast("date")


def write_bucketed(df: DataFrame, name: str, path: str, buckets: int, key="Ticker", date="Date") -> DataFrame:
    """The panel as a table bucketed by key and sorted by date, one file a
    bucket, and read back: windows and joins by key over it need no exchange.
    ``path`` is a folder that the cluster shares."""
    (df.repartition(buckets, key).sortWithinPartitions(key, date).write.mode("overwrite").option("path", path)
     .bucketBy(buckets, key).sortBy(key, date).format("parquet").saveAsTable(name))
    return df.sparkSession.table(name)


def _with_bad_cells(df: DataFrame, casts: dict) -> DataFrame:
    bad = [(new.isNull() & F.col(c).isNotNull() & ~F.lower(F.trim(c)).isin(MISSING)).cast("int") for c, new in casts.items()]
    return df.withColumns({**casts, "_bad_cells": sum(bad, F.lit(0))})


def read_bars_csv(spark: SparkSession, path: str, date_fmt: str | None = None, flag_bad: bool = False) -> DataFrame:
    """Bar CSV with a header. Names are normalised (C1: 'Adj Close' ->
    adj_close), the date parsed (C2) and prices cast to double. Partition
    folders (``Ticker=...``) are read back as a string column. Cells that hold no
    number or date (``null``, ``NA``, ...) read as NULL; ``flag_bad`` adds
    ``_bad_cells``, the row's cells that hold neither a value nor one of
    ``MISSING``."""
    raw = spark.read.option("header", True).option("inferSchema", False) \
        .option("recursiveFileLookup", False).csv(path)
    df = normalize_columns(raw)
    casts = {c: _number(c) for c in _DOUBLE_COLS if c in df.columns}
    if "Date" in df.columns:
        casts["Date"] = _date("Date", date_fmt)
    if "Ticker" in df.columns:
        df = df.withColumn("Ticker", F.col("Ticker").cast("string"))
    return _with_bad_cells(df, casts) if flag_bad else df.withColumns(casts)


def read_vendor_csv(spark: SparkSession, path: str, ticker: str | None = None) -> DataFrame:
    """Vendor daily CSV (<DATE>,<OPEN>,... with yyyyMMdd dates): keeps the
    six bar columns; the key comes from <TICKER> when present."""
    raw = spark.read.option("header", True).csv(path)
    cols = [F.col(f"`{src}`").alias(dst) for src, dst in VENDOR_COLUMNS.items()]
    key = F.col("`<TICKER>`") if "<TICKER>" in raw.columns else F.lit(ticker)
    df = raw.select(key.cast("string").alias("Ticker"), *cols)
    return df.withColumns({
        "Date": _date("Date", "yyyyMMdd"),
        **{c: _number(c) for c in ["Open", "High", "Low", "Close", "Volume"]}})


def sorted_by(df: DataFrame, keys=("Ticker", "Date")) -> DataFrame:
    """Rows in order of ``keys`` over the whole output (range partitions,
    sorted within, so part files follow each other)."""
    keys = [k for k in keys if k in df.columns]
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header, no index, sorted by key and date."""
    sorted_by(df).write.mode(mode).option("header", True).csv(path)


def export_csv(df: DataFrame, path: str, partition_by: str | None = "Ticker",
               mode: str = "overwrite") -> None:
    """One folder per key (the key is the file name part), written in
    parallel, each file sorted by date."""
    w = sorted_by(df).write.mode(mode).option("header", True)
    (w.partitionBy(partition_by) if partition_by else w).csv(path)


def write_vendor_csv(df: DataFrame, path: str, by_key: bool = False) -> None:
    """Writes bars in the vendor layout (used to land vendor files); ``by_key``: one
    folder ``Ticker=...`` a key with one file, the key also as a column."""
    out = df.select(F.col("Ticker").alias("<TICKER>"),
                    F.date_format("Date", "yyyyMMdd").alias("<DATE>"),
                    F.col("Open").alias("<OPEN>"), F.col("High").alias("<HIGH>"),
                    F.col("Low").alias("<LOW>"), F.col("Close").alias("<CLOSE>"),
                    F.col("Volume").alias("<VOL>"))
    if by_key:
        out = out.withColumn("Ticker", F.col("<TICKER>")).repartition("Ticker")
        out.write.mode("overwrite").option("header", True).partitionBy("Ticker").csv(path)
    else:
        out.write.mode("overwrite").option("header", True).csv(path)


def write_panel(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Engineered panel as parquet partitioned by calendar year, so readers of
    a date range prune whole folders (partition pruning / DPP)."""
    out = df if "Year" in df.columns else df.withColumn("Year", F.year("Date"))
    out.write.mode(mode).partitionBy("Year").parquet(path)


def read_panel(spark: SparkSession, path: str, from_year: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.filter(F.col("Year") >= from_year) if from_year is not None else df
