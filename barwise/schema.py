"""Column names and schemas of the bar data model."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = "Ticker"
DATE = "Date"
PRICE_COLS = ["Open", "High", "Low", "Close", "adj_close"]
OHLCV = ["Open", "High", "Low", "Close", "adj_close", "Volume"]

BAR_SCHEMA = T.StructType([
    T.StructField("Date", T.DateType()),
    T.StructField("Ticker", T.StringType()),
    T.StructField("Open", T.DoubleType()),
    T.StructField("High", T.DoubleType()),
    T.StructField("Low", T.DoubleType()),
    T.StructField("Close", T.DoubleType()),
    T.StructField("adj_close", T.DoubleType()),
    T.StructField("Volume", T.DoubleType()),
])

# Header of the single-ticker vendor CSV (fixed values of the vendor format).
VENDOR_COLUMNS = {"<DATE>": "Date", "<OPEN>": "Open", "<HIGH>": "High",
                  "<LOW>": "Low", "<CLOSE>": "Close", "<VOL>": "Volume"}

# The 24 engineered columns of the research panel, in output order.
FEATURE_COLS = [
    "Year", "Month", "Day", "DayOfWeek", "Is_Month_End", "Is_Month_Start",
    "Daily_Return", "MA7", "MA30", "MA90", "Volatility_30d",
    "Lag_Close_1", "Lag_Close_2", "Lag_Close_3", "Lag_Close_5",
    "Momentum_5d", "Momentum_10d", "Price_Position_20d",
    "Volume_MA20", "Volume_Ratio", "HL_Range", "Typical_Price",
    "Overnight_Gap", "Target_Direction",
]

# Model inputs of the research notebook (fixed lists).
SUPERVISED_FEATURES = [
    "Open", "High", "Low", "Volume", "Year", "Month", "Day", "DayOfWeek",
    "Is_Month_End", "Is_Month_Start", "Daily_Return", "MA7", "MA30", "MA90",
    "Volatility_30d", "Lag_Close_1", "Lag_Close_2", "Lag_Close_3", "Lag_Close_5",
    "Momentum_5d", "Momentum_10d", "Price_Position_20d",
    "Volume_MA20", "Volume_Ratio", "HL_Range", "Typical_Price", "Overnight_Gap",
]
UNSUPERVISED_FEATURES = [
    "Open", "High", "Low", "Volume", "Daily_Return", "Volatility_30d",
    "MA7", "MA30", "MA90", "Lag_Close_1", "Lag_Close_2", "Lag_Close_3", "Lag_Close_5",
    "Momentum_5d", "Momentum_10d", "Price_Position_20d",
    "Volume_MA20", "Volume_Ratio", "HL_Range", "Typical_Price", "Overnight_Gap",
    "Year", "Month", "DayOfWeek",
]
