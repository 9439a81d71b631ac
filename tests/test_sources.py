"""CSV readers: header normalisation (C1), date parsing (C2), vendor layout."""

import datetime as dt
import os

from barwise.operators.bars import normalize_name
from barwise.sources import files as Fi


def test_normalize_name():
    assert normalize_name(" Adj Close ") == "adj_close"
    assert normalize_name("Adj_Close") == "adj_close"
    assert normalize_name("Open") == "Open"
    assert normalize_name("Trade  Count") == "Trade_Count"


def test_read_bars_csv_with_reference_headers(spark):
    path = Fi.scratch_path(spark, "t_csv").replace("file:", "")
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "bars.csv"), "w") as f:
        f.write("Date,Ticker,Open,High,Low,Close,Adj Close,Volume\n")
        f.write("2024-01-02,AAA,1.5,2.0,1.0,1.75,1.7,100\n")
        f.write("2024-01-03,AAA,1.75,2.5,1.5,2.25,2.2,\n")
    df = Fi.read_bars_csv(spark, path)
    rows = sorted(df.collect())
    assert df.columns == ["Date", "Ticker", "Open", "High", "Low", "Close", "adj_close", "Volume"]
    assert rows[0].Date == dt.date(2024, 1, 2) and rows[0].adj_close == 1.7
    assert rows[1].Volume is None


def test_read_vendor_csv(spark):
    path = Fi.scratch_path(spark, "t_vendor").replace("file:", "")
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "x.csv"), "w") as f:
        f.write("<TICKER>,<PER>,<DATE>,<TIME>,<OPEN>,<HIGH>,<LOW>,<CLOSE>,<VOL>,<OPENINT>\n")
        f.write("XYZ.US,D,20240105,000000,10,11,9,10.5,1234,0\n")
    r = Fi.read_vendor_csv(spark, path).collect()[0]
    assert (r.Ticker, r.Date, r.Open, r.Close, r.Volume) == ("XYZ.US", dt.date(2024, 1, 5), 10.0, 10.5, 1234.0)
