"""The vendor data source: cells, skipped files, pushed dates, partitions, stream."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In

from barwise.sources import files as Fi
from barwise.sources import vendor as Ve

HEAD = "<DATE>,<OPEN>,<HIGH>,<LOW>,<CLOSE>,<VOL>\n"


def _land(root, name, text):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


@pytest.fixture
def folder(tmp_path):
    root = str(tmp_path / "vendor")
    _land(root, "aapl.us.txt", HEAD + "20240102,1,2,0.5,1.5,100\n20240103,1,2,0.5,n/a,\n20240103,1,2,0.5,n/a,\nbad,1,2,3,4,5\n")
    _land(root, "deep/Ticker=B%2FC/part-0.csv", "<TICKER>," + HEAD + "X,20240102,1,2,0.5,9.5,7\n")
    _land(root, "msft.us.txt", "<DATE>,<CLOSE>\n20240104,3.5\n")
    _land(root, "empty.txt", "")
    _land(root, "_SUCCESS", "x")
    _land(root, ".hidden/z.txt", HEAD + "20240102,1,2,0.5,1.5,100\n")
    return root


def test_cells_keys_and_left_out_files(spark, folder):
    rows = sorted(map(tuple, Ve.vendor_bars(spark, folder).collect()), key=str)
    d = dt.date
    assert rows == sorted([
        ("aapl", d(2024, 1, 2), 1.0, 2.0, 0.5, 1.5, 100.0), ("aapl", d(2024, 1, 3), 1.0, 2.0, 0.5, None, None),
        ("aapl", d(2024, 1, 3), 1.0, 2.0, 0.5, None, None), ("aapl", None, 1.0, 2.0, 3.0, 4.0, 5.0),
        ("B/C", d(2024, 1, 2), 1.0, 2.0, 0.5, 9.5, 7.0), ("msft", d(2024, 1, 4), None, None, None, 3.5, None)], key=str)
    by_column = Ve.vendor_bars(spark, folder, key="column").filter("Close = 9.5").collect()
    assert [r.Ticker for r in by_column] == ["X"]


def test_numbers_and_days_are_exact():
    import pyarrow as pa
    texts = ["100.02422780487805", " 1e3 ", "+.5", "-7.", "1,5", "nan", "", None, "0x10"]
    assert Ve._numbers(pa.array(texts)).to_pylist() == [100.02422780487805, 1000.0, 0.5, -7.0, None, None, None, None, None]
    days = ["20240229", "20230229", "20240431", "2024-01-02", "202401", "29991231", "09990101", None, ""]
    assert Ve._days(pa.array(days)).to_pylist() == [dt.date(2024, 2, 29), None, None, None, None, dt.date(2999, 12, 31),
                                                    dt.date(999, 1, 1), None, None]


def test_filters_skip_files_and_rows(spark, folder):
    r = Ve.VendorReader({"path": folder})
    f = [EqualTo(("Ticker",), "aapl"), In(("Ticker",), ("aapl", "msft")), GreaterThanOrEqual(("Date",), dt.date(2024, 1, 3))]
    assert list(r.pushFilters(f)) == f
    files = [x.key for p in r.partitions() for x in p.files]
    assert files == ["aapl"]
    assert sum(b.num_rows for p in r.partitions() for b in r.read(p)) == 2
    df = Ve.vendor_bars(spark, folder)
    assert df.filter("Ticker = 'aapl' and Date >= '2024-01-03'").count() == 2
    assert df.filter("Ticker in ('msft', 'B/C')").count() == 2
    assert df.filter("Date is null").count() == 1
    assert df.filter(F.lit(None).cast("string") == F.col("Ticker")).count() == 0


def test_partitions_by_size(folder):
    assert len(Ve.VendorReader({"path": folder}).partitions()) == 1
    small = Ve.VendorReader({"path": folder, "partition_mb": "0.00001"}).partitions()
    assert sorted(x.key for p in small for x in p.files) == ["B/C", "aapl", "msft"] and len(small) == 3


def test_empty_folder_and_ragged_line(spark, tmp_path):
    os.makedirs(tmp_path / "none")
    assert Ve.vendor_bars(spark, str(tmp_path / "none")).count() == 0
    _land(str(tmp_path), "bad/x.txt", HEAD + "20240102,1\n")
    with pytest.raises(Exception, match="x.txt"):
        Ve.vendor_bars(spark, str(tmp_path / "bad")).count()


def test_stream_takes_each_written_file_once(spark, folder):
    Ve.register_vendor_bars(spark)
    out = Fi.scratch_path(spark, "t_vendor")

    def run():
        time.sleep(0.3)
        q = (spark.readStream.format("vendor_bars").option("settle_s", "0.1").load(folder).writeStream
             .format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/ckpt")
             .trigger(availableNow=True).start())
        q.awaitTermination()
        return spark.read.schema(Ve.SCHEMA).parquet(f"{out}/rows").groupBy("Ticker").count().collect()
    assert dict(run()) == {"aapl": 4, "B/C": 1, "msft": 1}
    _land(folder, "msft.us.txt", HEAD + "20240104,1,1,1,3.5,1\n20240105,1,1,1,3.6,1\n")
    _land(folder, "new.txt", HEAD + "20240105,1,1,1,3.6,1\n")
    assert dict(run()) == {"aapl": 4, "B/C": 1, "msft": 3, "new": 1}
    assert dict(run()) == {"aapl": 4, "B/C": 1, "msft": 3, "new": 1}
