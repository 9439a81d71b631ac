"""``vendor_bars``: vendor daily files as a Spark data source.

A folder holds one CSV a ticker (``<DATE>,<OPEN>,...``, dates as yyyyMMdd), any depth
below. ``read_vendor_csv`` has Spark's CSV reader open all of them; this source
knows what the folder says before a file is opened:

* the ticker is the name of the folder ``Ticker=...`` or else of the file, so an
  equality or ``IN`` on ``Ticker`` skips the other files;
* comparisons of ``Date`` drop rows in the reader, before they reach Spark;
* small files share a partition of ``partition_mb`` (32), a file is read in blocks
  of a few MB, so a task's memory doesn't follow the file;
* as a stream, a file counts as new when it is written or rewritten. The offset is
  one modification time; files younger than ``settle_s`` (1 second) wait for the
  next batch, so that none of the same moment is missed. A rewritten file comes
  whole again: ``write_changed`` takes its bars as corrections.

Filters are handed back to Spark too, results never depend on the pushdown.

Options: ``key`` = ``file`` (default) or ``column`` (the key is in ``<TICKER>``; no
file is skipped then), ``partition_mb``, ``settle_s``.

Defined cases: cells that hold no number or date are NULL; missing columns are NULL;
empty files, and names that begin with ``_`` or ``.``, are left out; an empty folder
gives no rows; repeated rows stay; a line with more or fewer cells than the header
ends the job with its file's name.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv, fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from barwise.schema import VENDOR_COLUMNS

SCHEMA = "Ticker string, Date date, Open double, High double, Low double, Close double, Volume double"
_KEY_COLUMN = "<TICKER>"
_COMPARE = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal,
            LessThan: pc.less, LessThanOrEqual: pc.less_equal}


@dataclass(frozen=True)
class VendorFile:
    path: str
    key: str
    size: int
    written: int  # microseconds since 1970


@dataclass
class VendorFiles(InputPartition):
    files: tuple[VendorFile, ...]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def ticker_of(path: str) -> str:
    """The key a path names: the folder ``Ticker=...`` or the file up to its first dot."""
    parts = path.split("/")
    for part in reversed(parts[:-1]):
        if part.startswith("Ticker="):
            return unquote(part[len("Ticker="):])
    return parts[-1].split(".")[0]


def list_files(path: str) -> list[VendorFile]:
    system, root = _open(path)
    root = root.rstrip("/")
    found = []
    for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        names = info.path[len(root) + 1:].split("/")
        if info.type == fs.FileType.File and info.size and not any(n[0] in "_." for n in names):
            written = (info.mtime_ns or 0) // 1000
            found.append(VendorFile(info.path, ticker_of("/".join(names)), info.size, written))
    return sorted(found, key=lambda f: f.path)


def pack(files: list[VendorFile], limit: int) -> list[VendorFiles]:
    """Files in order, as many to a partition as ``limit`` bytes hold (at least one)."""
    out, now, size = [], [], 0
    for f in files:
        if now and size + f.size > limit:
            out.append(VendorFiles(tuple(now)))
            now, size = [], 0
        now.append(f)
        size += f.size
    return out + ([VendorFiles(tuple(now))] if now else [])


class _Files:
    """What the batch and the stream reader share: options and reading of files."""

    def __init__(self, options):
        self.path = options["path"]
        self.by_column = options.get("key", "file") == "column"
        self.limit = int(float(options.get("partition_mb", 32)) * (1 << 20))
        self.settle = float(options.get("settle_s", 1))
        self.dates: list[tuple] = []  # (comparison, day)

    def read(self, partition: VendorFiles) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.path)
        cols = [_KEY_COLUMN, *VENDOR_COLUMNS]
        convert = csv.ConvertOptions(include_columns=cols, include_missing_columns=True,
                                     column_types={c: pa.string() for c in cols})
        for f in partition.files:
            with system.open_input_stream(f.path) as raw:
                try:
                    for batch in csv.open_csv(raw, read_options=csv.ReadOptions(block_size=4 << 20), convert_options=convert):
                        yield self._bars(batch, f.key)
                except pa.ArrowInvalid as e:
                    raise ValueError(f"{f.path}: {e}") from e

    def _bars(self, raw: pa.RecordBatch, key: str) -> pa.RecordBatch:
        tickers = raw.column(_KEY_COLUMN) if self.by_column else pa.repeat(pa.scalar(key), raw.num_rows)
        columns = [tickers] + [_days(raw.column(c)) if dst == "Date" else _numbers(raw.column(c))
                               for c, dst in VENDOR_COLUMNS.items()]
        out = pa.RecordBatch.from_arrays(columns, ["Ticker", *VENDOR_COLUMNS.values()])
        for compare, day in self.dates:
            out = out.filter(compare(out.column("Date"), pa.scalar(day, pa.date32())))
        return out


def _cells_like(cells: pa.Array, pattern: str) -> pa.Array:
    """The trimmed cells that match ``pattern``, NULL for the others."""
    cells = pc.utf8_trim_whitespace(cells)
    return pc.if_else(pc.match_substring_regex(cells, pattern), cells, pa.scalar(None, pa.string()))


def _numbers(cells: pa.Array) -> pa.Array:
    return pc.cast(_cells_like(cells, r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), pa.float64())


def _days(cells: pa.Array) -> pa.Array:
    days = pc.strptime(_cells_like(cells, "^[0-9]{8}$"), format="%Y%m%d", unit="s", error_is_null=True)
    # a day past its month's end is read as one of the next month: no date
    return pc.if_else(pc.equal(pc.strftime(days, format="%Y%m%d"), pc.utf8_trim_whitespace(cells)), days.cast(pa.date32()), pa.scalar(None, pa.date32()))


class VendorReader(_Files, DataSourceReader):
    def __init__(self, options):
        super().__init__(options)
        self.tickers: set[str] | None = None

    def pushFilters(self, filters):
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("Ticker",) and not self.by_column and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.tickers = wanted if self.tickers is None else self.tickers & wanted
            elif column == ("Date",) and type(f) in _COMPARE and f.value is not None:
                self.dates.append((_COMPARE[type(f)], f.value))
            yield f

    def partitions(self) -> list[VendorFiles]:
        files = list_files(self.path)
        if self.tickers is not None:
            files = [f for f in files if f.key in self.tickers]
        # Spark reads a source without partitions once with None
        return pack(files, self.limit) or [VendorFiles(())]


class VendorStream(_Files, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"written": 0}

    def latestOffset(self) -> dict:
        until = int((time.time() - self.settle) * 1e6)
        return {"written": max((f.written for f in list_files(self.path) if f.written <= until), default=0)}

    def partitions(self, start: dict, end: dict) -> list[VendorFiles]:
        return pack([f for f in list_files(self.path) if start["written"] < f.written <= end["written"]], self.limit)

    def commit(self, end: dict) -> None:
        pass


class VendorBars(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vendor_bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> VendorReader:
        return VendorReader(self.options)

    def streamReader(self, schema) -> VendorStream:
        return VendorStream(self.options)


def register_vendor_bars(spark: SparkSession) -> None:
    """Makes ``spark.read.format("vendor_bars")`` and its stream known to a session,
    with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VendorBars)


def vendor_bars(spark: SparkSession, path: str, **options):
    """The bars below ``path`` (options: see module doc)."""
    register_vendor_bars(spark)
    return spark.read.format("vendor_bars").options(**options).load(path)
