"""DuckDB twins of the window features (used only by the oracle)."""

from __future__ import annotations

from barwise.schema import FEATURE_COLS

BASE = ["Ticker", "Date", "Open", "High", "Low", "Close", "adj_close", "Volume"]
W = "PARTITION BY Ticker ORDER BY Date"


def frame(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, x: str, n: int, min_n: int | None = None) -> str:
    need = n if min_n is None else min_n
    return f"CASE WHEN count({x}) OVER {frame(n)} >= {need} THEN {agg}({x}) OVER {frame(n)} END"


def pct(x: str, k: int) -> str:
    return f"{x} / nullif(lag({x}, {k}) OVER ({W}), 0) - 1"


def features_ctes(src: str, out: str = "feat") -> list[str]:
    """CTEs producing ``out`` = the 24-column research panel over ``src``."""
    f0 = f"{out}_0 AS (SELECT {', '.join(BASE)}, (Close - Open) / nullif(Open, 0) AS Daily_Return FROM {src})"
    lo, hi = full("min", "Close", 20), full("max", "Close", 20)
    vma = full("avg", "Volume", 20)
    cols = {
        "Year": "CAST(year(Date) AS INTEGER)",
        "Month": "CAST(month(Date) AS INTEGER)",
        "Day": "CAST(day(Date) AS INTEGER)",
        "DayOfWeek": "CAST(isodow(Date) - 1 AS INTEGER)",
        "Is_Month_End": "CAST(Date = last_day(Date) AS INTEGER)",
        "Is_Month_Start": "CAST(day(Date) = 1 AS INTEGER)",
        "Daily_Return": "Daily_Return",
        "MA7": full("avg", "Close", 7),
        "MA30": full("avg", "Close", 30),
        "MA90": full("avg", "Close", 90),
        "Volatility_30d": full("stddev_samp", "Daily_Return", 30, 10),
        "Lag_Close_1": f"lag(Close, 1) OVER ({W})",
        "Lag_Close_2": f"lag(Close, 2) OVER ({W})",
        "Lag_Close_3": f"lag(Close, 3) OVER ({W})",
        "Lag_Close_5": f"lag(Close, 5) OVER ({W})",
        "Momentum_5d": pct("Close", 5),
        "Momentum_10d": pct("Close", 10),
        "Price_Position_20d": f"(Close - ({lo})) / nullif(({hi}) - ({lo}) + 1e-8, 0)",
        "Volume_MA20": vma,
        "Volume_Ratio": f"Volume / nullif(({vma}) + 1e-6, 0)",
        "HL_Range": "High - Low",
        "Typical_Price": "(High + Low + Close) / 3",
        "Overnight_Gap": pct("Open", 1),
        "Target_Direction": f"CAST(coalesce(lead(Close, 1) OVER ({W}) > Close, false) AS INTEGER)",
    }
    assert list(cols) == FEATURE_COLS
    body = ",\n  ".join(f"{e} AS {c}" for c, e in cols.items())
    f1 = f"{out} AS (SELECT {', '.join(BASE)},\n  {body}\nFROM {out}_0)"
    return [f0, f1]


def clean_ctes(src: str = "feat", out: str = "df_clean") -> list[str]:
    """C8 after the features: rows with any NULL dropped."""
    return [f"{out} AS (SELECT * FROM {src} WHERE COLUMNS(*) IS NOT NULL)"]


def indicators_ctes(src: str, out: str = "ind") -> list[str]:
    f0 = f"{out}_0 AS (SELECT {', '.join(BASE)}, {pct('Close', 1)} AS Return FROM {src})"
    f1 = f"""{out} AS (SELECT {', '.join(BASE)},
  {full('avg', 'Close', 50)} AS SMA_50,
  {full('avg', 'Close', 200)} AS SMA_200,
  Return,
  ({full('stddev_samp', 'Return', 30)}) * sqrt(252) AS Volatility_30d,
  CASE WHEN Return IS NOT NULL THEN
    product(1 + Return) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 END AS Cumulative_Return
FROM {out}_0)"""
    return [f0, f1]
