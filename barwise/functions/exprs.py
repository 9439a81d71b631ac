"""Scalar Column -> Column helpers.

All are built-in Spark expressions, so they stay inside whole-stage codegen.
Division uses ``try_divide``: a zero denominator gives NULL (ANSI mode would
raise; pandas would give +-inf).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SQRT_252 = math.sqrt(252.0)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def intraday_return(open_="Open", close="Close") -> Column:
    """(close - open) / open."""
    return F.try_divide(col(close) - col(open_), col(open_))


def hl_range(high="High", low="Low") -> Column:
    """high - low."""
    return col(high) - col(low)


def typical_price(high="High", low="Low", close="Close") -> Column:
    """(high + low + close) / 3."""
    return (col(high) + col(low) + col(close)) / F.lit(3.0)


def safe_ratio(a, b, eps: float) -> Column:
    """a / (b + eps), the epsilon-guarded ratio; NULL if the sum is 0."""
    return F.try_divide(col(a), col(b) + F.lit(eps))


def ratio_minus_one(a, b) -> Column:
    """a / b - 1 with NULL for a zero or missing denominator (pct change)."""
    return F.try_divide(col(a), col(b)) - F.lit(1.0)


def weekday_mon0(date="Date") -> Column:
    """day of week with Monday = 0 ... Sunday = 6."""
    return F.weekday(col(date))


def month_end_flag(date="Date") -> Column:
    """1 on the last calendar day of the month."""
    return (col(date) == F.last_day(col(date))).cast("int")


def month_start_flag(date="Date") -> Column:
    """1 on the first calendar day of the month."""
    return (F.dayofmonth(col(date)) == 1).cast("int")


def quantize(c, bits: int = 20) -> Column:
    """Round to a multiple of 2**-bits (~1e-6 for 20 bits).

    Used only at the output edge of registered queries, on values computed by
    aggregates, so that two engines whose sums differ in the last ulp agree.
    Scaling by a power of two is exact, so equal inputs give equal outputs and
    there are no decimal half-way ties. NaN and values too large for the grid
    (2**62 / 2**bits and above) pass unchanged.
    """
    scale = float(2 ** bits)
    x = col(c).cast("double")
    grid = (F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) >= F.lit(2.0 ** (62 - bits))), x).otherwise(grid)


def round_cols(df, digits: dict):
    """round named columns half-up (presentation edge only)."""
    return df.withColumns({c: F.round(F.col(c), d) for c, d in digits.items()})


def yes_no(cond: Column) -> Column:
    """conditional text label."""
    return F.when(cond, F.lit("Yes")).otherwise(F.lit("No"))
