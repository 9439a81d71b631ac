"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None).

Builders take (spark, sf_dir) and return a DataFrame over the whole tables.
Oracle SQL runs in DuckDB on the same parquet files (views named after the
tables). Output columns carry the same names in both.

Float columns produced by aggregates (sums, means, deviations, products) go
through ``quantize`` (a multiple of 2**-20) in both engines, because the two
engines may sum in a different order and differ in the last ulp. Columns that
are pure arithmetic on inputs are compared unrounded.
"""

from __future__ import annotations

from collections.abc import Callable

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def q_sql(expr: str, bits: int = 20) -> str:
    """SQL twin of ``barwise.functions.exprs.quantize``."""
    scale, x = float(2 ** bits), f"CAST(({expr}) AS DOUBLE)"
    return (f"CASE WHEN isnan({x}) OR abs({x}) >= {2.0 ** (62 - bits)!r} THEN {x} "
            f"ELSE CAST(floor({x} * {scale!r} + 0.5) / {scale!r} AS DOUBLE) END")


def with_ctes(ctes: list[str], body: str) -> str:
    seen, uniq = set(), []
    for c in ctes:
        if c not in seen:
            seen.add(c)
            uniq.append(c)
    return "WITH " + ",\n".join(uniq) + "\n" + body
