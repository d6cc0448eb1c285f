"""Rounding, clamping, guards and safe casts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_even(c: str | Column, places: int = 0) -> Column:
    """Round half to even the way numpy does: scale, rint, unscale (MTH-03)."""
    k = float(10**places)
    return F.rint(col(c) * F.lit(k)) / F.lit(k)


def half_up(c: str | Column, places: int = 0) -> Column:
    """Round half up the way JavaScript's Math.round does (MTH-06)."""
    k = float(10**places)
    return F.floor(col(c) * F.lit(k) + F.lit(0.5)) / F.lit(k)


def clamp(c: str | Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Limit to [lo, hi]; null stays null (MTH-01)."""
    out = col(c)
    if lo is not None:
        out = F.when(out < lo, F.lit(lo)).otherwise(out)
    if hi is not None:
        out = F.when(out > hi, F.lit(hi)).otherwise(out)
    return out


def ratio(num: str | Column, den: str | Column, default: float | None = 0.0) -> Column:
    """num/den, with a zero or null denominator giving ``default`` (PRJ-04)."""
    q = col(num).cast("double") / F.nullif(col(den).cast("double"), F.lit(0.0))
    return q if default is None else F.coalesce(q, F.lit(default))


def to_number(c: str | Column, kind: str = "double", default: float | None = None) -> Column:
    """Cast text to a number; bad text becomes null or ``default`` (STR-06)."""
    v = F.trim(col(c)).try_cast(kind)
    return v if default is None else F.coalesce(v, F.lit(default).cast(kind))


def within_pct(value: str | Column, target: str | Column, pct: float = 0.05) -> Column:
    """|value-target| <= |target|*pct; a zero target needs an exact zero (MTH-05)."""
    v, t = col(value), col(target)
    return F.when(t == 0, v == 0).otherwise(F.abs(v - t) <= F.abs(t) * F.lit(pct))


def log_scale(c: str | Column) -> Column:
    """log1p of the value clipped at zero (MTH-02)."""
    return F.log1p(F.greatest(col(c), F.lit(0.0)))


def finite_or_null(c: str | Column) -> Column:
    """NaN and infinities become null (SNK-02)."""
    v = col(c)
    return F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), None).otherwise(v)


def lookup(c: str | Column, table: Mapping[str, object], default: object) -> Column:
    """Value of a literal map with a default for missing or null keys (MAP-01)."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, col(c)), F.lit(default))


def kept(*items: Column) -> Column:
    """Array of the non-null items, in order (ARR-02)."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def best_key(scores: Mapping[str, Column]) -> Column:
    """Name of the smallest non-null score; the earlier name wins ties (MAP-02)."""
    rows = [
        F.when(v.isNotNull(), F.struct(v.alias("v"), F.lit(i).alias("i"), F.lit(k).alias("k")))
        for i, (k, v) in enumerate(scores.items())
    ]
    return F.array_min(kept(*rows))["k"]


def computed_once(df: DataFrame) -> DataFrame:
    """Same rows, with every column computed before the next step.

    A column that a lambda or many predicates refer to would otherwise be folded
    into each of them and computed again every time.  The generator is a border
    the optimizer does not fold across; it stays in generated code.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))
