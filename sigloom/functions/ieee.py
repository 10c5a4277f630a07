"""Scalar functions on double columns with IEEE-754 results where Spark gives errors, nulls or other types."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_WHOLE = float(1 << 53)  # from here on every double is whole


def num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def divide(a: Column, b: Column) -> Column:
    safe = F.when(b == 0, F.lit(1.0)).otherwise(b)
    signed = F.when(F.isnan(a) | (a == 0), F.lit(math.nan)).when((a > 0) == ~_negative_zero(b), F.lit(math.inf)).otherwise(F.lit(-math.inf))
    return F.when(b == 0, signed).otherwise(a / safe)


def _negative_zero(b: Column) -> Column:
    return (b == 0) & (b.cast("string") == F.lit("-0.0"))


def gt(a: Column, b: Column) -> Column:
    return (a > b) & ~F.isnan(a) & ~F.isnan(b)


def lt(a: Column, b: Column) -> Column:
    return (a < b) & ~F.isnan(a) & ~F.isnan(b)


def gte(a: Column, b: Column) -> Column:
    return (a >= b) & ~F.isnan(a) & ~F.isnan(b)


def lte(a: Column, b: Column) -> Column:
    return (a <= b) & ~F.isnan(a) & ~F.isnan(b)


def eq(a: Column, b: Column) -> Column:
    return (a == b) & ~F.isnan(a) & ~F.isnan(b)


def neq(a: Column, b: Column) -> Column:
    return ~eq(a, b)


def log(x: Column, base10: bool = False) -> Column:
    f = F.log10 if base10 else F.log
    return F.when(F.isnan(x) | (x < 0), F.lit(math.nan)).when(x == 0, F.lit(-math.inf)).otherwise(f(F.when(x > 0, x).otherwise(F.lit(1.0))))


def sign(x: Column) -> Column:
    return F.when(gt(x, F.lit(0.0)), 1.0).when(lt(x, F.lit(0.0)), -1.0).otherwise(0.0)


def _whole(x: Column, f) -> Column:
    big = F.isnan(x) | (F.abs(x) >= _WHOLE)
    return F.when(big, x).otherwise(f(F.when(big, F.lit(0.0)).otherwise(x)).cast("double"))


def floor(x: Column) -> Column:
    return _whole(x, F.floor)


def ceil(x: Column) -> Column:
    return _whole(x, F.ceil)


def round_half_away(x: Column) -> Column:
    big = F.isnan(x) | (F.abs(x) >= _WHOLE)
    a = F.abs(F.when(big, F.lit(0.0)).otherwise(x))
    low = F.floor(a).cast("double")
    up = F.when(a - low >= 0.5, low + 1.0).otherwise(low)
    return F.when(big, x).otherwise(F.when(x < 0, -up).otherwise(up))


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
