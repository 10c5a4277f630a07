"""One message in, at most one out: arithmetic, constants, filters, comparisons, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigloom.functions import ieee
from sigloom.plans.signal import Base, Signal

UNARY = {
    "Sin": F.sin, "Cos": F.cos, "Tan": F.tan, "Exp": F.exp, "Log": ieee.log, "Log10": lambda x: ieee.log(x, True), "Abs": F.abs, "Sign": ieee.sign,
    "Floor": ieee.floor, "Ceil": ieee.ceil, "Round": ieee.round_half_away, "Identity": lambda x: x, "BooleanToNumber": lambda x: x.cast("double"),
}
WITH_VALUE = {"Add": lambda x, c: x + c, "Scale": lambda x, c: x * c, "Power": lambda x, c: F.pow(x, c)}
COMPARE = {"GT": ieee.gt, "LT": ieee.lt, "GTE": ieee.gte, "LTE": ieee.lte}


def unary(kind: str, s: Signal) -> Signal:
    return s.map(UNARY[kind](s.v))


def with_value(kind: str, s: Signal, value: float) -> Signal:
    return s.map(WITH_VALUE[kind](s.v, F.lit(float(value))))


def literal(value) -> Column:
    if isinstance(value, (list, tuple)):
        return F.array(*[literal(x) for x in value])
    return F.lit(value) if isinstance(value, bool) else F.lit(float(value))


def constant(s: Signal, value) -> Signal:
    """Every message with its value replaced."""
    return s.map(literal(value))


def interpolate(s: Signal, points: list, kind: str = "linear") -> Signal:
    """Piecewise through sorted points, the end pieces carried on; ``hermite`` takes slopes of neighbours, not scaled by widths."""
    pts = sorted((float(x), float(y)) for x, y in points)
    if len(pts) < 2:
        raise ValueError("a curve takes two points or more")
    slopes = []
    for i in range(len(pts)):
        a, b = pts[max(i - 1, 0)], pts[min(i + 1, len(pts) - 1)]
        slopes.append((b[1] - a[1]) / (b[0] - a[0]) if b[0] != a[0] else 0.0)

    def piece(i: int) -> Column:
        (x0, y0), (x1, y1) = pts[i], pts[i + 1]
        u = (s.v - F.lit(x0)) / F.lit(x1 - x0) if x1 != x0 else F.lit(0.0)
        if kind == "linear":
            return F.lit(y0) + u * F.lit(y1 - y0)
        m0, m1 = slopes[i], slopes[i + 1]
        return (2 * u * u * u - 3 * u * u + 1) * y0 + (u * u * u - 2 * u * u + u) * m0 + (-2 * u * u * u + 3 * u * u) * y1 + (u * u * u - u * u) * m1

    out = piece(len(pts) - 2)
    for i in range(len(pts) - 3, -1, -1):
        out = F.when(ieee.lt(s.v, F.lit(pts[i + 1][0])), piece(i)).otherwise(out)
    return s.map(out)


def replace_low(s: Signal, value: float, by: float) -> Signal:
    """Values up to ``value`` replaced; NaN and infinities leave."""
    return s.where(ieee.finite(s.v)).map(F.when(s.v <= F.lit(float(value)), F.lit(float(by))).otherwise(s.v))


def time_shift(s: Signal, shift: int) -> Signal:
    """Later by ``shift``; messages that would be before 0 leave."""
    rows = s.df().withColumn("t", F.col("t") + F.lit(int(shift))).where("t >= 0")
    return Signal(Base(rows, s.base.keys, s.base.order), "v")


def timestamp_extract(s: Signal) -> Signal:
    return s.map(F.col("t").cast("double"))


def keep(kind: str, s: Signal, value: float, epsilon: float = 1e-10) -> Signal:
    """The messages whose value compares as asked with a constant."""
    c, apart = F.lit(float(value)), F.abs(s.v - F.lit(float(value)))
    cond = {"GreaterThan": ieee.gt(s.v, c), "LessThan": ieee.lt(s.v, c), "EqualTo": ieee.lte(apart, F.lit(float(epsilon))), "NotEqualTo": ieee.gt(apart, F.lit(float(epsilon)))}
    return s.where(cond[kind])


def compare(kind: str, s: Signal, value: float, tolerance: float = 0.0) -> Signal:
    c, apart = F.lit(float(value)), F.abs(s.v - F.lit(float(value)))
    if kind in COMPARE:
        return s.map(COMPARE[kind](s.v, c))
    return s.map(ieee.lte(apart, F.lit(float(tolerance))) if kind == "EQ" else ieee.gt(apart, F.lit(float(tolerance))))


def vector_extract(s: Signal, index: int) -> Signal:
    """One element; a vector that is too short is an error."""
    return s.map(F.element_at(s.v, int(index) + 1))


def vector_project(s: Signal, indices: list[int]) -> Signal:
    return s.map(F.array(*[F.element_at(s.v, int(i) + 1) for i in indices]))

