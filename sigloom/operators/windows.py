"""Frames of the last n messages and running values. All of them count messages, so their signal is made solid first."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from sigloom.operators import chunks
from sigloom.plans.signal import Base, Signal


#: From this size on, frames are put together from two parts of blocks, as Spark goes through a frame anew for every row.
BLOCKS_FROM = 256


def _last(base: Base, n: int):
    if n < 1:
        raise ValueError("a window holds 1 message or more")
    return base.window.rowsBetween(-(n - 1), 0)


def _all(s: Signal):
    return s.base.window.rowsBetween(Window.unboundedPreceding, 0)


def _halves(base: Base, x: Column, n: int, f: Callable[[Column], Column]) -> tuple[Column, Column]:
    """``f`` of the last n messages in two parts: those of the row's own block of n, and those of the block before.

    The second is null where the block is whole. Both are running values, so a row costs the same
    whatever n is.
    """
    number = base.count()
    block = base.add(F.floor((number - 1) / n))
    by = Window.partitionBy(*base.keys, block).rowsBetween(Window.unboundedPreceding, 0)
    head = F.col(base.add(f(x).over(by.orderBy(*base.order))))
    tail = F.col(base.add(f(x).over(by.orderBy(*[F.col(c).desc() for c in base.order]))))
    rest = F.col(base.add(F.when(number % n != 0, F.lag(tail, n - 1).over(base.window))))
    return head, rest


def frame(base: Base, x: Column, n: int, kind: str) -> Column:
    """The mean, sum, sample deviation, min or max of the last ``n`` values of ``x``, a column of the base.

    NaN makes sums and means NaN; it is passed over in min and max, which are NaN for a window of
    nothing else. What stands in rows before the n-th is not defined.
    """
    _last(base, n)
    if kind in ("min", "max"):
        f, both = (F.min, F.least) if kind == "min" else (F.max, F.greatest)
        plain = F.when(~F.isnan(x), x)
        found = f(plain).over(_last(base, n)) if n < BLOCKS_FROM else both(*_halves(base, plain, n, f))
        return F.coalesce(found, F.lit(float("nan")))
    if n < BLOCKS_FROM:
        return {"mean": F.avg, "sum": F.sum, "deviation": F.stddev_samp}[kind](x).over(_last(base, n))
    head, rest = _halves(base, x, n, F.sum)
    if kind in ("mean", "sum"):
        total = head + F.coalesce(rest, F.lit(0.0))
        return total / n if kind == "mean" else total
    here = (base.count() - 1) % n + 1
    there = F.lit(n) - here
    spread, other = _halves(base, x, n, F.var_pop)
    apart = F.when(there > 0, head / here - rest / there).otherwise(0.0)
    square = spread * here + F.coalesce(other, F.lit(0.0)) * there + apart * apart * here * there / n
    return F.sqrt(square / (n - 1))


def _parallel(s: Signal, n: int, make: Callable[[Signal], Signal], ahead: int = 0) -> Signal:
    """``make``, which looks back n - 1 messages and ``ahead`` forward: by keys, or in chunks of time where there are none."""
    s = s.solid()
    return make(s) if s.base.keys or n < 1 else chunks.windowed(s, n, make, ahead=ahead)


def _framed(s: Signal, n: int, kind: str) -> Signal:
    return _parallel(s, n, lambda own: own.full(n, frame(own.base, own.v, n, kind)))


def moving_average(s: Signal, n: int) -> Signal:
    return _framed(s, n, "mean")


def moving_sum(s: Signal, n: int) -> Signal:
    return _framed(s, n, "sum")


def standard_deviation(s: Signal, n: int) -> Signal:
    """Sample deviation; 0 for a window of one."""
    return _framed(s, n, "deviation") if n != 1 else s.solid().map(F.lit(0.0))


def window_min_max(s: Signal, n: int, mode: str = "min") -> Signal:
    if mode not in ("min", "max"):
        raise ValueError("mode must be min or max")
    return _framed(s, n, mode)


def moving_key_count(s: Signal, n: int) -> Signal:
    """How often the current value is among the last n, from the first message on."""
    def make(own: Signal) -> Signal:
        held = own.map(F.collect_list(own.v).over(_last(own.base, n)))
        return own.map(F.size(F.filter(held.v, lambda x: x == own.v)).cast("double"))

    return _parallel(s, n, make)


def difference(s: Signal, newer_time: bool = True) -> Signal:
    """To the message before, at the newer time, or at the older one."""
    if newer_time:
        return _parallel(s, 2, lambda own: own.full(2, own.v - F.lag(own.v).over(own.base.window)))

    def older(own: Signal) -> Signal:
        w = own.base.window
        return own.map(F.lead(own.v).over(w) - own.v).where(F.lead(F.col("t")).over(w).isNotNull())

    return _parallel(s, 1, older, ahead=1)


def peaks(s: Signal, n: int) -> Signal:
    """Messages greater than all others in the odd window around them, at their own time."""
    if n < 3 or n % 2 == 0:
        raise ValueError("a peak needs an odd window of 3 or more")
    h = (n - 1) // 2

    def make(own: Signal) -> Signal:
        before, after = own.base.window.rowsBetween(-h, -1), own.base.window.rowsBetween(1, h)
        plain = F.when(~F.isnan(own.v), own.v)
        top = lambda w: F.coalesce(F.max(plain).over(w), F.lit(float("-inf")))
        whole = (F.count(F.lit(1)).over(before) == h) & (F.count(F.lit(1)).over(after) == h)
        beats = (own.v > top(before)) & (own.v > top(after)) | F.isnan(own.v)
        return own.where(whole & beats)

    return _parallel(s, h + 1, make, ahead=h)


def fir(s: Signal, coefficients: list[float]) -> Signal:
    if not coefficients:
        raise ValueError("a filter without coefficients")
    def make(own: Signal) -> Signal:
        terms = [F.lit(float(c)) * (F.lag(own.v, i).over(own.base.window) if i else own.v) for i, c in enumerate(coefficients)]
        return own.full(len(coefficients), reduce(lambda a, b: a + b, terms))

    return _parallel(s, len(coefficients), make)


def cumulative_sum(s: Signal) -> Signal:
    s = s.solid()
    return s.map(F.sum(s.v).over(_all(s))) if s.base.keys else chunks.running_sum(s)


def count(s: Signal) -> Signal:
    s = s.solid()
    return s.map(s.base.count().cast("double")) if s.base.keys else chunks.running(s.map(F.lit(1.0)), F.sum, lambda a, b: a + b, 0.0)


def tracker(s: Signal, mode: str) -> Signal:
    """Running minimum or maximum; NaN is passed over."""
    s = s.solid()
    f, start = (F.min, float("inf")) if mode == "min" else (F.max, float("-inf"))
    if not s.base.keys:
        return chunks.running(s, lambda v: f(F.when(~F.isnan(v), v)), F.least if mode == "min" else F.greatest, start)
    return s.map(F.coalesce(f(F.when(~F.isnan(s.v), s.v)).over(_all(s)), F.lit(start)))


def final_top(s: Signal, k: int, score_index: int, descending: bool = True) -> Signal:
    """The best k messages of all, per key: what the last snapshot of ``top_k`` holds. Later ones go first where equal."""
    s = s.solid()
    score = F.element_at(s.v, score_index + 1)
    order = [score.desc() if descending else score.asc(), *[F.col(c).desc() for c in s.base.order]]
    w = Window.partitionBy(*s.base.keys).orderBy(*order)
    rows = s.df().withColumn("seq", F.row_number().over(w)).where(F.col("seq") <= k)
    return Signal(Base(rows.select(*s.base.keys, "t", "seq", "v"), s.base.keys, ("seq",)), "v")

