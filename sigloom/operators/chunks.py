"""Signals without keys in parallel: time is cut into chunks of about equal counts, which are then keys.

A window of the last n messages needs n - 1 messages from before its chunk; these are copied in and
leave again. Running values go on from what all chunks before have given. All that reaches the
driver is chunk boundaries, counts and one total a chunk, as many as there are chunks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from sigloom.plans.signal import Base, Signal

CHUNK = "_chunk"
CHUNKS = 64


def boundaries(signal: Signal, chunks: int) -> list[int]:
    """Times at which chunks begin (but for the first): approximate quantiles of t."""
    cuts = signal.base.df.approxQuantile("t", [i / chunks for i in range(1, chunks)], 0.1 / chunks) if chunks > 1 else []
    return sorted({int(c) for c in cuts})


def _cuts(signal: Signal, chunks: int) -> tuple[list[int], dict[int, int]]:
    """Boundaries and the messages of each chunk, found once for a base."""
    base = signal.base
    if base.chunks is None or base.chunks[0] != chunks:
        cuts = boundaries(signal, chunks)
        sizes = {r[0]: r[1] for r in _cut(signal, cuts).base.df.groupBy(CHUNK).count().collect()}  # one row a chunk
        base.chunks = chunks, cuts, sizes
    return base.chunks[1:]


def _cut(signal: Signal, cuts: list[int]) -> Signal:
    """The signal with its chunk's number as its key. Boundaries are at most as many as chunks were asked for."""
    at = F.lit(0)
    for c in cuts:
        at = at + (F.col("t") >= F.lit(c)).cast("int")
    return Signal(Base(signal.df().withColumn(CHUNK, at), (CHUNK,), signal.base.order, strict=signal.base.strict), "v")


def windowed(signal: Signal, n: int, operator: Callable[[Signal], Signal], chunks: int = CHUNKS, ahead: int = 0) -> Signal:
    """``operator``, which looks back at most ``n - 1`` messages and ``ahead`` messages forward, over a signal without keys.

    Chunks with fewer messages than that are merged into their neighbours before.
    """
    if signal.base.keys:
        raise ValueError("a keyed signal runs in parallel by its keys")
    signal = signal.solid()
    cuts, sizes = _cuts(signal, chunks)
    kept, held = [], sizes.get(0, 0)
    for i, c in enumerate(cuts, 1):
        if held >= max(n - 1, ahead):
            kept.append(c)
            held = 0
        held += sizes.get(i, 0)
    own = _cut(signal, kept)
    tail = Window.partitionBy(CHUNK).orderBy(*[F.col(c).desc() for c in own.base.order])
    rows = own.base.df.withColumn("_halo", F.lit(False))
    halo = own.base.df.withColumn("_back", F.row_number().over(tail)).where(F.col("_back") <= n - 1).where(F.col(CHUNK) < len(kept)).drop("_back")
    halo = halo.withColumn(CHUNK, F.col(CHUNK) + 1).withColumn("_halo", F.lit(True))
    halo = halo.unionByName(_next(own, ahead)) if ahead else halo
    base = Base(rows.unionByName(halo), (CHUNK,), own.base.order, strict=own.base.strict)
    out = operator(Signal(base, "v"))
    if out.base is not base:
        raise ValueError("only operators that keep their messages' times and rows can run in chunks")
    out = out.where(~F.col("_halo"))
    rows = out.base.df.where(out.valid).select(*own.base.order, out.v.alias("v"))
    return Signal(Base(rows, (), own.base.order, strict=own.base.strict), "v")


def _next(own: Signal, ahead: int):
    """The first ``ahead`` messages of each chunk as those behind the chunk before it."""
    head = Window.partitionBy(CHUNK).orderBy(*own.base.order)
    rows = own.base.df.withColumn("_front", F.row_number().over(head)).where((F.col("_front") <= ahead) & (F.col(CHUNK) > 0)).drop("_front")
    return rows.withColumn(CHUNK, F.col(CHUNK) - 1).withColumn("_halo", F.lit(True))


def running(signal: Signal, total: Callable[[Column], Column], join: Callable[[Column, Column], Column], start: float, chunks: int = CHUNKS) -> Signal:
    """A running aggregate of a signal without keys: that of the chunk, joined with that of all chunks before."""
    if signal.base.keys:
        raise ValueError("a keyed signal runs in parallel by its keys")
    signal = signal.solid()
    own = _cut(signal, _cuts(signal, chunks)[0])
    sums = {r[0]: r[1] for r in own.base.df.groupBy(CHUNK).agg(total(F.col("v"))).collect()}  # one row a chunk
    lists = F.array(*[F.array(*[F.lit(float(sums[k])) for k in range(i) if sums.get(k) is not None], F.lit(start)) for i in range(max(sums, default=0) + 1)])
    before = F.aggregate(F.element_at(lists, F.col(CHUNK) + 1), F.lit(start), lambda a, b: join(a, b))
    here = total(F.col("v")).over(own.base.window.rowsBetween(Window.unboundedPreceding, 0))
    rows = own.base.df.select(CHUNK, *own.base.order, F.coalesce(here, F.lit(start)).alias("_here"))
    return Signal(Base(rows.select(*own.base.order, join(before, F.col("_here")).alias("v")), (), own.base.order, strict=own.base.strict), "v")


def running_sum(signal: Signal, chunks: int = CHUNKS) -> Signal:
    """The cumulative sum of a signal without keys."""
    return running(signal, F.sum, lambda a, b: a + b, 0.0, chunks)
