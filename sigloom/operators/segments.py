"""Runs of equal keys in time: a body is run within each segment and its last result comes out at the next one's start."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from sigloom.plans.bytecode import evaluate, key_column, needs_fold, validate
from sigloom.plans.signal import Base, Signal, synced


def _split(source: Signal, key: Column) -> Signal:
    """``source`` (solid) on a base that has its segments' numbers among the keys."""
    base, w = source.base, source.base.window
    k = F.col(base.add(key))
    change = F.col(base.add(F.coalesce((k != F.lag(k).over(w)).cast("long"), F.lit(0).cast("long"))))
    number = base.add(F.sum(change).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return Signal(Base(base.df.withColumnRenamed(number, "_seg"), (*base.keys, "_seg"), base.order), source.name)


def _closings(source: Signal, first: Column) -> tuple:
    """For each segment (by keys and _seg) the time of the next one's start, and ``first`` of its first row; the last has none."""
    base = source.base
    keys = base.keys[:-1]
    heads = base.df.groupBy(*base.keys).agg(F.min("t").alias("_t0"), F.min_by(first, "t").alias("_f"))
    w = Window.partitionBy(*keys).orderBy("_seg")
    return heads.select(*base.keys, F.lead("_t0").over(w).alias("_end"), F.lead("_f").over(w).alias("_next")).where("_end is not null"), keys


def pipeline(data: list[Signal], control: Signal | None, body: Callable[[list[Signal]], list[Signal]], code: list[float] | None = None, constants=()) -> list[Signal]:
    """The body's last outputs of every closed segment, at the time the next segment starts.

    Segments come from a control signal of keys, or from a stateless program over the data's vector.
    All state of the body starts anew with a segment; the open one at the end gives nothing.
    """
    if code is not None:
        source = data[0].solid()
        own, key = [source], key_column(source, code, constants)
    else:
        *own, control = synced([*data, control])
        if own[0].valid is not None:
            base = Base(own[0].base.df.where(own[0].valid), own[0].base.keys, own[0].base.order)
            own, control = [Signal(base, s.name) for s in own], Signal(base, control.name)
        key = control.v
    split = _split(own[0], key)
    out = []
    for s in body([Signal(split.base, o.name) for o in own]):
        last = s.df().groupBy(*split.base.keys).agg(F.max_by("v", F.struct(*s.base.order)).alias("v"))
        closed, keys = _closings(split, F.lit(None))
        rows = last.join(closed, list(split.base.keys)).select(*keys, F.col("_end").alias("t"), "v")
        out.append(Signal.of(rows, keys=keys))
    return out


def burst_aggregate(source: Signal, agg_code: list[float], agg_constants=(), seg_code: list[float] | None = None, seg_constants=(), key_columns: list[int] = (), outputs: int = 1) -> Signal:
    """[keys, aggregates] of each closed segment, at the row that closes it, with the key columns of that row."""
    program = validate(agg_code, outputs, len(agg_constants))
    if needs_fold(program):
        raise ValueError("an aggregate program can't feed back")
    source = source.solid()
    split = _split(source, key_column(source, seg_code, seg_constants) if seg_code else F.lit(0.0))
    outs, _ = evaluate(split, program, lambda k: F.element_at(split.v, k + 1), list(agg_constants), [])
    s = split.map(F.array(*[F.col(o) for o in outs]))
    last = s.df().groupBy(*split.base.keys).agg(F.max_by("v", F.struct(*split.base.order)).alias("v"))
    closed, keys = _closings(split, F.array(*[F.element_at(split.v, int(k) + 1) for k in key_columns]) if key_columns else F.array().cast("array<double>"))
    rows = last.join(closed, list(split.base.keys)).select(*keys, F.col("_end").alias("t"), F.concat("_next", "v").alias("v"))
    return Signal.of(rows, keys=keys)


def keyed_pipeline(source: Signal, body: Callable[[Signal], Signal], key_index: int | None = None, key_columns: list[int] | None = None) -> Signal:
    """The body run for each key of a vector signal; with ``key_index`` the key comes first in the result.

    ``key_columns`` make a composite key by value, so different keys never share state.
    """
    source = source.solid()
    indices = [key_index] if key_columns is None else list(key_columns)
    names = []
    for i in indices:
        names.append(source.base.add(F.element_at(source.v, int(i) + 1)))
    base = Base(source.base.df, (*source.base.keys, *names), source.base.order)
    out = body(Signal(base, source.name)).solid()
    value = out.v if out.base.df.schema[out.name].dataType.typeName() == "array" else F.array(out.v)
    if key_columns is None:
        value = F.concat(F.array(F.col(names[0])), value)
    order = tuple(c for c in out.base.order)
    rows = out.base.df.select(*source.base.keys, *order, value.alias("v"))
    return Signal(Base(rows, source.base.keys, order), "v")


def new_keys(source: Signal, key_index: int) -> Signal:
    """Each key of a vector signal at the time it is first seen: what a host is told when a keyed pipeline starts one."""
    source = source.solid()
    keys = source.base.keys
    rows = source.base.df.select(*keys, "t", F.element_at(source.v, int(key_index) + 1).alias("v")).groupBy(*keys, "v").agg(F.min("t").alias("t"))
    return Signal(Base(rows.select(*keys, "t", "v"), keys, strict=True), "v")
