"""Signals: lazily fused columns over a shared base.

A base is a DataFrame with one row per message: key columns, ``t`` and, where several messages can
share a ``t``, ``seq``. Operators append columns to it, so signals that stem from one base are
synchronised by rows and never joined; a filter is a column of flags until an operator that counts
messages (a window) needs the rows that pass, which makes a new base. Signals of different bases
meet by an inner equi-join on keys and ``t``.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_NAMES = itertools.count()


class Base:
    """Rows of messages that signals add columns to."""

    def __init__(self, df: DataFrame, keys: tuple[str, ...] = (), order: tuple[str, ...] = ("t",), arrival: str | None = None, strict: bool = False):
        """``arrival``: the column that tells in which order rows came; ``strict``: t is known to increase from row to row."""
        self.df, self.keys, self.order, self.arrival, self.strict = df, tuple(keys), tuple(order), arrival, strict
        self._count: str | None = None
        self.chunks: tuple | None = None  # how chunks.py has cut it, if it has no keys

    def add(self, value: Column) -> str:
        name = f"_c{next(_NAMES)}"
        self.df = self.df.withColumn(name, value)
        return name

    @property
    def window(self):
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def count(self) -> Column:
        """How many messages there were up to each row."""
        if self._count is None:
            self._count = self.add(F.row_number().over(self.window))
        return F.col(self._count)

    @property
    def fixed(self) -> list[str]:
        return [*self.keys, *self.order]


@dataclass(frozen=True)
class Signal:
    """One column of a base, and the column that tells which rows are messages (None: all)."""

    base: Base
    name: str
    valid: str | None = None

    @staticmethod
    def of(df: DataFrame, t: Column | str = "t", v: Column | str = "v", keys: tuple[str, ...] = (), seq: Column | str | None = None, arrival: Column | str | None = None) -> Signal:
        """A signal of the rows of ``df``.

        Operators by themselves expect ``t`` to increase from row to row of each key; the input of a
        program sees to that (``accepted``) and needs ``arrival`` to know which rows came late.
        """
        as_col = lambda c: F.col(c) if isinstance(c, str) else c
        cols = [*[F.col(k) for k in keys], as_col(t).cast("long").alias("t")]
        order = ("t",)
        if seq is not None:
            cols.append(as_col(seq).alias("seq"))
            order = ("t", "seq")
        if arrival is not None:
            cols.append(as_col(arrival).alias("_arrival"))
        return Signal(Base(df.select(*cols, as_col(v).alias("v")), keys, order, None if arrival is None else "_arrival"), "v")

    @property
    def v(self) -> Column:
        return F.col(self.name)

    def map(self, value: Column) -> Signal:
        return replace(self, name=self.base.add(value))

    def where(self, keep: Column) -> Signal:
        keep = F.coalesce(keep, F.lit(False))
        return replace(self, valid=self.base.add(keep if self.valid is None else F.col(self.valid) & keep))

    def df(self, name: str = "v", extra: tuple[str, ...] = ()) -> DataFrame:
        """Keys, t (and seq) and the value of every message."""
        rows = self.base.df if self.valid is None else self.base.df.where(self.valid)
        return rows.select(*self.base.fixed, *extra, self.v.alias(name))

    def solid(self) -> Signal:
        """The same signal on a base of which every row is one of its messages."""
        if self.valid is None:
            return self
        base = self.base
        return Signal(Base(self.df(extra=() if base.arrival is None else (base.arrival,)), base.keys, base.order, base.arrival, base.strict), "v")

    def full(self, n: int, value: Column) -> Signal:
        """A windowed value, from the n-th message on. The signal has to be solid."""
        out = self.map(value)
        return out if n <= 1 else out.where(self.base.count() >= n)



def synced(signals: list[Signal]) -> list[Signal]:
    """The signals at the times that all of them have, on one base."""
    first = signals[0].base
    if all(s.base is first for s in signals):
        flags = list(dict.fromkeys(s.valid for s in signals if s.valid is not None))
        if not flags:
            return signals
        both = flags[0] if len(flags) == 1 else first.add(reduce(lambda a, b: a & b, map(F.col, flags)))
        return [replace(s, valid=both) for s in signals]
    keys = first.keys
    # signals of one base need no join among themselves
    groups: dict[int, list[int]] = {}
    for i, s in enumerate(signals):
        groups.setdefault(id(s.base), []).append(i)
    whole, names = None, {}
    for members in groups.values():
        own = synced([signals[i] for i in members])
        base = own[0].base
        rows = base.df if own[0].valid is None else base.df.where(own[0].valid)
        cols = []
        for i, s in zip(members, own, strict=True):
            names[i] = f"_s{next(_NAMES)}"
            cols.append(s.v.alias(names[i]))
        part = rows.select(*keys, "t", *cols)
        whole = part if whole is None else whole.join(part, [*keys, "t"], "inner")
    base = Base(whole, keys, strict=all(s.base.strict for s in signals))
    return [Signal(base, names[i]) for i in range(len(signals))]


def accepted(signals: list[Signal]) -> list[Signal]:
    """What the ports of an input take: of each signal the messages later than all that arrived before them.

    Without an arrival order messages come in the order of time, and of several with one time the
    one with the smallest value counts. Signals that share a base and its messages still do so after.
    """
    done: dict[tuple, Base] = {}
    out = []
    for s in signals:
        if s.base.strict:
            out.append(s)
            continue
        at = id(s.base), s.valid
        if at not in done:
            base = s.base
            if base.arrival is not None or base.order == ("t",):
                rows = base.df if s.valid is None else base.df.where(s.valid)
                if base.arrival is not None:
                    rows = monotone(rows, "t", base.arrival, base.keys)
                elif base.keys:
                    ahead = F.lag("t").over(Window.partitionBy(*base.keys).orderBy("t", s.v))
                    rows = rows.withColumn("_ahead", ahead).where("_ahead is null or t > _ahead").drop("_ahead")
                else:  # the same without a window over all rows
                    whole = F.struct(s.v.alias("_v"), F.struct(*[c for c in rows.columns if c != "t"]).alias("_row"))
                    rows = rows.groupBy("t").agg(F.min(whole).alias("_first")).select("t", "_first._row.*")
            else:  # several messages of one time have their order
                rows = (base.df if s.valid is None else base.df.where(s.valid)).withColumn("_ahead", F.lag("t").over(base.window)).where("_ahead is null or t > _ahead").drop("_ahead")
            done[at] = Base(rows, base.keys, ("t",), strict=True)
        out.append(Signal(done[at], s.name))
    return out


def monotone(df: DataFrame, t: str, seq: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The rows that an input port accepts: those later than all that arrived (by ``seq``) before them."""
    w = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_last", F.max(t).over(w)).where(F.col("_last").isNull() | (F.col(t) > F.col("_last"))).drop("_last")
