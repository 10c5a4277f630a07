"""Operators on several ports: messages meet at equal times."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigloom.functions import ieee
from sigloom.operators.scalar import COMPARE
from sigloom.plans.signal import Signal, synced


def join(signals: list[Signal]) -> list[Signal]:
    return synced(signals)


def _fold(signals: list[Signal], f) -> Signal:
    own = synced(signals)
    return own[0].map(reduce(f, [s.v for s in own]))


def arithmetic(kind: str, signals: list[Signal]) -> Signal:
    """Sum, difference, product or quotient of all ports; a zero divisor gives no message."""
    if kind != "Division":
        return _fold(signals, {"Addition": lambda a, b: a + b, "Subtraction": lambda a, b: a - b, "Multiplication": lambda a, b: a * b}[kind])
    own = synced(signals)
    divisors = [s.v for s in own[1:]]
    out = own[0].where(reduce(lambda a, b: a & b, [d != 0 for d in divisors]))
    return out.map(reduce(lambda a, d: a / F.when(d == 0, F.lit(1.0)).otherwise(d), divisors, own[0].v))


def linear(signals: list[Signal], coefficients: list[float]) -> Signal:
    if len(coefficients) < 2 or len(coefficients) != len(signals):
        raise ValueError("a weighted sum takes two ports or more and a coefficient for each")
    own = synced(signals)
    return own[0].map(reduce(lambda a, b: a + b, [F.lit(float(c)) * s.v for c, s in zip(coefficients, own, strict=True)]))


def compare(kind: str, signals: list[Signal], tolerance: float = 0.0) -> Signal:
    a, b = synced(signals)
    if kind in COMPARE:
        return a.map(COMPARE[kind](a.v, b.v))
    apart = F.abs(a.v - b.v)
    return a.map(ieee.lte(apart, F.lit(float(tolerance))) if kind == "EQ" else ieee.gt(apart, F.lit(float(tolerance))))


def keep(kind: str, signals: list[Signal], epsilon: float = 1e-10) -> Signal:
    """The first port's message where it compares as asked with that of every other port."""
    own = synced(signals)
    first, eps = own[0], F.lit(float(epsilon))
    test = {
        "SyncGreaterThan": lambda o: ieee.gt(first.v, o), "SyncLessThan": lambda o: ieee.lt(first.v, o),
        "SyncEqual": lambda o: ieee.lt(F.abs(first.v - o), eps), "SyncNotEqual": lambda o: ieee.gte(F.abs(first.v - o), eps),
    }[kind]
    return first.where(reduce(lambda a, b: a & b, [test(s.v) for s in own[1:]]))


def logic(kind: str, signals: list[Signal]) -> Signal:
    """Truth tables as documented: NAND and NOR are the negated AND and OR of all ports, implication folds from the left."""
    def both(f) -> Signal:
        return _fold(signals, f)

    if kind == "LogicalAnd":
        return both(lambda a, b: a & b)
    if kind == "LogicalOr":
        return both(lambda a, b: a | b)
    if kind == "LogicalXor":
        return both(lambda a, b: a != b)
    if kind == "LogicalXnor":
        return both(lambda a, b: a == b)
    if kind == "LogicalImplication":
        return both(lambda a, b: ~a | b)
    out = both(lambda a, b: a & b) if kind == "LogicalNand" else both(lambda a, b: a | b)
    return out.map(~out.v)


def demultiplex(data: Signal, controls: list[Signal]) -> list[Signal]:
    """The data at each output whose control is true at the same time."""
    own = synced([data, *controls])
    return [own[0].where(c.v) for c in own[1:]]


def multiplex(data: list[Signal], controls: list[Signal]) -> Signal:
    """The message of the one port whose control is true; none where several or no control is."""
    chosen = synced(controls)
    one = reduce(lambda a, b: a + b, [c.v.cast("int") for c in chosen]) == 1
    if all(d.base is chosen[0].base for d in data):
        picked: list[Column] = [F.when(c.v & (F.col(d.valid) if d.valid else F.lit(True)), d.v) for c, d in zip(chosen, data, strict=True)]
        out = chosen[0].where(one).map(F.coalesce(*picked))
        return out.where(out.v.isNotNull())
    keys = chosen[0].base.keys
    rows = chosen[0].where(one)
    rows = rows.base.df.where(rows.valid).select(*keys, "t", *[c.v.alias(f"_k{i}") for i, c in enumerate(chosen)])
    for i, d in enumerate(data):
        rows = rows.join(d.df(f"_d{i}").select(*keys, "t", f"_d{i}"), [*keys, "t"], "left")
    rows = rows.withColumn("v", F.coalesce(*[F.when(F.col(f"_k{i}"), F.col(f"_d{i}")) for i in range(len(data))])).where("v is not null")
    return Signal.of(rows, keys=keys)


def compose(signals: list[Signal]) -> Signal:
    own = synced(signals)
    return own[0].map(F.array(*[s.v for s in own]))
