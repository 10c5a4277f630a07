"""As-of lookups and grids in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.plans.signal import Signal


def variable(data: Signal, queries: Signal, default: float = 0.0) -> Signal:
    """At each query the latest data up to it, or the default before any.

    A query is answered only if data at or after it exist. Data and queries are one tagged stream,
    so there is one shuffle and no range join.
    """
    keys = data.base.keys
    tagged = data.df().select(*keys, "t", F.lit(0).alias("g"), "v").unionByName(queries.df("q").select(*keys, "t", F.lit(1).alias("g"), F.lit(None).cast("double").alias("v")))
    w = Window.partitionBy(*keys).orderBy("t", "g").rowsBetween(Window.unboundedPreceding, 0)
    rows = tagged.withColumn("l", F.last("v", True).over(w)).withColumn("m", F.max(F.when(F.col("g") == 0, F.col("t"))).over(Window.partitionBy(*keys)))
    rows = rows.where((F.col("g") == 1) & (F.col("t") <= F.col("m")))
    return Signal.of(rows.select(*keys, "t", F.coalesce("l", F.lit(float(default))).alias("v")), keys=keys)


def keyed_variable(updates: Signal, queries: Signal, heartbeat: Signal | None = None, mode: str = "exists", default: float = 0.0) -> Signal:
    """Lookups in a table that a changelog of [key, value] keeps (NaN deletes): whether a key is there, or its value.

    Strictly as-of, updates at a query's time included; a query is answered once an update (of any
    key) or a heartbeat at or after it has come.
    """
    if mode not in ("exists", "lookup"):
        raise ValueError("mode must be exists or lookup")
    keys = updates.base.keys
    u = updates.df().select(*keys, "t", F.element_at("v", 1).alias("k"), F.element_at("v", 2).alias("x"), F.lit(0).alias("g"))
    q = queries.df().select(*keys, "t", F.col("v").alias("k"), F.lit(None).cast("double").alias("x"), F.lit(1).alias("g"))
    w = Window.partitionBy(*keys, "k").orderBy("t", "g").rowsBetween(Window.unboundedPreceding, 0)
    rows = u.unionByName(q).withColumn("l", F.last("x", True).over(w)).where("g = 1")
    times = u.select(*keys, "t")
    if heartbeat is not None:
        times = times.unionByName(heartbeat.df().select(*keys, "t"))
    # one row a key, or one row in all
    released = times.groupBy(*keys).agg(F.max("t").alias("m")) if keys else times.agg(F.max("t").alias("m")).withColumn("_one", F.lit(1))
    rows = rows.join(released, [*keys]) if keys else rows.withColumn("_one", F.lit(1)).join(F.broadcast(released), "_one")
    there = F.col("l").isNotNull() & ~F.isnan("l")
    out = there if mode == "exists" else F.when(there, F.col("l")).otherwise(F.lit(float(default)))
    return Signal.of(rows.where("t <= m").select(*keys, "t", out.alias("v")), keys=keys)


def _index(t, origin, dt: int):
    """Number of the last grid point up to t."""
    x = t - origin
    return F.call_function("div", x - F.pmod(x, F.lit(int(dt)).cast("long")), F.lit(int(dt)).cast("long"))


#: Numbers that one array holds when grid points are made.
_BLOCK = 4096


def _numbers(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` once for each whole number from its a to its b, as ``name``: by blocks first, so no array grows with a gap."""
    block = lambda c: _index(F.col(c), F.lit(0).cast("long"), _BLOCK)
    blocks = rows.withColumn("_block", F.explode(F.sequence(block("a"), block("b"))))
    first = F.col("_block") * F.lit(_BLOCK).cast("long")
    part = F.sequence(F.greatest(F.col("a"), first), F.least(F.col("b"), first + (_BLOCK - 1)))
    return blocks.withColumn(name, F.explode(part)).drop("_block")


def _pairs(s: Signal) -> DataFrame:
    s = s.solid()
    w = s.base.window
    head = Window.partitionBy(*s.base.keys).orderBy(*s.base.order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return s.base.df.select(*s.base.keys, "t", s.v.alias("v"), F.lag("t").over(w).alias("pt"), F.lag(s.v).over(w).alias("pv"), F.first("t").over(head).alias("t1"))


def resample_constant(s: Signal, interval: int, t0: int | None = None, snap_first: bool = False) -> Signal:
    """The last value at each point of a grid; with ``snap_first`` the next one, from the point at or before the first message.

    Each message gives the grid points since the one before it, so no point is looked up.
    """
    if interval <= 0:
        raise ValueError("the distance of grid points has to be above 0")
    dt, keys, rows = int(interval), s.base.keys, _pairs(s)
    origin = F.lit(int(t0 or 0)).cast("long") if t0 is not None or snap_first else F.col("t1")
    upto = _index(F.col("t"), origin, dt)
    since = _index(F.col("pt"), origin, dt) + 1
    if snap_first:
        since = F.when(F.col("pt").isNull(), upto).otherwise(since)
    elif t0 is not None:
        since = F.when(F.col("pt").isNotNull(), F.greatest(since, F.lit(0).cast("long")))
    rows = rows.withColumns({"a": since, "b": upto}).where("a is not null and a <= b")
    rows = _numbers(rows, "n").select(*keys, "t", "v", "pv", "n", origin.alias("o"))
    at = F.col("o") + F.col("n") * dt
    value = F.col("v") if snap_first else F.when(at == F.col("t"), F.col("v")).otherwise(F.col("pv"))
    return Signal.of(rows.select(*keys, at.alias("t"), value.alias("v")), keys=keys)


def resample_hermite(s: Signal, interval: int) -> Signal:
    """A cubic through neighbours at each point of a grid that starts at the second message.

    An interval between two messages is filled once the message after it has come.
    """
    if interval <= 0:
        raise ValueError("the distance of grid points has to be above 0")
    s, dt = s.solid(), int(interval)
    keys, w, number = s.base.keys, s.base.window, s.base.count()
    rows = s.base.df.select(
        *keys, F.lag(s.v, 2).over(w).alias("p0"), F.lag("t", 1).over(w).alias("t1"), F.lag(s.v, 1).over(w).alias("p1"), F.col("t").alias("t2"), s.v.alias("p2"), F.lead(s.v, 1).over(w).alias("p3"),
        F.lead("t", 1).over(w).alias("t3"), number.alias("n"), F.min(F.when(number == 2, F.col("t"))).over(Window.partitionBy(*keys)).alias("o"),
    )
    rows = rows.where("n >= 3 and t3 is not null")
    since = F.when(F.col("n") == 3, F.lit(0).cast("long")).otherwise(_index(F.col("t1"), F.col("o"), dt) + 1)
    rows = rows.withColumns({"a": since, "b": _index(F.col("t2"), F.col("o"), dt)}).where("a <= b")
    rows = _numbers(rows, "k")
    g = F.col("o") + F.col("k") * dt
    u = (g - F.col("t1")).cast("double") / (F.col("t2") - F.col("t1")).cast("double")
    m1, m2 = (F.col("p2") - F.col("p0")) / 2, (F.col("p3") - F.col("p1")) / 2
    v = (2 * u * u * u - 3 * u * u + 1) * F.col("p1") + (u * u * u - 2 * u * u + u) * m1 + (u * u * u - u * u) * m2 + (-2 * u * u * u + 3 * u * u) * F.col("p2")
    return Signal.of(rows.select(*keys, g.alias("t"), v.alias("v")), keys=keys)

