"""One query for each operator over the event and order tables, with the SQL that it is held against."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.operators import folds, scalar, segments, sync, timegrid, windows
from sigloom.plans import bytecode
from sigloom.plans.bytecode import CODES
from sigloom.plans.program import compile_program, result_table
from sigloom.plans.session import Program, Run
from sigloom.plans.signal import Signal, monotone, synced

KEYS = ("user_id",)
DAY = 86_400_000_000
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

E_SQL = "e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS t, value AS v FROM events)"
#: Two signals of different tables that share some times, and one signal of orders.
AB_SQL = """a AS (SELECT user_id, event_id AS t, value AS v FROM events WHERE event_type IN ('click', 'view')),
b AS (SELECT user_id, event_id AS t, round(value * 0.5 + user_id % 7, 4) AS v FROM events WHERE event_type IN ('view', 'purchase')),
c AS (SELECT user_id, event_id AS t, value - 60 AS v FROM events WHERE event_type IN ('view', 'error'))"""


def micros(column: str):
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def signal(spark: SparkSession, sf_dir: str, keys: tuple = KEYS) -> Signal:
    return Signal.of(events(spark, sf_dir), micros("ts"), "value", keys)


def abc(spark: SparkSession, sf_dir: str) -> list[Signal]:
    e = events(spark, sf_dir)
    pick = lambda a, b: e.where(F.col("event_type").isin(a, b))
    return [
        Signal.of(pick("click", "view"), "event_id", "value", KEYS),
        Signal.of(pick("view", "purchase"), "event_id", F.round(F.col("value") * 0.5 + F.col("user_id") % 7, 4), KEYS),
        Signal.of(pick("view", "error"), "event_id", F.col("value") - 60, KEYS),
    ]


def vectors(spark: SparkSession, sf_dir: str, keys: tuple = KEYS) -> Signal:
    """[value, event_id % 5, user_id % 3] of each event."""
    v = F.array("value", (F.col("event_id") % 5).cast("double"), (F.col("user_id") % 3).cast("double"))
    return Signal.of(events(spark, sf_dir), micros("ts"), v, keys)


V_SQL = E_SQL + ", w AS (SELECT user_id, event_id, t, v AS x0, CAST(event_id % 5 AS DOUBLE) AS x1, CAST(user_id % 3 AS DOUBLE) AS x2 FROM e)"


def rounded(s: Signal, *names: str, digits: int = 6) -> DataFrame:
    """Keys, t and the value, rounded; the elements of a vector by ``names``."""
    rows = s.df()
    kind = rows.schema["v"].dataType.typeName()
    near = lambda c: F.round(c, digits) + F.lit(0.0)
    if kind == "array":
        cols = [near(F.col("v")[i]).alias(n) for i, n in enumerate(names)]
    else:
        cols = [near(F.col("v")).alias("v") if kind == "double" else F.col("v")]
    return rows.select(*s.base.keys, "t", *cols)


def sevenths(s: Signal) -> Signal:
    """A seventh of the values: decimal inputs then give no ties for rounding to decide."""
    return s.map(s.v / 7)


def add(name: str, make: Callable[[SparkSession, str], Signal | DataFrame], sql: str | None, *names: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = make(spark, sf_dir)
        return rounded(out, *names) if isinstance(out, Signal) else out

    query.__name__ = name
    _QUERIES[name] = query
    if sql is not None:
        _SQL[name] = sql


def near(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def of_e(name: str, make: Callable[[Signal], Signal], value: str, where: str = "true") -> None:
    add(name, lambda sp, d: make(signal(sp, d)), f"WITH {E_SQL} SELECT user_id, t, {value} AS v FROM e WHERE {where}")


def windowed(name: str, make: Callable[[Signal], Signal], value: str, keep: str = "true", over: str = "WINDOW w AS (PARTITION BY user_id ORDER BY t)") -> None:
    add(name, lambda sp, d: make(signal(sp, d)), f"WITH {E_SQL}, x AS (SELECT user_id, t, {value} AS v, row_number() OVER w AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM e {over}) SELECT user_id, t, {near('v')} AS v FROM x WHERE {keep}")


# --- ingress
def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", "event_id", micros("ts").alias("t"), F.col("value").alias("v")).withColumn("seq", F.col("event_id") * 7919 % 10007)
    return monotone(rows.withColumn("seq", F.col("seq") * 1_000_000 + F.col("event_id")), "t", "seq", KEYS).select("user_id", "t", "v")


add("input_monotone", _arrivals, f"""WITH {E_SQL}, s AS (SELECT *, (event_id * 7919 % 10007) * 1000000 + event_id AS seq FROM e),
m AS (SELECT *, max(t) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM s)
SELECT user_id, t, v FROM m WHERE p IS NULL OR t > p""")
add("output_json", lambda sp, d: result_table({("out", "o1"): signal(sp, d).map(F.col("v") * 2)}).select("user_id", "op", "port", "t", F.get_json_object("value", "$.v").cast("double").alias("v")), f"WITH {E_SQL} SELECT user_id, 'out' AS op, 'o1' AS port, t, v * 2 AS v FROM e")

# --- scalar
of_e("add", lambda s: scalar.with_value("Add", s, 1.25), near("v + 1.25"))
of_e("scale", lambda s: scalar.with_value("Scale", s, -2.5), near("v * -2.5"))
of_e("power", lambda s: scalar.with_value("Power", s, 0.5), near("pow(v, 0.5)"))
for _f in ("Sin", "Cos", "Tan"):
    of_e(_f.lower(), lambda s, f=_f: scalar.unary(f, scalar.with_value("Scale", s, 0.01)), near(f"{_f.lower()}(v * 0.01)"))
of_e("exp", lambda s: scalar.unary("Exp", scalar.with_value("Scale", s, 0.01)), near("exp(v * 0.01)"))
of_e("log", lambda s: scalar.unary("Log", scalar.with_value("Add", s, 1.0)), near("ln(v + 1)"))
of_e("log10", lambda s: scalar.unary("Log10", scalar.with_value("Add", s, 1.0)), near("log10(v + 1)"))
of_e("abs", lambda s: scalar.unary("Abs", scalar.with_value("Add", s, -50.0)), near("abs(v - 50)"))
of_e("sign", lambda s: scalar.unary("Sign", scalar.with_value("Add", s, -50.0)), "CAST(sign(v - 50) AS DOUBLE) + 0.0")
of_e("floor", lambda s: scalar.unary("Floor", scalar.with_value("Add", s, -50.0)), "floor(v - 50) + 0.0")
of_e("ceil", lambda s: scalar.unary("Ceil", scalar.with_value("Add", s, -50.0)), "ceil(v - 50) + 0.0")
of_e("round", lambda s: scalar.unary("Round", scalar.with_value("Add", s, -50.0)), "round(v - 50) + 0.0")
of_e("identity", lambda s: scalar.unary("Identity", s), near("v"))
of_e("constant_number", lambda s: scalar.constant(s, 7.5), "CAST(7.5 AS DOUBLE)")
of_e("constant_number_to_boolean", lambda s: scalar.constant(s, True), "true")
of_e("constant_boolean", lambda s: scalar.constant(scalar.compare("GT", s, 50.0), False), "false")
of_e("constant_boolean_to_number", lambda s: scalar.constant(scalar.compare("GT", s, 50.0), 1.5), "CAST(1.5 AS DOUBLE)")
add("constant_vector", lambda sp, d: scalar.constant(signal(sp, d), [1.0, 2.0]), f"WITH {E_SQL} SELECT user_id, t, CAST(1 AS DOUBLE) AS a, CAST(2 AS DOUBLE) AS b FROM e", "a", "b")
of_e("boolean_to_number", lambda s: scalar.unary("BooleanToNumber", scalar.compare("GT", s, 50.0)), "CASE WHEN v > 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")
POINTS = [[0.0, 0.0], [50.0, 10.0], [100.0, -5.0]]
of_e("function_linear", lambda s: scalar.interpolate(s, POINTS), near("CASE WHEN v < 50 THEN v / 50 * 10 ELSE 10 + (v - 50) / 50 * -15 END"))
of_e("function_hermite", lambda s: scalar.interpolate(s, POINTS, "hermite"), near("""CASE WHEN v < 50 THEN (pow(v / 50, 3) - 2 * pow(v / 50, 2) + v / 50) * 0.2 + (-2 * pow(v / 50, 3) + 3 * pow(v / 50, 2)) * 10 + (pow(v / 50, 3) - pow(v / 50, 2)) * -0.05
ELSE (2 * pow(v / 50 - 1, 3) - 3 * pow(v / 50 - 1, 2) + 1) * 10 + (pow(v / 50 - 1, 3) - 2 * pow(v / 50 - 1, 2) + v / 50 - 1) * -0.05 + (-2 * pow(v / 50 - 1, 3) + 3 * pow(v / 50 - 1, 2)) * -5 + (pow(v / 50 - 1, 3) - pow(v / 50 - 1, 2)) * -0.3 END"""))
of_e("replace_le", lambda s: scalar.replace_low(s, 20.0, 0.5), near("CASE WHEN v <= 20 THEN 0.5 ELSE v END"))
add("time_shift", lambda sp, d: scalar.time_shift(Signal.of(events(sp, d), "event_id", "value", KEYS), -100), "SELECT user_id, event_id - 100 AS t, round(value, 6) + 0.0 AS v FROM events WHERE event_id >= 100")
add("timestamp_extract", lambda sp, d: scalar.timestamp_extract(vectors(sp, d)), f"WITH {V_SQL} SELECT user_id, t, CAST(t AS DOUBLE) AS v FROM w")
# --- vectors
add("vector_extract", lambda sp, d: scalar.vector_extract(vectors(sp, d), 1), f"WITH {V_SQL} SELECT user_id, t, x1 AS v FROM w")
add("vector_project", lambda sp, d: scalar.vector_project(vectors(sp, d), [2, 0]), f"WITH {V_SQL} SELECT user_id, t, x2 AS a, {near('x0')} AS b FROM w", "a", "b")
add("vector_compose", lambda sp, d: sync.compose(abc(sp, d)), f"WITH {AB_SQL} SELECT user_id, t, {near('a.v')} AS a, {near('b.v')} AS b, {near('c.v')} AS c FROM a JOIN b USING (user_id, t) JOIN c USING (user_id, t)", "a", "b", "c")
# --- filters and comparisons
of_e("greater_than", lambda s: scalar.keep("GreaterThan", s, 80.0), near("v"), "v > 80")
of_e("less_than", lambda s: scalar.keep("LessThan", s, 20.0), near("v"), "v < 20")
of_e("equal_to", lambda s: scalar.keep("EqualTo", s, 40.0, 5.0), near("v"), "abs(v - 40) <= 5")
of_e("not_equal_to", lambda s: scalar.keep("NotEqualTo", s, 40.0, 5.0), near("v"), "abs(v - 40) > 5")
for _f, _o in (("GT", ">"), ("LT", "<"), ("GTE", ">="), ("LTE", "<=")):
    of_e(f"compare_{_f.lower()}", lambda s, f=_f: scalar.compare(f, s, 50.0), f"v {_o} 50")
    add(f"compare_sync_{_f.lower()}", lambda sp, d, f=_f: sync.compare(f, abc(sp, d)[:2]), f"WITH {AB_SQL} SELECT user_id, t, a.v {_o} b.v AS v FROM a JOIN b USING (user_id, t)")
for _f, _o in (("EQ", "<="), ("NEQ", ">")):
    of_e(f"compare_{_f.lower()}", lambda s, f=_f: scalar.compare(f, s, 50.0, 10.0), f"abs(v - 50) {_o} 10")
    add(f"compare_sync_{_f.lower()}", lambda sp, d, f=_f: sync.compare(f, abc(sp, d)[:2], 10.0), f"WITH {AB_SQL} SELECT user_id, t, abs(a.v - b.v) {_o} 10 AS v FROM a JOIN b USING (user_id, t)")
for _f, _w in (("SyncGreaterThan", "a.v > b.v AND a.v > c.v"), ("SyncLessThan", "a.v < b.v AND a.v < c.v"), ("SyncEqual", "abs(a.v - b.v) < 30 AND abs(a.v - c.v) < 30"), ("SyncNotEqual", "abs(a.v - b.v) >= 30 AND abs(a.v - c.v) >= 30")):
    _n = {"SyncGreaterThan": "sync_greater_than", "SyncLessThan": "sync_less_than", "SyncEqual": "sync_equal", "SyncNotEqual": "sync_not_equal"}[_f]
    add(_n, lambda sp, d, f=_f: sync.keep(f, abc(sp, d), 30.0), f"WITH {AB_SQL} SELECT user_id, t, {near('a.v')} AS v FROM a JOIN b USING (user_id, t) JOIN c USING (user_id, t) WHERE {_w}")
# --- logic, on three joined boolean signals
for _f, _x in (("And", "p AND q AND r"), ("Or", "p OR q OR r"), ("Xor", "(p <> q) <> r"), ("Nand", "NOT (p AND q AND r)"), ("Nor", "NOT (p OR q OR r)"), ("Xnor", "(p = q) = r"), ("Implication", "NOT (NOT p OR q) OR r")):
    add(f"logical_{_f.lower()}", lambda sp, d, f=_f: sync.logic(f"Logical{f}", [scalar.compare("GT", s, 20.0) for s in abc(sp, d)]),
        f"WITH {AB_SQL}, x AS (SELECT user_id, t, a.v > 20 AS p, b.v > 20 AS q, c.v > 20 AS r FROM a JOIN b USING (user_id, t) JOIN c USING (user_id, t)) SELECT user_id, t, {_x} AS v FROM x")


def _demux(sp: SparkSession, d: str) -> DataFrame:
    a, b, c = abc(sp, d)
    outs = sync.demultiplex(a, [scalar.compare("GT", b, 30.0), scalar.compare("LT", c, 0.0)])
    tables = [rounded(o).withColumn("port", F.lit(i + 1)) for i, o in enumerate(outs)]
    return tables[0].unionByName(tables[1])


add("demultiplexer", _demux, f"WITH {AB_SQL}, x AS (SELECT user_id, t, {near('a.v')} AS v, b.v > 30 AS p, c.v < 0 AS q FROM a JOIN b USING (user_id, t) JOIN c USING (user_id, t)) SELECT user_id, t, v, 1 AS port FROM x WHERE p UNION ALL SELECT user_id, t, v, 2 FROM x WHERE q")


def _mux(sp: SparkSession, d: str) -> Signal:
    a, b, c = abc(sp, d)
    return sync.multiplex([a, b], [scalar.compare("GT", b, 30.0), scalar.compare("LT", c, 0.0)])


add("multiplexer", _mux, f"WITH {AB_SQL}, x AS (SELECT user_id, t, b.v > 30 AS p, c.v < 0 AS q FROM b JOIN c USING (user_id, t)), y AS (SELECT x.user_id, x.t, CASE WHEN p THEN a.v ELSE b.v END AS v FROM x LEFT JOIN a USING (user_id, t) LEFT JOIN b USING (user_id, t) WHERE p <> q) SELECT user_id, t, {near('v')} AS v FROM y WHERE v IS NOT NULL")
# --- joins


def _join(sp: SparkSession, d: str) -> DataFrame:
    a, b, c = sync.join(abc(sp, d))
    return a.base.df.select("user_id", "t", F.round(a.v, 6).alias("a"), F.round(b.v, 6).alias("b"), (F.round(c.v, 6) + 0.0).alias("c"))


add("join", _join, f"WITH {AB_SQL} SELECT user_id, t, round(a.v, 6) AS a, round(b.v, 6) AS b, {near('c.v')} AS c FROM a JOIN b USING (user_id, t) JOIN c USING (user_id, t)")
# products have more decimals than a double can tell from a tie, so this one is compared to 2 digits
add("multiplication", lambda sp, d: rounded(sevenths(sync.arithmetic("Multiplication", abc(sp, d))), digits=2), f"WITH {AB_SQL} SELECT user_id, t, round(a.v * b.v * c.v / 7, 2) + 0.0 AS v FROM a JOIN b USING (user_id, t) JOIN c USING (user_id, t)")
for _f, _x, _w in (("Addition", "a.v + b.v + c.v", "true"), ("Subtraction", "a.v - b.v - c.v", "true"), ("Division", "a.v / b.v / c.v", "b.v <> 0 AND c.v <> 0")):
    add(_f.lower(), lambda sp, d, f=_f: sevenths(sync.arithmetic(f, abc(sp, d))), f"WITH {AB_SQL} SELECT user_id, t, {near(f'({_x}) / 7')} AS v FROM a JOIN b USING (user_id, t) JOIN c USING (user_id, t) WHERE {_w}")
add("linear", lambda sp, d: sync.linear(abc(sp, d), [0.5, -1.0, 2.0]), f"WITH {AB_SQL} SELECT user_id, t, {near('0.5 * a.v - b.v + 2 * c.v')} AS v FROM a JOIN b USING (user_id, t) JOIN c USING (user_id, t)")
add("variable_asof", lambda sp, d: timegrid.variable(abc(sp, d)[0], abc(sp, d)[1], -1.0), f"""WITH {AB_SQL}, m AS (SELECT user_id, max(t) AS m FROM a GROUP BY user_id)
SELECT b.user_id, b.t, {near('coalesce(a.v, -1)')} AS v FROM b ASOF LEFT JOIN a ON b.user_id = a.user_id AND b.t >= a.t JOIN m ON m.user_id = b.user_id WHERE b.t <= m.m""")


def _keyed(mode: str) -> Callable[[SparkSession, str], Signal]:
    def make(sp: SparkSession, d: str) -> Signal:
        e = events(sp, d)
        ups = e.where(F.col("event_type").isin("click", "view"))
        u = Signal.of(ups, "event_id", F.array((F.col("user_id") % 40).cast("double"), F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))))
        q = Signal.of(e.where(F.col("event_type").isin("view", "purchase")), "event_id", (F.col("user_id") * 3 % 40).cast("double"))
        return timegrid.keyed_variable(u, q, None, mode, -1.0)

    return make


_KEYED_SQL = """WITH u AS (SELECT event_id AS t, user_id % 40 AS k, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS x FROM events WHERE event_type IN ('click', 'view')),
q AS (SELECT event_id AS t, user_id * 3 % 40 AS k FROM events WHERE event_type IN ('view', 'purchase'))
SELECT q.t, {} AS v FROM q ASOF LEFT JOIN u ON q.k = u.k AND q.t >= u.t WHERE q.t <= (SELECT max(t) FROM u)"""
add("keyed_variable_exists", _keyed("exists"), _KEYED_SQL.format("u.x IS NOT NULL"))
add("keyed_variable_lookup", _keyed("lookup"), _KEYED_SQL.format(near("coalesce(u.x, -1)")))
# --- windows
N = 14
_FRAME = f"OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN {N - 1} PRECEDING AND CURRENT ROW)"
for _n, _m, _x in (
    ("moving_average", windows.moving_average, "avg(v)"), ("moving_sum", windows.moving_sum, "sum(v)"), ("standard_deviation", windows.standard_deviation, "stddev_samp(v)"),
    ("window_min", lambda s, n: windows.window_min_max(s, n, "min"), "min(v)"), ("window_max", lambda s, n: windows.window_min_max(s, n, "max"), "max(v)"),
):
    windowed(_n, lambda s, m=_m: m(s, N), f"{_x} {_FRAME}", f"rn >= {N}")
add("moving_key_count", lambda sp, d: windows.moving_key_count(scalar.vector_extract(vectors(sp, d), 1), 10), f"""WITH {V_SQL}, x AS (SELECT user_id, t, x1, list(x1) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS l FROM w)
SELECT user_id, t, CAST(len(list_filter(l, lambda y: y = x1)) AS DOUBLE) AS v FROM x""")
windowed("difference", windows.difference, "v - lag(v) OVER w", "rn > 1")
add("difference_oldest", lambda sp, d: windows.difference(signal(sp, d), False), f"WITH {E_SQL}, x AS (SELECT user_id, t, lead(v) OVER (PARTITION BY user_id ORDER BY t) - v AS v FROM e) SELECT user_id, t, {near('v')} AS v FROM x WHERE v IS NOT NULL")
add("peak_detector", lambda sp, d: windows.peaks(signal(sp, d), 5), f"""WITH {E_SQL}, x AS (SELECT user_id, t, v, max(v) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS l,
max(v) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS r, row_number() OVER (PARTITION BY user_id ORDER BY t) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM e)
SELECT user_id, t, {near('v')} AS v FROM x WHERE v > l AND v > r AND rn > 2 AND rn <= n - 2""")
windowed("fir", lambda s: windows.fir(s, [0.5, 0.3, 0.2]), "0.5 * v + 0.3 * lag(v, 1) OVER w + 0.2 * lag(v, 2) OVER w", "rn >= 3")
windowed("cumulative_sum", windows.cumulative_sum, "sum(v) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING)")
windowed("count", windows.count, "CAST(row_number() OVER w AS DOUBLE)")
windowed("count_boolean", lambda s: windows.count(scalar.compare("GT", s, 50.0)), "CAST(row_number() OVER w AS DOUBLE)")
windowed("min_tracker", lambda s: windows.tracker(s, "min"), "min(v) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING)")
windowed("max_tracker", lambda s: windows.tracker(s, "max"), "max(v) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING)")
add("filter_then_window", lambda sp, d: windows.moving_average(scalar.keep("GreaterThan", signal(sp, d), 30.0), 5), f"WITH {E_SQL}, x AS (SELECT user_id, t, avg(v) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS v, row_number() OVER (PARTITION BY user_id ORDER BY t) AS rn FROM e WHERE v > 30) SELECT user_id, t, {near('v')} AS v FROM x WHERE rn >= 5")


def _topk(sp: SparkSession, d: str) -> DataFrame:
    rows = windows.final_top(vectors(sp, d), 3, 0).df(extra=("t",))
    return rows.select("user_id", "t", F.col("seq").cast("long").alias("rank"), F.round(F.col("v")[0], 6).alias("v"))


add("topk_final", _topk, f"WITH {V_SQL}, x AS (SELECT user_id, t, x0, row_number() OVER (PARTITION BY user_id ORDER BY x0 DESC, t DESC) AS r FROM w) SELECT user_id, t, r AS rank, round(x0, 6) AS v FROM x WHERE r <= 3")


def _snapshots(sp: SparkSession, d: str) -> DataFrame:
    rows = folds.top_k(vectors(sp, d), 3, 0).df()
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("user_id", "t").orderBy("seq")).cast("long")
    return rows.select("user_id", "t", rank.alias("rank"), F.round(F.col("v")[0], 6).alias("v"))


add("topk_snapshot", _snapshots, f"""WITH {V_SQL}, x AS (SELECT a.user_id, a.t, b.x0, row_number() OVER (PARTITION BY a.user_id, a.t ORDER BY b.x0 DESC, b.t DESC) AS r FROM w a JOIN w b ON a.user_id = b.user_id AND b.t <= a.t)
SELECT user_id, t, r AS rank, round(x0, 6) AS v FROM x WHERE r <= 3""")
# --- segments and keys
_ISLANDS = f"""{V_SQL}, k AS (SELECT *, {{key}} AS k FROM w), g AS (SELECT *, CASE WHEN k <> lag(k) OVER (PARTITION BY user_id ORDER BY t) THEN 1 ELSE 0 END AS c FROM k),
s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS seg FROM g),
z AS (SELECT user_id, seg, min(t) AS t0, sum(x0) AS total, count(*) AS n, arg_min(x2, t) AS f2 FROM s GROUP BY user_id, seg),
o AS (SELECT user_id, lead(t0) OVER (PARTITION BY user_id ORDER BY seg) AS t, total, n, lead(f2) OVER (PARTITION BY user_id ORDER BY seg) AS nf FROM z)"""


def _day_pipeline(sp: SparkSession, d: str) -> Signal:
    s = signal(sp, d)
    return segments.pipeline([s], s.map(F.floor(F.col("t") / DAY).cast("double")), lambda own: [windows.cumulative_sum(own[0])])[0]


add("pipeline_day", _day_pipeline, f"WITH {_ISLANDS.format(key=f't // {DAY}')} SELECT user_id, t, {near('total')} AS v FROM o WHERE t IS NOT NULL")


def code(*words) -> list[float]:
    """Codes by name, numbers as they are."""
    return [float(CODES.index(w)) if isinstance(w, str) else float(w) for w in words]


_PARITY = code("INPUT", 1, "CONST", 0, "GT", "END")
add("pipeline_bytecode", lambda sp, d: segments.pipeline([vectors(sp, d)], None, lambda own: [windows.cumulative_sum(scalar.vector_extract(own[0], 0))], _PARITY, [2.0])[0],
    f"WITH {_ISLANDS.format(key='CASE WHEN x1 > 2 THEN 1 ELSE 0 END')} SELECT user_id, t, {near('total')} AS v FROM o WHERE t IS NOT NULL")
add("burst_aggregate", lambda sp, d: segments.burst_aggregate(vectors(sp, d), code("INPUT", 0, "CUMSUM", 0, "END", "COUNT", 2, "END"), (), _PARITY, [2.0], [2], 2),
    f"WITH {_ISLANDS.format(key='CASE WHEN x1 > 2 THEN 1 ELSE 0 END')} SELECT user_id, t, nf AS k, {near('total')} AS total, CAST(n AS DOUBLE) AS n FROM o WHERE t IS NOT NULL", "k", "total", "n")
add("keyed_sum", lambda sp, d: segments.keyed_pipeline(vectors(sp, d), lambda s: windows.cumulative_sum(scalar.vector_extract(s, 0)), 1), f"WITH {V_SQL} SELECT user_id, t, x1 AS k, {near('sum(x0) OVER (PARTITION BY user_id, x1 ORDER BY t ROWS UNBOUNDED PRECEDING)')} AS v FROM w", "k", "v")
add("keyed_computed", lambda sp, d: segments.keyed_pipeline(vectors(sp, d, ()), lambda s: windows.count(scalar.vector_extract(s, 0)), None, [1, 2]), f"WITH {V_SQL} SELECT t, CAST(count(*) OVER (PARTITION BY x1, x2 ORDER BY t ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS v FROM w", "v")
add("new_keys", lambda sp, d: segments.new_keys(vectors(sp, d), 1), f"WITH {V_SQL} SELECT user_id, min(t) AS t, x1 AS v FROM w GROUP BY user_id, x1")
# --- grids
HOUR = 3_600_000_000
_GRID = f"WITH {E_SQL}, p AS (SELECT user_id, t, v, lag(t) OVER w AS pt, lag(v) OVER w AS pv, first_value(t) OVER w AS t1 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t))"
add("resampler_constant", lambda sp, d: timegrid.resample_constant(signal(sp, d), 24 * HOUR), f"""{_GRID}, g AS (SELECT user_id, t, v, pv, t1 + unnest(range((pt - t1) // {DAY} + 1, (t - t1) // {DAY} + 1)) * {DAY} AS g FROM p WHERE pt IS NOT NULL)
SELECT user_id, g AS t, {near('CASE WHEN g = t THEN v ELSE pv END')} AS v FROM g""")
add("resampler_constant_t0", lambda sp, d: timegrid.resample_constant(signal(sp, d), 24 * HOUR, 5 * HOUR), f"""{_GRID}, g AS (SELECT user_id, t, v, pv, {5 * HOUR} + unnest(range((pt - {5 * HOUR}) // {DAY} + 1, (t - {5 * HOUR}) // {DAY} + 1)) * {DAY} AS g FROM p WHERE pt IS NOT NULL)
SELECT user_id, g AS t, {near('CASE WHEN g = t THEN v ELSE pv END')} AS v FROM g""")
add("resampler_constant_snap", lambda sp, d: timegrid.resample_constant(signal(sp, d), 24 * HOUR, 0, True), f"""{_GRID}, g AS (SELECT user_id, v, unnest(range(CASE WHEN pt IS NULL THEN t // {DAY} ELSE pt // {DAY} + 1 END, t // {DAY} + 1)) * {DAY} AS g FROM p)
SELECT user_id, g AS t, {near('v')} AS v FROM g""")
add("resampler_hermite", lambda sp, d: timegrid.resample_hermite(signal(sp, d), 24 * HOUR), f"""WITH {E_SQL}, p AS (SELECT user_id, lag(v, 2) OVER w AS p0, lag(t) OVER w AS t1, lag(v) OVER w AS p1, t AS t2, v AS p2, lead(v) OVER w AS p3, row_number() OVER w AS n, nth_value(t, 2) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS o
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
g AS (SELECT *, o + unnest(range(CASE WHEN n = 3 THEN 0 ELSE (t1 - o) // {DAY} + 1 END, (t2 - o) // {DAY} + 1)) * {DAY} AS g FROM p WHERE n >= 3 AND p3 IS NOT NULL),
h AS (SELECT *, CAST(g - t1 AS DOUBLE) / CAST(t2 - t1 AS DOUBLE) AS u FROM g)
SELECT user_id, g AS t, {near('(2*u*u*u - 3*u*u + 1) * p1 + (u*u*u - 2*u*u + u) * (p2 - p0) / 2 + (u*u*u - u*u) * (p3 - p1) / 2 + (-2*u*u*u + 3*u*u) * p2')} AS v FROM h""")
# --- fused programs
add("fused_arithmetic", lambda sp, d: bytecode.fused(vectors(sp, d), code("INPUT", 0, "CONST", 0, "MUL", "INPUT", 1, "ADD", "END", "INPUT", 0, "INPUT", 1, "CONST", 1, "ADD", "DIV", "SQRT", "END"), 2, [2.5, 1.0]),
    f"WITH {V_SQL} SELECT user_id, t, {near('x0 * 2.5 + x1')} AS a, {near('sqrt(x0 / (x1 + 1))')} AS b FROM w", "a", "b")
add("fused_expression_ports", lambda sp, d: bytecode.fused(sync.compose(abc(sp, d)), code("INPUT", 0, "INPUT", 1, "SUB", "ABS", "INPUT", 2, "GT", "END"), 1), f"WITH {AB_SQL} SELECT user_id, t, CASE WHEN abs(a.v - b.v) > c.v THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM a JOIN b USING (user_id, t) JOIN c USING (user_id, t)", "v")
add("fused_running_average", lambda sp, d: bytecode.fused(vectors(sp, d), code("INPUT", 0, "CUMSUM", 0, "COUNT", 2, "DIV", "CONST", 0, "DIV", "END", "STATE_LOAD", 0, "END"), 2, [7.0]), f"WITH {V_SQL}, x AS (SELECT user_id, t, sum(x0) OVER w2 AS s, count(*) OVER w2 AS n FROM w WINDOW w2 AS (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING)) SELECT user_id, t, {near('s / n / 7')} AS a, {near('s')} AS s FROM x", "a", "s")
add("fused_moving_gate", lambda sp, d: bytecode.fused(vectors(sp, d), code("INPUT", 0, "CONST", 0, "GT", "GATE", "INPUT", 0, "MA_UPDATE", 5, "END", "INPUT", 0, "STD_UPDATE", 5, "END"), 2, [30.0]),
    f"WITH {V_SQL}, x AS (SELECT user_id, t, x0, avg(x0) OVER f AS a, stddev_samp(x0) OVER f AS b, row_number() OVER (PARTITION BY user_id ORDER BY t) AS rn FROM w WINDOW f AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT user_id, t, {near('a')} AS a, {near('b')} AS b FROM x WHERE rn >= 5 AND x0 > 30", "a", "b")
add("fused_extremes", lambda sp, d: bytecode.fused(vectors(sp, d), code("INPUT", 0, "WIN_MIN", 4, "END", "INPUT", 0, "WIN_MAX", 4, "END", "INPUT", 0, "MAX_AGG", 0, "INPUT", 0, "MIN_AGG", 1, "SUB", "END", "INPUT", 0, "MSUM_UPDATE", 4, "END"), 4),
    f"WITH {V_SQL}, x AS (SELECT user_id, t, min(x0) OVER f AS a, max(x0) OVER f AS b, max(x0) OVER r - min(x0) OVER r AS c, sum(x0) OVER f AS d, row_number() OVER (PARTITION BY user_id ORDER BY t) AS rn FROM w WINDOW f AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), r AS (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING)) SELECT user_id, t, {near('a')} AS a, {near('b')} AS b, {near('c')} AS c, {near('d')} AS d FROM x WHERE rn >= 4", "a", "b", "c", "d")
add("fused_changes", lambda sp, d: bytecode.fused(vectors(sp, d), code("INPUT", 0, "DIFF", 0, "END", "INPUT", 0, "SIGN_CHANGE", 2, "END", "INPUT", 0, "FIR_UPDATE", 0, 3, "END"), 3, (), [0.5, 0.25, 0.25]),
    f"WITH {V_SQL}, x AS (SELECT user_id, t, x0 - lag(x0) OVER w2 AS a, 0.5 * x0 + 0.25 * lag(x0) OVER w2 + 0.25 * lag(x0, 2) OVER w2 AS c, row_number() OVER w2 AS rn FROM w WINDOW w2 AS (PARTITION BY user_id ORDER BY t)) SELECT user_id, t, {near('a')} AS a, CAST(sign(a) AS DOUBLE) + 0.0 AS b, {near('c')} AS c FROM x WHERE rn >= 3", "a", "b", "c")
# --- folds
_STEP = f"{V_SQL}, n AS (SELECT user_id, t, x0, row_number() OVER (PARTITION BY user_id ORDER BY t) AS rn FROM w)"
add("iir", lambda sp, d: folds.iir(signal(sp, d), [0.4, 0.2], [-0.5]), f"""WITH RECURSIVE {_STEP}, p AS (SELECT *, lag(x0) OVER (PARTITION BY user_id ORDER BY t) AS x1 FROM n),
y AS (SELECT user_id, rn, t, 0.4 * x0 + 0.2 * x1 AS y FROM p WHERE rn = 2 UNION ALL SELECT p.user_id, p.rn, p.t, 0.4 * p.x0 + 0.2 * p.x1 + 0.5 * y.y FROM y JOIN p ON p.user_id = y.user_id AND p.rn = y.rn + 1)
SELECT user_id, t, {near('y')} AS v FROM y""")
add("rsi", lambda sp, d: folds.rsi(signal(sp, d), 5), f"""WITH RECURSIVE {_STEP}, p AS (SELECT *, x0 - lag(x0) OVER (PARTITION BY user_id ORDER BY t) AS dx FROM n),
f AS (SELECT user_id, sum(greatest(dx, 0)) / 5 AS g, sum(greatest(-dx, 0)) / 5 AS l FROM p WHERE rn BETWEEN 2 AND 6 GROUP BY user_id HAVING count(*) = 5),
y AS (SELECT p.user_id, p.rn, p.t, f.g, f.l FROM f JOIN p ON p.user_id = f.user_id AND p.rn = 6
UNION ALL SELECT p.user_id, p.rn, p.t, (y.g * 4 + greatest(p.dx, 0)) / 5, (y.l * 4 + greatest(-p.dx, 0)) / 5 FROM y JOIN p ON p.user_id = y.user_id AND p.rn = y.rn + 1)
SELECT user_id, t, {near('CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) ELSE 100 END')} AS v FROM y""")
TRIGGER = {
    "id": "trigger", "type": "TriggerSet", "input_port_type": "number", "output_port_type": "number", "entryOperator": "sum", "outputOperator": {"id": "big", "port": "o1"},
    "operators": [{"id": "sum", "type": "CumulativeSum"}, {"id": "big", "type": "GreaterThan", "value": 300.0}], "connections": [{"from": "sum", "to": "big"}],
}
add("trigger_set", lambda sp, d: folds.single(TRIGGER | {"id": "op"}, [signal(sp, d)]), f"""WITH RECURSIVE {_STEP},
y AS (SELECT user_id, rn, t, x0 AS s FROM n WHERE rn = 1 UNION ALL SELECT n.user_id, n.rn, n.t, CASE WHEN y.s > 300 THEN n.x0 ELSE y.s + n.x0 END FROM y JOIN n ON n.user_id = y.user_id AND n.rn = y.rn + 1)
SELECT user_id, t, {near('s')} AS v FROM y WHERE s > 300""")
#: y(t) = x(t) + 0.5 y of before, spelled as a cycle of operators: the sum is scaled and comes back at the next message.
FEEDBACK = {
    "entryOperator": "in", "output": {"sum": ["o1"]},
    "operators": [{"id": "in", "type": "Input", "portTypes": ["number"]}, {"id": "n", "type": "CountNumber"}, {"id": "sum", "type": "Addition", "numPorts": 2}, {"id": "half", "type": "Scale", "value": 0.5}, {"id": "next", "type": "TimeShift", "shift": 1},
                  {"id": "first", "type": "LessThan", "value": 1.5}, {"id": "zero", "type": "ConstantNumber", "value": 0.0}],
    "connections": [{"from": "in", "to": "n"}, {"from": "n", "to": "first"}, {"from": "first", "to": "zero"}, {"from": "zero", "to": "sum", "toPort": "i2"}, {"from": "in", "to": "sum", "toPort": "i1"},
                    {"from": "sum", "to": "half"}, {"from": "half", "to": "next"}, {"from": "next", "to": "sum", "toPort": "i2"}],
}


def _feedback(sp: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = events(sp, d).withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts")))
    (out,) = compile_program(FEEDBACK, [Signal.of(e, "n", "value", KEYS)]).values()
    return rounded(sevenths(out))


add("feedback_cycle", _feedback, f"""WITH RECURSIVE {_STEP}, y AS (SELECT user_id, rn, x0 AS y FROM n WHERE rn = 1 UNION ALL SELECT n.user_id, n.rn, n.x0 + 0.5 * y.y FROM y JOIN n ON n.user_id = y.user_id AND n.rn = y.rn + 1)
SELECT user_id, rn AS t, {near('y / 7')} AS v FROM y""")


def _double_big(state: dict, port: int, t: int, v):
    state["n"] = state.get("n", 0) + 1
    return [(0, t, 2 * v)] if v > 50 and state["n"] > 1 else []


add("udf_operator", lambda sp, d: folds.udf_operator([signal(sp, d)], _double_big)[0], f"WITH {E_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) AS rn FROM e) SELECT user_id, t, {near('2 * v')} AS v FROM x WHERE v > 50 AND rn > 1")
# --- whole programs
BOLLINGER = {
    "title": "Bollinger bands", "apiVersion": "v1", "entryOperator": "in", "output": {"out": ["o1", "o2", "o3"]},
    "prototypes": {"Band": {"parameters": [{"name": "n", "type": "number"}, {"name": "k", "type": "number", "default": 2}], "entry": {"operator": "sd"}, "output": {"operator": "wide"},
                            "operators": [{"id": "sd", "type": "StandardDeviation", "window_size": "${n}"}, {"id": "wide", "type": "Scale", "value": "${k}"}], "connections": [{"from": "sd", "to": "wide"}]}},
    "operators": [{"id": "in", "type": "Input", "portTypes": ["number"]}, {"id": "ma", "type": "MovingAverage", "window_size": 14}, {"id": "band", "prototype": "Band", "parameters": {"n": 14}}, {"id": "up", "type": "Addition"}, {"id": "low", "type": "Subtraction"},
                  {"id": "out", "type": "Output", "portTypes": ["number", "number", "number"]}],
    "connections": [{"from": "in", "to": "ma"}, {"from": "in", "to": "band"}, {"from": "ma", "to": "up", "toPort": "i1"}, {"from": "band", "to": "up", "toPort": "i2"}, {"from": "ma", "to": "low", "toPort": "i1"}, {"from": "band", "to": "low", "toPort": "i2"},
                    {"from": "low", "to": "out", "toPort": "i1"}, {"from": "up", "to": "out", "toPort": "i2"}, {"from": "ma", "to": "out", "toPort": "i3"}],
}


def bollinger(sp: SparkSession, d: str) -> DataFrame:
    """The flagship: a JSON program with a prototype, compiled to one shuffle, one sort and one window."""
    low, up, mid = synced(list(compile_program(json.dumps(BOLLINGER), [signal(sp, d)]).values()))
    rows = low.base.df.where(low.valid)
    return rows.select("user_id", "t", F.round(low.v, 6).alias("low"), F.round(mid.v, 6).alias("mid"), F.round(up.v, 6).alias("up"))


add("bollinger", bollinger, f"WITH {E_SQL}, x AS (SELECT user_id, t, avg(v) {_FRAME} AS m, stddev_samp(v) {_FRAME} AS s, row_number() OVER (PARTITION BY user_id ORDER BY t) AS rn FROM e) SELECT user_id, t, round(m - 2 * s, 6) AS low, round(m, 6) AS mid, round(m + 2 * s, 6) AS up FROM x WHERE rn >= {N}")


def ppg(sp: SparkSession, d: str) -> DataFrame:
    """Peaks of a signal above its long average."""
    s = signal(sp, d)
    short, long = windows.moving_average(s, 3), windows.moving_average(s, 12)
    above = sync.arithmetic("Subtraction", [short, long])
    return rounded(windows.peaks(above, 7))


add("ppg_peaks", ppg, f"""WITH {E_SQL}, a AS (SELECT user_id, t, avg(v) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) - avg(v) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS v, row_number() OVER (PARTITION BY user_id ORDER BY t) AS rn FROM e),
b AS (SELECT user_id, t, v, max(v) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS l, max(v) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS r, row_number() OVER (PARTITION BY user_id ORDER BY t) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM a WHERE rn >= 12)
SELECT user_id, t, {near('v')} AS v FROM b WHERE v > l AND v > r AND k > 3 AND k <= n - 3""")


# --- operators by JSON, against the same SQL as above


def graph(operator: dict, port_types: list[str], wires: list[tuple[str, str]], outputs: list[str]) -> dict:
    """A program of an input and one operator; ``wires`` are (output of the input, port of the operator)."""
    return {
        "entryOperator": "in",
        "operators": [{"id": "in", "type": "Input", "portTypes": port_types}, {"id": "op", **operator}],
        "connections": [{"from": "in", "fromPort": o, "to": "op", "toPort": p} for o, p in wires],
        "output": {"op": outputs},
    }


def by_json(name: str, operator: dict, of: Callable[[SparkSession, str], list[Signal]], port_types: list[str], wires: list[tuple[str, str]], sql: str, *names: str, finish: Callable[[Signal], Signal] = lambda s: s) -> None:
    """A query of a program with one operator."""
    def make(sp: SparkSession, d: str) -> Signal:
        (out,) = compile_program(json.dumps(graph(operator, port_types, wires, ["o1"])), of(sp, d)).values()
        return finish(out)

    add(name, make, sql, *names)


_THREE = ["number"] * 3
_DATA = [("o1", "i1"), ("o2", "i2"), ("o3", "i3")]
by_json("program_linear", {"type": "Linear", "coefficients": [0.5, -1.0, 2.0]}, abc, _THREE, _DATA, _SQL["linear"])
by_json("program_division", {"type": "Division", "numPorts": 3}, abc, _THREE, _DATA, _SQL["division"], finish=sevenths)
by_json("program_sync_greater_than", {"type": "SyncGreaterThan", "numPorts": 3}, abc, _THREE, _DATA, _SQL["sync_greater_than"])
by_json("program_vector_compose", {"type": "VectorCompose", "numPorts": 3}, abc, _THREE, _DATA, _SQL["vector_compose"], "a", "b", "c")
by_json("program_compare_sync", {"type": "CompareSyncEQ", "tolerance": 10.0}, lambda sp, d: abc(sp, d)[:2], _THREE[:2], _DATA[:2], _SQL["compare_sync_eq"])
by_json("program_variable", {"type": "Variable", "default_value": -1.0}, lambda sp, d: abc(sp, d)[:2], _THREE[:2], [("o1", "i1"), ("o2", "c1")], _SQL["variable_asof"])


def flags(sp: SparkSession, d: str) -> list[Signal]:
    return [scalar.compare("GT", s, 20.0) for s in abc(sp, d)]


for _f in ("And", "Or", "Xor", "Nand", "Nor", "Xnor", "Implication"):
    by_json(f"program_logical_{_f.lower()}", {"type": f"Logical{_f}", "numPorts": 3}, flags, ["boolean"] * 3, _DATA, _SQL[f"logical_{_f.lower()}"])


def routes(sp: SparkSession, d: str) -> list[Signal]:
    a, b, c = abc(sp, d)
    return [a, b, scalar.compare("GT", b, 30.0), scalar.compare("LT", c, 0.0)]


_ROUTED = ["number", "number", "boolean", "boolean"]


def _program_demux(sp: SparkSession, d: str) -> DataFrame:
    program = graph({"type": "Demultiplexer", "numPorts": 2}, _ROUTED, [("o1", "i1"), ("o3", "c1"), ("o4", "c2")], ["o1", "o2"])
    outs = compile_program(program, routes(sp, d)).values()
    first, second = [rounded(o).withColumn("port", F.lit(i + 1)) for i, o in enumerate(outs)]
    return first.unionByName(second)


add("program_demultiplexer", _program_demux, _SQL["demultiplexer"])
by_json("program_multiplexer", {"type": "Multiplexer", "numPorts": 2}, routes, _ROUTED, [("o1", "i1"), ("o2", "i2"), ("o3", "c1"), ("o4", "c2")], _SQL["multiplexer"])


def lookups(sp: SparkSession, d: str) -> list[Signal]:
    """A changelog, queries and a heartbeat that goes on after the changelog's end."""
    e = events(sp, d)
    key = (F.col("user_id") % 40).cast("double")
    value = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    changes = e.where(F.col("event_type").isin("click", "view") & (F.col("event_id") % 4 != 3) & (F.col("event_id") < 500))
    asked = e.where(F.col("event_type").isin("view", "purchase"))
    beats = e.where((F.col("event_type") == "error") & (F.col("event_id") < 900))
    return [Signal.of(changes, "event_id", F.array(key, value)), Signal.of(asked, "event_id", (F.col("user_id") * 3 % 40).cast("double")), Signal.of(beats, "event_id", "value")]


by_json("program_keyed_variable_heartbeat", {"type": "KeyedVariable", "mode": "lookup", "default_value": -1.0}, lookups, ["vector_number", "number", "number"], [("o1", "i1"), ("o2", "c1"), ("o3", "c2")],
    f"""WITH u AS (SELECT event_id AS t, user_id % 40 AS k, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS x FROM events WHERE event_type IN ('click', 'view') AND event_id % 4 <> 3 AND event_id < 500),
q AS (SELECT event_id AS t, user_id * 3 % 40 AS k FROM events WHERE event_type IN ('view', 'purchase')), m AS (SELECT max(t) AS m FROM (SELECT t FROM u UNION ALL SELECT event_id FROM events WHERE event_type = 'error' AND event_id < 900))
SELECT q.t, {near('coalesce(u.x, -1)')} AS v FROM q ASOF LEFT JOIN u ON q.k = u.k AND q.t >= u.t WHERE q.t <= (SELECT m FROM m)""")
by_json("program_fused_ports", {"type": "FusedExpression", "numPorts": 3, "numOutputs": 1, "bytecode": code("INPUT", 0, "INPUT", 1, "SUB", "ABS", "INPUT", 2, "GT", "END")}, abc, _THREE, _DATA, _SQL["fused_expression_ports"], "v")
by_json("program_burst", {"type": "BurstAggregate", "aggBytecode": code("INPUT", 0, "CUMSUM", 0, "END", "COUNT", 2, "END"), "segBytecode": _PARITY, "segConstants": [2.0], "keyColumns": [2], "numAggOutputs": 2}, lambda sp, d: [vectors(sp, d)],
    ["vector_number"], [("o1", "i1")], _SQL["burst_aggregate"], "k", "total", "n")
_SUM_OF_FIRST = {"operators": [{"id": "x", "type": "VectorExtract", "index": 0}, {"id": "s", "type": "CumulativeSum"}], "connections": [{"from": "x", "to": "s"}]}
by_json("program_keyed", {"type": "KeyedPipeline", "key_index": 1, "prototype": {**_SUM_OF_FIRST, "entry": {"operator": "x"}, "output": {"operator": "s"}}}, lambda sp, d: [vectors(sp, d)], ["vector_number"], [("o1", "i1")], _SQL["keyed_sum"], "k", "v")
by_json("program_pipeline", {"type": "Pipeline", "input_port_types": ["vector_number"], "output_port_types": ["number"], "segmentBytecode": _PARITY, "segmentConstants": [2.0], "entryOperator": "x", "outputMappings": {"s": {"o1": "o1"}}, **_SUM_OF_FIRST},
    lambda sp, d: [vectors(sp, d)], ["vector_number"], [("o1", "i1")], _SQL["pipeline_bytecode"])


def _late_rows(sp: SparkSession, d: str) -> Signal:
    """Rows in another order than that of time, one in seven twice: the input drops what is late or repeated, then messages are counted."""
    e = events(sp, d).select("user_id", "event_id", micros("ts").alias("t"), F.col("value").alias("v"))
    rows = e.withColumn("n", F.lit(0)).unionByName(e.where("event_id % 7 = 0").withColumn("n", F.lit(1)))
    arrival = (F.col("event_id") * 7919 % 10007 * 1_000_000 + F.col("event_id")) * 2 + F.col("n")
    s = Signal.of(rows, "t", "v", KEYS, arrival=arrival)
    (out,) = compile_program(graph({"type": "CountNumber"}, ["number"], [("o1", "i1")], ["o1"]), [s]).values()
    return out


add("program_late_rows", _late_rows, f"""WITH {E_SQL}, r AS (SELECT *, 0 AS n FROM e UNION ALL SELECT *, 1 FROM e WHERE event_id % 7 = 0), s AS (SELECT *, (event_id * 7919 % 10007 * 1000000 + event_id) * 2 + n AS seq FROM r),
m AS (SELECT *, max(t) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM s)
SELECT user_id, t, CAST(row_number() OVER (PARTITION BY user_id ORDER BY t) AS DOUBLE) AS v FROM m WHERE p IS NULL OR t > p""")


def _cycle_in_segments(sp: SparkSession, d: str) -> Signal:
    """The feedback cycle inside a Pipeline: it starts anew with every ten messages."""
    from pyspark.sql import Window

    e = events(sp, d).withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts")))
    body = {"operators": FEEDBACK["operators"], "connections": FEEDBACK["connections"], "entryOperator": "in", "outputMappings": {"sum": {"o1": "o1"}}}
    program = graph({"type": "Pipeline", "input_port_types": ["number"], "output_port_types": ["number"], **body}, ["number", "number"], [("o1", "i1"), ("o2", "c1")], ["o1"])
    s = Signal.of(e, "n", "value", KEYS)
    (out,) = compile_program(program, [s, s.map(F.floor((F.col("t") - 1) / 10).cast("double"))]).values()
    return sevenths(out)


add("pipeline_cycle", _cycle_in_segments, f"""WITH RECURSIVE {_STEP}, k AS (SELECT user_id, rn, x0, (rn - 1) // 10 AS seg, (rn - 1) % 10 AS i FROM n),
y AS (SELECT user_id, seg, i, x0 AS y FROM k WHERE i = 0 UNION ALL SELECT k.user_id, k.seg, k.i, k.x0 + 0.5 * y.y FROM y JOIN k ON k.user_id = y.user_id AND k.seg = y.seg AND k.i = y.i + 1)
SELECT y.user_id, n.rn AS t, {near('y / 7')} AS v FROM y JOIN n ON n.user_id = y.user_id AND n.rn = (y.seg + 1) * 10 + 1 WHERE y.i = 9""")

# --- the rest of the fused codes
_HUNDREDTH = ("INPUT", 0, "CONST", 0, "MUL")
_LESS_50 = ("INPUT", 0, "CONST", 1, "SUB")
_PLUS_1 = ("INPUT", 0, "CONST", 2, "ADD")
add("fused_functions", lambda sp, d: bytecode.fused(vectors(sp, d), code("INPUT", 0, "CONST", 3, "POW", "END", *_PLUS_1, "LOG", "END", *_PLUS_1, "LOG10", "END", *_HUNDREDTH, "EXP", "END", *_HUNDREDTH, "SIN", "END", *_HUNDREDTH, "COS", "END", *_HUNDREDTH, "TAN", "END"), 7, [0.01, 50.0, 1.0, 0.5]),
    f"WITH {V_SQL} SELECT user_id, t, {near('pow(x0, 0.5)')} AS a, {near('ln(x0 + 1)')} AS b, {near('log10(x0 + 1)')} AS c, {near('exp(x0 * 0.01)')} AS d, {near('sin(x0 * 0.01)')} AS e, {near('cos(x0 * 0.01)')} AS f, {near('tan(x0 * 0.01)')} AS g FROM w", *"abcdefg")
add("fused_rounding", lambda sp, d: bytecode.fused(vectors(sp, d), code(*_LESS_50, "SIGN", "END", *_LESS_50, "FLOOR", "END", *_LESS_50, "CEIL", "END", *_LESS_50, "ROUND", "END", *_LESS_50, "NEG", "END"), 5, [0.01, 50.0]),
    f"WITH {V_SQL} SELECT user_id, t, CAST(sign(x0 - 50) AS DOUBLE) + 0.0 AS a, floor(x0 - 50) + 0.0 AS b, ceil(x0 - 50) + 0.0 AS c, round(x0 - 50) + 0.0 AS d, {near('50 - x0')} AS e FROM w", *"abcde")
_TWO = ("INPUT", 1, "CONST", 0)
add("fused_logic", lambda sp, d: bytecode.fused(vectors(sp, d), code(*_TWO, "GTE", "END", *_TWO, "LT", "END", *_TWO, "LTE", "END", *_TWO, "EQ", "END", *_TWO, "NEQ", "END", "INPUT", 1, "INPUT", 2, "AND", "END", "INPUT", 1, "INPUT", 2, "OR", "END", "INPUT", 1, "NOT", "END"), 8, [2.0]),
    "WITH " + V_SQL + " SELECT user_id, t, " + ", ".join(f"CASE WHEN {x} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {n}" for n, x in zip("abcdefgh", ("x1 >= 2", "x1 < 2", "x1 <= 2", "x1 = 2", "x1 <> 2", "x1 <> 0 AND x2 <> 0", "x1 <> 0 OR x2 <> 0", "x1 = 0"), strict=True)) + " FROM w", *"abcdefgh")
by_json("fused_iir", {"type": "FusedExpressionVector", "numOutputs": 1, "bytecode": code("INPUT", 0, "IIR_UPDATE", 2, 1, 0, "END"), "coefficients": [0.4, 0.2, -0.5]}, lambda sp, d: [vectors(sp, d)], ["vector_number"], [("o1", "i1")], _SQL["iir"], "v")


def _run_table(sp: SparkSession, d: str) -> DataFrame:
    """A program over a wide table, one result row for each of its rows."""
    program = Program().add_operator("in", "Input", portTypes=["number", "number"]).add_operator("m", "MovingSum", window_size=3).add_operator("x", "Subtraction")
    program = program.connect("in", "m", "o1", "i1").connect("in", "x", "o1", "i1").connect("in", "x", "o2", "i2").add_output("m").add_output("x")
    wide = events(sp, d).select(F.col("event_id").alias("time"), F.when(F.col("event_type") != "error", F.col("value")).alias("a"), (F.col("user_id") % 10).cast("double").alias("b"))
    out = Run(program, wide, {"a": "i1", "b": "i2"}).exec({"m:o1": "total", "x:o1": "rest"})
    return out.select("time", F.round("total", 6).alias("total"), F.round("rest", 6).alias("rest"))


add("run_table", _run_table, """WITH a AS (SELECT event_id AS time, value AS a FROM events WHERE event_type <> 'error'),
m AS (SELECT time, sum(a) OVER (ORDER BY time ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS total, row_number() OVER (ORDER BY time) AS rn FROM a)
SELECT e.event_id AS time, CASE WHEN m.rn >= 3 THEN round(m.total, 6) END AS total, round(a.a - e.user_id % 10, 6) AS rest FROM events e LEFT JOIN m ON m.time = e.event_id LEFT JOIN a ON a.time = e.event_id""")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


__all__ = ["bollinger", "oracle_sql", "queries"]
