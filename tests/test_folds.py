"""Folds: what their rows hold, how they are dealt, and that a machine taken up again is a fresh one."""

import random

import pytest
from pyspark.sql import functions as F

from sigloom.operators.folds import fold, tagged, udf_operator, wide
from sigloom.plans.interpreter import Machine
from sigloom.plans.program import compile_program, load
from sigloom.plans.signal import Base, Signal
from sigloom.queries import FEEDBACK, TRIGGER, queries

#: y(t) = x(t) + 0.5 y of before within each segment, of the first of a vector, or with a filter ahead.
BODY = {"operators": FEEDBACK["operators"], "connections": FEEDBACK["connections"], "entryOperator": "in", "outputMappings": {"sum": {"o1": "o1"}}}


def cycles(kind="number", over=None):
    """The feedback cycle in a Pipeline with a control port; ``over``: only data above it come to it."""
    body = dict(BODY)
    if kind == "vector_number":
        own = [{"id": "x", "type": "VectorExtract", "index": 1}, *BODY["operators"]]
        body |= {"operators": own, "connections": [{"from": "x", "to": "in"}, *BODY["connections"]], "entryOperator": "x"}
    operators = [{"id": "i", "type": "Input", "portTypes": [kind, "number"]}, {"id": "p", "type": "Pipeline", "input_port_types": [kind], "output_port_types": ["number"], **body}]
    wires = [{"from": "i", "fromPort": "o2", "to": "p", "toPort": "c1"}]
    if over is None:
        wires.append({"from": "i", "to": "p", "toPort": "i1"})
    else:
        operators.append({"id": "f", "type": "GreaterThan", "value": over})
        wires += [{"from": "i", "to": "f"}, {"from": "f", "to": "p", "toPort": "i1"}]
    return {"entryOperator": "i", "output": {"p": ["o1"]}, "operators": operators, "connections": wires}


def walk(n, vector=False):
    rng, rows = random.Random(3), []
    for k in (1, 2, 3):
        for t in range(1, n + 1):
            x = round(rng.gauss(10, 5), 2)
            rows.append((k, t, [0.0, x] if vector else x, float((t - 1) // 7)))
    return rows


@pytest.mark.parametrize("kind, over, apart", [("number", None, False), ("number", 9.0, False), ("number", 9.0, True), ("vector_number", None, False), ("vector_number", None, True)])
def test_cycles_in_segments_equal_the_interpreter(spark, kind, over, apart):
    rows = walk(60, kind == "vector_number")
    df = spark.createDataFrame(rows, f"k long, t long, v {'array<double>' if kind == 'vector_number' else 'double'}, c double")
    data = Signal(Base(df, ("k",)), "v")
    control = Signal.of(df, v="c", keys=("k",)) if apart else data.map(F.col("c"))
    program, want = cycles(kind, over), []
    (out,) = compile_program(program, [data, control]).values()
    for k in (1, 2, 3):
        machine = load(program).machine()
        want += [(k, u, y) for key, t, v, c in rows if key == k for m in ((0, t, v), (1, t, c)) for _, u, y in machine.push([m])]
    assert sorted((r["k"], r["t"], r["v"]) for r in out.df().collect()) == want and len(want) > 10


def test_rows_hold_no_columns_of_other_types(spark):
    # a list column of nulls made writing a batch quadratic in its rows
    numbers = Signal.of(spark.createDataFrame([(1, 1.0), (2, 2.0)], "t long, v double"))
    vectors = Signal.of(spark.createDataFrame([(1, [1.0]), (3, [])], "t long, v array<double>"))
    assert tagged([numbers]).columns == ["t", "seq", "p", "num"]
    mixed = tagged([numbers, vectors])
    assert mixed.columns == ["t", "seq", "p", "num", "vec"] and mixed.where("vec is null").count() == 0
    out = udf_operator([numbers, vectors], lambda state, p, t, v: [(p, t, v)], ["number", "vector_number"])
    assert [r["v"] for r in out[0].df().orderBy("t").collect()] == [1.0, 2.0] and [r["v"] for r in out[1].df().orderBy("t").collect()] == [[1.0], []]


def test_ports_of_one_base_share_rows(spark):
    base = Base(spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "t long, v double"), strict=True)
    s = Signal(base, "v")
    assert wide([s, s.map(F.col("t").cast("double"))]).count() == 3
    (out,) = udf_operator([s.where(F.col("t") > 1), s.where(F.col("t") < 3)], lambda state, p, t, v: [(0, 10 * t + p, v)])
    got = [(r["t"], r["v"]) for r in out.df().orderBy("seq").collect()]
    assert [t for t, _ in got] == [11, 20, 21, 30]
    assert got[0][1] == 1.0 and got[1][1] != got[1][1] and got[-1][1] == 3.0
    # rows of equal times keep the order by port, so they are not put together
    twice = Base(spark.createDataFrame([(1, 1.0), (1, 2.0)], "t long, v double"))
    (out,) = udf_operator([Signal(twice, "v"), Signal(twice, "v")], lambda state, p, t, v: [(0, t, float(p))])
    assert [r["v"] for r in out.df().orderBy("seq").collect()] == [0.0, 0.0, 1.0, 1.0]


def test_one_scan_and_tasks_that_are_not_joined(spark):
    out = queries()["pipeline_cycle"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "REPARTITION_BY_NUM" in plan
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


NUMBER = [
    {"type": "CumulativeSum"}, {"type": "MovingAverage", "window_size": 3}, {"type": "StandardDeviation", "window_size": 3}, {"type": "RelativeStrengthIndex", "n": 3}, {"type": "ResamplerConstant", "interval": 3},
    {"type": "InfiniteImpulseResponse", "b_coeffs": [0.4, 0.2], "a_coeffs": [-0.5]}, {"type": "MaxTracker"}, {"type": "Input", "portTypes": ["number"]}, {k: v for k, v in TRIGGER.items() if k != "id"},
]


@pytest.mark.parametrize("spec", NUMBER, ids=lambda s: s["type"])
def test_a_machine_taken_up_again_is_fresh(spec):
    rows = [(t, v) for _, t, v, _ in walk(40)[:40]]
    machine = Machine([{"id": "op", **spec}], [], "op", [("op", 0)])
    first = [m for r in rows for m in machine.push([(0, *r)])]
    machine.fresh()
    assert [m for r in rows for m in machine.push([(0, *r)])] == first and first


def test_cycles_taken_up_again_are_fresh():
    for program in (cycles(), cycles("vector_number"), FEEDBACK):
        machine, vector = load(program).machine(), program["operators"][0]["portTypes"][0] == "vector_number"
        ports = len(program["operators"][0]["portTypes"])
        sent = [m for _, t, v, c in walk(25, vector)[:25] for m in ((0, t, v), (1, t, c))[:ports]]
        first = [x for m in sent for x in machine.push([m])]
        machine.push([(0, 1000, sent[0][2])])  # left in a queue
        machine.fresh()
        assert [x for m in sent for x in machine.push([m])] == first and first


def test_a_fold_takes_up_machines_afresh(spark):
    df = spark.range(90).selectExpr("id % 30 AS k", "id AS t", "1.0D AS v")
    (out,) = fold([Signal.of(df, keys=("k",))], lambda: Machine([{"id": "n", "type": "CountNumber"}], [], "n", [("n", 0)]), ["number"])
    assert sorted((r["k"], r["v"], r["seq"]) for r in out.df().collect()) == [(k, float(n + 1), n) for k in range(30) for n in range(3)]
