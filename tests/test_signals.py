"""Declarative plans against the message-at-a-time interpreter, and documented cases."""

import json
import math
import random

import pytest

from sigloom.plans.interpreter import Machine, Node, load_machine, save_machine
from sigloom.plans.program import ProgramError, compile_program, expand, load
from sigloom.plans.session import Engine, Program, Run
from sigloom.plans.signal import Signal, monotone, synced
from sigloom.sources.tables import from_rows, list_csv, list_programs, read_csv, to_json


def frame(spark, rows, kind="double"):
    return Signal.of(spark.createDataFrame(rows, f"t long, v {kind}"))


def collected(s):
    return [(r["t"], r["v"]) for r in s.df().orderBy(*s.base.order).collect()]


def walk(n, seed=1):
    rng, t, out = random.Random(seed), 0, []
    for _ in range(n):
        t += rng.randint(1, 7)
        out.append((t, round(rng.gauss(10, 5), 2)))
    return out


SINGLE = [
    {"type": "Add", "value": 1.25}, {"type": "Scale", "value": -2.5}, {"type": "Power", "value": 2}, {"type": "Sin"}, {"type": "Log"}, {"type": "Log10"}, {"type": "Sign"}, {"type": "Floor"}, {"type": "Ceil"}, {"type": "Round"},
    {"type": "GreaterThan", "value": 10}, {"type": "EqualTo", "value": 10, "epsilon": 2}, {"type": "NotEqualTo", "value": 10, "epsilon": 2}, {"type": "LessThanOrEqualToReplace", "value": 8, "replaceBy": 0}, {"type": "TimeShift", "shift": -20},
    {"type": "Function", "points": [[0, 0], [10, 5], [12, -3]]}, {"type": "MovingAverage", "window_size": 4}, {"type": "MovingSum", "window_size": 1}, {"type": "StandardDeviation", "window_size": 5}, {"type": "StandardDeviation", "window_size": 1},
    {"type": "WindowMinMax", "window_size": 3, "mode": "max"}, {"type": "MovingKeyCount", "window_size": 4}, {"type": "Difference"}, {"type": "Difference", "use_oldest_time": False}, {"type": "PeakDetector", "window_size": 3},
    {"type": "PeakDetector", "window_size": 7}, {"type": "FiniteImpulseResponse", "coeff": [0.5, 0.25, 1]}, {"type": "InfiniteImpulseResponse", "b_coeffs": [0.5, 0.1], "a_coeffs": [0.3, -0.2]}, {"type": "CumulativeSum"}, {"type": "CountNumber"},
    {"type": "MinTracker"}, {"type": "MaxTracker"}, {"type": "ResamplerConstant", "interval": 3}, {"type": "ResamplerConstant", "interval": 3, "t0": 40}, {"type": "ResamplerConstant", "interval": 4, "t0": 1}, {"type": "ResamplerConstant", "interval": 5, "snapFirst": 1},
    {"type": "ResamplerHermite", "interval": 2}, {"type": "RelativeStrengthIndex", "n": 4},
]


def same(a, b):
    assert len(a) == len(b), (a[:5], b[:5])
    for (t, x), (u, y) in zip(a, b, strict=True):
        assert t == u
        assert x == y or math.isnan(x) and math.isnan(y) or abs(x - y) < 1e-8 * max(1, abs(x)), (t, x, y)


@pytest.mark.parametrize("spec", SINGLE, ids=lambda s: "-".join(map(str, s.values()))[:40])
def test_plan_equals_interpreter(spark, spec):
    rows = walk(40)
    spec = {"id": "x", **spec}
    program = {"entryOperator": "in", "operators": [{"id": "in", "type": "Input", "portTypes": ["number"]}, spec], "connections": [{"from": "in", "to": "x"}], "output": {"x": ["o1"]}}
    (out,) = compile_program(program, [frame(spark, rows)]).values()
    node, want = Node(spec), []
    for m in rows:
        node.data[0].append(m)
        want += [(t, v) for _, t, v in node.step()]
    same(collected(out), want)


def test_fewer_rows_than_the_window(spark):
    program = Program().add_operator("in", "Input", portTypes=["number"]).add_operator("m", "MovingAverage", window_size=5).connect("in", "m").add_output("m")
    (out,) = program.signals([frame(spark, walk(4))]).values()
    assert collected(out) == []


def test_ieee_cases(spark):
    values = [math.nan, math.inf, -math.inf, 0.0, -0.0, 2.5, -2.5, 1e300, -1.0]
    rows = [(i, v) for i, v in enumerate(values)]
    for spec in ({"type": "Log"}, {"type": "Floor"}, {"type": "Round"}, {"type": "Sign"}, {"type": "MinTracker"}, {"type": "MaxTracker"}, {"type": "GreaterThan", "value": 0.0}, {"type": "NotEqualTo", "value": 0.0}, {"type": "LessThanOrEqualToReplace", "value": 0, "replaceBy": 7}):
        program = {"entryOperator": "in", "operators": [{"id": "in", "type": "Input", "portTypes": ["number"]}, {"id": "x", **spec}], "connections": [{"from": "in", "to": "x"}], "output": {"x": ["o1"]}}
        (out,) = compile_program(program, [frame(spark, rows)]).values()
        node, want = Node({"id": "x", **spec}), []
        for m in rows:
            node.data[0].append(m)
            want += [(t, v) for _, t, v in node.step()]
        same(collected(out), want)


def test_division_by_zero_in_code(spark):
    from sigloom.plans.bytecode import fused
    from sigloom.queries import code

    s = Signal.of(spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 0.0]), (4, [1.0, -0.0]), (5, [6.0, 3.0])], "t long, v array<double>"))
    got = [v[0] for _, v in collected(fused(s, code("INPUT", 0, "INPUT", 1, "DIV", "END"), 1))]
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and got[3] == -math.inf and got[4] == 2.0


@pytest.mark.parametrize("seed", range(12))
def test_random_code(spark, seed):
    from sigloom.plans.bytecode import ARGUMENTS, CODES, effect, fused

    rng = random.Random(seed)
    bytecode, outs = [], rng.randint(1, 3)
    slot = 0
    for _ in range(outs):
        depth = 0
        for _ in range(rng.randint(1, 10)):
            name = rng.choice([c for c in CODES if c not in ("END", "IIR_UPDATE", "STATE_LOAD", "TAN", "EXP", "POW", "LOG", "LOG10", "SQRT", "DIV") and effect(c)[0] <= depth])
            args = {"INPUT": [rng.randrange(3)], "CONST": [rng.randrange(2)], "FIR_UPDATE": [0, 2]}.get(name, [slot] if ARGUMENTS.get(name) and name in ("CUMSUM", "COUNT", "MAX_AGG", "MIN_AGG", "DIFF", "SIGN_CHANGE") else [rng.randint(2, 4)] * ARGUMENTS.get(name, 0))
            slot += 2 * (name in ("CUMSUM", "COUNT", "MAX_AGG", "MIN_AGG", "DIFF", "SIGN_CHANGE"))
            bytecode += [CODES.index(name), *args]
            depth += effect(name)[1] - effect(name)[0]
        if depth == 0:
            bytecode += [CODES.index("INPUT"), 0]
        bytecode += [CODES.index("END")]
    spec = {"id": "f", "type": "FusedExpressionVector", "bytecode": [float(b) for b in bytecode], "numOutputs": outs, "constants": [1.5, -2.0], "coefficients": [0.5, 0.25]}
    rows = [(i, [round(rng.uniform(-5, 5), 2) for _ in range(3)]) for i in range(20)]
    node, want = Node(spec), []
    for m in rows:
        node.data[0].append(m)
        want += [(t, v) for _, t, v in node.step()]
    got = collected(fused(Signal.of(spark.createDataFrame(rows, "t long, v array<double>")), spec["bytecode"], outs, spec["constants"], spec["coefficients"]))
    assert [t for t, _ in got] == [t for t, _ in want]
    for (_, a), (_, b) in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or math.isnan(x) and math.isnan(y) or math.isinf(x) and math.isinf(y) or abs(x - y) <= 1e-6 * max(1, abs(x)), (a, b)


def test_truth_tables(spark):
    a, b = [True, True, False, False], [True, False, True, False]
    df = spark.createDataFrame([(i + 1, x, y) for i, (x, y) in enumerate(zip(a, b, strict=True))], "t long, a boolean, b boolean")
    from sigloom.operators import sync

    want = {"And": [1, 0, 0, 0], "Or": [1, 1, 1, 0], "Xor": [0, 1, 1, 0], "Nand": [0, 1, 1, 1], "Nor": [0, 0, 0, 1], "Xnor": [1, 0, 0, 1], "Implication": [1, 0, 1, 1]}
    for kind, row in want.items():
        out = sync.logic(f"Logical{kind}", [Signal.of(df, "t", "a"), Signal.of(df, "t", "b")])
        assert [int(v) for _, v in collected(out)] == row, kind


def test_late_and_repeated_messages_leave(spark):
    df = spark.createDataFrame([(0, 5), (1, 3), (2, 5), (3, 6), (4, 6), (5, 9)], "seq long, t long")
    assert [r["t"] for r in monotone(df, "t", "seq").orderBy("seq").collect()] == [5, 6, 9]


def test_unmatched_times_give_nothing(spark):
    a, b = frame(spark, [(1, 1.0), (3, 3.0)]), frame(spark, [(2, 5.0), (3, 7.0)])
    x, y = synced([a, b])
    assert collected(x) == [(3, 3.0)] and collected(y) == [(3, 7.0)]


def test_segments_and_open_tail(spark):
    program = {
        "entryOperator": "in", "output": {"p": ["o1"]},
        "operators": [{"id": "in", "type": "Input", "portTypes": ["number", "number"]},
                      {"id": "p", "type": "Pipeline", "input_port_types": ["number"], "output_port_types": ["number"], "entryOperator": "s", "operators": [{"id": "s", "type": "CumulativeSum"}], "connections": [], "outputMappings": {"s": {"o1": "o1"}}}],
        "connections": [{"from": "in", "to": "p", "fromPort": "o1", "toPort": "i1"}, {"from": "in", "to": "p", "fromPort": "o2", "toPort": "c1"}],
    }
    data, key = [(1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0), (5, 5.0)], [(1, 0.0), (2, 0.0), (3, 1.0), (4, 2.0), (5, 2.0)]
    (out,) = compile_program(program, [frame(spark, data), frame(spark, key)]).values()
    assert collected(out) == [(3, 3.0), (4, 3.0)]
    machine, got = load(program).machine(), []
    for (t, v), (_, k) in zip(data, key, strict=True):
        got += machine.push([(0, t, v), (1, t, k)])
    assert [(t, v) for _, t, v in got] == [(3, 3.0), (4, 3.0)]


def test_keyed_sums(spark):
    proto = {"operators": [{"id": "v", "type": "VectorExtract", "index": 1}, {"id": "s", "type": "CumulativeSum"}], "connections": [{"from": "v", "to": "s"}], "entry": {"operator": "v"}, "output": {"operator": "s"}}
    program = {"entryOperator": "in", "output": {"k": ["o1"]}, "operators": [{"id": "in", "type": "Input", "portTypes": ["vector_number"]}, {"id": "k", "type": "KeyedPipeline", "key_index": 0, "prototype": proto}], "connections": [{"from": "in", "to": "k"}]}
    rows = [(1, [1.0, 100.0]), (2, [2.0, 200.0]), (3, [1.0, 150.0]), (4, [2.0, 250.0])]
    want = [(1, [1.0, 100.0]), (2, [2.0, 200.0]), (3, [1.0, 250.0]), (4, [2.0, 450.0])]
    (out,) = compile_program(program, [frame(spark, rows, "array<double>")]).values()
    assert collected(out) == want
    machine = load(program).machine()
    assert [(t, v) for r in rows for _, t, v in machine.push([(0, *r)])] == want


def test_lookups_as_of(spark):
    from sigloom.operators.timegrid import keyed_variable, variable

    data, asked = frame(spark, [(5, 1.0), (10, 2.0)]), frame(spark, [(1, 0.0), (5, 0.0), (7, 0.0), (10, 0.0), (12, 0.0)])
    assert collected(variable(data, asked, -1.0)) == [(1, -1.0), (5, 1.0), (7, 1.0), (10, 2.0)]
    ups = frame(spark, [(1, [42.0, 1.0]), (5, [7.0, 3.0]), (6, [42.0, math.nan])], "array<double>")
    keys = frame(spark, [(1, 42.0), (5, 42.0), (6, 42.0), (9, 7.0)])
    assert collected(keyed_variable(ups, keys)) == [(1, True), (5, True), (6, False)]
    assert collected(keyed_variable(ups, keys, frame(spark, [(20, 0.0)]), "lookup", -1.0)) == [(1, 1.0), (5, 1.0), (6, -1.0), (9, 3.0)]


def test_top_k_ties(spark):
    from sigloom.operators.folds import top_k
    from sigloom.operators.windows import final_top

    s = frame(spark, [(1, [1.0, 10.0]), (2, [5.0, 20.0]), (3, [5.0, 30.0]), (4, [0.0, 40.0])], "array<double>")
    rows = [(r["t"], r["v"][1]) for r in top_k(s, 2, 0).df().orderBy("t", "seq").collect()]
    assert rows == [(1, 10.0), (2, 20.0), (2, 10.0), (3, 30.0), (3, 20.0), (4, 30.0), (4, 20.0)]
    assert [r["v"][1] for r in final_top(s, 2, 0).df().orderBy("seq").collect()] == [30.0, 20.0]


def plain_rsi(values, n):
    steps = [y - x for x, y in zip(values, values[1:], strict=False)]
    gain = sum(d for d in steps[:n] if d > 0) / n
    loss = sum(-d for d in steps[:n] if d < 0) / n
    out = []
    for d in [None, *steps[n:]]:
        if d is not None:
            gain, loss = (gain * (n - 1) + max(d, 0)) / n, (loss * (n - 1) + max(-d, 0)) / n
        out.append(100 - 100 / (1 + gain / loss) if loss else 100.0)
    return out


@pytest.mark.parametrize("n", [1, 3, 9])
def test_rsi_by_a_plain_loop(n):
    values = [v for _, v in walk(40, 8)]
    node, out = Node({"id": "r", "type": "RelativeStrengthIndex", "n": n}), []
    for i, v in enumerate(values, 1):
        node.data[0].append((i, v))
        out += node.step()
    same([(t, v) for _, t, v in out], list(zip(range(n + 1, 41), plain_rsi(values, n), strict=True)))


@pytest.mark.parametrize("rows", [[(1, 1.0), (1, 5.0), (2, 3.0)], [(3, 1.0), (1, 2.0), (3, 3.0), (4, 4.0), (2, 5.0), (5, 6.0)], []])
def test_input_drops_late_and_repeated_rows(spark, rows):
    program = Program().add_operator("in", "Input", portTypes=["number"]).add_operator("n", "CumulativeSum").connect("in", "n").add_output("n")
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "a long, t long, v double")
    (out,) = program.signals([Signal.of(df, arrival="a")]).values()
    machine = load(program.as_dict()).machine()
    assert collected(out) == [(t, v) for r in rows for _, t, v in machine.push([(0, *r)])]
    # without an order of arrival: by time, and the smallest value of a time
    (out,) = program.signals([Signal.of(df)]).values()
    machine = load(program.as_dict()).machine()
    assert collected(out) == [(t, v) for r in sorted(rows) for _, t, v in machine.push([(0, *r)])]


def test_folds_hold_one_batch(spark):
    # one key of many messages, as a stream of batches, in order
    df = spark.range(200_000).selectExpr("id % 1 AS k", "id * 2 AS t", "CAST(id % 7 AS DOUBLE) AS v")
    from sigloom.operators.folds import iir

    rows = iir(Signal.of(df, keys=("k",)), [1.0], [-1.0]).df().selectExpr("max_by(v, t) AS last", "count(*) AS n", "sum(CAST(seq * 2 = t AS INT)) AS ordered").first()
    assert (rows["last"], rows["n"], rows["ordered"]) == (sum(i % 7 for i in range(200_000)), 200_000, 200_000)


def test_entry_of_a_body_has_the_ports(spark):
    body = {"id": "p", "type": "Pipeline", "input_port_types": ["number", "number"], "output_port_types": ["number"], "entryOperator": "s", "operators": [{"id": "s", "type": "CumulativeSum"}], "connections": [], "outputMappings": {"s": {"o1": "o1"}}}
    program = {"entryOperator": "p", "operators": [body], "connections": [], "output": {"p": ["o1"]}}
    from sigloom.plans.diagnostics import diagnose

    assert [e["code"] for e in diagnose(program)["errors"]] == ["ENTRY_PORT_MISMATCH"]


def test_state_goes_on(spark):
    text = json.dumps({"entryOperator": "in", "output": {"b": ["o1"]}, "operators": [{"id": "in", "type": "Input", "portTypes": ["number"]}, {"id": "a", "type": "MovingAverage", "window_size": 3}, {"id": "b", "type": "CumulativeSum"}], "connections": [{"from": "in", "to": "a"}, {"from": "a", "to": "b"}]})
    rows, graph = walk(20), load(text)
    one = graph.machine()
    want = [m for r in rows for m in one.push([(0, *r)])]
    first, second = graph.machine(), graph.machine()
    got = [m for r in rows[:7] for m in first.push([(0, *r)])]
    load_machine(second, json.loads(json.dumps(save_machine(first))))
    assert got + [m for r in rows[7:] for m in second.push([(0, *r)])] == want


def test_session(spark):
    engine = Engine()
    program = Program(id="p").add_operator("in", "Input", portTypes=["number"]).add_operator("s", "Scale", value=2).connect("in", "s").add_output("s", "o1")
    assert engine.create_program("p", program.to_json()) == ""
    assert engine.get_program_entry_operator_id("p") == "in"
    engine.add_to_message_buffer("p", "i1", 1, 3.0)
    engine.add_to_message_buffer("p", "i1", 1, 4.0)
    assert engine.process_message_buffer("p") == {"s": {"o1": [{"time": 1, "value": 6.0}]}}
    saved = engine.serialize_program_data("p")
    engine.restore_program_data_from_json("p", saved)
    assert engine.process_batch("p", [1, 2], [9.0, 5.0], ["i1", "i1"], debug=True)["s"]["o1"] == [{"time": 2, "value": 10.0}]
    assert "already" in engine.create_program("p", program.to_json())
    assert engine.delete_program("p") and not engine.delete_program("p")
    assert "n0" in program.to_mermaid()


def test_run_over_a_table(spark):
    program = Program().add_operator("in", "Input", portTypes=["number"]).add_operator("m", "MovingAverage", window_size=2).connect("in", "m").add_output("m", "o1")
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 5.0)], "time long, x double")
    assert [tuple(r) for r in Run(program, df, {"x": "i1"}).exec({"m:o1": "avg"}).orderBy("time").collect()] == [(1, None), (2, None), (3, 3.0)]


def test_prototypes():
    program = {"prototypes": {"P": {"parameters": [{"name": "k", "type": "number"}], "operators": [{"id": "a", "type": "Scale", "value": "${k}"}], "connections": [], "entry": {"operator": "a"}, "output": {"operator": "a"}}},
               "operators": [{"id": "in", "type": "Input", "portTypes": ["number"]}, {"id": "p", "prototype": "P", "parameters": {"k": 3}}], "connections": [{"from": "in", "to": "p"}], "entryOperator": "in", "output": {"p": ["o1"]}}
    full = expand(program)
    assert full["operators"][1] == {"id": "p::a", "type": "Scale", "value": 3} and full["connections"][0]["to"] == "p::a" and full["output"] == {"p::a": ["o1"]}
    program["operators"][1]["parameters"] = {"k": "x"}
    with pytest.raises(ProgramError):
        load(program)


@pytest.mark.parametrize(("change", "code"), [
    (lambda p: p["operators"].append({"id": "z", "type": "Nope"}), "UNKNOWN_OPERATOR_TYPE"),
    (lambda p: p["operators"][1].pop("window_size"), "MISSING_REQUIRED_FIELD"),
    (lambda p: p["operators"][1].update(window_size=0), "INVALID_PARAMETER_VALUE"),
    (lambda p: p["operators"][0].update(portTypes=["text"]), "INVALID_PORT_TYPE"),
    (lambda p: p["connections"][0].update(to="nobody"), "INVALID_OPERATOR_REF"),
    (lambda p: p["connections"][0].update(toPort="i7"), "PORT_INDEX_OUT_OF_BOUNDS"),
    (lambda p: p["operators"][0].update(portTypes=["boolean"]), "PORT_TYPE_MISMATCH"),
    (lambda p: p.update(entryOperator="nobody"), "INVALID_ENTRY_OPERATOR"),
    (lambda p: p.pop("output"), "MISSING_OUTPUT_FIELD"),
    (lambda p: p.update(output={"m": ["o9"]}), "INVALID_OUTPUT_MAPPING"),
    (lambda p: p["operators"].append({"id": "z", "prototype": "Q"}), "UNKNOWN_PROTOTYPE"),
])
def test_diagnostics(change, code):
    from sigloom.plans.diagnostics import diagnose

    program = {"entryOperator": "in", "operators": [{"id": "in", "type": "Input", "portTypes": ["number"]}, {"id": "m", "type": "MovingAverage", "window_size": 3}], "connections": [{"from": "in", "to": "m"}], "output": {"m": ["o1"]}}
    assert diagnose(json.dumps(program)) == {"valid": True, "errors": []}
    change(program)
    assert code in [e["code"] for e in diagnose(program)["errors"]]
    assert diagnose("{")["errors"][0]["code"] == "INVALID_JSON"


def test_csv_and_listing(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,Open\n1.5,2.25\n2,263.420.013\nx,y\n3,4\n")
    (tmp_path / "p.json").write_text(json.dumps({"entryOperator": "in", "operators": [{"id": "in", "type": "Input", "portTypes": ["number"]}], "connections": [], "output": {"in": ["o1"]}}))
    (tmp_path / "q.json").write_text("{}")
    rows = read_csv(spark, str(tmp_path / "a.csv"), scale_t=2).orderBy("t").collect()
    assert [tuple(r) for r in rows] == [(3, 2.25), (4, 263.42), (6, 4.0)]
    assert list_programs(spark, str(tmp_path)) == [str(tmp_path / "p.json")] and list_csv(spark, str(tmp_path)) == [str(tmp_path / "a.csv")]
    (s, _) = from_rows(spark, [[1, 2, 3], [2, 4, 5]])
    assert json.loads(to_json({("a", "o1"): s})) == {"a": {"o1": [{"time": 1, "value": 2.0}, {"time": 2, "value": 4.0}]}}


def test_batch_runner(spark, tmp_path):
    from sigloom.__main__ import main

    (tmp_path / "a.csv").write_text("time,Open\n1,2.5\n2,3.5\n3,5\n")
    program = Program().add_operator("in", "Input", portTypes=["number"]).add_operator("d", "Difference").connect("in", "d").add_output("d").add_output("in")
    (tmp_path / "p.json").write_text(program.to_json())
    main([str(tmp_path / "p.json"), str(tmp_path / "a.csv"), "--output", str(tmp_path / "out"), "--tail", "2"])
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(lines, key=lambda x: x["in"]["time"]) == [
        {"in": {"time": 2, "value": 3.5}, "out": {"in": {"o1": [{"time": 2, "value": 3.5}]}}},
        {"in": {"time": 3, "value": 5.0}, "out": {"d": {"o1": [{"time": 3, "value": 1.5}]}, "in": {"o1": [{"time": 3, "value": 5.0}]}}},
    ]


def test_prints_and_collector(spark):
    from sigloom.plans.session import Collector, pretty_print, pretty_print_validation

    assert Collector([frame(spark, [(2, 1.0), (1, 3.0)])]).port(0) == [(1, 3.0), (2, 1.0)]
    assert pretty_print({"a": {"o1": [{"time": 1, "value": 2.0}]}}).split() == ["a.o1", "1", "2.0"]
    assert "UNKNOWN" in pretty_print_validation({"valid": False, "errors": [{"code": "UNKNOWN", "path": "", "message": "m"}]}) and pretty_print_validation({"valid": True}) == "nothing is wrong"


def test_long_gaps_in_grids(spark):
    from sigloom.operators.timegrid import resample_constant

    s = Signal.of(spark.createDataFrame([("k", 0, 1.0), ("k", 1_000_000, 2.0)], "k string, t long, v double"), keys=("k",))
    rows = resample_constant(s, 1).df().selectExpr("count(*) AS n", "min(t) AS a", "max(t) AS b", "sum(v) AS s", "count(DISTINCT t) AS d").first()
    assert tuple(rows) == (1_000_000, 1, 1_000_000, 1_000_001.0, 1_000_000)


def test_stream_equals_batch(spark, tmp_path):
    from sigloom.streaming.host import run_stream

    program = {"entryOperator": "in", "output": {"s": ["o1"]}, "operators": [{"id": "in", "type": "Input", "portTypes": ["number"]}, {"id": "m", "type": "MovingAverage", "window_size": 3}, {"id": "s", "type": "CumulativeSum"}], "connections": [{"from": "in", "to": "m"}, {"from": "m", "to": "s"}]}
    rows = [(k, t, v) for k in (1, 2) for t, v in walk(12, k)]
    rows.sort(key=lambda r: r[1])
    source = str(tmp_path / "in")
    for i in range(0, len(rows), 10):
        spark.createDataFrame(rows[i : i + 10], "k long, t long, v double").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("k long, t long, v double").option("maxFilesPerTrigger", 1).parquet(source)
    q = run_stream(program, stream, ("k",)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r["k"], r["t"], round(r["num"], 6)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    (out,) = compile_program(program, [Signal.of(spark.createDataFrame(rows, "k long, t long, v double"), keys=("k",))]).values()
    assert got == sorted((r["k"], r["t"], round(r["v"], 6)) for r in out.df().collect())


def test_one_shuffle_for_bollinger(spark):
    from sigloom.queries import bollinger

    plan = bollinger(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_trigger_set_resets():
    from sigloom.queries import TRIGGER

    machine, out = Machine([TRIGGER], [], "trigger", [("trigger", 0)]), []
    for t, v in enumerate([200.0, 200.0, 100.0, 250.0]):
        out += machine.push([(0, t, v)])
    assert [(t, v) for _, t, v in out] == [(1, 400.0), (3, 350.0)]
