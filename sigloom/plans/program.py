"""Programs: JSON graphs of operators, expanded, checked and compiled to signals."""

from __future__ import annotations

import copy
import json
import re
from dataclasses import dataclass, field

from sigloom.operators import folds, scalar, segments, sync, timegrid, windows
from sigloom.plans import bytecode
from sigloom.plans.interpreter import MAPS, SYNC, TESTS, VALUED, Machine
from sigloom.plans.signal import Signal, accepted

NUM, BOOL, VEC, BVEC = "number", "boolean", "vector_number", "vector_boolean"
PORT_TYPES = (NUM, BOOL, VEC, BVEC)


class ProgramError(ValueError):
    """A program that can't be made, with a code and the place of the fault."""

    def __init__(self, message: str, code: str = "INVALID_PARAMETER_VALUE", path: str = ""):
        super().__init__(message)
        self.code, self.path = code, path


# --- operator types --------------------------------------------------------------------------

#: For each type the fields that it can't do without.
REQUIRED: dict[str, tuple[str, ...]] = {
    **{k: () for k in MAPS}, **{k: ("value",) for k in VALUED}, "Input": ("portTypes",), "Output": ("portTypes",), "Join": ("portTypes",), "Function": ("points",), "LessThanOrEqualToReplace": ("value", "replaceBy"),
    "TimeShift": ("shift",), "TimestampExtract": (), "GreaterThan": ("value",), "LessThan": ("value",), "EqualTo": ("value",), "NotEqualTo": ("value",), "VectorExtract": ("index",), "VectorProject": ("indices",),
    **{f"Compare{k}": ("value",) for k in (*TESTS, "EQ", "NEQ")}, **{f"CompareSync{k}": () for k in (*TESTS, "EQ", "NEQ")}, "SyncGreaterThan": (), "SyncLessThan": (), "SyncEqual": (), "SyncNotEqual": (),
    **{f"Logical{k}": () for k in ("And", "Or", "Xor", "Nand", "Nor", "Xnor", "Implication")}, **{k: () for k in SYNC - {"Linear"}}, "Linear": ("coefficients",), "Demultiplexer": (), "Multiplexer": (), "Variable": (), "KeyedVariable": (),
    **{k: ("window_size",) for k in ("MovingAverage", "MovingSum", "StandardDeviation", "WindowMinMax", "MovingKeyCount", "PeakDetector")}, "Difference": (), "FiniteImpulseResponse": ("coeff",), "InfiniteImpulseResponse": (), "CumulativeSum": (),
    "CountNumber": (), "CountBoolean": (), "MinTracker": (), "MaxTracker": (), "TopK": ("k", "score_index"), "ResamplerConstant": ("interval",), "ResamplerHermite": ("interval",), "RelativeStrengthIndex": (), "VectorCompose": (),
    "FusedExpression": ("bytecode", "numOutputs"), "FusedExpressionVector": ("bytecode", "numOutputs"), "BurstAggregate": ("aggBytecode",), "KeyedPipeline": ("prototype",),
    "Pipeline": ("input_port_types", "output_port_types", "operators", "entryOperator", "outputMappings"), "TriggerSet": ("input_port_type", "output_port_type", "operators", "entryOperator", "outputOperator"),
    **{f"Constant{k}": ("value",) for k in ("Number", "Boolean", "NumberToBoolean", "BooleanToNumber", "NumberToVector", "VectorToNumber", "BooleanToVector", "VectorToBoolean", "Vector", "BooleanVector")},
}


@dataclass(frozen=True)
class Ports:
    data: tuple[str, ...]
    control: tuple[str, ...]
    out: tuple[str, ...]


def ports(spec: dict) -> Ports:
    """The port types of an operator."""
    kind, n = spec["type"], int(spec.get("numPorts", 2))
    if kind in ("Input", "Output", "Join"):
        types = tuple(spec["portTypes"])
        return Ports(types, (), types)
    if kind == "Linear":
        return Ports((NUM,) * len(spec["coefficients"]), (), (NUM,))
    if kind in SYNC or kind in ("SyncGreaterThan", "SyncLessThan", "SyncEqual", "SyncNotEqual"):
        return Ports((NUM,) * n, (), (NUM,))
    if kind.startswith("Logical"):
        return Ports((BOOL,) * n, (), (BOOL,))
    if kind.startswith("CompareSync"):
        return Ports((NUM, NUM), (), (BOOL,))
    if kind.startswith("Compare"):
        return Ports((NUM,), (), (BOOL,))
    if kind == "Demultiplexer":
        n, t = int(spec.get("numPorts", 1)), spec.get("portType", NUM)
        return Ports((t,), (BOOL,) * n, (t,) * n)
    if kind == "Multiplexer":
        t = spec.get("portType", NUM)
        return Ports((t,) * n, (BOOL,) * n, (t,))
    if kind == "KeyedVariable":
        return Ports((VEC,), (NUM, NUM), (BOOL if spec.get("mode", "exists") == "exists" else NUM,))
    if kind == "Variable":
        return Ports((NUM,), (NUM,), (NUM,))
    if kind == "Pipeline":
        return Ports(tuple(spec["input_port_types"]), () if spec.get("segmentBytecode") else (NUM,), tuple(spec["output_port_types"]))
    if kind == "TriggerSet":
        return Ports((spec["input_port_type"],), (), (spec["output_port_type"],))
    fixed = {
        "BooleanToNumber": (BOOL, NUM), "CountBoolean": (BOOL, NUM), "TimestampExtract": (VEC, NUM), "VectorExtract": (VEC, NUM), "VectorProject": (VEC, VEC), "TopK": (VEC, VEC), "KeyedPipeline": (VEC, VEC),
        "FusedExpressionVector": (VEC, VEC), "BurstAggregate": (VEC, VEC), "ConstantBoolean": (BOOL, BOOL), "ConstantNumberToBoolean": (NUM, BOOL), "ConstantBooleanToNumber": (BOOL, NUM), "ConstantNumberToVector": (NUM, VEC),
        "ConstantVectorToNumber": (VEC, NUM), "ConstantBooleanToVector": (BOOL, BVEC), "ConstantVectorToBoolean": (BVEC, BOOL), "ConstantVector": (VEC, VEC), "ConstantBooleanVector": (BVEC, BVEC),
    }
    if kind in fixed:
        return Ports((fixed[kind][0],), (), (fixed[kind][1],))
    if kind in ("VectorCompose", "FusedExpression"):
        return Ports((NUM,) * n, (), (VEC,))
    return Ports((NUM,), (), (NUM,))


def check_operator(spec: dict) -> None:
    """ProgramError for a type, field or value that is wrong."""
    if not spec.get("id") or not spec.get("type"):
        raise ProgramError("an operator lacks its id or its type", "MISSING_REQUIRED_FIELD")
    kind = spec["type"]
    if kind not in REQUIRED:
        raise ProgramError(f"no operator is of type {kind!r}", "UNKNOWN_OPERATOR_TYPE", "/type")
    for name in REQUIRED[kind]:
        if name not in spec:
            raise ProgramError(f"{kind} {spec['id']} lacks {name}", "MISSING_REQUIRED_FIELD", f"/{name}")
    if kind == "InfiniteImpulseResponse" and not ("b_coeffs" in spec or "b" in spec):
        raise ProgramError(f"{kind} {spec['id']} lacks b_coeffs", "MISSING_REQUIRED_FIELD", "/b_coeffs")
    for name in ("portTypes", "input_port_types", "output_port_types"):
        for t in spec.get(name, []):
            if t not in PORT_TYPES:
                raise ProgramError(f"{t!r} is no port type", "INVALID_PORT_TYPE", f"/{name}")
    for name in ("portType", "input_port_type", "output_port_type"):
        if name in spec and spec[name] not in PORT_TYPES:
            raise ProgramError(f"{spec[name]!r} is no port type", "INVALID_PORT_TYPE", f"/{name}")

    def ask(good: bool, message: str, name: str) -> None:
        if not good:
            raise ProgramError(message, "INVALID_PARAMETER_VALUE", f"/{name}")

    if kind == "PeakDetector":
        ask(spec["window_size"] >= 3, "a peak needs a window of 3 or more", "window_size")
        ask(spec["window_size"] % 2 == 1, "the window of a peak has a middle, so its size is odd", "window_size")
    elif "window_size" in spec:
        ask(spec["window_size"] >= 1, "a window holds 1 message or more", "window_size")
    if kind == "FiniteImpulseResponse":
        ask(bool(spec["coeff"]), "a filter without coefficients", "coeff")
    if kind == "InfiniteImpulseResponse":
        ask(bool(spec.get("b_coeffs", spec.get("b"))), "a feedback filter without b coefficients", "b_coeffs")
    if kind in ("ResamplerConstant", "ResamplerHermite"):
        ask(spec["interval"] > 0, "the distance of grid points has to be above 0", "interval")
    if kind == "Function":
        ask(len(spec["points"]) >= 2, "a curve takes two points or more", "points")
    if kind == "Linear":
        ask(len(spec["coefficients"]) >= 2, "a weighted sum takes two ports or more", "coefficients")
    if kind == "Join":
        ask(len(spec["portTypes"]) >= 2, "a join takes two ports or more", "portTypes")
    if kind in ("Input", "Output"):
        ask(bool(spec["portTypes"]), f"{kind} has no port", "portTypes")
    if kind == "TopK":
        ask(spec["k"] >= 1, "the best k are 1 or more", "k")
    if kind in ("SyncEqual", "SyncNotEqual"):
        ask(spec.get("epsilon", 1e-10) > 0, "epsilon has to be above 0", "epsilon")
    try:
        if kind in ("FusedExpression", "FusedExpressionVector"):
            bytecode.validate(spec["bytecode"], spec["numOutputs"], len(spec.get("constants", [])), len(spec.get("coefficients", [])), int(spec["numPorts"]) if kind == "FusedExpression" and "numPorts" in spec else None)
        if kind == "BurstAggregate":
            bytecode.validate(spec["aggBytecode"], spec.get("numAggOutputs", 1), len(spec.get("aggConstants", [])))
        if kind == "Pipeline" and spec.get("segmentBytecode"):
            bytecode.validate(spec["segmentBytecode"], 1, len(spec.get("segmentConstants", [])), stateless=True)
    except ValueError as wrong:
        raise ProgramError(str(wrong), "INVALID_PARAMETER_VALUE", "/bytecode") from wrong
    if kind in ("Pipeline", "TriggerSet", "KeyedPipeline") and isinstance(spec.get("prototype", {}), dict):
        body = body_of(spec)
        for s in body.specs:
            check_operator(s)
        body.check()
        first, outer = ports(body.by_id()[body.entry]).data, ports(spec).data
        if len(first) < len(outer):
            raise ProgramError(f"{spec['id']} has {len(outer)} data ports, its entry {body.entry} {len(first)}", "ENTRY_PORT_MISMATCH", "/entryOperator")


# --- graphs ----------------------------------------------------------------------------------


def port_number(name: str) -> tuple[bool, int]:
    """(is control, index) of a port name such as i1, c2 or o1."""
    m = re.fullmatch(r"([ico])([1-9]\d*)", str(name))
    if not m:
        raise ProgramError(f"{name!r} names no port: i1, c1, o1 and so on do", "PORT_INDEX_OUT_OF_BOUNDS")
    return m[1] == "c", int(m[2]) - 1


@dataclass
class Graph:
    """Operators, edges (from, output, to, port, is control), the entry, and outputs (operator, output) in order."""

    specs: list[dict]
    edges: list[tuple[str, int, str, int, bool]]
    entry: str
    outputs: list[tuple[str, int]]
    labels: list[tuple[str, str]] = field(default_factory=list)

    def by_id(self) -> dict[str, dict]:
        return {s["id"]: s for s in self.specs}

    def check(self) -> None:
        own = self.by_id()
        for i, (a, o, b, p, control) in enumerate(self.edges):
            path = f"/connections/{i}"
            for name in (a, b):
                if name not in own:
                    raise ProgramError(f"a connection names {name!r}, which is not there", "INVALID_OPERATOR_REF", path)
            source, target = ports(own[a]).out, ports(own[b])
            into = target.control if control else target.data
            if o >= len(source):
                raise ProgramError(f"{a} has no output {o + 1}", "PORT_INDEX_OUT_OF_BOUNDS", f"{path}/fromPort")
            if p >= len(into):
                raise ProgramError(f"{b} has no {'control' if control else 'data'} port {p + 1}", "PORT_INDEX_OUT_OF_BOUNDS", f"{path}/toPort")
            if source[o] != into[p]:
                raise ProgramError(f"type mismatch: {a} gives {source[o]}, {b} takes {into[p]}", "PORT_TYPE_MISMATCH", path)
        if self.entry not in own:
            raise ProgramError(f"the entry {self.entry!r} is not among the operators", "INVALID_ENTRY_OPERATOR", "/entryOperator")
        for name, o in self.outputs:
            if name not in own:
                raise ProgramError(f"an output names {name!r}, which is not there", "INVALID_OUTPUT_MAPPING", "/output")
            if o >= len(ports(own[name]).out):
                raise ProgramError(f"{name} has no output {o + 1} to give", "INVALID_OUTPUT_MAPPING", "/output")

    def cyclic(self) -> bool:
        """Whether any operator feeds, in the end, itself."""
        waiting = {s["id"]: 0 for s in self.specs}
        for _, _, b, _, _ in self.edges:
            waiting[b] += 1
        ready, done = [k for k, n in waiting.items() if not n], 0
        while ready:
            a, done = ready.pop(), done + 1
            for x, _, b, _, _ in self.edges:
                if x == a:
                    waiting[b] -= 1
                    if not waiting[b]:
                        ready.append(b)
        return done < len(waiting)

    def kinds(self) -> list[str]:
        own = self.by_id()
        return [ports(own[n]).out[o] for n, o in self.outputs]

    def machine(self, trace: bool = False) -> Machine:
        return Machine(self.specs, self.edges, self.entry, self.outputs, trace)


def edge_of(c: dict) -> tuple[str, int, str, int, bool]:
    if "from" not in c or "to" not in c:
        raise ProgramError("a connection lacks one of its ends", "MISSING_REQUIRED_FIELD")
    control, port = port_number(c.get("toPort", "i1"))
    return str(c["from"]), port_number(c.get("fromPort", "o1"))[1], str(c["to"]), port, control or c.get("kind") == "control"


def body_of(spec: dict) -> Graph:
    """The graph inside a Pipeline, TriggerSet or KeyedPipeline."""
    if spec["type"] == "KeyedPipeline":
        p = spec["prototype"]
        entry, out = p["entry"], p["output"]
        return Graph(p["operators"], [edge_of(c) for c in p.get("connections", [])], str(entry["operator"]), [(str(out["operator"]), port_number(out.get("port", "o1"))[1])])
    edges = [edge_of(c) for c in spec.get("connections", [])]
    if spec["type"] == "TriggerSet":
        out = spec["outputOperator"]
        name, port = (out, "o1") if isinstance(out, str) else (out["id"], out.get("port", "o1")) if "id" in out else next(iter(out.items()))
        port = port if isinstance(port, str) else next(iter(port.values() if isinstance(port, dict) else port))
        return Graph(spec["operators"], edges, spec["entryOperator"], [(name, port_number(port)[1])])
    outputs: dict[int, tuple[str, int]] = {}
    for name, mapping in spec["outputMappings"].items():
        for inner, outer in mapping.items():
            outputs[port_number(outer)[1]] = (name, port_number(inner)[1])
    if sorted(outputs) != list(range(len(outputs))):
        raise ProgramError("the outputs of a Pipeline are not numbered from 1 on", "INVALID_OUTPUT_MAPPING", "/outputMappings")
    return Graph(spec["operators"], edges, spec["entryOperator"], [outputs[i] for i in range(len(outputs))])


# --- prototypes ------------------------------------------------------------------------------

_TYPES = {"number": (int, float), "string": str, "boolean": bool, "array": list, "object": dict}
_REFERENCE = re.compile(r"\$\{([^}]*)\}")


def fits(kind: str, value) -> bool:
    return isinstance(value, _TYPES.get(kind, ())) and not (kind == "number" and isinstance(value, bool))


def substitute(x, values: dict):
    """``x`` with ${name} replaced; a string that is one reference takes the value's type."""
    if isinstance(x, dict):
        return {k: substitute(v, values) for k, v in x.items()}
    if isinstance(x, list):
        return [substitute(v, values) for v in x]
    if not isinstance(x, str) or "${" not in x:
        return x

    def value(name: str):
        if name not in values:
            raise ProgramError(f"nothing is called {name!r} here", "UNKNOWN_PARAM_REFERENCE")
        return values[name]

    whole = _REFERENCE.fullmatch(x)
    return value(whole[1]) if whole else _REFERENCE.sub(lambda m: str(value(m[1])), x)


def arguments(proto: dict, given: dict, instance: str) -> dict:
    """Parameter values of one instance: the given ones over defaults."""
    known = {p["name"]: p for p in proto.get("parameters", [])}
    for name, v in given.items():
        if name not in known:
            raise ProgramError(f"{instance} gives {name!r}, which its prototype doesn't take", "UNKNOWN_PARAMETER", f"/parameters/{name}")
        if not fits(known[name]["type"], v):
            raise ProgramError(f"{instance} gives {name!r} as something else than a {known[name]['type']}", "INVALID_PARAMETER_TYPE", f"/parameters/{name}")
    out = {n: p["default"] for n, p in known.items() if p.get("default") is not None} | given
    for name in known:
        if name not in out:
            raise ProgramError(f"{instance} doesn't give {name!r}, which has no default", "MISSING_PARAMETER", "/parameters")
    return out


def expand(program: dict) -> dict:
    """``program`` without prototypes: instances become their operators, with ids ``instance::operator``."""
    program = copy.deepcopy(program)
    known = dict(program.pop("prototypes", None) or {})
    operators, edges, ends = [], list(program.get("connections", [])), {}

    def place(op: dict, prefix: str, into: list, wires: list) -> tuple | None:
        proto = op.get("prototype")
        if proto is None or op.get("type") == "KeyedPipeline":
            op = dict(op, id=prefix + str(op.get("id", "")))
            if isinstance(proto, str):
                if proto not in known:
                    raise ProgramError(f"no prototype is called {proto!r}", "UNKNOWN_PROTOTYPE", "/prototype")
                proto = known[proto]
            if proto is not None:
                inner = substitute({k: v for k, v in proto.items() if k != "parameters"}, arguments(proto, op.get("parameters", {}), op["id"]))
                nested, own_wires, own_ends = [], list(inner.get("connections", [])), {}
                for o in inner["operators"]:
                    got = place(o, "", nested, own_wires)
                    if got:
                        own_ends[o["id"]] = got
                wires_here = [redirect(w, own_ends) for w in inner.get("connections", [])] + own_wires[len(inner.get("connections", [])) :]
                op["prototype"] = dict(inner, operators=nested, connections=wires_here)
            into.append(op)
            return None
        if isinstance(proto, str):
            if proto not in known:
                raise ProgramError(f"no prototype is called {proto!r}", "UNKNOWN_PROTOTYPE", "/prototype")
            proto = known[proto]
        name = prefix + str(op["id"])
        values = arguments(proto, op.get("parameters", {}), name)
        body = substitute({k: v for k, v in proto.items() if k != "parameters"}, values)
        inside = {}
        for o in body["operators"]:
            got = place(o, f"{name}::", into, wires)
            if got:
                inside[f"{name}::{o['id']}"] = got
        for c in body.get("connections", []):
            wires.append(redirect(dict(c, **{"from": f"{name}::{c['from']}", "to": f"{name}::{c['to']}"}), inside))
        entry, out = body["entry"], body["output"]
        first, last = f"{name}::{entry['operator']}", f"{name}::{out['operator']}"
        first_port, last_port = entry.get("port", "i1"), out.get("port", "o1")
        if first in inside:
            first, first_port = inside[first][0]
        if last in inside:
            last, last_port = inside[last][1]
        return (first, first_port), (last, last_port)

    for op in program.get("operators", []):
        got = place(op, "", operators, edges)
        if got:
            ends[str(op["id"])] = got
    program["operators"], program["connections"] = operators, [redirect(c, ends) for c in edges]
    entry = program.get("entryOperator")
    if entry in ends:
        program["entryOperator"] = ends[entry][0][0]
    program["output"] = {(ends[n][1][0] if n in ends else n): p for n, p in program.get("output", {}).items()}
    return program


def redirect(c: dict, ends: dict) -> dict:
    """A connection with instances replaced by the operators at their ends."""
    c = dict(c)
    if c.get("from") in ends:
        c["from"], port = ends[c["from"]][1]
        c["fromPort"] = c.get("fromPort", port) if c.get("fromPort", "o1") != "o1" else port
    if c.get("to") in ends:
        c["to"], port = ends[c["to"]][0]
        c["toPort"] = c.get("toPort", port) if c.get("toPort", "i1") != "i1" else port
    return c


def load(program: str | dict) -> Graph:
    """The graph of a program (JSON text or object), expanded and checked."""
    if isinstance(program, str):
        try:
            program = json.loads(program)
        except json.JSONDecodeError as wrong:
            raise ProgramError(f"this is no JSON: {wrong}", "INVALID_JSON") from wrong
    if not isinstance(program, dict) or not isinstance(program.get("operators"), list):
        raise ProgramError("operators are missing", "SCHEMA_VALIDATION", "/operators")
    program = expand(program)
    for name, code in (("entryOperator", "MISSING_REQUIRED_FIELD"), ("output", "MISSING_OUTPUT_FIELD")):
        if not program.get(name):
            raise ProgramError(f"{name} is missing", code, f"/{name}")
    for i, s in enumerate(program["operators"]):
        try:
            check_operator(s)
        except ProgramError as wrong:
            wrong.path = f"/operators/{i}{wrong.path}"
            raise
    outputs, labels = [], []
    for name, own in program["output"].items():
        for p in own:
            outputs.append((str(name), port_number(p)[1]))
            labels.append((str(name), p))
    graph = Graph(program["operators"], [edge_of(c) for c in program.get("connections", [])], str(program["entryOperator"]), outputs, labels)
    graph.check()
    return graph


# --- compiler --------------------------------------------------------------------------------


def build(spec: dict, data: list[Signal], control: list[Signal]) -> list[Signal]:
    """The output signals of one operator."""
    kind, get, s = spec["type"], spec.get, data[0] if data else None
    if kind == "Output":
        return data
    if kind == "Input":
        taken = iter(accepted([x for x in data if x is not None]))
        return [x if x is None else next(taken) for x in data]
    if kind in scalar.UNARY:
        return [scalar.unary(kind, s)]
    if kind in scalar.WITH_VALUE:
        return [scalar.with_value(kind, s, get("value"))]
    if kind.startswith("Constant"):
        return [scalar.constant(s, get("value"))]
    if kind == "Function":
        return [scalar.interpolate(s, get("points"), get("interpolation", "linear"))]
    if kind == "LessThanOrEqualToReplace":
        return [scalar.replace_low(s, get("value"), get("replaceBy"))]
    if kind == "TimeShift":
        return [scalar.time_shift(s, get("shift"))]
    if kind == "TimestampExtract":
        return [scalar.timestamp_extract(s)]
    if kind in ("GreaterThan", "LessThan", "EqualTo", "NotEqualTo"):
        return [scalar.keep(kind, s, get("value"), get("epsilon", 1e-10))]
    if kind.startswith("CompareSync"):
        return [sync.compare(kind[11:], data, get("tolerance", 0.0))]
    if kind.startswith("Compare"):
        return [scalar.compare(kind[7:], s, get("value"), get("tolerance", 0.0))]
    if kind.startswith("Sync"):
        return [sync.keep(kind, data, get("epsilon", 1e-10))]
    if kind.startswith("Logical"):
        return [sync.logic(kind, data)]
    if kind == "Linear":
        return [sync.linear(data, get("coefficients"))]
    if kind in SYNC:
        return [sync.arithmetic(kind, data)]
    if kind == "Join":
        return sync.join(data)
    if kind == "Demultiplexer":
        return sync.demultiplex(s, control)
    if kind == "Multiplexer":
        return [sync.multiplex(data, control)]
    if kind == "VectorCompose":
        return [sync.compose(data)]
    if kind == "VectorExtract":
        return [scalar.vector_extract(s, get("index"))]
    if kind == "VectorProject":
        return [scalar.vector_project(s, get("indices"))]
    if kind == "Variable":
        return [timegrid.variable(s, control[0], get("default_value", 0.0))]
    if kind == "KeyedVariable":
        return [timegrid.keyed_variable(s, control[0], control[1] if len(control) > 1 else None, get("mode", "exists"), get("default_value", 0.0))]
    simple = {
        "MovingAverage": lambda: windows.moving_average(s, get("window_size")), "MovingSum": lambda: windows.moving_sum(s, get("window_size")), "StandardDeviation": lambda: windows.standard_deviation(s, get("window_size")),
        "WindowMinMax": lambda: windows.window_min_max(s, get("window_size"), get("mode", "min")), "MovingKeyCount": lambda: windows.moving_key_count(s, get("window_size")), "Difference": lambda: windows.difference(s, get("use_oldest_time", True)),
        "PeakDetector": lambda: windows.peaks(s, get("window_size")), "FiniteImpulseResponse": lambda: windows.fir(s, get("coeff")), "CumulativeSum": lambda: windows.cumulative_sum(s), "CountNumber": lambda: windows.count(s),
        "CountBoolean": lambda: windows.count(s), "MinTracker": lambda: windows.tracker(s, "min"), "MaxTracker": lambda: windows.tracker(s, "max"),
        "ResamplerConstant": lambda: timegrid.resample_constant(s, get("interval"), get("t0"), bool(int(get("snapFirst", 0)))), "ResamplerHermite": lambda: timegrid.resample_hermite(s, get("interval")),
        "InfiniteImpulseResponse": lambda: folds.iir(s, get("b_coeffs", get("b")), get("a_coeffs", get("a", []))), "RelativeStrengthIndex": lambda: folds.rsi(s, get("n", get("window_size"))),
        "TopK": lambda: folds.top_k(s, get("k"), get("score_index"), str(get("descending", "true")).lower() == "true"),
    }
    if kind in simple:
        return [simple[kind]()]
    if kind in ("FusedExpression", "FusedExpressionVector"):
        if bytecode.needs_fold(bytecode.parse(get("bytecode"))):
            return [folds.single(spec, [sync.compose(data)] if kind == "FusedExpression" else data, VEC) if kind == "FusedExpressionVector" else folds.single(dict(spec, type="FusedExpressionVector"), [sync.compose(data)], VEC)]
        source = sync.compose(data) if kind == "FusedExpression" else s
        return [bytecode.fused(source, get("bytecode"), get("numOutputs"), get("constants", ()), get("coefficients", ()))]
    if kind == "BurstAggregate":
        if bytecode.needs_fold(bytecode.parse(get("aggBytecode"))):
            return [folds.single(spec, data, VEC)]
        return [segments.burst_aggregate(s, get("aggBytecode"), get("aggConstants", ()), get("segBytecode"), get("segConstants", ()), get("keyColumns", ()), get("numAggOutputs", 1))]
    body = body_of(spec)
    if body.cyclic() or kind == "TriggerSet":
        return folds.fold([*data, *control], lambda: Machine([spec], [], spec["id"], [(spec["id"], o) for o in range(len(ports(spec).out))]), list(ports(spec).out))
    if kind == "Pipeline":
        return segments.pipeline(data, control[0] if control else None, lambda own: compile_graph(body, own), get("segmentBytecode"), get("segmentConstants", ()))
    return [segments.keyed_pipeline(s, lambda own: compile_graph(body, [own])[0], get("key_index"), get("keyColumnIndices"))]


def compile_graph(graph: Graph, inputs: list[Signal], every: dict | None = None) -> list[Signal]:
    """The graph's outputs for signals at its entry's ports. A graph with cycles is one fold.

    ``every``, if given, receives all signals by (operator, output).
    """
    own = graph.by_id()
    if graph.cyclic():
        return folds.fold(accepted(inputs) if own[graph.entry]["type"] == "Input" else inputs, graph.machine, graph.kinds())
    made: dict[tuple[str, int], Signal | None] = {}
    feeds: dict[str, list] = {}
    for a, o, b, p, control in graph.edges:
        feeds.setdefault(b, []).append((control, p, a, o))

    def outputs_of(name: str) -> None:
        if (name, 0) in made:
            return
        spec, kind = own[name], ports(own[name])
        data: list = [None] * len(kind.data)
        control: list = [None] * len(kind.control)
        if name == graph.entry:
            data[: len(inputs)] = inputs
        for is_control, p, a, o in feeds.get(name, []):
            outputs_of(a)
            (control if is_control else data)[p] = made[a, o]
        if name != graph.entry and spec["type"] not in ("Input", "Output") and None in data or None in (control[:1] if spec["type"] == "KeyedVariable" else control):
            got: list = [None] * len(kind.out)  # a port that nothing feeds never gives a message
        else:
            got = build(spec, data, [c for c in control if c is not None])
        for o, s in enumerate(got):
            made[name, o] = s

    for name in own if every is not None else [n for n, _ in graph.outputs]:
        outputs_of(name)
    if every is not None:
        every.update({k: s for k, s in made.items() if s is not None})
    out = []
    for name, o in graph.outputs:
        if made[name, o] is None:
            raise ProgramError(f"nothing reaches output {o + 1} of {name}", "INVALID_OUTPUT_MAPPING", "/output")
        out.append(made[name, o])
    return out


def compile_program(program: str | dict | Graph, inputs: list[Signal], debug: bool = False) -> dict[tuple[str, str], Signal]:
    """{(operator, port): signal} of a program's outputs, or with ``debug`` of all its operators."""
    graph = program if isinstance(program, Graph) else load(program)
    every: dict = {}
    found = compile_graph(graph, inputs, every if debug and not graph.cyclic() else None)
    out = dict(zip(graph.labels, found, strict=True))
    return {(n, f"o{o + 1}"): s for (n, o), s in every.items()} | out if debug else out


def result_table(outputs: dict[tuple[str, str], Signal]):
    """One long table of all outputs: keys, op, port, t and the value as JSON."""
    from pyspark.sql import functions as F

    whole = None
    for (op, port), s in outputs.items():
        rows = s.df()
        t = "t" if "t" in rows.columns else "seq"
        rows = rows.select(*s.base.keys, F.lit(op).alias("op"), F.lit(port).alias("port"), F.col(t).alias("t"), F.to_json(F.struct("v")).alias("value"))
        whole = rows if whole is None else whole.unionByName(rows)
    return whole


__all__ = ["Graph", "ProgramError", "build", "check_operator", "compile_graph", "compile_program", "expand", "load", "ports", "result_table"]
