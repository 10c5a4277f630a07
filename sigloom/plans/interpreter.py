"""A message-at-a-time interpreter of operator graphs.

It runs what no window can express (feedback, cycles, reset on fire, code of the user) inside
grouped folds and streaming state, drives incremental sessions, and is the yardstick of the tests.
State is plain data, so a machine can be saved as JSON and taken up again.
"""

from __future__ import annotations

import base64
import bisect
import json
import math
from collections import deque

from sigloom.plans import bytecode

NAN, INF = math.nan, math.inf


def _safe(f):
    def g(*a):
        try:
            return float(f(*a))
        except ValueError:
            return NAN
        except OverflowError:
            return INF

    return g


def _log(x: float, f=math.log) -> float:
    return NAN if x < 0 or x != x else -INF if x == 0 else f(x)


def _round(x: float) -> float:
    if not math.isfinite(x) or abs(x) >= 2**53:
        return x
    low = math.floor(abs(x))
    return math.copysign(low + (abs(x) - low >= 0.5), x)


def _whole(f):
    return lambda x: float(f(x)) if math.isfinite(x) else x


def _divide(a: float, b: float) -> float:
    if b:
        return a / b
    return NAN if a != a or a == 0 else math.copysign(INF, a) * math.copysign(1, b)


def _sign(x: float) -> float:
    return float((x > 0) - (x < 0))


MAPS = {
    "Sin": _safe(math.sin), "Cos": _safe(math.cos), "Tan": _safe(math.tan), "Exp": _safe(math.exp), "Log": _log, "Log10": lambda x: _log(x, math.log10), "Abs": abs, "Sign": _sign,
    "Floor": _whole(math.floor), "Ceil": _whole(math.ceil), "Round": _round, "Identity": lambda x: x, "BooleanToNumber": float,
}
VALUED = {"Add": lambda x, c: x + c, "Scale": lambda x, c: x * c, "Power": _safe(math.pow)}
TESTS = {"GT": lambda a, b: a > b, "LT": lambda a, b: a < b, "GTE": lambda a, b: a >= b, "LTE": lambda a, b: a <= b}


def fold_logic(kind: str, values: list[bool]) -> bool:
    if kind in ("LogicalAnd", "LogicalNand"):
        return all(values) != (kind == "LogicalNand")
    if kind in ("LogicalOr", "LogicalNor"):
        return any(values) != (kind == "LogicalNor")
    out = values[0]
    for b in values[1:]:
        out = {"LogicalXor": out != b, "LogicalXnor": out == b, "LogicalImplication": not out or b}[kind]
    return out


def value_of(kind: str, spec: dict):
    """What a message's value becomes by an operator with a fixed value, if it is one."""
    if kind in VALUED:
        f, c = VALUED[kind], float(spec["value"])
        return lambda v: f(v, c)
    if kind.startswith("Constant"):
        return lambda _: spec["value"]
    return None


class Node:
    """One operator: queues of its data and control ports, and its state."""

    def __init__(self, spec: dict):
        self.spec, self.kind = spec, spec["type"]
        self.data: list[deque] = [deque() for _ in range(n_data(spec))]
        self.control: list[deque] = [deque() for _ in range(n_control(spec))]
        self.state: dict = {}
        # what a message's way through this node depends on is found once
        self._map = MAPS.get(self.kind) or value_of(self.kind, spec)
        self._together = self.kind in SYNC or self.kind in ("Join", "VectorCompose", "FusedExpression") or self.kind.startswith(("CompareSync", "Logical", "Sync"))
        self._code: list | None = None
        self._inner: dict[str, Node] = {}
        if self.kind in ("Pipeline", "KeyedPipeline", "TriggerSet"):
            self.state["inner"] = {} if self.kind == "KeyedPipeline" else inner_machine(spec)

    def fresh(self) -> None:
        """Forgets all messages; what was found about the operator and the graph inside it stays."""
        for q in (*self.data, *self.control):
            q.clear()
        inner = self.state.get("inner")
        self.state, self._inner = {}, {}
        if self.kind == "KeyedPipeline":
            self.state["inner"] = {}
        elif inner is not None:
            inner.fresh()
            self.state["inner"] = inner

    def step(self) -> list[tuple[int, int, object]]:
        """(output, t, value) of everything that the queued messages give."""
        kind = self.kind
        out: list = []
        if self._map:
            q, f = self.data[0], self._map
            while q:
                t, v = q.popleft()
                out.append((0, t, f(v)))
            return out
        if kind in ("Input", "Output"):
            for i, q in enumerate(self.data):
                while q:
                    t, v = q.popleft()
                    if kind == "Output" or t > self.state.get(f"last{i}", -(1 << 63)):
                        self.state[f"last{i}"] = t
                        out.append((i, t, v))
            return out
        if kind == "Demultiplexer":
            for t, (v, *flags) in matched([*self.data, *self.control]):
                out += [(i, t, v) for i, f in enumerate(flags) if f]
            return out
        if kind == "Multiplexer":
            return self.multiplex()
        if kind in ("Variable", "KeyedVariable"):
            return self.lookup()
        if kind == "Pipeline":
            return self.segments()
        if self._together:
            for t, values in matched(self.data):
                if kind == "Join":
                    out += [(i, t, v) for i, v in enumerate(values)]
                else:
                    got = self.together(t, values)
                    out += [(0, t, v) for v in got]
            return out
        q = self.data[0]
        while q:
            t, v = q.popleft()
            out += [(0, u, w) for u, w in self.one(t, v)]
        return out

    # --- several ports
    def together(self, t: int, values: list) -> list:
        kind, s = self.kind, self.spec
        first, rest = values[0], values[1:]
        if kind == "VectorCompose":
            return [list(values)]
        if kind == "FusedExpression":
            return self.run_code(list(values))
        if kind.startswith("Logical"):
            return [fold_logic(kind, values)]
        if kind.startswith("CompareSync"):
            test = kind[11:]
            tol = float(s.get("tolerance", 0.0))
            d = abs(first - rest[0])
            return [TESTS[test](first, rest[0]) if test in TESTS else d <= tol if test == "EQ" else d > tol]
        if kind.startswith("Sync"):
            eps = float(s.get("epsilon", 1e-10))
            ok = {"SyncGreaterThan": lambda o: first > o, "SyncLessThan": lambda o: first < o, "SyncEqual": lambda o: abs(first - o) < eps, "SyncNotEqual": lambda o: abs(first - o) >= eps}[kind]
            return [first] if all(map(ok, rest)) else []
        if kind == "Linear":
            return [sum(float(c) * v for c, v in zip(s["coefficients"], values, strict=True))]
        if kind == "Division" and not all(rest):
            return []
        for b in rest:
            first = {"Addition": first + b, "Subtraction": first - b, "Multiplication": first * b}[kind] if kind != "Division" else first / b
        return [first]

    def multiplex(self) -> list:
        out = []
        while all(self.control):
            top = max(c[0][0] for c in self.control)
            for c in self.control:
                while c and c[0][0] < top:
                    c.popleft()
            if not all(self.control) or any(c[0][0] != top for c in self.control):
                continue
            on = [i for i, c in enumerate(self.control) if c[0][1]]
            if len(on) == 1:
                q = self.data[on[0]]
                while q and q[0][0] < top:
                    q.popleft()
                if not q:
                    break
                if q[0][0] == top:
                    out.append((0, *q.popleft()))
            for c in self.control:
                c.popleft()
            for q in self.data:
                while q and q[0][0] <= top:
                    q.popleft()
        return out

    def lookup(self) -> list:
        out, st, keyed = [], self.state, self.kind == "KeyedVariable"
        if keyed and len(self.control) > 1:
            for t, _ in self.control[1]:
                st["now"] = max(st.get("now", t), t)
            self.control[1].clear()
        log = st["log"] = deque(st.get("log", ()))
        for t, v in self.data[0]:
            log.append([t, v])
            st["now"] = max(st.get("now", t), t)
        self.data[0].clear()
        asked, table = self.control[0], st.setdefault("table", {})
        while asked and asked[0][0] <= st.get("now", -INF):
            t, k = asked.popleft()
            while log and log[0][0] <= t:
                _, v = log.popleft()
                if keyed and v[1] == v[1]:
                    table[v[0]] = v[1]
                elif keyed:
                    table.pop(v[0], None)
                else:
                    st["value"] = v
            if not keyed:
                out.append((0, t, st.get("value", float(self.spec.get("default_value", 0.0)))))
            else:
                default = float(self.spec.get("default_value", 0.0))
                out.append((0, t, k in table if self.spec.get("mode", "exists") == "exists" else table.get(k, default)))
        return out

    def segments(self) -> list:
        out, st, code = [], self.state, self.spec.get("segmentBytecode")
        rows = [(t, [v], self.code_value(v)) for t, v in drain(self.data[0])] if code else [(t, v[:-1], v[-1]) for t, v in matched([*self.data, *self.control])]
        for t, values, key in rows:
            if "key" in st and st["key"] != key:
                out += [(int(i), t, v) for i, v in st["held"].items()]
                st["inner"].fresh()
                st["held"] = {}
            st["key"] = key
            st.setdefault("held", {})
            for i, _, v in st["inner"].push([(k, t, v) for k, v in enumerate(values)]):
                st["held"][str(i)] = v
        return out

    def code_value(self, v):
        return self._scratch("segmentBytecode", "segmentConstants", 1).run_code(v)[0][0]

    def _scratch(self, code: str, constants: str, outputs: int) -> Node:
        """A node that runs one of the programs of this one."""
        if code not in self._inner:
            self._inner[code] = Node({"type": "FusedExpressionVector", "bytecode": self.spec[code], "constants": self.spec.get(constants, []), "numOutputs": outputs})
        return self._inner[code]

    # --- one port
    def one(self, t: int, v) -> list[tuple[int, object]]:
        kind, s, st = self.kind, self.spec, self.state
        if kind in ("GreaterThan", "LessThan", "EqualTo", "NotEqualTo"):
            c, eps = float(s["value"]), float(s.get("epsilon", 1e-10))
            ok = {"GreaterThan": v > c, "LessThan": v < c, "EqualTo": abs(v - c) <= eps, "NotEqualTo": abs(v - c) > eps}[kind]
            return [(t, v)] if ok else []
        if kind.startswith("Compare"):
            c, tol, test = float(s["value"]), float(s.get("tolerance", 0.0)), kind[7:]
            return [(t, TESTS[test](v, c) if test in TESTS else abs(v - c) <= tol if test == "EQ" else abs(v - c) > tol)]
        if kind == "LessThanOrEqualToReplace":
            return [(t, float(s["replaceBy"]) if v <= float(s["value"]) else v)] if math.isfinite(v) else []
        if kind == "TimeShift":
            return [(t + int(s["shift"]), v)] if t + int(s["shift"]) >= 0 else []
        if kind == "TimestampExtract":
            return [(t, float(t))]
        if kind == "Function":
            return [(t, interpolated(s["points"], v, s.get("interpolation", "linear")))]
        if kind == "VectorExtract":
            return [(t, v[int(s["index"])])]
        if kind == "VectorProject":
            return [(t, [v[int(i)] for i in s["indices"]])]
        if kind == "CumulativeSum":
            st["sum"] = st.get("sum", 0.0) + v
            return [(t, st["sum"])]
        if kind in ("CountNumber", "CountBoolean"):
            st["n"] = st.get("n", 0) + 1
            return [(t, float(st["n"]))]
        if kind in ("MinTracker", "MaxTracker"):
            best = st.get("best", INF if kind == "MinTracker" else -INF)
            st["best"] = v if (v < best if kind == "MinTracker" else v > best) else best
            return [(t, st["best"])]
        if kind in ("FusedExpressionVector",):
            return [(t, x) for x in self.run_code(v)]
        if kind == "TopK":
            rows, i, down = st.setdefault("rows", []), int(s["score_index"]), str(s.get("descending", "true")).lower() == "true"
            keys = [-r[i] if down else r[i] for r in rows]
            rows.insert(bisect.bisect_left(keys, -v[i] if down else v[i]), list(v))
            del rows[int(s["k"]) :]
            return [(t, list(r)) for r in rows]
        if kind in ("ResamplerConstant", "ResamplerHermite"):
            return self.resample(t, v)
        if kind == "KeyedPipeline":
            return self.keyed(t, v)
        if kind == "TriggerSet":
            fired = st["inner"].push([(0, t, v)])
            if not fired:
                return []
            st["inner"].fresh()
            return [(fired[0][1], fired[0][2])]
        if kind == "BurstAggregate":
            return self.burst(t, v)
        return self.windowed(t, v)

    def windowed(self, t: int, v) -> list:
        kind, s, st = self.kind, self.spec, self.state
        buf = st.setdefault("buf", [])
        buf.append([t, v])
        if kind == "Difference":
            if len(buf) < 2:
                return []
            (t0, a), (t1, b) = buf
            del buf[0]
            return [(t1 if s.get("use_oldest_time", True) else t0, b - a)]
        if kind == "InfiniteImpulseResponse":
            b, a = s.get("b_coeffs", s.get("b")), s.get("a_coeffs", s.get("a"))
            del buf[: -len(b)]
            if len(buf) < len(b):
                return []
            past = st.setdefault("y", [])
            y = sum(float(c) * buf[-1 - i][1] for i, c in enumerate(b)) - sum(float(c) * p for c, p in zip(a, reversed(past), strict=False))
            past.append(y)
            del past[: max(0, len(past) - len(a))]
            return [(t, y)]
        if kind == "RelativeStrengthIndex":
            n = int(s["n"] if "n" in s else s["window_size"])
            del buf[: -(n + 1)]
            if len(buf) <= n:
                return []
            if "gain" not in st:
                steps = [y[1] - x[1] for x, y in zip(buf, buf[1:], strict=False)]
                st["gain"], st["loss"] = sum(max(d, 0.0) for d in steps) / n, sum(max(-d, 0.0) for d in steps) / n
            else:
                d = buf[-1][1] - buf[-2][1]
                st["gain"], st["loss"] = (st["gain"] * (n - 1) + max(d, 0.0)) / n, (st["loss"] * (n - 1) + max(-d, 0.0)) / n
            return [(t, 100.0 - 100.0 / (1.0 + st["gain"] / st["loss"]) if st["loss"] > 0 else 100.0)]
        n = len(s["coeff"]) if kind == "FiniteImpulseResponse" else int(s["window_size"])
        if kind in ("MovingAverage", "MovingSum"):
            total = rolled(st, buf, n)
            return [] if total is None else [(t, total / n if kind == "MovingAverage" else total)]
        del buf[:-n]
        x = [y for _, y in buf]
        if kind == "MovingKeyCount":
            return [(t, float(sum(y == v for y in x)))]
        if len(buf) < n:
            return []
        if kind == "StandardDeviation":
            mean = math.fsum(x) / n
            return [(t, math.sqrt(math.fsum((y - mean) ** 2 for y in x) / (n - 1)) if n > 1 else 0.0)]
        if kind == "WindowMinMax":
            return [(t, extreme(x, s.get("mode", "min") == "min"))]
        if kind == "FiniteImpulseResponse":
            return [(t, sum(float(c) * y for c, y in zip(s["coeff"], reversed(x), strict=True)))]
        if kind == "PeakDetector":
            h = n // 2
            return [tuple(buf[h])] if not any(y >= x[h] for i, y in enumerate(x) if i != h) else []
        raise ValueError(f"no operator is of type {kind!r}")

    def resample(self, t: int, v) -> list:
        s, st, dt, out = self.spec, self.state, int(self.spec["interval"]), []
        if self.kind == "ResamplerHermite":
            p = st.setdefault("p", [])
            p.append([t, v])
            if len(p) == 2 and "next" not in st:
                st["next"] = t
            if len(p) < 4:
                return []
            (_, a), (t1, b), (t2, c), (_, d) = p[-4:]
            del p[:-3]
            while st["next"] <= t2:
                u = (st["next"] - t1) / (t2 - t1)
                out.append((st["next"], (2 * u**3 - 3 * u**2 + 1) * b + (u**3 - 2 * u**2 + u) * (c - a) / 2 + (u**3 - u**2) * (d - b) / 2 + (3 * u**2 - 2 * u**3) * c))
                st["next"] += dt
            return out
        snap, t0 = bool(int(s.get("snapFirst", 0))), s.get("t0")
        if "next" not in st:
            if snap:
                o = int(t0 or 0)
                st["next"] = o + (t - o) // dt * dt
            elif t0 is None:
                st["next"] = t + dt
            else:
                st["next"] = int(t0) if t < int(t0) else int(t0) + ((t - int(t0)) // dt + 1) * dt
            if not snap:
                st["v"] = v
                return []
        while st["next"] <= t:
            out.append((st["next"], v if snap or st["next"] == t else st["v"]))
            st["next"] += dt
        st["v"] = v
        return out

    def keyed(self, t: int, v) -> list:
        s, inner = self.spec, self.state["inner"]
        columns = s.get("keyColumnIndices")
        key = json.dumps([v[int(i)] for i in columns] if columns else v[int(s["key_index"])])
        if key not in inner:
            inner[key] = inner_machine(s)
        out = []
        for _, _, x in inner[key].push([(0, t, v)]):
            x = list(x) if isinstance(x, list) else [x]
            out.append((t, x if columns else [v[int(s["key_index"])], *x]))
        return out

    def burst(self, t: int, v) -> list:
        s, st, out = self.spec, self.state, []
        key = self._scratch("segBytecode", "segConstants", 1).run_code(v)[0][0] if s.get("segBytecode") else 0.0
        if "key" in st and st["key"] != key:
            out.append((t, [v[int(k)] for k in s.get("keyColumns", [])] + st["held"]))
            st.pop("slots", None)
            st.pop("rings", None)
        st["key"] = key
        agg = self._scratch("aggBytecode", "aggConstants", s.get("numAggOutputs", 1))
        agg.state = st
        st["held"] = agg.run_code(v, always=True)[0]
        return out

    def run_code(self, row: list[float], always: bool = False) -> list[list[float]]:
        """[outputs] of the fused program for one row, or [] if it suppresses the row."""
        s, st = self.spec, self.state
        constants, coefficients = s.get("constants", []), s.get("coefficients", [])
        slots, rings = st.setdefault("slots", {}), st.setdefault("rings", {})
        stack: list[float] = []
        outs, emit = [], True
        if self._code is None:
            self._code = bytecode.parse(s["bytecode"])
        for at, (name, *args) in enumerate(self._code):
            slot = str(args[0]) if args else ""
            if name == "INPUT":
                stack.append(float(row[args[0]]))
            elif name == "CONST":
                stack.append(float(constants[args[0]]))
            elif name == "END":
                outs.append(stack.pop())
                stack.clear()
            elif name == "GATE":
                emit &= stack.pop() != 0
            elif name == "STATE_LOAD":
                stack.append(slots.get(slot, 0.0))
            elif name == "COUNT":
                slots[slot] = slots.get(slot, 0.0) + 1
                stack.append(slots[slot])
            elif name in BINARY:
                b, a = stack.pop(), stack.pop()
                stack.append(float(BINARY[name](a, b)))
            elif name in UNARY:
                stack.append(float(UNARY[name](stack.pop())))
            elif name == "CUMSUM":
                slots[slot] = slots.get(slot, 0.0) + stack.pop()
                stack.append(slots[slot])
            elif name in ("MAX_AGG", "MIN_AGG"):
                x, best = stack.pop(), slots.get(slot, -INF if name == "MAX_AGG" else INF)
                slots[slot] = x if (x > best if name == "MAX_AGG" else x < best) else best
                stack.append(slots[slot])
            else:
                ring, x = rings.setdefault(str(at), []), stack.pop()
                ring.append(x)
                n = {"DIFF": 2, "SIGN_CHANGE": 2, "FIR_UPDATE": args[-1] if args else 0}.get(name, args[0])
                del ring[:-n]
                if len(ring) < n:
                    emit = False
                    stack.append(0.0)
                elif name in ("DIFF", "SIGN_CHANGE"):
                    d = ring[1] - ring[0]
                    stack.append(d if name == "DIFF" else _sign(d))
                elif name == "FIR_UPDATE":
                    stack.append(sum(float(coefficients[args[0] + i]) * ring[-1 - i] for i in range(n)))
                elif name == "IIR_UPDATE":
                    nb, na, start = args
                    past = rings.setdefault(f"y{at}", [])
                    y = sum(float(coefficients[start + i]) * ring[-1 - i] for i in range(nb)) - sum(float(coefficients[start + nb + i]) * p for i, p in enumerate(reversed(past)))
                    past.append(y)
                    del past[: max(0, len(past) - na)]
                    stack.append(y)
                elif name in ("WIN_MIN", "WIN_MAX"):
                    stack.append(extreme(ring, name == "WIN_MIN"))
                else:
                    total = math.fsum(ring)
                    mean = total / n
                    stack.append(total if name == "MSUM_UPDATE" else mean if name == "MA_UPDATE" else math.sqrt(math.fsum((y - mean) ** 2 for y in ring) / (n - 1)) if n > 1 else NAN)
        return [outs] if emit or always else []


BINARY = {
    "ADD": lambda a, b: a + b, "SUB": lambda a, b: a - b, "MUL": lambda a, b: a * b, "DIV": _divide, "POW": _safe(math.pow), "GT": lambda a, b: a > b, "GTE": lambda a, b: a >= b, "LT": lambda a, b: a < b,
    "LTE": lambda a, b: a <= b, "EQ": lambda a, b: a == b, "NEQ": lambda a, b: a != b, "AND": lambda a, b: a != 0 and b != 0, "OR": lambda a, b: a != 0 or b != 0,
}
UNARY = {
    "ABS": abs, "SQRT": _safe(math.sqrt), "LOG": _log, "LOG10": lambda x: _log(x, math.log10), "EXP": _safe(math.exp), "SIN": _safe(math.sin), "COS": _safe(math.cos), "TAN": _safe(math.tan), "SIGN": _sign,
    "FLOOR": _whole(math.floor), "CEIL": _whole(math.ceil), "ROUND": _round, "NEG": lambda x: -x, "NOT": lambda x: x == 0,
}
SYNC = {"Addition", "Subtraction", "Multiplication", "Division", "Linear"}


def extreme(values: list[float], least: bool) -> float:
    """The smallest or largest value; NaN is passed over unless there is nothing else."""
    plain = [x for x in values if x == x]
    return (min(plain) if least else max(plain)) if plain else NAN


def rolled(state: dict, buf: list, n: int) -> float | None:
    """The sum of the last n values of ``buf`` ([t, value] each, the newest just added), or None before there are n.

    A running sum with compensation; it is taken anew every n messages and where a value isn't finite,
    so that rounding can't pile up and an infinity or NaN leaves with its message.
    """
    if len(buf) > n:
        gone = buf[-n - 1][1]
        del buf[:-n]
    else:
        gone = None
    if len(buf) < n:
        return None
    age, new = state.get("age", n), buf[-1][1]
    if age >= n or gone is None or not math.isfinite(state["sum"] + gone + new):
        state["sum"], state["low"], state["age"] = math.fsum(y for _, y in buf) if all(math.isfinite(y) for _, y in buf) else sum(y for _, y in buf), 0.0, 1
    else:
        for y in (new, -gone):
            y += state["low"]
            total = state["sum"] + y
            state["low"] = y - (total - state["sum"])
            state["sum"] = total
        state["age"] = age + 1
    return state["sum"] + state["low"]


def interpolated(points: list, x: float, kind: str = "linear") -> float:
    pts = sorted((float(p[0]), float(p[1])) for p in points)
    i = min(max(bisect.bisect_right([p[0] for p in pts], x) - 1, 0), len(pts) - 2)
    (x0, y0), (x1, y1) = pts[i], pts[i + 1]
    u = (x - x0) / (x1 - x0) if x1 != x0 else 0.0
    if kind == "linear":
        return y0 + u * (y1 - y0)

    def slope(k: int) -> float:
        a, b = pts[max(k - 1, 0)], pts[min(k + 1, len(pts) - 1)]
        return (b[1] - a[1]) / (b[0] - a[0]) if b[0] != a[0] else 0.0

    return (2 * u**3 - 3 * u**2 + 1) * y0 + (u**3 - 2 * u**2 + u) * slope(i) + (3 * u**2 - 2 * u**3) * y1 + (u**3 - u**2) * slope(i + 1)


def drain(q: deque) -> list:
    out = list(q)
    q.clear()
    return out


def matched(queues: list[deque]):
    """Values of all queues at the times that all have, oldest first; what can't match any more is dropped."""
    while all(queues):
        times = [q[0][0] for q in queues]
        top = max(times)
        if min(times) == top:
            yield top, [q.popleft()[1] for q in queues]
            continue
        for q in queues:
            while q and q[0][0] < top:
                q.popleft()


def n_data(s: dict) -> int:
    kind = s["type"]
    if kind in ("Input", "Output", "Join"):
        return len(s["portTypes"])
    if kind == "Linear":
        return len(s["coefficients"])
    if kind in SYNC or kind.startswith(("Logical", "Sync")) or kind in ("Multiplexer", "VectorCompose", "FusedExpression"):
        return int(s.get("numPorts", 2))
    if kind.startswith("CompareSync"):
        return 2
    return len(s["input_port_types"]) if kind == "Pipeline" else 1


def n_control(s: dict) -> int:
    kind = s["type"]
    if kind == "Demultiplexer":
        return int(s.get("numPorts", 1))
    if kind == "Multiplexer":
        return int(s.get("numPorts", 2))
    return {"Variable": 1, "KeyedVariable": 2, "Pipeline": 0 if s.get("segmentBytecode") else 1}.get(kind, 0)


class Machine:
    """A graph of nodes. ``edges``: (from, output, to, port, is control); ``outputs``: (node, output) in order."""

    def __init__(self, specs: list[dict], edges: list[tuple], entry: str, outputs: list[tuple[str, int]], trace: bool = False):
        self.nodes = {s["id"]: Node(s) for s in specs}
        self.entry, self.outputs, self.trace = entry, list(outputs), trace
        self.children: dict = {}
        for a, o, b, p, control in edges:
            self.children.setdefault(a, []).append((o, b, p, control))
        self.gives: dict = {}
        for i, (n, o) in enumerate(self.outputs):
            self.gives.setdefault(n, []).append((i, o))
        self.seen: list = []

    def fresh(self) -> None:
        """As it was before the first message."""
        self.seen = []
        for node in self.nodes.values():
            node.fresh()

    def push(self, messages: list[tuple[int, int, object]]) -> list[tuple[int, int, object]]:
        """Feeds (port, t, value) to the entry node, control ports after data ports; returns (output number, t, value)."""
        out: list = []
        self.seen = []
        entry = self.nodes[self.entry]
        for p, t, v in messages:
            (entry.data[p] if p < len(entry.data) else entry.control[p - len(entry.data)]).append((t, v))
        self.run(self.entry, out)
        return out

    def run(self, name: str, out: list) -> None:
        got = self.nodes[name].step()
        if not got:
            return
        if self.trace:
            self.seen += [(name, *g) for g in got]
        given = self.gives.get(name)
        if given:
            out += [(i, t, v) for o, t, v in got for i, p in given if p == o]
        touched: list = []
        for o, child, p, control in self.children.get(name, []):
            fed = [(t, v) for x, t, v in got if x == o]
            if fed:
                node = self.nodes[child]
                (node.control if control else node.data)[p].extend(fed)
                if child not in touched:
                    touched.append(child)
        for child in touched:
            self.run(child, out)


# --- state as JSON ---------------------------------------------------------------------------


def _pack(x):
    if isinstance(x, Machine):
        return {"machine": {n: _pack({"data": [list(q) for q in node.data], "control": [list(q) for q in node.control], "state": node.state}) for n, node in x.nodes.items()}}
    if isinstance(x, dict):
        return {"map": [[k, _pack(v)] for k, v in x.items()]}
    if isinstance(x, (list, tuple, deque)):
        return [_pack(v) for v in x]
    return x


def _unpack(x, make=None):
    if isinstance(x, dict) and "map" in x:
        return {k: _unpack(v, make) for k, v in x["map"]}
    if isinstance(x, dict) and "machine" in x:
        machine = make()
        restore_machine(machine, x)
        return machine
    return [_unpack(v, make) for v in x] if isinstance(x, list) else x


def save_machine(machine: Machine) -> dict[str, dict]:
    """{operator: {name, bytes}} with each node's queues and state in base64."""
    packed = _pack(machine)["machine"]
    return {n: {"name": machine.nodes[n].kind, "bytes": base64.b64encode(json.dumps(p).encode()).decode()} for n, p in packed.items()}


def load_machine(machine: Machine, saved: dict[str, dict]) -> None:
    restore_machine(machine, {"machine": {n: json.loads(base64.b64decode(s["bytes"])) for n, s in saved.items()}})


def restore_machine(machine: Machine, packed: dict) -> None:
    for n, p in packed["machine"].items():
        node = machine.nodes[n]
        own = _unpack(p, lambda node=node: inner_machine(node.spec))
        node.data = [deque(tuple(m) for m in q) for q in own["data"]]
        node.control = [deque(tuple(m) for m in q) for q in own["control"]]
        node.state = own["state"]


def inner_machine(spec: dict) -> Machine:
    """The body of a composite operator."""
    from sigloom.plans.program import body_of

    body = body_of(spec)
    return Machine(body.specs, body.edges, body.entry, body.outputs)
