"""The host API: programs by id that take messages piece by piece or whole tables, and a builder for programs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from sigloom.plans import diagnostics
from sigloom.plans.interpreter import load_machine, save_machine
from sigloom.plans.program import ProgramError, compile_program, load, ports
from sigloom.plans.signal import Signal


class Program:
    """Builds a program's JSON operator by operator."""

    def __init__(self, entry: str | None = None, title: str = "", description: str = "", id: str = "program"):
        self.id, self.entry, self.title, self.description = id, entry, title, description
        self.operators: list[dict] = []
        self.connections: list[dict] = []
        self.output: dict[str, list[str]] = {}
        self.prototypes: dict[str, dict] = {}

    def add_operator(self, id: str, type: str, **fields) -> Program:
        self.operators.append({"id": id, "type": type, **fields})
        self.entry = self.entry or id
        return self

    def add_prototype(self, name: str, operators: list, connections: list, entry: dict | str, output: dict | str, parameters: list = ()) -> Program:
        end = lambda x: {"operator": x} if isinstance(x, str) else x
        self.prototypes[name] = {"parameters": list(parameters), "operators": list(operators), "connections": list(connections), "entry": end(entry), "output": end(output)}
        return self

    def add_prototype_instance(self, id: str, prototype: str, **parameters) -> Program:
        self.operators.append({"id": id, "prototype": prototype, "parameters": parameters})
        self.entry = self.entry or id
        return self

    def connect(self, source: str, target: str, from_port: str = "o1", to_port: str = "i1") -> Program:
        self.connections.append({"from": source, "to": target, "fromPort": from_port, "toPort": to_port})
        return self

    def add_output(self, operator: str, *names: str) -> Program:
        self.output.setdefault(operator, []).extend(names or ("o1",))
        return self

    def as_dict(self) -> dict:
        out = {"apiVersion": "v1", "entryOperator": self.entry, "output": self.output, "operators": self.operators, "connections": self.connections}
        out |= {k: v for k, v in (("title", self.title), ("description", self.description), ("prototypes", self.prototypes)) if v}
        return out

    def to_json(self) -> str:
        return json.dumps(self.as_dict())

    def validate(self) -> None:
        found = diagnostics.validate(self.as_dict())
        if not found["valid"]:
            raise ProgramError(found["error"])

    def to_mermaid(self) -> str:
        """The graph as a mermaid flowchart."""
        lines = ["flowchart LR"]
        lines += [f'  n{i}["{o["id"]}: {o.get("type", o.get("prototype"))}"]' for i, o in enumerate(self.operators)]
        at = {o["id"]: f"n{i}" for i, o in enumerate(self.operators)}
        lines += [f"  {at[c['from']]} -- {c['fromPort']} to {c['toPort']} --> {at[c['to']]}" for c in self.connections]
        return "\n".join(lines)

    def signals(self, inputs: list[Signal], debug: bool = False) -> dict[tuple[str, str], Signal]:
        return compile_program(self.as_dict(), inputs, debug)


class Engine:
    """Programs by id. Incremental calls run on the driver, for small pieces; ``run`` compiles to a Spark plan."""

    def __init__(self):
        self._programs: dict[str, dict] = {}

    def create_program(self, id: str, text: str | dict) -> str:
        """Empty if the program was made, else what is wrong."""
        if id in self._programs:
            return f"{id} is already taken by a program"
        try:
            graph = load(text)
        except ProgramError as wrong:
            return str(wrong)
        self._programs[id] = {"graph": graph, "machine": graph.machine(trace=True), "buffer": [], "vector": {}}
        return ""

    def delete_program(self, id: str) -> bool:
        return self._programs.pop(id, None) is not None

    def get_program_entry_operator_id(self, id: str) -> str:
        return self._programs[id]["graph"].entry if id in self._programs else ""

    validate_program = staticmethod(diagnostics.validate)
    validate_operator = staticmethod(diagnostics.validate_operator)
    diagnose_program = staticmethod(diagnostics.diagnose)

    def add_to_message_buffer(self, id: str, port: str, t: int, value) -> str:
        if id not in self._programs:
            return f"no program is called {id}"
        self._programs[id]["buffer"].append((port, int(t), value))
        return ""

    def begin_vector_message(self, id: str, port: str, t: int) -> None:
        self._programs[id]["vector"][port] = (int(t), [])

    def push_vector_message_value(self, id: str, port: str, value: float) -> None:
        self._programs[id]["vector"][port][1].append(float(value))

    def end_vector_message(self, id: str, port: str) -> None:
        t, values = self._programs[id]["vector"].pop(port)
        self._programs[id]["buffer"].append((port, t, values))

    def abort_vector_message(self, id: str, port: str) -> None:
        self._programs[id]["vector"].pop(port, None)

    def process_message_buffer(self, id: str, debug: bool = False) -> dict:
        """{operator: {port: [{time, value}]}} of all that was buffered."""
        own = self._programs[id]
        buffer, own["buffer"] = own["buffer"], []
        return self._process(own, buffer, debug)

    def process_message_buffer_debug(self, id: str) -> dict:
        return self.process_message_buffer(id, True)

    def process_batch(self, id: str, times: list[int], values: list, names: list[str], debug: bool = False) -> dict:
        """Messages given as columns of times, values and port names."""
        return self._process(self._programs[id], list(zip(names, times, values, strict=True)), debug)

    def process_batch_debug(self, id: str, times: list[int], values: list, names: list[str]) -> dict:
        return self.process_batch(id, times, values, names, True)

    def _process(self, own: dict, buffer: list, debug: bool) -> dict:
        graph, machine = own["graph"], own["machine"]
        kinds = ports(graph.by_id()[graph.entry]).data
        at = {f"i{i + 1}": i for i in range(len(kinds))}
        out: dict = {}

        def put(op: str, port: str, t: int, v) -> None:
            out.setdefault(op, {}).setdefault(port, []).append({"time": t, "value": v})

        for port, t, v in buffer:
            if port not in at:
                raise ProgramError(f"{port!r} is no port of the entry", "PORT_INDEX_OUT_OF_BOUNDS")
            got = machine.push([(at[port], t, v)])
            if debug:
                for n, o, u, w in machine.seen:
                    put(n, f"o{o + 1}", u, w)
            else:
                for i, u, w in got:
                    put(*graph.labels[i], u, w)
        return out

    def serialize_program_data(self, id: str) -> str:
        return json.dumps(save_machine(self._programs[id]["machine"]))

    def restore_program_data_from_json(self, id: str, text: str) -> None:
        load_machine(self._programs[id]["machine"], json.loads(text))

    def run(self, id: str, inputs: list[Signal], debug: bool = False) -> dict[tuple[str, str], Signal]:
        """The program over whole signals, as Spark plans."""
        return compile_program(self._programs[id]["graph"], inputs, debug)


class Run:
    """A program over a wide table: one row a time, one column a port; nulls are no message."""

    def __init__(self, program: Program, df: DataFrame, port_mappings: dict[str, str] | None = None, debug: bool = False):
        program.validate()
        if "time" not in df.columns:
            raise ValueError("the table has no column called time")
        self.program, self.df, self.debug = program, df, debug
        self.mappings = port_mappings or {c: c for c in df.columns if c != "time"}

    def exec(self, output_mappings: dict[str, str] | None = None) -> DataFrame:
        """One row for each input row: each output's value at that time (the last one), or null."""
        from pyspark.sql import functions as F

        graph = load(self.program.as_dict())
        n = len(ports(graph.by_id()[graph.entry]).data)
        inputs: list = [None] * n
        for column, port in self.mappings.items():
            inputs[int(port[1:]) - 1] = Signal.of(self.df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).select("time", F.col(column).cast("double").alias("x")), "time", "x")
        out = self.df.select(F.col("time").cast("long").alias("time"))
        for (op, port), s in compile_program(graph, inputs, self.debug).items():
            name = (output_mappings or {}).get(f"{op}:{port}", f"{op}:{port}")
            rows = s.df()
            order = F.struct(*[F.col(c) for c in s.base.order])
            rows = rows.groupBy(F.col("t").alias("time")).agg(F.max_by("v", order).alias(name))
            out = out.join(rows, "time", "left")
        return out


class Collector:
    """A sink without bound: what signals gave, by port, gathered on the driver. For small results and tests."""

    def __init__(self, signals: list[Signal]):
        self.ports = [[(r["t"], r["v"]) for r in s.df().orderBy(*s.base.order).collect()] for s in signals]

    def port(self, number: int) -> list[tuple]:
        return self.ports[number]


def pretty_print(results: str | dict) -> str:
    """Results ({operator: {port: [{time, value}]}}, or as JSON) as lines for people."""
    results = json.loads(results) if isinstance(results, str) else results
    lines = []
    for op, own in results.items():
        for port, messages in own.items():
            lines.append(f"{op}.{port}")
            lines += [f"  {m['time']:>12}  {m['value']}" for m in messages]
    return "\n".join(lines)


def pretty_print_validation(found: str | dict) -> str:
    """What ``validate`` or ``diagnose`` found as lines for people."""
    found = json.loads(found) if isinstance(found, str) else found
    if found["valid"]:
        return "nothing is wrong"
    return "\n".join([f"wrong: {found['error']}"] if "error" in found else [f"{e['code']} at {e['path'] or '/'}: {e['message']}" for e in found["errors"]])
