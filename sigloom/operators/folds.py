"""What no window expresses: a machine runs over each key's messages, in time order.

Used for feedback filters, RSI, reset on fire, top-k snapshots, graphs with cycles and code of the
user. Messages are dealt by key and sorted by key and time once; each task then reads its sorted rows
as a stream of Arrow batches and takes up a fresh machine where a key begins. A task holds one batch
and one machine, however many messages a key has; the sort spills. Keys run in parallel.

Rows hold columns of the types that ports have and no others, and no null in place of a list: the
size of a batch is taken at every row, and a list column is then gone through from its last list on.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.plans.interpreter import Machine
from sigloom.plans.signal import Base, Signal

KINDS = {"number": ("num", "double"), "boolean": ("flag", "boolean"), "vector_number": ("vec", "array<double>"), "vector_boolean": ("flags", "array<boolean>")}


def kind_of(signal: Signal) -> str:
    simple = signal.base.df.schema[signal.name].dataType.simpleString()
    return {"double": "number", "boolean": "boolean", "array<double>": "vector_number", "array<boolean>": "vector_boolean"}.get(simple, "number")


def tagged(inputs: list[Signal]) -> DataFrame:
    """All messages of all ports in one table: keys, t, seq, p (port) and a value column for each type that a port has."""
    whole, used = None, [KINDS[k] for k in KINDS if k in map(kind_of, inputs)]
    for p, s in enumerate(inputs):
        rows = s.df()
        seq = F.col("seq").cast("long") if "seq" in rows.columns else F.lit(0).cast("long")
        own, _ = KINDS[kind_of(s)]
        t = F.col("t") if "t" in rows.columns else F.col("seq")
        values = [(F.col("v") if n == own else F.array() if k.startswith("array") else F.lit(None)).cast(k).alias(n) for n, k in used]
        rows = rows.select(*s.base.keys, t.cast("long").alias("t"), seq.alias("seq"), F.lit(p).alias("p"), *values)
        whole = rows if whole is None else whole.unionByName(rows)
    return whole


def _together(inputs: list[Signal]) -> bool:
    """Whether a row of one base can hold the messages of all ports: its times are unique, so they keep their order."""
    base = inputs[0].base
    return base.strict and base.order == ("t",) and all(s.base is base for s in inputs)


def wide(inputs: list[Signal]) -> DataFrame:
    """The messages of signals of one base: keys, t, a value column for each port, and for those that skip rows one that tells."""
    base, flags = inputs[0].base, {p: F.col(s.valid) for p, s in enumerate(inputs) if s.valid is not None}
    rows = base.df.where(reduce(lambda a, b: a | b, flags.values())) if len(flags) == len(inputs) else base.df
    values = [s.v.cast(KINDS[kind_of(s)][1]).alias(f"_v{p}") for p, s in enumerate(inputs)]
    return rows.select(*base.keys, F.col("t").cast("long").alias("t"), *values, *[f.alias(f"_on{p}") for p, f in flags.items()])


def messages(pdf, kinds: list[str]):
    """(port, t, value) of a sorted pandas frame of ``tagged`` rows."""
    columns = {k: pdf[KINDS[k][0]].tolist() for k in set(kinds)}
    for i, (p, t) in enumerate(zip(pdf["p"].tolist(), pdf["t"].tolist(), strict=True)):
        v = columns[kinds[p]][i]
        yield p, t, [x for x in v] if kinds[p].startswith("vector") else v


def _list(column, kind: str) -> list:
    """The values of a type as a Python list; a number that is null is NaN."""
    return column.fill_null(math.nan).to_pylist() if kind == "number" and column.null_count else column.to_pylist()


def _ports(batch, kinds: list[str], together: bool) -> list[tuple[int, list, list | None]]:
    """(port, values by row, whether a row is one of its messages by row, None for all) of each port."""
    if not together:
        lists = {k: _list(batch.column(KINDS[k][0]), k) for k in set(kinds)}
        return [(p, lists[k], None) for p, k in enumerate(kinds)]
    names = batch.schema.names
    return [(p, _list(batch.column(f"_v{p}"), k), batch.column(f"_on{p}").to_pylist() if f"_on{p}" in names else None) for p, k in enumerate(kinds)]


def _same(a, b) -> bool:
    """Whether two keys are one; a NaN is the same as another."""
    return a == b or all(x == y or x != x and y != y for x, y in zip(a, b, strict=True))


def fold(inputs: list[Signal], make: Callable[[], Machine], output_kinds: list[str]) -> list[Signal]:
    """The outputs of a fresh machine for each key. Messages of equal times come by port."""
    keys, kinds, together = list(inputs[0].base.keys), [kind_of(s) for s in inputs], _together(inputs)
    rows = wide(inputs) if together else tagged(inputs)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    output_kinds, width = list(output_kinds), len(keys)
    given = [k for k in KINDS if k in output_kinds]
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "t long, seq long, o int", *[f"{KINDS[k][0]} {KINDS[k][1]}" for k in given]])

    def run(batches):
        import pyarrow as pa

        plain = {"number": pa.float64(), "boolean": pa.bool_(), "vector_number": pa.list_(pa.float64()), "vector_boolean": pa.list_(pa.bool_())}
        rest = [pa.field("t", pa.int64()), pa.field("seq", pa.int64()), pa.field("o", pa.int32()), *[pa.field(KINDS[k][0], plain[k]) for k in given]]
        final = None
        machine, now, seq = None, None, 0

        def packed(rows):
            columns = [pa.array([r[0][i] for r in rows], final.field(i).type) for i in range(width)]
            columns += [pa.array([r[2] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int32())]
            for kind in given:
                values = [(float(r[4]) if kind == "number" else r[4]) if output_kinds[r[3]] == kind else None for r in rows]
                columns.append(pa.array(values, plain[kind]))
            return pa.RecordBatch.from_arrays(columns, schema=final)

        for batch in batches:
            if final is None:
                final = pa.schema([*[batch.schema.field(i) for i in range(width)], *rest])
            own = list(zip(*[batch.column(i).to_pylist() for i in range(width)], strict=True)) if keys else [()] * batch.num_rows
            every, out = _ports(batch, kinds, together), []
            here = [every] * batch.num_rows if together else [(every[p],) for p in batch.column("p").to_pylist()]
            for i, (key, t, fed) in enumerate(zip(own, batch.column("t").to_pylist(), here, strict=True)):
                if machine is None:
                    machine, now = make(), key
                elif key != now and not _same(key, now):
                    machine.fresh()
                    now, seq = key, 0
                for p, values, on in fed:
                    if on is None or on[i]:
                        for o, u, v in machine.push([(p, t, values[i])]):
                            out.append((now, seq, u, o, v))
                            seq += 1
                if len(out) >= 1 << 15:
                    yield packed(out)
                    out = []
            if out:
                yield packed(out)

    # A fixed number of partitions: machines take far longer than the bytes that AQE would join tasks by. Rows that are
    # dealt by their keys already would not be dealt again, and AQE would join those tasks; by a hash of the keys they are.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, F.hash(*keys)) if keys else rows.repartition(1)
    order = [*keys, "t"] if together else [*keys, "t", "seq", "p"]
    done = dealt.sortWithinPartitions(*order).mapInArrow(run, schema)
    return [Signal(Base(done.where(F.col("o") == o).select(*keys, "t", "seq", F.col(KINDS[k][0]).alias("v")), tuple(keys), ("t", "seq")), "v") for o, k in enumerate(output_kinds)]


def single(spec: dict, inputs: list[Signal], output_kind: str = "number") -> Signal:
    """One operator as a fold."""
    spec = {"id": "op", **spec}
    return fold(inputs, lambda: Machine([spec], [], "op", [("op", 0)]), [output_kind])[0]


def iir(s: Signal, b: list[float], a: list[float]) -> Signal:
    """y = sum of b x - sum of a y of before, from as many messages on as ``b`` has; what is not there yet counts 0."""
    if not b:
        raise ValueError("a feedback filter without b coefficients")
    return single({"type": "InfiniteImpulseResponse", "b_coeffs": list(b), "a_coeffs": list(a)}, [s])


def rsi(s: Signal, n: int) -> Signal:
    """Relative strength index with Wilder's smoothing over ``n`` steps; 100 without losses."""
    return single({"type": "RelativeStrengthIndex", "n": int(n)}, [s])


def top_k(s: Signal, k: int, score_index: int, descending: bool = True) -> Signal:
    """After every message all k best rows, best first, at its time; ``seq`` has their order."""
    return single({"type": "TopK", "k": int(k), "score_index": int(score_index), "descending": "true" if descending else "false"}, [s], "vector_number")


class Code:
    """A machine of one function of the user: ``process(state, port, t, value)`` gives (output, t, value) tuples."""

    def __init__(self, process: Callable):
        self.process, self.state = process, {}

    def fresh(self) -> None:
        self.state = {}

    def push(self, got: list[tuple[int, int, object]]) -> list[tuple[int, int, object]]:
        return [m for p, t, v in got for m in self.process(self.state, p, t, v) or ()]


def udf_operator(inputs: list[Signal], process: Callable, output_kinds: list[str] = ("number",)) -> list[Signal]:
    """An operator in Python: ``process`` keeps its state in a dict of its own for each key."""
    return fold(inputs, lambda: Code(process), list(output_kinds))
