"""Programs as streaming queries: one machine per key, kept as state from batch to batch.

Messages are taken in order of time within a batch; an input that gets one not later than its last
drops it, so results depend on event time alone and any cut into batches gives the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from sigloom.operators.folds import KINDS, messages
from sigloom.plans.interpreter import load_machine, save_machine
from sigloom.plans.program import Graph, load, ports

_VALUES = ", ".join(f"{n} {t}" for n, t in KINDS.values())


def run_stream(program: str | dict | Graph, stream: DataFrame, keys: tuple[str, ...] = (), t: str = "t", columns: dict[str, str] | None = None) -> DataFrame:
    """A streaming DataFrame of results: keys, op, port, t, seq and a value column for each type.

    ``stream`` holds ``keys``, ``t`` and one column for each input port (``columns``: port to column,
    default {"i1": "v"}); a null is no message. State is kept by Spark's checkpoint, so a query that
    is started again goes on where it was.
    """
    graph = program if isinstance(program, Graph) else load(program)
    kinds = list(ports(graph.by_id()[graph.entry]).data)
    out_kinds, labels = graph.kinds(), list(graph.labels)
    columns = columns or {"i1": "v"}
    keyed = stream if keys else stream.withColumn("_all", F.lit(0))
    own = list(keys) or ["_all"]
    given = {int(p[1:]) - 1: c for p, c in columns.items()}
    rows = keyed.select(*own, F.col(t).cast("long").alias("t"), *[F.col(c).cast(KINDS[kinds[p]][1]).alias(f"p{p}") for p, c in given.items()])
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in own], "op string, port string, t long, seq long", _VALUES])

    def step(key, frames: Iterable, state):
        import pandas as pd

        machine = graph.machine()
        if state.exists:
            load_machine(machine, json.loads(state.get[0]))
        out = []
        whole = pd.concat(list(frames), ignore_index=True)
        tall = []
        for p in given:
            part = whole[["t", f"p{p}"]].dropna(subset=[f"p{p}"])
            tall.append(pd.DataFrame({"t": part["t"], "p": p, KINDS[kinds[p]][0]: part[f"p{p}"]}))
        tall = pd.concat(tall, ignore_index=True).sort_values(["t", "p"], kind="stable")
        for m in messages(tall, kinds):
            out += machine.push([m])
        state.update((json.dumps(save_machine(machine)),))
        cols: dict = {k: [v] * len(out) for k, v in zip(own, key, strict=True)}
        cols |= {"op": [labels[o][0] for o, _, _ in out], "port": [labels[o][1] for o, _, _ in out], "t": [u for _, u, _ in out], "seq": range(len(out))}
        for kind, (name, _) in KINDS.items():
            cols[name] = pd.Series([(float(v) if kind == "number" else v) if out_kinds[o] == kind else None for o, _, v in out], dtype=object)
        yield pd.DataFrame(cols)

    done = rows.groupBy(*own).applyInPandasWithState(step, schema, "machine string", "append", GroupStateTimeout.NoTimeout)
    return done if keys else done.drop("_all")
