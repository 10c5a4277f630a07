"""Sources and sinks: CSV of numbers, listings, rows in memory, and results as JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.plans.diagnostics import validate
from sigloom.plans.signal import Signal

#: What counts as the number at the start of a field.
_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def read_csv(spark: SparkSession, path: str, scale_t: float = 1.0, scale_v: float = 1.0, head: int | None = None, tail: int | None = None) -> DataFrame:
    """(t, v) of a two-column CSV: the numeric prefix of each field; lines without two of them (such as a header) are left out.

    ``t`` is cut to a whole number after scaling. ``head`` and ``tail`` keep the first or last rows by t.
    """
    fields = F.split("value", ",", 3)
    number = lambda i: F.regexp_extract(F.coalesce(F.get(fields, F.lit(i)), F.lit("")), _PREFIX, 1)
    rows = spark.read.text(path).select(number(0).alias("a"), number(1).alias("b")).where("a <> '' and b <> ''")
    rows = rows.select(F.floor(F.col("a").cast("double") * float(scale_t)).cast("long").alias("t"), (F.col("b").cast("double") * float(scale_v)).alias("v"))
    if head is not None:
        rows = rows.orderBy("t").limit(int(head))
    if tail is not None:
        rows = rows.orderBy(F.col("t").desc()).limit(int(tail))
    return rows


def _files(spark: SparkSession, folder: str, ending: str) -> list[str]:
    """Files of a folder in any store that Spark reads, by the end of their names."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    names = sorted(f.getPath().getName() for f in found if f.isFile())
    return [f"{folder.rstrip('/')}/{n}" for n in names if n.endswith(ending)]


def list_csv(spark: SparkSession, folder: str) -> list[str]:
    return _files(spark, folder, ".csv")


def list_programs(spark: SparkSession, folder: str) -> list[str]:
    """The JSON files of a folder that are valid programs."""
    return [f for f in _files(spark, folder, ".json") if validate(read_program(spark, f))["valid"]]


def read_program(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def from_rows(spark: SparkSession, rows: list[list[float]], vector: bool = False) -> list[Signal]:
    """Signals of [time, ...values] rows: one for each value, on one base, or one of vectors."""
    width = len(rows[0]) - 1 if rows else 1
    df = spark.createDataFrame([(int(r[0]), [float(x) for x in r[1:]]) for r in rows], "t long, v array<double>")
    s = Signal.of(df)
    return [s] if vector else [s.map(F.element_at(s.v, i + 1)) for i in range(width)]


def from_buffer(spark: SparkSession, times, values) -> Signal:
    """A vector signal of a row-major two-dimensional array."""
    import pandas as pd

    pdf = pd.DataFrame({"t": [int(t) for t in times], "v": [[float(x) for x in row] for row in values]})
    return Signal.of(spark.createDataFrame(pdf, "t long, v array<double>"))


def to_json(outputs: dict[tuple[str, str], Signal]) -> str:
    """{operator: {port: [{time, value}]}} of collected results, for small ones."""
    out: dict = {}
    for (op, port), s in outputs.items():
        rows = s.df().orderBy(*s.base.order).collect()
        out.setdefault(op, {})[port] = [{"time": r["t"] if "t" in r.asDict() else r["seq"], "value": r["v"]} for r in rows]
    return json.dumps(out)


def in_and_out(data: DataFrame, outputs: dict[tuple[str, str], Signal]) -> DataFrame:
    """One row (t, line) for each message of ``data`` (t, v): {"in": {time, value}, "out": {operator: {port: [{time, value}]}}} as JSON.

    ``out`` holds what the program gave at the message's time; operators and ports without results are left out.
    """
    whole = None
    for (op, port), s in outputs.items():
        order = [F.col(c) for c in s.base.order]
        rows = s.df().select(F.col("t"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.to_json(F.struct(F.col("t").alias("time"), F.col("v").alias("value"))).alias("m")).alias("m"))
        port_rows = rows.groupBy("t").agg(F.sort_array(F.collect_list("m")).alias("m"))
        port_rows = port_rows.select("t", F.lit(op).alias("op"), F.concat(F.lit(json.dumps(port) + ":["), F.array_join(F.transform("m", lambda m: m["m"]), ","), F.lit("]")).alias("p"))
        whole = port_rows if whole is None else whole.unionByName(port_rows)
    by_op = whole.groupBy("t", "op").agg(F.array_join(F.array_sort(F.collect_list("p")), ",").alias("p"))
    by_op = by_op.select("t", F.concat(F.to_json(F.struct("op")).substr(F.lit(7), F.length(F.to_json(F.struct("op"))) - 7), F.lit(":{"), F.col("p"), F.lit("}")).alias("o"))
    out = by_op.groupBy("t").agg(F.array_join(F.array_sort(F.collect_list("o")), ",").alias("o"))
    given = F.to_json(F.struct(F.col("t").alias("time"), F.col("v").alias("value")))
    return data.join(out, "t", "left").select("t", F.concat(F.lit('{"in":'), given, F.lit(',"out":{'), F.coalesce("o", F.lit("")), F.lit("}}")).alias("line"))


def write_json(table: DataFrame, path: str) -> None:
    """A result table as JSON lines, written by the executors."""
    table.write.mode("overwrite").json(path)
