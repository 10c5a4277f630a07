"""Runs a program over a CSV of times and values: python -m sigloom program.json data.csv --output folder."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sigloom.plans.program import compile_program
from sigloom.plans.signal import Signal
from sigloom.sources.tables import in_and_out, read_csv, read_program


def main(given: list[str] | None = None) -> None:
    ask = argparse.ArgumentParser(prog="sigloom", description=__doc__)
    ask.add_argument("program")
    ask.add_argument("data")
    ask.add_argument("--output", required=True, help="a folder for JSON lines, in any store that Spark writes")
    ask.add_argument("--scale-t", type=float, default=1.0)
    ask.add_argument("--scale-y", type=float, default=1.0)
    ask.add_argument("--head", type=int)
    ask.add_argument("--tail", type=int)
    ask.add_argument("--debug", action="store_true", help="results of all operators")
    args = ask.parse_args(given)
    spark = SparkSession.builder.getOrCreate()
    data = read_csv(spark, args.data, args.scale_t, args.scale_y, args.head, args.tail)
    outputs = compile_program(read_program(spark, args.program), [Signal.of(data)], args.debug)
    in_and_out(data, outputs).orderBy("t").select(F.col("line").alias("value")).write.mode("errorifexists").text(args.output)


if __name__ == "__main__":
    main()
