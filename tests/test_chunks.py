"""Unkeyed signals in chunks, and frames in blocks, give what one plain window over all gives."""

import math
import random

import pytest

from sigloom.operators import chunks, windows
from sigloom.plans.interpreter import Node
from sigloom.plans.session import Program
from sigloom.plans.signal import Signal


def walk(rows, seed):
    rng = random.Random(seed)
    return [(i * 3 + rng.randrange(3), round(rng.gauss(0, 5), 2)) for i in range(rows)]


def got(s):
    return [(r["t"], round(r["v"], 6)) for r in s.df().orderBy("t").collect()]


def plain(spec, rows):
    node, out = Node({"id": "x", **spec}), []
    for m in rows:
        node.data[0].append(m)
        out += [(t, round(v, 6)) for _, t, v in node.step()]
    return out


@pytest.mark.parametrize("rows", [0, 3, 200])
def test_chunks_equal_one_window(spark, rows):
    messages = walk(rows, rows)
    s = Signal.of(spark.createDataFrame(messages, "t long, v double"))
    assert got(chunks.windowed(s, 7, lambda own: windows.moving_average(own, 7), 9)) == plain({"type": "MovingAverage", "window_size": 7}, messages)
    assert got(chunks.running_sum(s, 9)) == plain({"type": "CumulativeSum"}, messages)
    assert got(windows.tracker(s, "min")) == plain({"type": "MinTracker"}, messages)
    assert got(windows.count(s)) == plain({"type": "CountNumber"}, messages)


@pytest.mark.parametrize("kind", ["MovingAverage", "CumulativeSum", "CountNumber", "StandardDeviation", "MaxTracker", "Difference", "PeakDetector"])
def test_no_single_task_for_signals_without_keys(spark, kind):
    program = Program().add_operator("in", "Input", portTypes=["number"]).add_operator("x", kind, window_size=5).connect("in", "x").add_output("x")
    df = spark.createDataFrame(walk(300, 4), "t long, v double")
    (out,) = program.signals([Signal.of(df)]).values()
    assert "SinglePartition" not in out.df()._jdf.queryExecution().executedPlan().toString()
    assert got(out) == plain({"type": kind, "window_size": 5}, walk(300, 4))


def test_older_differences_in_chunks(spark):
    messages = walk(100, 5)
    s = Signal.of(spark.createDataFrame(messages, "t long, v double"))
    assert got(windows.difference(s, False)) == plain({"type": "Difference", "use_oldest_time": False}, messages)


@pytest.mark.parametrize(("kind", "spec"), [("mean", {"type": "MovingAverage"}), ("sum", {"type": "MovingSum"}), ("deviation", {"type": "StandardDeviation"}), ("min", {"type": "WindowMinMax", "mode": "min"}), ("max", {"type": "WindowMinMax", "mode": "max"})])
@pytest.mark.parametrize("n", [2, 7, 60])
def test_frames_in_blocks(spark, monkeypatch, kind, spec, n):
    monkeypatch.setattr(windows, "BLOCKS_FROM", 2)
    df = spark.createDataFrame([(k, t, v + 1e6 * (k == "b")) for k in "ab" for t, v in walk(50, ord(k))], "k string, t long, v double")
    s = Signal.of(df, keys=("k",))
    out = windows._framed(s, n, kind).df().collect()
    for k in "ab":
        want = plain({**spec, "window_size": n}, [(t, v + 1e6 * (k == "b")) for t, v in walk(50, ord(k))])
        found = sorted((r["t"], r["v"]) for r in out if r["k"] == k)
        assert [t for t, _ in found] == [t for t, _ in want] and all(math.isclose(x, y, rel_tol=1e-7, abs_tol=1e-5) for (_, x), (_, y) in zip(found, want, strict=True))


def test_not_a_number_in_frames(spark, monkeypatch):
    messages = [(i, v) for i, v in enumerate([1.0, math.nan, 3.0, math.nan, math.nan, 2.0, 5.0])]
    df = spark.createDataFrame([("k", *m) for m in messages], "k string, t long, v double")
    for blocks in (256, 2):
        monkeypatch.setattr(windows, "BLOCKS_FROM", blocks)
        for mode in ("min", "max"):
            out = [(r["t"], r["v"]) for r in windows.window_min_max(Signal.of(df, keys=("k",)), 2, mode).df().orderBy("t").collect()]
            assert str(out) == str(plain({"type": "WindowMinMax", "mode": mode, "window_size": 2}, messages))
