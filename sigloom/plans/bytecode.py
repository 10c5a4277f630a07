"""Fused expression programs: postfix code over a row's inputs, as columns.

Codes are numbers with their arguments inline. A program has one ``END`` for each output. Windowed
codes that are still warming up and a failing gate suppress the whole row, but never hold back any
state, so window columns are taken over all rows and flags are applied last.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from sigloom.functions import ieee
from sigloom.operators.windows import frame
from sigloom.plans.signal import Signal

# Codes by name, in order, and how many inline arguments those have that take any.
CODES = (
    "INPUT CONST ADD SUB MUL DIV POW ABS SQRT LOG LOG10 EXP SIN COS TAN SIGN FLOOR CEIL ROUND NEG END CUMSUM COUNT MAX_AGG MIN_AGG STATE_LOAD "
    "GT GTE LT LTE EQ NEQ AND OR NOT MA_UPDATE MSUM_UPDATE STD_UPDATE DIFF SIGN_CHANGE WIN_MIN WIN_MAX FIR_UPDATE IIR_UPDATE GATE"
).split()
ARGUMENTS = {"INPUT": 1, "CONST": 1, "CUMSUM": 1, "COUNT": 1, "MAX_AGG": 1, "MIN_AGG": 1, "STATE_LOAD": 1, "MA_UPDATE": 1, "MSUM_UPDATE": 1, "STD_UPDATE": 1, "DIFF": 1, "SIGN_CHANGE": 1, "WIN_MIN": 1, "WIN_MAX": 1, "FIR_UPDATE": 2, "IIR_UPDATE": 3}

BINARY = {
    "ADD": lambda a, b: a + b, "SUB": lambda a, b: a - b, "MUL": lambda a, b: a * b, "DIV": ieee.divide, "POW": F.pow, "GT": ieee.gt, "GTE": ieee.gte, "LT": ieee.lt, "LTE": ieee.lte,
    "EQ": ieee.eq, "NEQ": ieee.neq, "AND": lambda a, b: _true(a) & _true(b), "OR": lambda a, b: _true(a) | _true(b),
}
UNARY = {
    "ABS": F.abs, "SQRT": F.sqrt, "LOG": ieee.log, "LOG10": lambda x: ieee.log(x, True), "EXP": F.exp, "SIN": F.sin, "COS": F.cos, "TAN": F.tan, "SIGN": ieee.sign, "FLOOR": ieee.floor, "CEIL": ieee.ceil,
    "ROUND": ieee.round_half_away, "NEG": lambda x: -x, "NOT": lambda x: ~_true(x),
}
TRUTH = {"GT", "GTE", "LT", "LTE", "EQ", "NEQ", "AND", "OR", "NOT"}
STATEFUL = {"CUMSUM", "COUNT", "MAX_AGG", "MIN_AGG", "STATE_LOAD", "MA_UPDATE", "MSUM_UPDATE", "STD_UPDATE", "DIFF", "SIGN_CHANGE", "WIN_MIN", "WIN_MAX", "FIR_UPDATE", "IIR_UPDATE"}
DEPTH = 64


def _true(x: Column) -> Column:
    return (x != 0) | F.isnan(x)


def parse(code: list[float]) -> list[tuple]:
    """(name, *arguments) of each instruction; ValueError for an unknown code or a missing argument."""
    out, at = [], 0
    while at < len(code):
        number = int(code[at])
        if number != code[at] or not 0 <= number < len(CODES):
            raise ValueError(f"unknown opcode {code[at]}")
        name = CODES[number]
        n = ARGUMENTS.get(name, 0)
        if at + 1 + n > len(code):
            raise ValueError(f"{name} lacks an argument")
        out.append((name, *[int(x) for x in code[at + 1 : at + 1 + n]]))
        at += 1 + n
    return out


def effect(name: str) -> tuple[int, int]:
    """How many values an instruction takes and leaves."""
    if name in BINARY:
        return 2, 1
    if name in ("INPUT", "CONST", "COUNT", "STATE_LOAD"):
        return 0, 1
    if name in ("END", "GATE"):
        return 1, 0
    return 1, 1


def validate(code: list[float], outputs: int | None = None, constants: int = 0, coefficients: int = 0, inputs: int | None = None, stateless: bool = False) -> list[tuple]:
    """The parsed program, or ValueError for what is wrong with it."""
    program, depth, ends = parse(code), 0, 0
    for name, *args in program:
        take, leave = effect(name)
        if depth < take:
            raise ValueError(f"{name}: the stack is too short")
        depth += leave - take
        if depth > DEPTH:
            raise ValueError("the stack is too deep")
        if name == "CONST" and not args[0] < constants or name == "INPUT" and inputs is not None and not args[0] < inputs:
            raise ValueError(f"{name} {args[0]} is out of range")
        if name == "FIR_UPDATE" and (args[1] < 1 or sum(args) > coefficients) or name == "IIR_UPDATE" and (args[0] < 1 or sum(args) > coefficients):
            raise ValueError(f"{name}: coefficients are out of range")
        if name in ("MA_UPDATE", "MSUM_UPDATE", "STD_UPDATE", "WIN_MIN", "WIN_MAX") and args[0] < 1:
            raise ValueError(f"{name}: a window holds 1 message or more")
        if stateless and (name in STATEFUL or name == "GATE"):
            raise ValueError(f"{name} isn't stateless")
        if name == "END":
            ends, depth = ends + 1, 0
    if program and program[-1][0] != "END":
        raise ValueError("bytecode must finish with END")
    if outputs is not None and ends != outputs:
        raise ValueError(f"{ends} END for {outputs} outputs")
    return program


def evaluate(source: Signal, program: list[tuple], pick, constants: list[float], coefficients: list[float]) -> tuple[list[str], list[str]]:
    """Columns on the (solid) source's base: one for each output, and the flags that let a row pass.

    ``pick(k)`` is the column of input k.
    """
    base, stack, outputs, flags, slots = source.base, [], [], [], {}
    w = base.window
    whole = w.rowsBetween(Window.unboundedPreceding, 0)

    def kept(x: Column) -> Column:
        return F.col(base.add(x))

    def warm(n: int) -> None:
        if n > 1:
            flags.append(base.add(base.count() >= n))

    for name, *args in program:
        if name == "INPUT":
            stack.append(pick(args[0]))
        elif name == "CONST":
            stack.append(F.lit(float(constants[args[0]])))
        elif name in BINARY:
            b, a = stack.pop(), stack.pop()
            out = BINARY[name](a, b)
            stack.append(out.cast("double") if name in TRUTH else out)
        elif name in UNARY:
            out = UNARY[name](stack.pop())
            stack.append(out.cast("double") if name in TRUTH else out)
        elif name == "END":
            outputs.append(base.add(stack.pop()))
            stack.clear()
        elif name == "GATE":
            flags.append(base.add(_true(stack.pop())))
        elif name == "STATE_LOAD":
            stack.append(slots.get(args[0], F.lit(0.0)))
        elif name == "COUNT":
            slots[args[0]] = kept(base.count().cast("double"))
            stack.append(slots[args[0]])
        else:
            x = kept(stack.pop())
            if name == "CUMSUM":
                out = slots[args[0]] = kept(F.sum(x).over(whole))
            elif name in ("MAX_AGG", "MIN_AGG"):
                f, start = (F.max, float("-inf")) if name == "MAX_AGG" else (F.min, float("inf"))
                out = slots[args[0]] = kept(F.coalesce(f(F.when(~F.isnan(x), x)).over(whole), F.lit(start)))
            elif name == "DIFF":
                out, _ = kept(F.coalesce(x - F.lag(x).over(w), F.lit(0.0))), warm(2)
            elif name == "SIGN_CHANGE":
                out, _ = kept(F.coalesce(ieee.sign(x - F.lag(x).over(w)), F.lit(0.0))), warm(2)
            elif name == "FIR_UPDATE":
                start, n = args
                terms = [F.lit(float(coefficients[start + i])) * (F.lag(x, i).over(w) if i else x) for i in range(n)]
                out, _ = kept(F.coalesce(reduce(lambda a, b: a + b, terms), F.lit(0.0))), warm(n)
            else:
                n = args[0]
                kind = {"MA_UPDATE": "mean", "MSUM_UPDATE": "sum", "STD_UPDATE": "deviation", "WIN_MIN": "min", "WIN_MAX": "max"}[name]
                out, _ = kept(F.when(base.count() >= n, F.coalesce(frame(base, x, n, kind), F.lit(float("nan")))).otherwise(0.0)), warm(n)
            stack.append(out)
    return outputs, flags


def needs_fold(program: list[tuple]) -> bool:
    """Whether the program feeds results back into itself, which no window can."""
    return any(name == "IIR_UPDATE" for name, *_ in program)


def fused(source: Signal, code: list[float], outputs: int, constants=(), coefficients=(), width: int | None = None) -> Signal:
    """A vector of ``outputs`` values for each vector of ``source`` that the program lets pass."""
    program = validate(code, outputs, len(constants), len(coefficients), width)
    source = source.solid()
    outs, flags = evaluate(source, program, lambda k: F.element_at(source.v, k + 1), list(constants), list(coefficients))
    out = source.map(F.array(*[F.col(o) for o in outs]))
    for f in flags:
        out = out.where(F.col(f))
    return out


def key_column(source: Signal, code: list[float], constants=()) -> Column:
    """The one value of a stateless program, as a column on the source's base."""
    program = validate(code, 1, len(constants), stateless=True)
    (out,), _ = evaluate(source, program, lambda k: F.element_at(source.v, k + 1), list(constants), [])
    return F.col(out)
