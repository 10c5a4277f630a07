"""Temperature mixing: source shares to an exponent, realised as budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.llm.common import BLANKS, free_prefix, staged


def token_count(text: Column) -> Column:
    """Words of a text: runs outside 0x20 and 0x09-0x0D."""
    plain = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(plain == "", F.lit(0)).otherwise(F.size(F.split(plain, "[\\x20\\x09-\\x0D]+", -1))).cast("long")


def tempered(totals: list[float], exponent: float) -> list[float]:
    """Shares of ``totals`` raised to ``exponent`` and normalised; empty sources get none."""
    top = max(totals, default=0)
    raw = [math.exp(exponent * math.log(x / top)) if x > 0 else 0.0 for x in totals]
    return [x / sum(raw) for x in raw] if top else raw


def entropy(shares: list[float]) -> float:
    return -sum(x * math.log(x) for x in shares if x > 0)


def bisect_exponent(totals: list[float], budget: float, target_entropy: float | None, repetition: float | None, steps: int = 80) -> float:
    """The exponent in 0 to 1 with the target entropy (nats), then raised as far as no source is repeated more than the limit.

    The entropy falls and the largest repetition falls as the exponent grows; at 1 shares are as
    they are. A target that isn't reached gives the nearest end of 0 to 1; without a target the
    limit alone decides, so the mix is as flat as it allows.
    """
    def solve(fits) -> float:
        """The least exponent that fits, where fits is false below some point and true from it on."""
        if fits(0.0):
            return 0.0
        low, high = 0.0, 1.0
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (low, mid) if fits(mid) else (mid, high)
        return high

    out = 0.0 if target_entropy is None else solve(lambda a: entropy(tempered(totals, a)) <= target_entropy)
    if repetition is not None:
        most = lambda a: max((budget * w / t for w, t in zip(tempered(totals, a), totals, strict=True) if t > 0), default=0.0)
        out = max(out, solve(lambda a: most(a) <= repetition))
    return out


def _bits(place: Column, shift: int) -> Column:
    return F.shiftrightunsigned(place, shift).bitwiseAND(F.lit(0xFFF)).cast("int")


def mix_sources(docs: DataFrame, budget_share: float = 1.0, target_entropy: float | None = None, repetition: float | None = 4.0, seed: int = 17, max_sources: int = 100_000, source: str = "source", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``n_tokens``, ``weight`` (of its source), ``copies`` and ``block``.

    The budget is ``budget_share`` times all tokens; a source gets its tempered share of it. Whole
    repetitions go to every document; the rest goes to the head of a pseudo-random permutation of
    the source's documents, in 4096 blocks by the leading bits of a hash of id and text (``block``;
    epochs of one source are cut from the same permutation). No source is ever sorted: the cut is
    found from token sums of blocks, then of the 4096 blocks within the one that the budget ends
    in, then within that one. ``copies`` is 0 for documents past the cut; no row is dropped.

    Source totals are all that reaches the driver; more than ``max_sources`` sources raise
    ValueError, which also bounds the broadcast cuts. Defined cases: a null source is a source; a
    text without words has no tokens and gets its source's whole repetitions; equal rows have equal
    places and stand on one side of the cut together; an empty table stays empty.
    """
    names = ("n_tokens", "weight", "copies", "block")
    own = docs.drop(*[c for c in docs.columns if c.lower() in names])
    place = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.coalesce(F.col(text), F.lit("")))
    own = own.withColumn("n_tokens", token_count(F.col(text)))
    narrow = staged(own.select(F.col(source).alias("s"), "n_tokens", place.alias("p")), "places")
    totals = narrow.groupBy("s").agg(F.sum("n_tokens").alias("n")).limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    totals = sorted(((r["s"], int(r["n"])) for r in totals), key=lambda r: (r[0] is not None, str(r[0])))
    tokens = [float(n) for _, n in totals]
    budget = budget_share * sum(tokens)
    weights = tempered(tokens, bisect_exponent(tokens, budget, target_entropy, repetition))
    goals = [budget * w for w in weights]
    whole = [int(g // n) if n else 0 for g, n in zip(goals, tokens, strict=True)]
    spark, kind = docs.sparkSession, docs.schema[source].dataType
    fields = [T.StructField("_s", kind), T.StructField("_rest", T.LongType()), T.StructField("_b1", T.IntegerType()), T.StructField("_b2", T.IntegerType()), T.StructField("_cut", T.LongType())]
    # for each source: tokens left to give, the block and the block within it that the cut is in, and the cut
    state = {s: [int(g - k * n), None, None, None] for (s, n), g, k in zip(totals, goals, whole, strict=True)}
    rows = narrow.withColumns({"b1": _bits(F.col("p"), 52), "b2": _bits(F.col("p"), 40), "o": _signed(F.col("p"))})
    same = F.col("s").eqNullSafe(F.col("_s"))
    for level, (at, within) in enumerate((("b1", same), ("b2", same & (F.col("b1") == F.col("_b1"))), ("o", same & (F.col("b1") == F.col("_b1")) & (F.col("b2") == F.col("_b2"))))):
        here = spark.createDataFrame([(s, *v) for s, v in state.items()], T.StructType(fields))
        sums = rows.join(F.broadcast(here), within).groupBy("s", F.col(at).alias("at"), "_rest").agg(F.sum("n_tokens").alias("n"))
        for r in _crossing(sums, level == 2).collect():  # one row a source at most
            state[r["s"]][level + 1] = r["at"]
            state[r["s"]][0] = r["left"]
    final = [(s, *state[s], w, k) for (s, _), w, k in zip(totals, weights, whole, strict=True)]
    tag = free_prefix(own.columns)
    fields = [*fields, T.StructField("_weight", T.DoubleType()), T.StructField("_whole", T.IntegerType())]
    final = spark.createDataFrame(final, T.StructType([T.StructField(tag + f.name, f.dataType) for f in fields]))
    of = lambda name: F.col(f"{tag}_{name}")
    b1, b2 = _bits(of("p"), 52), _bits(of("p"), 40)
    extra = (b1 < of("b1")) | (b1 == of("b1")) & ((b2 < of("b2")) | (b2 == of("b2")) & (_signed(of("p")) <= of("cut")))
    out = own.withColumn(f"{tag}_p", place).join(F.broadcast(final), F.col(source).eqNullSafe(of("s")))
    return out.select(*own.columns, of("weight").alias("weight"), (of("whole") + F.coalesce(extra, F.lit(False)).cast("int")).alias("copies"), b1.alias("block"))


def _signed(place: Column) -> Column:
    """Unsigned order as a signed one."""
    return place.bitwiseXOR(F.lit(-(1 << 63)))


def _crossing(sums: DataFrame, last: bool) -> DataFrame:
    """For each source the first item (by ``at``) whose running tokens pass the rest, and what is left for it.

    With ``last`` the last item whose running tokens still fit.
    """
    w = Window.partitionBy("s").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    run = sums.withColumn("run", F.sum("n").over(w))
    if last:
        return run.where("run <= _rest").groupBy("s").agg(F.max("at").alias("at")).withColumn("left", F.lit(0).cast("long"))
    past = run.where("run > _rest").groupBy("s").agg(F.min(F.struct("at", (F.col("_rest") - F.col("run") + F.col("n")).alias("left"))).alias("r"))
    return past.select("s", "r.at", "r.left")
