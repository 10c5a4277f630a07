"""Removal of repeated substrings by suffix arrays.

A string of ``length`` bytes that starts at two or more places of the corpus is removed at all of
them. Suffixes can only be sorted within one task, so the corpus is first cut into contexts that
tasks can sort for themselves without losing a match: every window of ``length`` bytes has as its
key the least hash among its 32-grams. Equal windows have equal keys, a key's windows are a few
runs of neighbouring windows, and a run with the bytes its windows cover is a context. Keys of one
occurrence end there; equal contexts of a key become one with their number as its weight. The
contexts of a key are then sorted by ``grouping.suffix_arrays``, and windows that are equal for
``length`` bytes stand next to each other in that order: a run of them with a weight of two or more
is removed wherever its contexts occur.

Before that, a context of a key is cut down to the windows that may be equal to another's: the key's
gram stands at one place of the context, so equal windows have equal bytes around it, and what is
around it in every window of a quarter of all offsets is compared first.

A key with more than ``most_contexts`` different contexts is cut again by a further key of its
windows under another hash, which parts them without parting equal windows. A key that still has
more than ``largest`` contexts after all further keys is cut into single windows, keyed by a hash of
all their bytes, so what a task holds of one key is bounded, however alike texts are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.llm.common import free_prefix, mix64, powers, prefix_hash, shuffle_width, slices, staged, unstage, utf8, with_arrow
from sigloom.llm.grouping import suffix_arrays

GRAM = 32
LONGEST_RUN = 2048  # windows of one context
CONTEXTS_A_TASK = 512  # of crowded keys, when these are cut further
_TOP = np.uint64((1 << 64) - 1)


def sliding_min(h: np.ndarray, k: int) -> np.ndarray:
    """The least of every k neighbours, from minima up to and down to the edges of blocks of k."""
    n = len(h)
    blocks = np.concatenate((h, np.full(-n % k, _TOP))).reshape(-1, k)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - k + 1
    return np.minimum(behind[:m], ahead[k - 1 : k - 1 + m])


def runs(data: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The contexts of one text: first window, number of windows, key, a hash of the bytes, and where in it the key's gram is (-1: at several places)."""
    n = len(data)
    p = prefix_hash(data)
    _, down = powers(n)
    gram = min(GRAM, length)
    h = mix64((p[gram:] - p[:-gram]) * down[: n - gram + 1] + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    k = length - gram + 1
    least = sliding_min(h, k)
    change = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    size = np.diff(np.append(change, len(least)))
    if len(size) and size.max() > LONGEST_RUN:
        pieces = -(-size // LONGEST_RUN)
        change = np.repeat(change, pieces) + LONGEST_RUN * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        size = np.diff(np.append(change, len(least)))
    # places of grams that are the least of any window: no larger than the largest minimum of the windows around
    edge = np.full(k - 1, _TOP)
    place = np.flatnonzero(h == ~sliding_min(np.concatenate((edge, ~least, edge)), k))
    values, rank = np.unique(h[place], return_inverse=True)
    order = np.argsort(rank, kind="stable")
    place = place[order]
    at = rank[order] * (n + 1) + place
    own = np.searchsorted(values, least[change]) * (n + 1)
    first = np.searchsorted(at, own + change)
    once = np.searchsorted(at, own + change + size + (k - 1)) - first == 1
    end = change + size + length - 1
    content = mix64((p[end] - p[change]) * down[change] ^ size.astype(np.uint64))
    return change, size, least[change], content, np.where(once, place[np.minimum(first, len(place) - 1)] - change, -1)


def _row_keys(text: str, id_col: str) -> list:
    body, ident = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(id_col).cast("string"), F.lit("\0null"))
    return [F.xxhash64(ident, body).alias("r1"), F.xxhash64(F.lit(1), ident, body).alias("r2")]


_OCCURRENCE = "r1 long, r2 long, lo int, w int, h long, k long, g int"


def occurrences(docs: DataFrame, length: int, text: str, id_col: str) -> DataFrame:
    """(r1, r2, lo, w, h, k, g): every context of every row: where it starts, its windows, and what ``runs`` says of it."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, 1 << 20):
                r1, r2, out = part.column(0).to_numpy(), part.column(1).to_numpy(), []
                for i, raw in enumerate(utf8(part.column(2).to_pylist())):
                    if len(raw) >= length:
                        lo, w, h, k, g = runs(np.frombuffer(raw, np.uint8), length, 0)
                        out.append((np.full(len(lo), i), lo, w, h, k, g))
                if out:
                    i, lo, w, h, k, g = (np.concatenate(c) for c in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(r1[i]), pa.array(r2[i]), pa.array(lo.astype(np.int32)), pa.array(w.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(k.view(np.int64)), pa.array(g.astype(np.int32))],
                        names=["r1", "r2", "lo", "w", "h", "k", "g"],
                    )

    return docs.select(*_row_keys(text, id_col), F.col(text)).mapInArrow(run, _OCCURRENCE)


def promising(group: list[tuple[int, bytes, int]], length: int, parts: int = 4) -> list[tuple[int, int, int]]:
    """Of contexts (weight, bytes, place of the key's gram) of one key those that may hold repeated windows: (number, first, end of these windows).

    A window of a context has the gram at one of length - gram + 1 offsets. All windows of a part of
    these offsets hold the same bytes around the gram, so windows can only be equal where these are.
    """
    gram = min(GRAM, length)
    whole = [(i, 0, len(c) - length + 1) for i, (_, c, _) in enumerate(group)]
    span = length - gram
    if span < parts or any(g < 0 for *_, g in group):
        return whole
    step = -(-span // parts)
    weight: dict[tuple[int, bytes], int] = {}
    own: list[list] = []
    for w, c, g in group:
        own.append([])
        for j in range(0, span, step):
            far = min(j + step, span)
            first, last = max(0, g - far), min(len(c) - length, g - j)
            if first <= last:
                key = j, c[g - j : g + gram + span - far]
                own[-1].append((key, first, last + 1))
                weight[key] = weight.get(key, 0) + w
    out = []
    for i, ranges in enumerate(own):
        live = [(a, b) for key, a, b in ranges if weight[key] > 1]
        if live:
            out.append((i, min(a for a, _ in live), max(b for _, b in live)))
    return out


def repeated_windows(contexts: list[list[tuple[int, bytes]]], length: int) -> list[list[list[tuple[int, int]]]]:
    """For groups of (weight, bytes): in each context the runs [a, b) of window starts that occur twice or more in the group."""
    strings, offsets, at = [], [], 0
    flat = b"".join(c for group in contexts for _, c in group)
    data = np.frombuffer(flat, np.uint8)
    p = prefix_hash(data)
    _, down = powers(len(data))
    for group in contexts:
        parts, own, here = [], [], 0
        for weight, c in group:
            parts += [np.frombuffer(c, np.uint8).astype(np.int64) + 1, np.zeros(1, np.int64)]
            own.append((here, at, len(c), weight))
            here += len(c) + 1
            at += len(c)
        strings.append(np.concatenate(parts))
        offsets.append(own)
    sa, begins = suffix_arrays(strings)
    sizes = np.array([len(s) for s in strings])
    total = int(sizes.sum())
    # of every cell of the sorted strings: its byte in data, whether a window starts there, its weight
    byte, window, weight = np.zeros(total, np.int64), np.zeros(total, bool), np.zeros(total, np.int64)
    for begin, own in zip(begins.tolist(), offsets, strict=True):
        for here, start, n, w in own:
            s = begin + here
            byte[s : s + n] = np.arange(start, start + n)
            window[s : s + n - length + 1] = True
            weight[s : s + n] = w
    cell = sa + np.repeat(begins, sizes)
    open_ = window[cell]
    first = np.where(window, byte, 0)
    value = np.zeros(total, np.uint64)
    value[window] = (p[first[window] + length] - p[first[window]]) * down[first[window]]
    ordered = value[cell]
    same = np.zeros(total, bool)
    same[1:] = open_[1:] & open_[:-1] & (ordered[1:] == ordered[:-1])
    same[begins[sizes > 0]] = False
    heads = np.flatnonzero(~same)
    sums = np.add.reduceat(weight[cell] * open_, heads) if total else np.zeros(0)
    repeated = np.zeros(total, bool)
    repeated[cell] = np.repeat(sums >= 2, np.diff(np.append(heads, total))) & open_
    out = []
    for begin, own in zip(begins.tolist(), offsets, strict=True):
        rows = []
        for here, _, n, _ in own:
            edge = np.flatnonzero(np.diff(repeated[begin + here : begin + here + n].astype(np.int8), prepend=0, append=0))
            rows.append(list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)))
        out.append(rows)
    return out


def _sorted_groups(contexts: DataFrame, length: int, batch_bytes: int, lane_bytes: int = 3 << 19) -> DataFrame:
    """(h, k, repeated): for contexts (h, k, weight, g, context) the repeated runs of those that have any."""
    schema = "h long, k long, repeated array<struct<a:int,b:int>>"

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        keys: list = []
        groups: list = []
        size = 0

        def flush():
            nonlocal keys, groups, size
            h, k, rep = [], [], []
            chosen = [promising(g, length) for g in groups]
            cut = [[(groups[i][n][0], groups[i][n][1][a : b + length - 1]) for n, a, b in own] for i, own in enumerate(chosen)]
            # strings of like lengths are sorted together, as the longest sets the number of steps
            order = sorted((i for i, c in enumerate(cut) if c), key=lambda i: sum(len(c) for _, c in cut[i]))
            while order:
                here, total = [], 0
                while order and (not here or total < lane_bytes):
                    here.append(order.pop())
                    total += sum(len(c) for _, c in cut[here[-1]])
                for i, found in zip(here, repeated_windows([cut[i] for i in here], length), strict=True):
                    for (n, off, _), r in zip(chosen[i], found, strict=True):
                        if r:
                            h.append(keys[i][n][0])
                            k.append(keys[i][n][1])
                            rep.append([{"a": x + off, "b": y + off} for x, y in r])
            keys, groups, size = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(k, pa.int64()), pa.array(rep, kind)], names=["h", "k", "repeated"])

        seen: set = set()
        for batch in batches:
            for h, k, w, g, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if not keys or keys[-1][0][0] != h:
                    if size >= batch_bytes:
                        yield flush()
                    keys.append([])
                    groups.append([])
                    seen = set()
                if k not in seen:  # equal rows of the table give a context twice
                    seen.add(k)
                    keys[-1].append((h, k))
                    groups[-1].append((w, c, g))
                    size += len(c) + 1
        if keys:
            yield flush()

    # by a hash of the key: AQE leaves a repartition by "h" out where a join before dealt by it, and tears keys when it then broadcasts that join or splits its tasks
    dealt = contexts.select("h", "k", "weight", "g", "context").repartition(shuffle_width(contexts.sparkSession), F.xxhash64("h")).sortWithinPartitions("h")
    return dealt.mapInArrow(run, schema)


def _cut(docs: DataFrame, contexts: DataFrame, length: int, text: str, id_col: str) -> DataFrame:
    """(h, k, weight, g, context): the bytes of contexts (h, k, weight, at) from the row each is at."""
    lists = contexts.groupBy(F.col("at.r1").alias("r1"), F.col("at.r2").alias("r2")).agg(F.collect_list(F.struct("at.lo", "at.w", "at.g", "h", "k", "weight")).alias("cuts"))
    rows = docs.select(*_row_keys(text, id_col), F.col(text).alias("text")).join(lists, ["r1", "r2"]).select("text", "cuts")

    def run(batches):
        import pyarrow as pa

        names = ["h", "k", "weight", "g", "context"]
        for batch in batches:
            for part in slices(batch, 1 << 20):
                out = [
                    (c["h"], c["k"], c["weight"], c["g"], raw[c["lo"] : c["lo"] + c["w"] + length - 1])
                    for raw, cuts in zip(utf8(part.column(0).to_pylist()), part.column(1).to_pylist(), strict=True)
                    for c in cuts
                ]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                columns = zip(*out, strict=True) if out else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=names)

    return rows.mapInArrow(run, "h long, k long, weight long, g int, context binary")


def singles(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Like ``runs``: every window of one text as a context of its own, with two hashes of its bytes as its key and its content, and its first bytes as the gram."""
    p = prefix_hash(data)
    _, down = powers(len(data))
    n = len(data) - length + 1
    h = (p[length:] - p[:-length]) * down[:n]
    return np.arange(n), np.ones(n, np.int64), mix64(h), mix64(h ^ np.uint64(length)), np.zeros(n, np.int64)


def _parted(contexts: DataFrame, length: int, seed: int | None) -> DataFrame:
    """(h, k, weight, off, w, h2, k2, g, context): contexts cut by a further key of their windows, or without a seed into these."""
    names = ["h", "k", "weight", "off", "w", "h2", "k2", "g", "context"]

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

        def packed(rows):
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for part in slices(batch, 1 << 20):
                out, size = [], 0
                for h, k, weight, c in zip(*(x.to_pylist() for x in part.columns), strict=True):
                    data = np.frombuffer(c, np.uint8)
                    lo, w, key, content, g = singles(data, length) if seed is None else runs(data, length, seed)
                    key = mix64(key ^ np.uint64(h & (1 << 64) - 1)).view(np.int64)
                    for x, n, key2, k2, place in zip(lo.tolist(), w.tolist(), key.tolist(), content.view(np.int64).tolist(), g.tolist(), strict=True):
                        out.append((h, k, weight, x, n, key2, k2, place, c[x : x + n + length - 1]))
                        size += n + length
                        if size > 8 << 20:
                            yield packed(out)
                            out, size = [], 0
                yield packed(out)

    return contexts.select("h", "k", "weight", "context").mapInArrow(run, "h long, k long, weight long, off int, w int, h2 long, k2 long, g int, context binary")


def _runs_of(found: DataFrame) -> DataFrame:
    """(h, k, a, b): the runs of (h, k, repeated), one a row."""
    return found.select("h", "k", F.explode("repeated").alias("x")).select("h", "k", "x.a", "x.b")


def repeated_spans(docs: DataFrame, length: int = 400, most_contexts: int = 48, levels: int = 4, largest: int = 4096, batch_bytes: int = 12 << 20, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(r1, r2, spans): by row key the byte ranges [a, b) that repeated windows cover, not yet merged.

    A level of further keys stages one table, the parts: its contexts are put together from them
    where they are read, and the runs found in them go back along the parts to the contexts above.
    """
    width = shuffle_width(docs.sparkSession)
    every = staged(occurrences(docs, length, text, id_col), "occurrences")
    shared = every.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("g").alias("g")).where("c > 1 or g < 0").select("h")
    occur = staged(every.join(shared, "h", "left_semi").select("r1", "r2", "lo", "w", "h", "k", "g"), "shared")
    unstage(every)
    heads = occur.groupBy("h", "k").agg(F.count(F.lit(1)).alias("weight"), F.min(F.struct("r1", "r2", "lo", "w", "g")).alias("at"))
    cut = staged(_cut(docs, heads, length, text, id_col), "contexts")
    keys = cut.groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    contexts_of = lambda chosen: cut.join(chosen.select("h"), "h", "left_semi")
    found, above = [], []
    for level in range(1, levels + 2):
        most = most_contexts if level < levels else largest
        crowded = 0 if level > levels else keys.where(F.col("c") > most).agg(F.sum("c")).first()[0] or 0
        here = contexts_of(keys.where(F.col("c") <= most)) if crowded else cut if level == 1 else contexts_of(keys)
        found.append(_runs_of(_sorted_groups(here, length, batch_bytes)))
        if not crowded:
            break
        # a crowded key's contexts are dealt evenly, to no more tasks than their number asks for: each writes files
        dealt = contexts_of(keys.where(F.col("c") > most)).repartition(min(width, -(-crowded // CONTEXTS_A_TASK)))
        parts = staged(_parted(dealt, length, level if level < levels else None), f"parts{level}")
        above.append(parts.select("h", "k", "off", "h2", "k2"))
        keys = parts.groupBy(F.col("h2").alias("h")).agg(F.countDistinct("k2").alias("c"), F.sum("weight").alias("n"), F.min("g").alias("g")).where("n > 1 or g < 0")
        again = parts.select(F.col("h2").alias("h"), F.col("k2").alias("k"), "weight", "g", "context")
        contexts_of = lambda chosen, again=again: again.join(chosen.select("h"), "h", "left_semi").groupBy("h", "k").agg(F.sum("weight").alias("weight"), F.max("g").alias("g"), F.max("context").alias("context"))
    hit = found.pop()
    while found:
        deep = hit.select(F.col("h").alias("h2"), F.col("k").alias("k2"), "a", "b")
        hit = found.pop().unionByName(above.pop().join(deep, ["h2", "k2"]).select("h", "k", (F.col("off") + F.col("a")).alias("a"), (F.col("off") + F.col("b")).alias("b")))
    # equal rows give a context twice; sets hold no more runs than a context, and no more spans than a text has
    runs_of = hit.groupBy("h", "k").agg(F.collect_set(F.struct("a", "b")).alias("repeated"))
    spans = occur.join(runs_of, ["h", "k"]).select("r1", "r2", F.explode(F.transform("repeated", lambda x: F.struct((F.col("lo") + x["a"]).alias("a"), (F.col("lo") + x["b"] + (length - 1)).alias("b")))).alias("s"))
    return spans.groupBy("r1", "r2").agg(F.collect_set("s").alias("spans"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Disjoint ranges that don't touch, in order."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = 400, text: str = "text", id_col: str = "doc_id", **settings) -> DataFrame:
    """``docs`` with ``kept`` (the remaining bytes), ``n_bytes``, ``n_removed``, and ``removed`` (ranges of bytes).

    A byte goes if a string of ``length`` bytes covers it that also starts anywhere else in any
    text, the same one included; matches never cross texts and are judged on the input. Texts are
    taken as UTF-8; null is empty, and a text shorter than ``length`` bytes is kept whole. Equal
    rows are copies of each other; ids may be null or of any type; an empty table stays empty. Other columns pass through; those named like a result are replaced.
    """
    found = repeated_spans(docs, length, text=text, id_col=id_col, **settings)
    names = ("kept", "n_bytes", "n_removed", "removed")
    own = docs.drop(*[c for c in docs.columns if c.lower() in names and c not in (text, id_col)])
    r1, r2, at = (free_prefix(own.columns) + n for n in ("r1", "r2", "spans"))
    keys = [k.alias(n) for k, n in zip(_row_keys(text, id_col), (r1, r2), strict=True)]
    found = found.select(F.col("r1").alias(r1), F.col("r2").alias(r2), F.col("spans").alias(at))
    joined = own.select("*", *keys).join(found, [r1, r2], "left").drop(r1, r2)
    ranges = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    fields = [T.StructField("kept", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", ranges)]

    def fn(texts, spans):
        rows = []
        for raw, own in zip(utf8(texts), spans, strict=True):
            gone = merged(own or [])
            at, kept = 0, []
            for a, b in gone:
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            rows.append((b"".join(kept), len(raw), sum(b - a for a, b in gone), [{"start": a, "end": b} for a, b in gone]))
        return list(map(list, zip(*rows, strict=True))) if rows else [[], [], [], []]

    return with_arrow(joined, [text, at], fields, fn).drop(at)
