"""Quality scores by a generalised additive model with pairwise interactions.

Shallow trees are boosted cyclically on binned features, one feature (later one pair) at a time, so
all trees of a feature add up to one lookup table. A score is the sum of a document's bins, taken
for whole batches at once.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.llm.common import utf8, with_arrow

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper_share", "digit_share", "odd_symbol_share", "stop_share", "pause_share", "blank_share", "newline_share",
    "high_byte_share", "byte_entropy", "distinct_words", "distinct_pairs", "top_word_share", "distinct_lines", "log_line_length", "short_words", "long_words", "symbol_words",
)

_CLASS = np.zeros(256, np.int64)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
for _c in b".!?":
    _CLASS[_c] = 4
for _c in b",;:'\"()-":
    _CLASS[_c] = 5
for _c in b" \t\r\x0b\f":
    _CLASS[_c] = 6
_CLASS[ord("\n")] = 7
for _c in b"#$%&*+/<=>@[\\]^_`{|}~":
    _CLASS[_c] = 8
_CLASS[128:] = 9
_SYMBOL_END = frozenset(b"#$%&*+/<=>@[\\]^_`{|}~!")


def features(text: bytes) -> list[float]:
    """The features of one whole text; all 0 for an empty one."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kind = np.bincount(_CLASS, byte, 10)
    share = byte[byte > 0] / n
    words = text.split()
    k = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = kind[1] + kind[2] + kind[9]
    if k:
        counts = Counter(words)
        pairs = len(set(zip(words, words[1:], strict=False))) / max(k - 1, 1) if k > 1 else 1.0
        lengths = np.fromiter(map(len, words), np.int64, k)
        of_words = [float(lengths.mean()), len(counts) / k, pairs, max(counts.values()) / k, float((lengths <= 2).mean()), float((lengths >= 14).mean()), sum(v for w, v in counts.items() if w[-1] in _SYMBOL_END) / k]
    else:
        of_words = [0.0] * 7
    mean, distinct, pairs, top, short, long, symbol = of_words
    return [
        float(np.log1p(n)), float(np.log1p(k)), mean, kind[2] / max(letters, 1), kind[3] / n, kind[8] / n, kind[4] / n, kind[5] / n, kind[6] / n, kind[7] / n,
        kind[9] / n, float(-(share * np.log2(share)).sum()), distinct, pairs, top, len(set(lines)) / max(len(lines), 1), float(np.log1p(n / max(len(lines), 1))), short, long, symbol,
    ]


@dataclass
class Model:
    """Bin edges and lookup tables; ``score`` is the mean response of the sum of bins."""

    edges: list = field(default_factory=list)  # of each feature
    coarse: list = field(default_factory=list)  # of each feature, for pairs
    base: float = 0.0
    single: list = field(default_factory=list)  # one table for each feature
    pairs: list = field(default_factory=list)  # (i, j, two-dimensional table)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], "right") for i, e in enumerate(self.edges)], axis=1) if len(self.edges) else np.zeros((len(x), 0), np.int64)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        at = self.bins(x)
        for i, table in enumerate(self.single):
            out += table[at[:, i]]
        for i, j, table in self.pairs:
            out += table[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -40, 40)))


def _edges(values: np.ndarray, most: int) -> np.ndarray:
    """Cut points between distinct values, at quantiles."""
    distinct = np.unique(values)
    if len(distinct) <= most:
        return (distinct[1:] + distinct[:-1]) / 2
    cuts = np.quantile(values, np.linspace(0, 1, most + 1)[1:-1], method="nearest")
    return np.unique(cuts)


def _leaf(g, h, reg):
    return g / (h + reg)


def _best_cut(g: np.ndarray, h: np.ndarray, reg: float, least: float) -> tuple[float, int]:
    """Gain and place (bins before it) of the best cut of a row of bins."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + reg) + gr**2 / (hr + reg) - g.sum() ** 2 / (h.sum() + reg)
    gain = np.where((hl >= least) & (hr >= least), gain, 0.0)
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def tree_update(g: np.ndarray, h: np.ndarray, leaves: int, reg: float, least: float) -> np.ndarray:
    """A shallow tree over the bins of one feature, as its value for each bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        cuts = [(*_best_cut(g[a:b], h[a:b], reg, least), a, b) for a, b in parts]
        gain, k, a, b = max(cuts)
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, a + k), (a + k, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum(), reg)
    return out


def pair_update(g: np.ndarray, h: np.ndarray, reg: float, least: float) -> tuple[float, np.ndarray]:
    """A tree of one cut on one axis and one on the other in each half: its gain and values."""
    best = (0.0, np.zeros(g.shape))
    whole = g.sum() ** 2 / (h.sum() + reg)
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        for cut in range(1, a.shape[0]):
            out, gain = np.zeros(a.shape), -whole
            for part in (slice(0, cut), slice(cut, None)):
                gp, hp = a[part].sum(axis=0), b[part].sum(axis=0)
                _, k = _best_cut(gp, hp, reg, least)
                for side in (slice(0, k), slice(k, None)):
                    gs, hs = gp[side].sum(), hp[side].sum()
                    gain += gs**2 / (hs + reg)
                    out[part, side] = _leaf(gs, hs, reg)
            if gain > best[0] + 1e-12:
                best = (gain, out if axis == 0 else out.T)
    return best


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, pair_bins: int = 8, rounds: int = 120, pair_rounds: int = 40, pairs: int = 6, rate: float = 0.15, leaves: int = 4, reg: float = 2.0, least: float = 2.0) -> Model:
    """A model of labels ``y`` (0 to 1) by features ``x``; without rows, or with labels all alike, a constant one."""
    d = x.shape[1] if x.ndim == 2 else 0
    p = (y.sum() + 0.5) / (len(y) + 1)
    model = Model([_edges(x[:, i], bins) if len(x) else np.zeros(0) for i in range(d)], [], float(np.log(p / (1 - p))), [], [])
    if not len(y) or y.min() == y.max():
        return Model([], [], model.base, [], [])
    model.coarse = [_edges(x[:, i], pair_bins) for i in range(d)]
    model.single = [np.zeros(len(e) + 1) for e in model.edges]
    at = model.bins(x)
    out = np.full(len(y), model.base)
    for _ in range(rounds):
        for i in range(d):
            mean = 1 / (1 + np.exp(-out))
            n = len(model.single[i])
            step = rate * tree_update(np.bincount(at[:, i], y - mean, n), np.bincount(at[:, i], mean * (1 - mean), n), leaves, reg, least)
            model.single[i] += step
            out += step[at[:, i]]
    few = np.stack([np.searchsorted(e, x[:, i], "right") for i, e in enumerate(model.coarse)], axis=1)
    mean = 1 / (1 + np.exp(-out))
    gains = []

    def grids(i, j, mean):
        shape = len(model.coarse[i]) + 1, len(model.coarse[j]) + 1
        cell = few[:, i] * shape[1] + few[:, j]
        size = shape[0] * shape[1]
        return cell, np.bincount(cell, y - mean, size).reshape(shape), np.bincount(cell, mean * (1 - mean), size).reshape(shape)

    for i in range(d):
        for j in range(i + 1, d):
            _, g, h = grids(i, j, mean)
            gains.append((pair_update(g, h, reg, least)[0], -i, -j))
    chosen = [(-i, -j) for gain, i, j in sorted(gains, reverse=True)[:pairs] if gain > 1e-9]
    tables = {ij: np.zeros((len(model.coarse[ij[0]]) + 1, len(model.coarse[ij[1]]) + 1)) for ij in chosen}
    for _ in range(pair_rounds):
        for i, j in chosen:
            mean = 1 / (1 + np.exp(-out))
            cell, g, h = grids(i, j, mean)
            step = rate * pair_update(g, h, reg, least)[1]
            tables[i, j] += step
            out += step.ravel()[cell]
    model.pairs = [(i, j, t) for (i, j), t in tables.items()]
    return model


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4 (a null id counts as an empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4))


def train(docs: DataFrame, labels: DataFrame, max_train: int = 20_000, held_out: int = 2, text: str = "text", id_col: str = "doc_id", label: str = "quality") -> Model:
    """A model of ``label`` fitted on at most ``max_train`` labelled documents outside fold ``held_out``.

    The sample is bounded, as its labels and 20 features a document are all that reaches the driver:
    the documents with the smallest hash of their id are taken, whatever the size of the input.
    Several labels of one document count with their mean; null labels and ids are left out; ids are
    compared as texts, so they may be of any type; of equal ids in ``docs`` one row counts. Without
    any label the model is a constant one.
    """
    ident, held, words = F.col(id_col).cast("string"), "id", "words"
    own = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).where(fold(id_col) != held_out)
    own = own.groupBy(ident.alias(held)).agg(F.avg(F.col(label).cast("double")).alias("y"))
    own = own.orderBy(F.xxhash64(held), held).limit(max_train)
    rows = docs.select(ident.alias(held), F.col(text).alias(words)).join(F.broadcast(own), held)
    rows = with_arrow(rows, [words], [T.StructField("x", T.ArrayType(T.DoubleType()))], lambda t: ([features(b) for b in utf8(t)],)).select(held, "y", "x")
    rows = rows.groupBy(held).agg(F.min(F.struct("y", "x")).alias("r")).select(held, "r.y", "r.x")
    got = sorted(rows.collect())
    return fit(np.array([r[2] for r in got]).reshape(-1, len(FEATURES)), np.array([r[1] for r in got]))


def score(docs: DataFrame, model: Model, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on), over whole texts.

    A null text is an empty one and gets a score too. Other columns pass through; those named
    ``score`` or ``predicted`` are replaced.
    """
    def fn(texts):
        s = model.score(np.array([features(b) for b in utf8(texts)]).reshape(-1, len(FEATURES)))
        return s.tolist(), (s >= threshold).astype(int).tolist()

    return with_arrow(docs, [text], [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], fn)
