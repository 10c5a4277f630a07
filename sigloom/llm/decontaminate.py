"""Benchmark decontamination: passages as queries against a BM25 index of the test items.

The index is inverted; postings are cut into blocks of items, and each term has the largest weight
it has in each of its blocks (sparse lists, nothing of terms times blocks). Every passage of every
document is a query: the block maxima of its terms are added up for a whole batch of passages, and
block-max WAND runs for the passages and blocks that can still reach the threshold. The most common
terms of an item, as long as they weigh less than half its threshold, are left out of these sums and
counted in full instead.

What no single passage reaches (a question far from its answer, or in pieces) is retrieved
over the whole document: one that holds enough of a question's shingles holds one of its rarest, as
many as may be missing and one more. All hits are then verified against the whole document: the
question's word shingles and the answer's words have to be there.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.llm.common import combine, mix64, staged, utf8, with_arrow, word_hashes

K1, B = 1.2, 0.75
PASSAGE, STRIDE = 64, 32


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the last non-blank line is the answer if another stands before it, else there is none."""
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\f")]
    return ("\n".join(lines[:-1]), lines[-1]) if len(lines) > 1 else ("\n".join(lines), "")


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of runs of n words; of the whole sequence where there are fewer."""
    if len(words) == 0:
        return words
    k = min(n, len(words))
    return np.unique(mix64(np.uint64(k) + combine(words, k)))


def _flat(lists: list[np.ndarray], kind) -> tuple[np.ndarray, np.ndarray]:
    """Arrays in a row, and where each begins (with the end behind them)."""
    return np.concatenate([np.empty(0, kind), *lists]).astype(kind), np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64))).astype(np.int64)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] of them), starts[1], ..."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Index:
    """The inverted index of one part of the items. Weights are BM25 over an item's own score, so all lie in 0 to 1.

    An item is retrieved by a passage that scores at least ``threshold`` times what the poorest run
    of words scores that a passage holds of an item it runs into (33 words, or the whole item).
    """

    def __init__(self, items: list[tuple], words: int = 5, overlap: float = 0.8, block: int = 16, whole: tuple[int, float, dict[int, int]] | None = None, threshold: float = 0.6):
        items = sorted(items, key=lambda x: (x[0] is None, x[0] if x[0] is not None else "", x[1] or ""))
        halves = [split_item(text or "") for _, text in items]
        sides = []
        for k in (0, 1):
            h, n = word_hashes([x[k].encode("utf-8", "surrogatepass").lower() for x in halves])
            sides.append(np.split(h, np.cumsum(n)[:-1]) if len(n) else [])
        parsed = [(item_id, q, a) for (item_id, _), q, a in zip(items, *sides, strict=True) if len(q) + len(a)]
        self.ids = [p[0] for p in parsed]
        self.sizes = [min(words, len(q)) for _, q, _ in parsed]
        self.question, self.question_at = _flat([shingle_hashes(q, words) for _, q, _ in parsed], np.uint64)
        self.answer, self.answer_at = _flat([np.unique(a) for *_, a in parsed], np.uint64)
        self.overlap, self.block = overlap, block
        order = [np.concatenate((q, a)) for _, q, a in parsed]
        flat, ends = _flat(order, np.uint64)
        length = np.diff(ends)
        self.terms, term = np.unique(flat, return_inverse=True)
        cell, count = np.unique(np.repeat(np.arange(len(parsed)), length) * max(len(self.terms), 1) + term, return_counts=True)
        item, term = cell // max(len(self.terms), 1), cell % max(len(self.terms), 1)
        # items, mean length and the items of each term: of the whole benchmark where this is a part of it
        known, mean, df = whole or (len(parsed), float(length.mean()) if len(parsed) else 1.0, None)
        held = np.bincount(term, minlength=len(self.terms)) if df is None else np.array([df[int(t)] for t in self.terms], np.int64)
        idf = np.log(1 + (known - held + 0.5) / (held + 0.5))
        raw = idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * length[item] / mean))
        score = np.bincount(item, raw, len(parsed))
        weight = raw / score[item]
        self.item_at = np.searchsorted(item, np.arange(len(parsed) + 1))
        self.item_term, self.item_weight = self.terms[term], weight
        self.least = np.array([threshold * self._poorest(order[i], i) for i in range(len(parsed))])
        ratio = weight / self.least[item] * (1 + 1e-6)
        # the most common terms of an item that weigh less than half its threshold are not essential
        by = np.lexsort((term, -held[term], item))
        run = np.cumsum(ratio[by])
        run -= np.repeat((run - ratio[by])[self.item_at[:-1][np.diff(self.item_at) > 0]], np.diff(self.item_at)[np.diff(self.item_at) > 0]) if len(run) else 0
        essential = np.empty(len(by), bool)
        essential[by] = run >= 0.5
        self.blocks = max(1, -(-len(parsed) // block))
        rest = np.zeros(len(parsed))
        np.add.at(rest, item[~essential], ratio[~essential])
        self.rest = np.zeros(self.blocks)
        np.maximum.at(self.rest, np.arange(len(parsed)) // block, rest)
        # postings by term and item, block maxima by term and block
        by = np.lexsort((item, term))
        key = term[by] * self.blocks + item[by] // block
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        self.posting, self.posting_weight = item[by].astype(np.int32), weight[by]
        self.list_key, self.list_at = key[edge], np.append(edge, len(key))
        self.list_bound = np.maximum.reduceat(ratio[by], edge).astype(np.float32) * np.float32(1 + 1e-6) if len(key) else np.empty(0, np.float32)
        live = by[essential[by]]
        key = term[live] * self.blocks + item[live] // block
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        self.live_block = (key[edge] % self.blocks).astype(np.int32)
        self.live_bound = np.maximum.reduceat(ratio[live], edge) if len(key) else np.empty(0)
        self.live_at = np.searchsorted(key[edge] // self.blocks, np.arange(len(self.terms) + 1))
        self.rare = self._rare()

    @property
    def nbytes(self) -> int:
        """Bytes of all arrays."""
        own = sum(v.nbytes for v in vars(self).values() if isinstance(v, np.ndarray))
        return own + sum(x.nbytes for v in self.rare.values() for x in v)

    def _own(self, item: int) -> tuple[np.ndarray, np.ndarray]:
        """The sorted terms of an item with their weights."""
        low, high = self.item_at[item], self.item_at[item + 1]
        return self.item_term[low:high], self.item_weight[low:high]

    def _poorest(self, order: np.ndarray, item: int) -> float:
        """The least that a run of as many words scores as a passage is sure to hold."""
        size = PASSAGE - STRIDE + 1
        if len(order) <= size:
            return 1.0
        terms, weights = self._own(item)
        at = np.searchsorted(terms, order).tolist()
        weights = weights.tolist()
        return min(sum(weights[t] for t in set(at[k : k + size])) for k in range(len(at) - size + 1))

    def question_of(self, item: int) -> np.ndarray:
        return self.question[self.question_at[item] : self.question_at[item + 1]]

    def _rare(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By words in a shingle: sorted shingles, where the items of each begin, and the items.

        Only the rarest shingles of each question, so many that a document without any of them misses too many.
        """
        questions = [self.question_of(i).tolist() for i in range(len(self.ids))]
        df = Counter((n, x) for n, q in zip(self.sizes, questions, strict=True) for x in q)
        pairs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, (n, q) in enumerate(zip(self.sizes, questions, strict=True)):
            need = max(1, int(np.ceil(len(q) * (self.overlap - 1e-9) - 1e-9)))
            for x in sorted(q, key=lambda x: (df[n, x], x))[: len(q) - need + 1]:
                pairs[n].append((x, i))
        out = {}
        for n, own in pairs.items():
            own.sort()
            keys, at = np.unique(np.array([x for x, _ in own], np.uint64), return_index=True)
            out[n] = keys, np.append(at, len(own)), np.array([i for _, i in own], np.int64)
        return out

    def spread(self, hashes: np.ndarray, counts: np.ndarray) -> list[set[int]]:
        """For each text all items of which it holds enough question shingles, wherever they stand, and some more."""
        out: list[set[int]] = [set() for _ in counts]
        ends = np.cumsum(counts)
        for n, (keys, at, items) in self.rare.items():
            if len(hashes) < n:
                continue
            h = mix64(np.uint64(n) + combine(hashes, n))
            k = np.searchsorted(keys, h)
            k[k == len(keys)] = 0
            where = np.flatnonzero(keys[k] == h)
            text = np.searchsorted(ends, where, "right")
            inside = where + n <= ends[text]
            for key in np.unique(text[inside] * len(keys) + k[where[inside]]).tolist():
                x = key % len(keys)
                out[key // len(keys)].update(items[at[x] : at[x + 1]].tolist())
        return out

    def score(self, item: int, words: np.ndarray) -> float:
        """The best BM25 score of a text's passages for an item."""
        terms, weights = self._own(item)
        k = np.searchsorted(terms, words)
        k[k == len(terms)] = 0
        where = np.flatnonzero(terms[k] == words)
        tiles: dict[int, set[int]] = defaultdict(set)
        for p, t in zip((where // STRIDE).tolist(), k[where].tolist(), strict=True):
            tiles[p].add(t)
        return max((float(weights[sorted(tiles[p] | tiles.get(p + 1, set()))].sum()) for p in sorted({*tiles, *(x - 1 for x in tiles if x)}, reverse=True)), default=0.0)

    def search(self, terms: np.ndarray, blocks: list[int]) -> dict[int, float]:
        """All items of the given blocks whose score for the distinct ``terms`` reaches their threshold, by block-max WAND."""
        found: dict[int, float] = {}
        for b in blocks:
            key = terms * self.blocks + b
            at = np.searchsorted(self.list_key, key)
            at[at == len(self.list_key)] = 0
            cursors = []
            for x in at[self.list_key[at] == key].tolist():
                low, high = self.list_at[x], self.list_at[x + 1]
                own = list(zip(self.posting[low:high].tolist(), self.posting_weight[low:high].tolist(), strict=True))
                cursors.append([own, 0, float(self.list_bound[x])])
            while cursors:
                cursors.sort(key=lambda c: c[0][c[1]][0])
                total, pivot = 0.0, -1
                for x, c in enumerate(cursors):
                    total += c[2]
                    if total >= 1 - 1e-6:
                        pivot = x
                        break
                if pivot < 0:
                    break
                item = cursors[pivot][0][cursors[pivot][1]][0]
                if cursors[0][0][cursors[0][1]][0] == item:
                    value = 0.0
                    for c in cursors:
                        if c[0][c[1]][0] == item:
                            value += c[0][c[1]][1]
                            c[1] += 1
                    if value >= self.least[item] - 1e-9:
                        found[item] = max(found.get(item, 0.0), value)
                else:
                    for c in cursors[:pivot]:
                        while c[1] < len(c[0]) and c[0][c[1]][0] < item:
                            c[1] += 1
                cursors = [c for c in cursors if c[1] < len(c[0])]
        return found

    def retrieve(self, hashes: np.ndarray, counts: np.ndarray, cells: int = 1 << 20) -> list[dict[int, float]]:
        """For each text (its words' hashes in a row) the items that any of its passages retrieves, with the best score.

        ``cells`` bounds how many sums, and how many terms of them, are held at once.
        """
        out: list[dict[int, float]] = [{} for _ in counts]
        if not len(self.terms) or not len(hashes):
            return out
        k = np.searchsorted(self.terms, hashes)
        k[k == len(self.terms)] = 0
        known = self.terms[k] == hashes
        where, term = np.flatnonzero(known), k[known]
        ends = np.cumsum(counts)
        begins = ends - counts
        # tiles of STRIDE words within each text; a passage is a tile with the next one
        tile_of_text = np.maximum(-(-counts // STRIDE), 1)
        first_tile = np.cumsum(tile_of_text) - tile_of_text
        text = np.searchsorted(ends, where, "right")
        tile = first_tile[text] + (where - begins[text]) // STRIDE
        n_tiles = int(tile_of_text.sum())
        owner = np.repeat(np.arange(len(counts)), tile_of_text)
        # one term counts once within a tile
        key = np.unique(tile * len(self.terms) + term)
        tile, term = key // len(self.terms), key % len(self.terms)
        start = np.searchsorted(tile, np.arange(n_tiles + 1))
        width = self.live_at[term + 1] - self.live_at[term]
        summed = np.concatenate(([0], np.cumsum(width)))
        least = 1 - 1e-3 - self.rest
        low = 0
        while low < n_tiles:
            # tiles low to high, and the one behind them for the last passage
            high = min(n_tiles, low + max(1, cells // self.blocks))
            high = max(low + 1, min(high, int(np.searchsorted(summed[start], summed[start[low]] + cells, "right")) - 1))
            last = min(n_tiles, high + 1)
            a, b = start[low], start[last]
            at = _ragged(self.live_at[term[a:b]], width[a:b])
            cell = np.repeat((tile[a:b] - low) * self.blocks, width[a:b]) + self.live_block[at]
            sums = np.bincount(cell, self.live_bound[at], (last - low) * self.blocks).reshape(last - low, self.blocks)
            total = sums[: high - low]
            same = owner[low + 1 : last] == owner[low : last - 1]
            total[: len(same)] += np.where(same[:, None], sums[1 : 1 + len(same)], 0)
            for p in np.flatnonzero((total >= least).any(axis=1)).tolist():
                end = low + p + 1 + int(p < len(same) and same[p])
                best = out[owner[low + p]]
                for item, value in self.search(np.unique(term[start[low + p] : start[end]]), np.flatnonzero(total[p] >= least).tolist()).items():
                    best[item] = max(best.get(item, 0.0), value)
            low = high
        return out

    def verify(self, item: int, words: np.ndarray, shingles: dict[int, np.ndarray]) -> tuple[float, float]:
        """Shares of the item's question shingles and of its answer words that the document holds."""
        n = self.sizes[item]
        if n not in shingles:
            shingles[n] = shingle_hashes(words, n) if len(words) >= n else words[:0]
        q, a = self.question_of(item), self.answer[self.answer_at[item] : self.answer_at[item + 1]]
        if 0 not in shingles:
            shingles[0] = np.unique(words)
        in_q = float(np.isin(q, shingles[n], assume_unique=True).mean()) if len(q) else 1.0
        in_a = float(np.isin(a, shingles[0], assume_unique=True).mean()) if len(a) else 1.0
        return in_q, in_a


def _counts(items: DataFrame) -> DataFrame:
    """(part, t, n) of ``items`` (part, text): a row with its length for each item with words, and one for each of its distinct terms t."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1).to_pylist()), strict=True):
                w = word_hashes([text.lower()])[0]
                if len(w):
                    t = np.unique(w).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([part] * (len(t) + 1), pa.int64()), pa.array([None, *t.tolist()], pa.int64()), pa.array([len(w)] + [0] * len(t), pa.int64())], names=["part", "t", "n"])

    return items.mapInArrow(run, "part long, t long, n long")


def hits_type(kind: T.DataType) -> T.ArrayType:
    """The type of hits for item ids of type ``kind``."""
    return T.ArrayType(T.StructType([T.StructField("item_id", kind), T.StructField("bm25", T.DoubleType()), T.StructField("question", T.DoubleType()), T.StructField("answer", T.DoubleType())]))


def _parts(spark, items: DataFrame, parts: int, **settings) -> list:
    """One broadcast index for each part of the items (by a hash of the item), with the term counts of all."""
    at_part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    if parts == 1:
        return [spark.sparkContext.broadcast(Index([tuple(r) for r in items.collect()], **settings))]
    terms = staged(_counts(items.select(at_part.cast("long").alias("part"), "text")), "terms")
    n, length = terms.where("t is null").agg(F.count(F.lit(1)), F.sum("n")).first()
    df = staged(terms.where("t is not null").groupBy("t").agg(F.count(F.lit(1)).alias("k")), "df")
    out = []
    for part in range(parts):
        own = [tuple(r) for r in items.where(at_part == part).collect()]
        mine = terms.where((F.col("part") == part) & F.col("t").isNotNull()).select("t").distinct().join(df, "t").collect()
        whole = n, (length or 0) / max(n, 1), {r["t"] % (1 << 64): r["k"] for r in mine}
        out.append(spark.sparkContext.broadcast(Index(own, whole=whole, **settings)))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, words: int = 5, overlap: float = 0.8, threshold: float = 0.6, part_bytes: int = 4 << 20, text: str = "text", hits: str = "hits") -> DataFrame:
    """``docs`` with ``hits``: the test items that a document holds, by item id, with their scores and overlaps.

    A hit has at least ``overlap`` of its question's distinct ``words``-word shingles and of its
    answer's distinct words in the document (A-Z lower-cased, words outside 0x20 and 0x09-0x0D).
    ``threshold`` is what a passage has to score to retrieve an item (see ``Index``); what it misses
    the question's rarest shingles retrieve.

    The benchmark is indexed in parts of about ``part_bytes`` of items, each a broadcast of its own
    of some 20 times that size; one Python stage reads the documents once, hashes the words of a
    slice once and takes the parts in turn, letting go of one before the next. So a task holds one
    part and one slice however large the benchmark grows.

    Defined cases: null and empty texts hold nothing; an item without words is never found; items
    with one id are found each for itself and the id is listed once with its best overlap; equal
    documents have equal hits; item ids keep their type and null is an id like any other; an empty
    benchmark finds nothing. Other columns pass through; one named like ``hits`` is replaced.
    """
    spark = docs.sparkSession
    kind = benchmark.schema["item_id"].dataType
    kind = T.LongType() if isinstance(kind, T.IntegralType) else kind
    items = benchmark.select(F.col("item_id").cast(kind).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    parts = max(1, -(-int(size) // part_bytes))
    indices = _parts(spark, items, parts, words=words, overlap=overlap, threshold=threshold)

    def fn(texts):
        hashes, counts = word_hashes([t.lower() for t in utf8(texts)])
        ends = np.cumsum(counts)
        rows: list[dict] = [{} for _ in texts]
        seen: list[dict] = [{} for _ in texts]
        for held in indices:
            ix = held.value
            found, far = ix.retrieve(hashes, counts), ix.spread(hashes, counts)
            for k, best in enumerate(found):
                for item in sorted({*best, *far[k]}):
                    own = hashes[ends[k] - counts[k] : ends[k]]
                    q, a = ix.verify(item, own, seen[k])
                    name = ix.ids[item]
                    if q >= overlap - 1e-9 and a >= overlap - 1e-9 and (name not in rows[k] or rows[k][name]["question"] < q):
                        rows[k][name] = {"item_id": name, "bm25": best[item] if item in best else ix.score(item, own), "question": q, "answer": a}
            if len(indices) > 1:
                held.__dict__.pop("_value", None)  # read again from the executor's disk for the next slice
        return ([[r[n] for n in [*sorted(n for n in r if n is not None), *[n for n in r if n is None]]] for r in rows],)

    return with_arrow(docs, [text], [T.StructField(hits, hits_type(kind))], fn, slice_bytes=1 << 20 if parts == 1 else 8 << 20)


# The same result by SQL alone, for tests: all items against all documents.
ORACLE = r"""
WITH i AS (
  SELECT item_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> '') AS l FROM benchmark
), qa AS (
  SELECT item_id, CASE WHEN len(l) > 1 THEN array_to_string(l[:len(l) - 1], chr(10)) ELSE array_to_string(l, chr(10)) END AS q,
         CASE WHEN len(l) > 1 THEN l[-1] ELSE '' END AS a FROM i
), lowered AS (
  SELECT item_id, regexp_extract_all(translate(q, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS qw,
         list_distinct(regexp_extract_all(translate(a, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS aw FROM qa
), item AS (
  SELECT item_id, aw, list_distinct(list_transform(range(1, len(qw) - least(5, len(qw)) + 2), lambda k: array_to_string(qw[k:k + least(5, len(qw)) - 1], ' '))) AS qs, least(5, len(qw)) AS n FROM lowered WHERE len(qw) > 0
), shingle AS (SELECT item_id, n, len(qs) AS total, len(aw) AS answers, aw, unnest(qs) AS s FROM item
), doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, d.n, array_to_string(w[k:k + d.n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM doc, (SELECT DISTINCT n FROM item)) d
), hit AS (
  SELECT doc_id, item_id, any_value(aw) AS aw, any_value(answers) AS answers FROM grams JOIN shingle USING (n, s) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(total) - 1e-9
), good AS (
  SELECT hit.doc_id, item_id FROM hit JOIN doc USING (doc_id)
  WHERE len(list_intersect(list_distinct(w), aw)) >= 0.8 * answers - 1e-9
)
SELECT d.doc_id, count(item_id) > 0 AS contaminated, count(item_id) AS n_items, coalesce(string_agg(item_id, ',' ORDER BY item_id), '') AS item_ids
FROM documents d LEFT JOIN good USING (doc_id) GROUP BY d.doc_id
"""


def leak_columns(found: DataFrame, hits: str = "hits") -> list:
    """contaminated, n_items, and the item ids joined by commas."""
    return [(F.size(hits) > 0).alias("contaminated"), F.size(hits).cast("long").alias("n_items"), F.array_join(F.transform(hits, lambda h: h["item_id"].cast("string")), ",").alias("item_ids")]
