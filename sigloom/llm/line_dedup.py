"""Line-level deduplication with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import BLANKS, ascii_lower, free_prefix


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("_h1"), F.xxhash64(F.lit(1), key).alias("_h2")]


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the lines that ``min_docs`` or more documents share removed from ``text``.

    Adds ``n_lines`` (before dropping) and ``n_dropped``; all other columns pass through.

    Lines are exploded, normalised and hashed to 128 bits; each document (id) counts once for a key
    however often it holds it. Only hashes are counted: first what is distinct by key and document,
    dealt by both, then partial counts by key, so a line that a third of all rows holds gathers in
    no task. They are joined back by a plain equi-join, which AQE splits where a key is hot; the
    positions that hit are then gathered per row and the kept lines put together by position. Texts
    are shuffled at most once, by row.

    Defined cases: a null or empty text is one empty line; an empty key is shorter than any
    ``min_chars`` of 1 or more and always stays; rows with one id are one document, and rows without
    an id are told apart by their texts; an empty table stays empty; columns with names used here are kept, as working columns
    start with an underscore and are renamed where they clash with the input's.
    """
    own = docs.columns
    tag = free_prefix(own)
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(body, "\n", -1)
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("\0null"))
    row = [F.xxhash64(ident, body).alias("r1"), F.xxhash64(F.lit(1), ident, body).alias("r2")]

    document = F.when(F.col(id_col).isNull(), F.xxhash64(F.lit(2), body)).otherwise(F.xxhash64(F.col(id_col).cast("string")))
    keys = docs.select(document.alias("d"), F.explode(F.array_distinct(F.transform(lines, line_key))).alias("k")).where(F.char_length("k") >= max(1, min_chars))
    common = keys.select("d", *_hashes(F.col("k"))).groupBy("_h1", "_h2").agg(F.count_distinct("d").alias("n")).where(F.col("n") >= min_docs).select("_h1", "_h2")

    placed = docs.select(*row, F.posexplode(lines).alias("pos", "line")).select("r1", "r2", "pos", line_key(F.col("line")).alias("k")).where(F.char_length("k") >= max(1, min_chars)).select("r1", "r2", "pos", *_hashes(F.col("k")))
    hits = placed.join(common, ["_h1", "_h2"], "left_semi").groupBy("r1", "r2").agg(F.collect_set("pos").alias("hit"))
    hits = hits.select(F.col("r1").alias(f"{tag}r1"), F.col("r2").alias(f"{tag}r2"), F.col("hit").alias(f"{tag}hit"))

    whole = docs.select("*", row[0].alias(f"{tag}r1"), row[1].alias(f"{tag}r2")).join(hits, [f"{tag}r1", f"{tag}r2"], "left")
    every = F.sequence(F.lit(0), F.size(f"{tag}lines") - 1)
    hit = F.coalesce(F.col(f"{tag}hit"), F.array().cast("array<int>"))
    kept = F.transform(F.array_except(every, hit), lambda i: F.element_at(F.col(f"{tag}lines"), i + 1))
    whole = whole.withColumn(f"{tag}lines", lines)
    out = [F.when(F.col(f"{tag}hit").isNull(), F.col(c)).otherwise(F.array_join(kept, "\n")).alias(c) if c == text else F.col(c) for c in own if c not in ("n_lines", "n_dropped")]
    return whole.select(*out, F.size(f"{tag}lines").cast("long").alias("n_lines"), F.size(hit).cast("long").alias("n_dropped"))
