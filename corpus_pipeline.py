"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, mixing.

``STAGES`` lists (name, function) pairs; each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``documents``; the last adds the mix: n_tokens, weight, copies, block.

Any column may be null, other columns are left out whatever their names, an empty table stays empty;
what nulls, ties and repeated rows give is said of each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm import quality_gam
from sigloom.llm.common import staged, table
from sigloom.llm.decontaminate import find_leaks
from sigloom.llm.line_dedup import dedup_lines
from sigloom.llm.mixing import mix_sources
from sigloom.llm.near_dedup import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model accepts; it learns from labels of the same documents.

    A null text is scored as an empty one; equal rows are kept or dropped together; without labels
    the model is constant (0.5) and accepts none.
    """
    model = quality_gam.train(docs, table(spark, sf_dir, "labels"))
    return quality_gam.score(docs, model, threshold=0.7).where("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that ten or more of them hold; ``n_chars`` follows the text.

    No row goes; a null text stays null; rows with one id are one document, those without an id are
    told apart by their texts.
    """
    out = dedup_lines(docs, min_docs=10, min_chars=1)
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest doc_id, nulls last; rows without words all stay.

    Equal rows are copies, so one of them stays; of rows with one id and different texts that are
    near copies, one stays by a hash of the row.
    """
    key = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in COLUMNS])
    keyed = docs.select(*COLUMNS).withColumn("_row", key)
    near = near_duplicates(keyed, words=5, percent=80, id_col="_row")
    # rows that are equal in all columns share a key, and n counts them
    near = near.groupBy(F.col("doc_id").alias("_row"), "n_shingles", "component_id").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row", "n", "n_shingles")
    kept = near.join(keyed.select("_row", "doc_id").distinct(), "_row").groupBy("component_id").agg(F.min(order).alias("r"))
    kept = staged(kept.select("r._row", ((F.col("r.n") > 1) & (F.col("r.n_shingles") > 0)).alias("_again")).groupBy("_row").agg(F.max("_again").alias("_again")), "kept")
    out = keyed.join(kept, "_row")
    return out.where("not _again").select(*COLUMNS).unionByName(out.where("_again").select(*COLUMNS).dropDuplicates())


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark. Null and empty texts hold none; equal rows go or stay together."""
    return find_leaks(docs, table(spark, sf_dir, "benchmark"), words=5, overlap=0.8).where(F.size("hits") == 0).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with how often each is to be read: as flat over sources as four repetitions allow.

    No row goes: those past their source's cut have 0 copies. A null source is a source; equal rows
    have equal copies; a text without words has no tokens.
    """
    return mix_sources(docs, budget_share=1.0, repetition=4.0).select(*COLUMNS, "n_tokens", "weight", "copies", "block")


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_copies), ("decontaminate", leaks), ("mix", mix)]

#: A trained model and a bisection have no SQL; the stages are held against brute force in tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs, name)
    return docs
