"""One query for each operator of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm import quality_gam
from sigloom.llm.common import staged, table
from sigloom.llm.decontaminate import ORACLE as OP4_SQL
from sigloom.llm.decontaminate import find_leaks, leak_columns
from sigloom.llm.html_extract import extract_text
from sigloom.llm.jpeg_media import thumbnail_columns, to_media
from sigloom.llm.line_dedup import dedup_lines
from sigloom.llm.mixing import mix_sources
from sigloom.llm.near_dedup import near_duplicates
from sigloom.llm.secret_scan import find_secrets
from sigloom.llm.substring_dedup import remove_repeats
from sigloom.llm.warc_archive import read_archives, write_archives


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_gam.train(docs, table(spark, sf_dir, "labels"))
    out = quality_gam.score(docs, model, threshold=0.7)
    return out.select("doc_id", (quality_gam.fold() == 2).alias("held_out"), "score", "predicted")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = thumbnail_columns(to_media(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), words=5, overlap=0.8)
    return found.select("doc_id", *leak_columns(found))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=400)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("repeated"))


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = staged(write_archives(table(spark, sf_dir, "pages"), min_bytes=100), "warc")
    return read_archives(archives, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _spelled(spans: str):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _count(kind: str):
    return F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", _count("assign"), _count("access"), _count("hex"), F.sha2(_spelled("base_spans"), 256).alias("base_sha256"), _spelled("secret_spans").alias("spans"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs, budget_share=1.0, repetition=4.0).select("doc_id", "source", "n_tokens", "weight", "copies", "block")


OP6_SQL = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), common AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT keyed.*, common.k IS NOT NULL AS hit FROM keyed LEFT JOIN common ON keyed.k = common.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE hit) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT hit), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_gam": op1_quality_gam,
        "op2_html_extract": op2_html_extract,
        "op3_jpeg_media": op3_jpeg_media,
        "op4_decontaminate": op4_decontaminate,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_warc_archive": op6_warc_archive,
        "op7_secret_scan": op7_secret_scan,
        "op8_line_dedup": op8_line_dedup,
        "op9_mix_sources": op9_mix_sources,
        "op10_near_dedup": op10_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_decontaminate": OP4_SQL, "op6_warc_archive": OP6_SQL, "op8_line_dedup": OP8_SQL}
