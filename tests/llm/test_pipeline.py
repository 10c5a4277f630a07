"""The pipeline's stages against plain versions, on a small corpus with planted cases."""

import random

from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(n, seed):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


def test_stages(spark, tmp_path):
    import corpus_pipeline as pipeline

    item = words(40, 9999)
    rows = {i: words(60, i) + "." for i in range(80)}
    for i in range(80, 140):
        rows[i] = " ".join(f"J{i}{j}!!$$" for j in range(50))
    for i in range(12):
        rows[i] += "\nCommon line"
    rows[200] = rows[20] + " tail"
    rows[201] = f"{words(30, 201)} {item} {words(30, 202)}"
    rows[202] = None
    data = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows.items()]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, int(i < 80), 0) for i in range(140)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns[:5] == COLUMNS
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    clean = set(range(80))
    assert kept[0] >= clean | {200, 201} and not kept[0] & set(range(80, 140))
    assert kept[1] == kept[0] and kept[2] == kept[1] - {200} and kept[3] == kept[2] - {201} and kept[4] == kept[3]
    lines = spark.read.parquet(str(tmp_path / "line_dedup")).where(F.col("text").contains("Common line")).count()
    assert lines == 0
    assert {r["doc_id"] for r in pipeline.run(spark, str(tmp_path)).collect()} == kept[4]


def test_near_copies_keep_one_row_of_a_component(spark):
    import corpus_pipeline as pipeline

    one, two = words(60, 1), words(60, 2)
    rows = [(7, one), (7, one), (7, one + " tail"), (None, one), (8, one), (None, two), (None, two), (None, two + " end"), (5, None), (5, None), (None, ""), (6, words(60, 3))]
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.near_copies(spark, docs, "").collect()
    assert sorted((str(r["doc_id"]), r["text"] and r["text"].split()[0]) for r in got if r["text"]) == sorted([("7", one.split()[0]), ("None", two.split()[0]), ("6", words(1, 3))])
    assert sorted(str(r["doc_id"]) for r in got if not r["text"]) == ["5", "5", "None"]


def test_stages_on_empty_and_odd_tables(spark, tmp_path):
    import corpus_pipeline as pipeline

    spark.createDataFrame([(1, words(40, 1))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row long, _first string, Score double"
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, words(30, 5), None, None, 9), (2, words(30, 5), None, None, 9), (3, words(90_000, 6), "en", "s", 1), (4, " \n\t", "en", "t", 3)]
    for data in ([], [(*r, 7, "x", 0.5) for r in rows]):
        docs = spark.createDataFrame(data, schema)
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns[:5] == COLUMNS and out.count() <= len(data), name
        kept = pipeline.near_copies(spark, docs, "").collect()
        assert len(kept) == (6 if data else 0)  # one of the equal documents goes, rows without words stay
        mixed = pipeline.mix(spark, docs, "").collect()
        assert len(mixed) == len(data)
