import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_near_dup import brute as near_brute
from wayfold.storage import materialize


def test_stages_take_effect(spark, tmp_path):
    uniq = lambda i, n=60: " ".join(f"u{i}x{j}" for j in range(n))
    bench = " ".join(f"b{j}" for j in range(20))
    rows = [(i, uniq(i), "en", "s", 0) for i in range(6)]
    rows += [(10, uniq(0) + " tail", "en", "s", 0), (11, "too short", "en", "s", 0), (12, uniq(12) + " " + bench, "en", "s", 0), (13, uniq(13) + " password=abcdef99", "en", "s", 0), (14, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in cp.STAGES:
        out = materialize(stage(spark, docs, str(tmp_path)), name)
        if name != "tokenise":
            assert out.columns == docs.columns
        if name == "near_duplicates":
            texts = [(r.doc_id, r.text) for r in docs.collect()]
            assert sorted(r.doc_id for r in out.collect()) == [d for d, _, _, k in near_brute(texts) if k]
        docs = out
        kept.append(sorted(r.doc_id for r in docs.collect()))
        if name == "secret_scan":
            assert [r.text for r in docs.filter("doc_id = 13").collect()] == [uniq(13) + " <assign>"]
    assert kept == [[0, 1, 2, 3, 4, 5, 10, 12, 13], [0, 1, 2, 3, 4, 5, 12, 13], [0, 1, 2, 3, 4, 5, 13], [0, 1, 2, 3, 4, 5, 13], [0, 1, 2, 3, 4, 5, 13]]
    assert docs.filter("not round_trip").count() == 0 and docs.filter("n_tokens <> size(ids)").count() == 0
    assert sorted(map(str, cp.run(spark, str(tmp_path)).collect())) == sorted(map(str, docs.collect()))


def test_near_duplicates_without_and_with_repeated_ids(spark):
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    rows = [(None, text(0)), (None, text(1)), (5, text(1) + " tail"), (6, text(2)), (6, text(2)), (7, text(3)), (7, text(4)), (None, text(5)), (None, text(5))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text) for r in cp.near_duplicates(spark, df, "").collect())
    assert got == sorted([("None", text(0)), ("5", text(1) + " tail"), ("6", text(2)), ("7", text(3)), ("7", text(4)), ("None", text(5))])


def test_empty_long_and_repeated_documents_with_extra_columns(spark, tmp_path):
    spark.createDataFrame([(1, "b " * 20)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, long, "s", 0, "x"), (1, long, "s", 0, "y"), (2, "", "s", 0, "x"), (None, None, None, None, None), (3, " ".join(f"v{i}" for i in range(80)), None, 0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, lines string").withColumn("lang", F.lit("en")).withColumn("_row", F.lit(7))
    for docs, ids in ((df, [1, 3]), (df.limit(0), [])):
        for _, stage in cp.STAGES:
            docs = materialize(stage(spark, docs, str(tmp_path)))
        assert sorted(r.doc_id for r in docs.collect()) == ids


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_whole_small_tables(spark):
    out = cp.run(spark, "/root/testdata/sf0.001")
    kept = out.count()
    assert 0 < kept < spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count() and out.filter("round_trip").count() == kept
