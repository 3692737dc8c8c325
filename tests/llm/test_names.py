"""Columns of documents and pages that have the names of the operators' own."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gramloom.llm import html_text

NAMES = ["score", "predicted", "offending", "lang_pred", "bits_per_byte", "_text", "_id", "_sha", "_key", "_ID_1", "_row", "kept", "text_key"]


@pytest.fixture(scope="module")
def clashing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 60")
    return docs.select("*", *(F.concat(F.lit(f"{n} "), "doc_id").alias(n) for n in NAMES)).localCheckpoint()


@pytest.mark.parametrize("k", range(5))
def test_stages_take_clashing_names(spark, sf, clashing, k):
    name, stage = corpus_pipeline.STAGES[k]
    got = stage(spark, clashing, sf)
    if name == "packing":
        assert got.count() > 0
        return
    assert got.columns == clashing.columns
    rows = got.collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in stage(spark, clashing.drop(*NAMES), sf).collect()}
    assert rows and all(r[n] == f"{n} {r['doc_id']}" for r in rows for n in NAMES)


def test_html_takes_clashing_names(spark):
    df = spark.createDataFrame([(1, "mine", "<article><p>x y</p></article>", 7)], "page_id long, text string, html string, n_chars long")
    got = html_text.extract(df)
    assert got.columns == ["page_id", "text", "n_chars", "text_1", "n_chars_1"]
    assert [tuple(r) for r in got.collect()] == [(1, "mine", 7, "x y", 3)]
