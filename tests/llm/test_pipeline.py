"""The pipeline against a plain version of its stages, and the operators' queries against their oracles."""

import re

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from gramloom.llm import exact_dedup, near_dup, packing, queries
from gramloom.llm._shared import written
from tests.llm.test_small import brute_classes


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf).toPandas()
    want = con.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda v: "null" if pd.isna(v) else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
    rows = lambda df: sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
    assert rows(got) == rows(want)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "toxicity", "exact_dedup", "near_dedup", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in kept.select("doc_id", "text").collect()}
        kept = stage(spark, kept, sf)
        if name == "packing":
            break
        assert kept.columns == docs.columns
        after = {r["doc_id"] for r in kept.select("doc_id").collect()}
        assert after <= set(before)
        if name == "language_id":
            assert after == {i for i, t in before.items() if re.search(r"[^\W\d_]", t or "")}
        if name == "toxicity":
            labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            clean = {i for i in before if labels.get(i) == 0}
            assert len(clean - after) <= 0.05 * len(clean)
        if name == "exact_dedup":
            last = {}
            for i, t in before.items():
                key = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
                last[key] = max(i, last.get(key, i))
            assert after == set(last.values())
        if name == "near_dedup":
            ids = sorted(before)
            classes = brute_classes([(i, before[i]) for i in ids])
            least = {}
            for i, c in zip(ids, classes, strict=True):
                least[c] = min(i, least.get(c, i))
            assert after == set(least.values())
    pieces = kept.collect()
    assert {r["doc_id"] for r in pieces} == set(before)
    room = {}
    for r in pieces:
        room[r["sequence_id"]] = room.get(r["sequence_id"], 0) + r["length"]
    assert max(room.values()) <= 2048
    # near the least possible number of sequences
    assert len(room) <= -(-sum(room.values()) // 2048) * 1.1 + 1


def test_run_gives_the_stages(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns[:3] == ["doc_id", "piece", "start"]


def test_no_id_is_not_the_id_null(spark):
    rows = [(None, "the same text of some seven words"), ("null", "the same text of some seven words"), ("a", None), ("a", ""), ("a", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert sorted(r["doc_id"] for r in exact_dedup.keep_one(docs).collect()) == ["a", "null"]
    kept = near_dup.keep_one(docs).collect()
    told = {r["doc_id"] for r in near_dup.near_classes(docs).filter("kept").collect()}
    assert {r["doc_id"] for r in kept} == told


def test_equal_rows_are_packed_in_several_groups(spark):
    rows = spark.range(6000).selectExpr("CAST(NULL AS LONG) AS doc_id", "0 AS piece", "0L AS start", "100L AS length", "7L AS ids_crc32", "id AS _row")
    got = packing.pack(written(rows, "rows"), 2048, group_pieces=1000).collect()
    groups = {}
    for r in got:
        groups[r["sequence_id"] >> 40] = groups.get(r["sequence_id"] >> 40, 0) + 1
    assert len(got) == 6000 and len(groups) == 6 and max(groups.values()) < 1300
