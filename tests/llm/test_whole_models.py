"""Models and limits come from every document, not from a sample, and from tables larger than a worker holds."""

import numpy as np
import pyarrow as pa

from gramloom.llm import language_id, toxicity
from gramloom.llm._shared import utf8


def test_trees_count_every_document(spark):
    rows = spark.range(4000).selectExpr("id AS doc_id", "concat('the house ', id) AS text", "if(id % 40 = 0, 'de', 'en') AS lang")
    known = language_id.learn(rows)
    texts = {"de": [], "en": []}
    for r in rows.filter(~language_id.held_out()).collect():
        texts[r["lang"]].append(r["text"])
    assert known.names == ["de", "en"]
    for name, tree in zip(known.names, known.trees, strict=True):
        grams, n = np.unique(language_id.windows(*utf8(pa.array(texts[name]))), return_counts=True)
        assert np.array_equal(tree.symbols[3][0], grams) and np.array_equal(tree.symbols[3][1], n)


def test_limits_come_from_all_held_out(spark):
    # a word in one held-out document of several thousand moves the mean
    rows = spark.range(20_000).selectExpr("id AS doc_id", "'the house by the river' AS text", "'en' AS lang")
    odd = next(r["doc_id"] for r in rows.filter(language_id.held_out()).sort("doc_id").collect()[1234:])
    other = rows.selectExpr("doc_id", f"if(doc_id = {odd}, repeat('zq', 400), text) AS text", "lang")
    known = language_id.learn(rows)
    (mean, _), (moved, _) = (language_id.limits(x, known)["en"] for x in (rows, other))
    held = rows.filter(language_id.held_out()).count()
    bits = known.code_lengths(*utf8(pa.array(["the house by the river", "zq" * 400])))[:, 0]
    assert abs(mean - bits[0] / 22) < 1e-9
    assert abs(moved - (bits[0] * (held - 1) + bits[1]) / (22 * (held - 1) + 800)) < 1e-9


def test_counts_in_parts_give_the_same(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.union(spark.createDataFrame([(-1, None, None), (-2, "", "en"), (-3, "Ωμέγα", None), (-4, "1 2 3", None)], docs.schema))
    whole = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    kept = {r["doc_id"] for r in language_id.accepted(docs).collect()}
    known = language_id.learn(docs)
    assert isinstance(known, language_id.Languages)
    monkeypatch.setattr(language_id, "MODEL_ROWS", 4000)
    parts = language_id.learn(docs)
    assert isinstance(parts, language_id.Parts) and len(parts.within) > 2
    assert [x for lo, hi in parts.within for x in range(lo, hi + 1)] == list(range(65536))
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert got.keys() == whole.keys()
    for i, r in whole.items():
        assert (got[i]["lang_pred"], got[i]["held_out"]) == (r["lang_pred"], r["held_out"])
        assert np.allclose([got[i]["score"], got[i]["bits_per_byte"] or 0], [r["score"], r["bits_per_byte"] or 0], rtol=1e-9)
    again = language_id.accepted(docs)
    assert again.columns == docs.columns and {r["doc_id"] for r in again.collect()} == kept


def test_a_language_may_be_missing_in_a_part(spark, monkeypatch):
    rows = [(k, t, n) for k, (t, n) in enumerate([("abab", "x"), ("cdcdcdcd", "y"), ("efgh", "y")] * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = sorted(map(tuple, language_id.identify(docs).select("doc_id", "lang_pred").collect()))
    monkeypatch.setattr(language_id, "MODEL_ROWS", 2)
    assert sorted(map(tuple, language_id.identify(docs).select("doc_id", "lang_pred").collect())) == whole


def test_toxicity_is_fitted_on_every_labelled_document(spark, monkeypatch):
    rows = spark.range(30_000).selectExpr("id AS doc_id", "if(id % 2 = 0, 'you vile fool. go', concat('good day. it is ', id)) AS text")
    labels = rows.selectExpr("doc_id", "CAST(doc_id % 2 = 0 AS INT) AS toxic")
    found = []
    monkeypatch.setattr(toxicity, "fit", lambda pull, documents, bucket, weight: found.append((documents, bucket)) or toxicity.NoisyOr(bucket, weight, -2.0))
    toxicity.learn(rows, labels)
    assert found[0][0] == rows.filter(~toxicity.held_out()).count() > 20_000 and len(found[0][1])


def test_toxicity_with_ids_joined_and_sums_in_spark(spark, monkeypatch):
    text = "concat('good day ', id % 7, if(id % 3 = 0, '. you vile fool', ''), if(id % 4 = 0, '. rotten old villain', ''), if(id % 50 = 1, '. the vile weather', ''))"
    docs = spark.range(600).selectExpr("id AS doc_id", f"{text} AS text")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 3 = 0 OR doc_id % 4 = 0 AS INT) AS toxic")
    monkeypatch.setattr(toxicity, "ROUNDS", 4)
    one = toxicity.learn(docs, labels)
    monkeypatch.setattr(toxicity, "FEW_IDS", 0)
    monkeypatch.setattr(toxicity, "PLACES", 0)
    other = toxicity.learn(docs, labels)
    assert len(one.bucket) and np.array_equal(one.bucket, other.bucket)
    assert np.allclose(one.weight, other.weight, rtol=1e-4) and np.isclose(one.bias, other.bias, rtol=1e-6)


def test_equal_evidence_makes_equal_bags():
    one = toxicity.bag_of(np.array([4, 4, 7, 9]), np.array([2, 5, 1, 2]))
    other = toxicity.bag_of(np.array([0, 3, 5, 5]), np.array([1, 2, 2, 5]))
    assert [x.tolist() for x in one] == [x.tolist() for x in other] == [[1, 2, 2, 5], [0, 1, 2, 2]]
    assert [len(x) for x in toxicity.bag_of(np.zeros(0, int), np.zeros(0, int))] == [0, 0]
