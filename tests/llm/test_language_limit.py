"""Texts of languages that were not learned go, clean documents stay."""

from gramloom.llm import language_id

ITALIAN = "La mattina presto il vecchio pescatore usciva dal porto con la sua barca e guardava il mare che cominciava appena a schiarire sotto il cielo grigio. "
FINNISH = "Varhain aamulla vanha kalastaja lähti satamasta veneellään ja katseli merta, joka alkoi vasta vaaleta harmaan taivaan alla. "


def test_unlearned_languages_go(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(-1, ITALIAN * 8, None), (-2, FINNISH * 9, None), (-3, "1 2 3", None)], docs.schema)
    scored = {r["doc_id"]: r for r in language_id.predict(more, language_id.learn(docs)).collect()}
    assert max(scored[-1]["bits_per_byte"], scored[-2]["bits_per_byte"]) < language_id.REJECT_BITS
    got = {r["doc_id"] for r in language_id.accepted(docs.union(more)).collect()}
    assert got == {r["doc_id"] for r in docs.filter(r"text rlike '\\p{L}'").collect()}


def test_short_texts_have_wider_limits(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = language_id.limits(docs, language_id.learn(docs))
    assert set(found) == {"de", "en", "es", "fr"}
    assert all(1 < mean < 4 and spread >= language_id.LEAST_SPREAD for mean, spread in found.values())


def test_sample_is_bounded_without_ids(spark):
    rows = spark.range(20_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'the same text' AS text", "'en' AS lang")
    assert 300 < language_id._sample(rows, 1000)[0].count() < 2000
