"""A model folder: made once, read again by another session's names, and never shuffled when it is asked."""

from gramloom.operators import models
from gramloom.schemas import END
from gramloom.sources.store import saved, scratch
from tests.test_models import brute_tables, corpus, sentence_frame


def test_folder_is_made_once_and_not_shuffled(spark):
    c = corpus(2, 40)
    path, asked = scratch(spark, "model"), []

    def source():
        asked.append(1)
        return sentence_frame(spark, c)

    first = models.NgramModel(models.Folder(spark, path, 4), source, 3)
    word = {r.token_id: r.token for r in first.vocabulary().collect()}
    t = brute_tables(c, 3)
    for n in (1, 2, 3):
        assert {tuple(word[r[k]] for k in range(n)): r["count"] for r in first.consistent(n).collect()} == dict(t[n])
        assert first.ranges(n).count() == len(t[n])
    again = models.NgramModel(models.Folder(spark, path, 4), source, 3)
    assert again.consistent(2).collect() and sorted(again.ranges(3).collect()) == sorted(first.ranges(3).collect()) and len(asked) == 1

    many = saved(again.consistent(3).select("w1", "w2").distinct())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = many.join(again.ranges(3), ["w1", "w2"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    model_side = [x for x in plan.split("Scan ") if "cf1" in x and "Bucketed: true" in x]
    assert model_side and plan.count("Exchange") <= 1  # the asks' only


def test_sentence_ids_of_hot_and_unknown_tokens(spark):
    c = [["a"] * 50 + ["b", END], ["zz", "a"]]
    own = saved(sentence_frame(spark, c))
    vocab = saved(models.counted_vocabulary(sentence_frame(spark, c[:1])))
    ids = {r.token: r.token_id for r in vocab.collect()}
    got = {r.doc_id: r.ids for r in models.sentence_ids(own, vocab, ["doc_id", "sent"]).collect()}
    assert got == {k: [ids.get(w, models.UNKNOWN) for w in s] for k, s in enumerate(c)}
