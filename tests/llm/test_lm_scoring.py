"""Counts of real words: scores against dictionaries of the words themselves, with more words and pairs than any small table of ids holds apart."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from gramloom.llm import lm_scoring


def test_scores_are_those_of_real_words(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK", 1 << 18)  # several blocks
    rng = random.Random(1)
    common = [f"c{k}" for k in range(40)]
    texts = [" ".join(rng.choice(common) if rng.random() < 0.3 else f"w{rng.randrange(600_000)}" for _ in range(2000)) for _ in range(300)]
    texts += [texts[0], "", "one", "c1 c2 c1 c2 c1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = spark.createDataFrame([(k,) for k in range(0, 300, 5)], "doc_id long")
    got = {r["doc_id"]: r for r in lm_scoring.cross_entropy_difference(df, ids).collect()}
    assert len(got) == len(texts)

    words = [re.findall("[0-9a-z]+", t) for t in texts]
    models = []
    target = set(range(0, 300, 5))
    for chosen in (target, set(range(len(texts))) - target):
        word, before, pair = Counter(), Counter(), Counter()
        for k in chosen:
            word.update(words[k])
            before.update(["", *words[k]][: len(words[k])])
            pair.update(zip(["", *words[k]], words[k], strict=False))
        models.append((word, before, pair, sum(word.values())))
    size = len(set(models[0][0]) | set(models[1][0]))
    weights = (1, models[0][3] / models[1][3])
    assert size > 1 << 18
    for k, own in enumerate(words):
        loss = []
        mine = Counter(own), Counter(["", *own][: len(own)]), Counter(zip(["", *own], own, strict=False))
        for side, (x, (word, before, pair, n)) in enumerate(zip(weights, models, strict=True)):
            left = (k in target) == (side == 0)  # a document's own words are not in the model that scores it
            w_, b_, p_ = (c if left else Counter() for c in mine)
            n = n - len(own) if left else n
            loss.append([math.log2(x * (before[h] - b_[h]) + lm_scoring.MU) - math.log2(x * (pair[h, w] - p_[h, w]) + lm_scoring.MU * (x * (word[w] - w_[w]) + 1) / (x * n + size)) for h, w in zip(["", *own], own, strict=False)])
        assert got[k]["n_tokens"] == len(own)
        for name, x in (("target_bits", loss[0]), ("background_bits", loss[1])):
            assert abs(got[k][name] - sum(x) / max(1, len(own))) < 1e-9
        assert abs(got[k]["gain_share"] - sum(a < b for a, b in zip(*loss, strict=True)) / max(1, len(own))) < 1e-2


def auc(scores, target):
    ranked = sorted(scores, key=scores.get)
    at = [k for k, d in enumerate(ranked) if d in target]
    return 1 - (sum(at) - len(at) * (len(at) - 1) / 2) / (len(at) * (len(ranked) - len(at)))


def test_a_random_target_is_not_told_apart(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    weights = [1 / (k + 1) for k in range(3000)]
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(30, 200))) for _ in range(1200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    target = set(rng.sample(range(1200), 300))
    got = lm_scoring.cross_entropy_difference(df, spark.createDataFrame([(k,) for k in target], "doc_id long")).collect()
    assert 0.45 < auc({r["doc_id"]: r["score"] for r in got}, target) < 0.55


def test_equal_rows_are_dealt_out(spark):
    df = spark.createDataFrame([(None, "a b c")], "doc_id long, text string").crossJoin(spark.range(5000)).select("doc_id", "text", F.monotonically_increasing_id().alias("_row"))
    sizes = [r["count"] for r in df.groupBy(lm_scoring._block_ids(8)).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1000
