"""Requests make sums and places of the contexts that they ask for only; single counts need no table of pairs."""

import random

from gramloom.operators import backoff, counts, cumulative, models
from gramloom.schemas import END, START


def corpus(spark):
    r = random.Random(7)
    rows = [([START, *(r.choice("abcdefgh") for _ in range(r.randint(0, 7))), END],) for _ in range(120)]
    return spark.createDataFrame(rows, "tokens array<string>")


def test_near(spark, monkeypatch):
    own = corpus(spark)
    tables = counts.consistent(counts.ngram_counts(own, 3))
    wide = {n: t.select(*(t["ngram"][i].alias(f"w{i + 1}") for i in range(n)), "count") for n, t in tables.items()}
    asks = [(a, b, w) for a in (None, START, "a", "b", "zz") for b in (START, "a", "c", END, "zz") for w in ("a", "d", START, END, "zz")] + [(None, None, START), (None, None, "a")]
    requests = spark.createDataFrame(asks, "c1 string, c2 string, w string")
    model = backoff.BackoffModel(wide, 0.1, 0.01, 0)
    near = model.near(requests)
    assert near.tables[3].count() < wide[3].count()
    told = lambda: [sorted(map(repr, f(requests).collect())) for f in (model.score, model.intervals)]
    few = told()
    monkeypatch.setattr(backoff, "FEW_ASKS", -1)
    assert few == told()


def test_contexts(spark, tmp_path):
    model = models.NgramModel(models.Folder(spark, f"file://{tmp_path}/m"), lambda: corpus(spark), 3)
    one, two = model.contexts(2).collect(), cumulative.contexts(model.ranges(2), 2).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two)) and len(one) == 9
    model = models.NgramModel(models.Folder(spark, f"file://{tmp_path}/n"), lambda: corpus(spark), 3)
    model.ranges(1), model.contexts(2)
    assert not (tmp_path / "n/tables/every").exists()
