"""Loads in turn equal one load; what a load doesn't touch stays; a lost load changes nothing."""

import random
from collections import Counter

import pytest

from gramloom.operators import loads
from gramloom.sources.store import scratch

SCHEMA = "ngram array<string>, count long"
ORDER = "0123456789_abcdefghijklmnopqrstuvwxyz"


def place(ngram):
    return [(ORDER.index(t[0]) if t[0] in ORDER and t not in ("_START_", "_END_") else ORDER.index("_"), t) for t in ngram]


def plain(*tables):
    total, at, out = Counter(), 0, []
    for table in tables:
        for ngram, n in table:
            total[tuple(ngram)] += n
    for ngram in sorted(total, key=place):
        out.append((ngram, total[ngram], at, at + total[ngram]))
        at += total[ngram]
    return out


def rows(df):
    return sorted(((tuple(r.ngram), r["count"], r.cf1, r.cf2) for r in df.collect()), key=lambda r: place(r[0]))


def some(seed, n, letters="abt19."):
    rng = random.Random(seed)
    token = lambda: rng.choice([*(c + rng.choice("xyz") for c in letters), "_START_", "_END_"])
    return [([token(), token()], rng.randint(1, 9)) for _ in range(n)]


def test_loads_in_turn_equal_one(spark):
    store = loads.CountStore(spark, scratch(spark, "loads"))
    assert rows(store.ranges()) == []
    tables = [some(1, 120), some(2, 80), some(3, 5, "t")]
    for k, t in enumerate(tables):
        assert store.load(f"load {k}", spark.createDataFrame(t, SCHEMA))
        assert rows(store.ranges()) == plain(*tables[: k + 1])
    assert not store.load("load 1", spark.createDataFrame(tables[1], SCHEMA))
    assert rows(store.ranges()) == plain(*tables)
    assert rows(store.ranges(store.versions()[0])) == plain(tables[0])
    with pytest.raises(ValueError):
        store.ranges("7")


def test_only_what_changes_is_written(spark):
    store = loads.CountStore(spark, scratch(spark, "loads"))
    store.load("one", spark.createDataFrame([(["a", "b"], 2), (["k", "b"], 3), (["z", "b"], 4)], SCHEMA))
    store.load("two", spark.createDataFrame([(["k", "a"], 5), (["k", "b"], 1)], SCHEMA))
    assert {(r.part, r.version[-1], r.total, r.offset) for r in store.manifest().collect()} == {("a", "1", 2, 0), ("k", "2", 9, 2), ("z", "1", 4, 11)}
    store.load("nothing", spark.createDataFrame([], SCHEMA))
    assert len(store.versions()) == 3 and not store.load("nothing", spark.createDataFrame([], SCHEMA))
    assert rows(store.ranges()) == [(("a", "b"), 2, 0, 2), (("k", "a"), 5, 2, 7), (("k", "b"), 4, 7, 11), (("z", "b"), 4, 11, 15)]


def test_a_lost_load_changes_nothing(spark, monkeypatch):
    store = loads.CountStore(spark, scratch(spark, "loads"))
    one, two = some(4, 30), some(5, 30)
    store.load("one", spark.createDataFrame(one, SCHEMA))
    with monkeypatch.context() as m:
        m.setattr(store, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.load("two", spark.createDataFrame(two, SCHEMA))
    assert rows(store.ranges()) == plain(one)
    assert store.load("two", spark.createDataFrame(two, SCHEMA))
    assert rows(store.ranges()) == plain(one, two)


@pytest.mark.parametrize("row", [(None, 1), ([], 1), ([None], 1), (["a"], None)])
def test_what_is_no_count_is_refused(spark, row):
    store = loads.CountStore(spark, scratch(spark, "loads"))
    with pytest.raises(Exception, match="asked for"):
        store.load("bad", spark.createDataFrame([row], SCHEMA))
    assert store.versions() == []
