"""Counts, cumulative ranges and the back-off model against brute force."""

import math
import random
from collections import Counter
from fractions import Fraction

from pyspark.sql import functions as F

from gramloom.operators import backoff, codec, counts, cumulative
from gramloom.schemas import END, START


def corpus(seed=0, n=60, words="abcdef"):
    rng = random.Random(seed)
    return [[START, *rng.choices(words, k=rng.randint(1, 6)), END] for _ in range(n)]


def sentence_frame(spark, corpus_):
    return spark.createDataFrame([(i, 0, s) for i, s in enumerate(corpus_)], "doc_id int, sent int, tokens array<string>")


def brute_tables(corpus_, n_max):
    t = {n: Counter(tuple(s[i : i + n]) for s in corpus_ for i in range(len(s) - n + 1)) for n in range(1, n_max + 1)}
    for n in range(n_max - 1, 0, -1):
        left, right = Counter(), Counter()
        for g, c in t[n + 1].items():
            left[g[:-1]] += c
            right[g[1:]] += c
        t[n] = {g: max(t[n].get(g, 0), left[g], right[g]) for g in {*t[n], *left, *right}}
    return t


def model(t, **k):
    tables = {}
    for n, rows in t.items():
        for g, c in rows.items():
            tables.setdefault(n, {}).setdefault(g[:-1], {})[g[-1]] = c
    return codec.Backoff(tables, **k)


def test_consistent_tables(spark):
    c = corpus()
    found = counts.consistent(counts.ngram_counts(sentence_frame(spark, c), 3))
    for n, rows in brute_tables(c, 3).items():
        assert {tuple(r["ngram"]): r["count"] for r in found[n].collect()} == dict(rows)
    assert counts.inconsistencies(found).count() == 0


def test_merge_and_mark(spark):
    frame = lambda d: spark.createDataFrame([([k], v) for k, v in d.items()], "ngram array<string>, count long")
    got = counts.max_merge(frame({"a": 1, "c": 5}), frame({"b": 2, "c": 3, "d": 1}))
    assert {r["ngram"][0]: r["count"] for r in got.collect()} == {"a": 1, "b": 2, "c": 5, "d": 1}
    got = counts.mark(frame({"a": 1, "b": 1, "c": 1}), frame({"b": 9}))
    assert {r["ngram"][0]: r["reject"] for r in got.collect()} == {"a": False, "b": True, "c": False}


def test_year_integration(spark):
    rows = [("of", "the", 1990, 3, 2), ("of", "the", 1991, 4, 1), ("of_ADP", "the", 1990, 9, 9)]
    raw = spark.createDataFrame(rows, "w1 string, w2 string, year int, match_count long, volume_count long")
    assert [(r["ngram"], r["count"]) for r in counts.integrate_years(raw, 2).collect()] == [(["of", "the"], 7)]


def test_prefix_sums_equal_a_window(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(1, 9)) for i in range(500)]
    rng.shuffle(rows)
    got = counts.prefix_sums(spark.createDataFrame(rows, "k int, count long"), ["k"], parts=7).orderBy("k").collect()
    at = 0
    for r in got:
        assert (r["cf1"], r["cf2"]) == (at, at + r["count"])
        at += r["count"]
    assert counts.prefix_sums(spark.createDataFrame([], "k int, count long"), ["k"]).count() == 0


def test_vocabulary_order(spark):
    t = spark.createDataFrame([([w], 1) for w in ("b", START, "1", ",", END, "a", "ab")], "ngram array<string>, count long")
    got = [r["token"] for r in counts.vocabulary(t).orderBy("token_id").collect()]
    assert got == ["1", ",", END, START, "a", "ab", "b"]


def test_cumulative_model(spark):
    rows = {1: [(1, 3), (2, 1), (3, 4)], 2: [(1, 2, 2), (1, 3, 1), (3, 1, 3)]}
    ranges = {n: cumulative.cumulative(spark.createDataFrame(r, ", ".join([f"w{i} int" for i in range(1, n + 1)] + ["count long"])), n) for n, r in rows.items()}
    m = cumulative.CumulativeModel(ranges)
    ask = spark.createDataFrame([(1, 2), (1, 3), (3, 2), (2, 3), (9, 9)], "c1 int, w int")
    got = {(r["c1"], r["w"]): tuple(r[2:]) for r in m.probabilities(ask).collect()}
    assert got == {(1, 2): (0, 2, 3, 2), (1, 3): (2, 3, 3, 2), (3, 2): (3, 4, 8, 1), (2, 3): (4, 8, 8, 1), (9, 9): (None, None, None, None)}
    ask = spark.createDataFrame([(1, 0, 1, 2), (1, 1, 1, 2), (1, 3, 1, 4), (2, 7, 1, 8), (2, 3, 2, 8)], "c1 int, num long, size long, den long")
    got = {(r["c1"], r["num"]): (r["w"], r["level"]) for r in m.next_words(ask).collect()}
    assert got == {(1, 0): (2, 2), (1, 1): (None, 2), (1, 3): (3, 2), (2, 7): (3, 1), (2, 3): (None, 1)}


def test_backoff_scores(spark):
    c = corpus(5)
    t = brute_tables(c, 3)
    frames = {n: spark.createDataFrame([(*g, k) for g, k in rows.items()], ", ".join([f"w{i} string" for i in range(1, n + 1)] + ["count long"])) for n, rows in t.items()}
    m = model(t, beta=0.1, gamma=0.01, offset=0)
    words = [*"abcdef", START, END, "zz"]
    asks = [(None, None, w) for w in words] + [(None, START, w) for w in words] + [(x, y, w) for x in [*"abc", START] for y in [*"abf", END, START] for w in words]
    got = backoff.BackoffModel(frames).score(spark.createDataFrame(asks, "c1 string, c2 string, w string")).collect()
    assert len(got) == len(asks)
    seen = 0
    for r in got:
        context = tuple(x for x in (r["c1"], r["c2"]) if x is not None)
        try:
            want = -math.log2(codec.as_interval(m.conditional(r["w"], context))[1])
        except (ValueError, IndexError, KeyError):
            want = None
        if want is None:
            assert r["bits"] is None, r
        else:
            seen += 1
            assert r["bits"] is not None and abs(r["bits"] - want) < 1e-9, (r, want)
    assert seen > 50


def test_backoff_distribution(spark):
    c = corpus(7)
    t = brute_tables(c, 2)
    frames = {n: spark.createDataFrame([(*g, k) for g, k in rows.items()], ", ".join([f"w{i} string" for i in range(1, n + 1)] + ["count long"])) for n, rows in t.items()}
    m = model(t, beta=0.1, gamma=0.01, offset=0)
    got = {}
    for r in backoff.BackoffModel(frames).distribution(2).collect():
        got.setdefault(r["w1"], []).append((r["cum"], r["len"], r["token"]))
    for context, rows in got.items():
        rows.sort()
        tokens, ends = m.distribution((context,), None)
        assert [x[2] for x in rows if x[1]] == tokens and [x[0] + x[1] for x in rows if x[1]] == ends


def test_probabilities_sum_to_one():
    words = [f"w{i:02}" for i in range(60)]
    c = corpus(11, 200, words)
    m = model(brute_tables(c, 3), beta=0.1, gamma=0.01, offset=0)
    for context in [(START,), tuple(c[0][:2]), tuple(c[1][1:3]), ("w00", "w59")]:
        total = sum((codec.as_interval(m.conditional(w, context))[1] for w in {x for s in c for x in s} - {START} - ({END} if context[-1] == START else set())), Fraction(0))
        assert total == 1


def test_translate_rejects(spark):
    vocab = spark.createDataFrame([(1, "a", "a"), (2, "b", "b")], "token_id int, token string, part string")
    t = spark.createDataFrame([(["a", "b"], 2), (["a", "z"], 1)], "ngram array<string>, count long")
    got = counts.translate(t, vocab, 2)
    assert counts.id_table(got, 2).collect() == [(1, 2, 2)]
    assert got.filter(F.col("reject") == "unindexed").count() == 1


def request_frames(spark, c, offset):
    t = brute_tables(c, 3)
    t = {n: Counter({g: k * 40 for g, k in rows.items()}) for n, rows in t.items()}  # counts well over the offset
    frames = {n: spark.createDataFrame([(*g, k) for g, k in rows.items()], ", ".join([f"w{i} string" for i in range(1, n + 1)] + ["count long"])) for n, rows in t.items()}
    return backoff.BackoffModel(frames, offset=offset), model(t, beta=0.1, gamma=0.01, offset=offset)


def test_backoff_intervals_are_exact(spark):
    c = corpus(5)
    joins, brute = request_frames(spark, c, 35)
    tokens = [*"abcdef", START, END, "zz"]
    asks = [(None, None, w) for w in tokens] + [(None, START, w) for w in tokens] + [(x, y, w) for x in [*"abc", START] for y in [*"abf", END, START] for w in tokens]
    got = joins.intervals(spark.createDataFrame(asks, "c1 string, c2 string, w string")).collect()
    assert len(got) == len(asks)
    backed = 0
    for r in got:
        context = tuple(x for x in (r["c1"], r["c2"]) if x is not None)
        try:
            want = codec.as_interval(brute.conditional(r["w"], context))
        except (ValueError, IndexError, KeyError):
            want = None
        if want is None:
            assert r["parts"] is None, r
            continue
        i = (0, 1, 1)
        for p in r["parts"]:
            i = codec.narrowed(i, (p["lo"], p["hi"] - p["lo"], p["total"]))
        backed += len(r["parts"]) > 1
        assert codec.as_interval(i) == want, (r, want)
    assert backed > 20


def test_backoff_next_is_exact(spark):
    c = corpus(6)
    joins, brute = request_frames(spark, c, 35)
    rng = random.Random(1)
    asks = [(x, y, rng.randrange(1000), rng.choice([1, 1, 1, 60]), 1061) for x in [*"abcdz", START] for y in [*"abfz", END, START] for _ in range(6)] + [(None, START, k, 1, 50) for k in range(50)] + [(None, None, 1, 1, 2)]
    got = joins.next_words(spark.createDataFrame(asks, "c1 string, c2 string, num long, size long, den long")).collect()
    assert len(got) == len(asks)
    told = Counter()
    for r in got:
        context = tuple(x for x in (r["c1"], r["c2"]) if x is not None)
        want = brute.next((r["num"], r["size"], r["den"]), context)
        assert r["w"] == (want and want[0]), (r, want)
        told[r["level"]] += 1
    assert min(told[n] for n in (1, 2, 3)) > 5 and told[None] > 5
