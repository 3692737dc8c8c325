"""Sequences and intervals under a tagged model, against plain dictionaries; some ranges of one context overlap here."""

import random

import pytest

from gramloom.operators import scan, tagged


def model(seed=3):
    rng = random.Random(seed)
    rows, at = [], 0
    grams = sorted([rng.choice("aAbBcCdDeE") * 2 for _ in range(3)] for _ in range(400))
    grams.sort(key=lambda w: [x.lower() for x in w] if rng.random() < 0.9 else w)  # some stand elsewhere: ranges overlap
    for w in grams:
        p = rng.randint(1, 9)
        rows.append((*w, p, at, at + p))
        at += p
    table = {}
    for *w, p, lo, hi in rows:
        for n in range(4):
            k = tuple(x.lower() for x in w[:n])
            q, a, b = table.get(k, (0, lo, hi))
            table[k] = (q + p, min(a, lo), max(b, hi))
    return rows, table


@pytest.fixture(scope="module")
def both(spark):
    rows, table = model()
    raw = spark.createDataFrame(rows, "w1 string, w2 string, w3 string, p long, c1 long, c2 long")
    return tagged.SequenceModel(tagged.marginals(raw, 3, "c1"), 3), table


def test_sequences(spark, both):
    own, table = both
    rng = random.Random(5)
    pick = lambda n: [rng.choice(["aa", "bb", "cc", "dd", "ee", "zz"]) for _ in range(n)]
    asks = [(pick(rng.randint(0, 4)), pick(rng.randint(1, 3))) for _ in range(300)] + [(None, ["aa"]), (["aa"], []), (["aa"], None), ([], ["aa"] * 4), (["aa"], ["bb"]), (["aa"], ["bb"])]
    got = own.probabilities(spark.createDataFrame(asks, "context array<string>, words array<string>")).collect()
    assert len(got) == len(asks)
    for r in got:
        c, s, want = tuple(r.context or ()), tuple(r.words or ()), None
        if 0 < len(s) <= 3:
            for k in range(min(len(c), 3 - len(s)), -1, -1):
                part = c[len(c) - k :]
                if part in table and part + s in table:
                    (p, lo, _), (q, a, b) = table[part], table[part + s]
                    want = (q / p, (a - lo) / p, (b - lo) / p, k)
                    break
        assert (want is None and r.probability is None and r.used is None) or pytest.approx(want) == (r.probability, r.lo, r.hi, r.used)


def plain_match(table, context, num, size, den):
    for k in range(min(len(context), 2), -1, -1):
        part = context[len(context) - k :]
        if part in table:
            break
    p, lo, hi = table[part]
    a, b = max(lo, lo + p * num // den), min(hi, lo - (-p * (num + size) // den))
    of = [(w[-1], x, y) for w, (_, x, y) in table.items() if len(w) == k + 1 and w[:-1] == part]
    for kind, found in (
        (1, [(x, w) for w, x, y in of if x <= a and y >= b]),
        (2, [(y, w) for w, x, y in of if x >= a and y <= b]),
        (3, [(-(y - a), x, w) for w, x, y in of if x < a < y] + [(-(b - x), x, w) for w, x, y in of if x < b < y]),
    ):
        if found:
            return min(found)[-1], kind, k
    return None, None, k


@pytest.mark.parametrize("few", [10**6, 0])
def test_matching(spark, both, few, monkeypatch):
    own, table = both
    monkeypatch.setattr(tagged, "carried", lambda *a, **k: scan.carried(*a, **k, few=few))
    rng = random.Random(6)
    asks = []
    for _ in range(300):
        num = rng.randint(0, 999)
        asks.append(([rng.choice(["aa", "bb", "cc", "dd", "ee", "zz"]) for _ in range(rng.randint(0, 3))], num, rng.choice([1, 3, 20, 80, 200, 500, 1000 - num]), 1000))
    asks += [(None, 5, 10, 1000), (["aa"], 5, 10, 1000), (["aa"], 5, 10, 1000)]
    got = own.matching_words(spark.createDataFrame(asks, "context array<string>, num long, size long, den long")).collect()
    assert len(got) == len(asks)
    kinds = set()
    for r in got:
        want = plain_match(table, tuple(r.context or ()), r.num, r["size"], r.den)
        assert want == (r.word, r.kind, r.used), r
        kinds.add(r.kind)
    assert kinds >= {1, 2, 3}


def test_an_empty_model(spark, both):
    empty = spark.createDataFrame([], "n int, w1 string, w2 string, w3 string, p long, c1 long, c2 long")
    asks = spark.createDataFrame([(["aa"], ["bb"], 1, 2, 10)], "context array<string>, words array<string>, num long, size long, den long")
    own = tagged.SequenceModel(empty, 3)
    assert own.probabilities(asks.select("context", "words")).collect()[0].probability is None
    assert own.matching_words(asks.drop("words")).collect()[0].word is None
