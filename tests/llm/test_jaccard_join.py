"""The Jaccard join's components against all pairs, over families of edited copies, small blocks and odd rows."""

import random
import re

import numpy as np
import pytest

from gramloom.llm import jaccard_join as J


def shingle_set(text, size=3):
    words = [w for w in re.split("[ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(docs, a=90, b=100, size=3):
    sets = [shingle_set(x, size) for _, x in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and b * len(sets[i] & sets[j]) >= a * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        own = least.get(find(i))
        least[find(i)] = d if own is None else own if d is None else min(own, d)
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(docs)), key=str)


def families(seed, n, most=12, long=120):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    common = r.choices(words, k=30)
    out = []
    while len(out) < n:
        base = r.choices(words, k=r.choice([2, 5, 9, 11, 14, 30, long]))
        if r.random() < 0.3:
            base[len(base) // 2 : len(base) // 2] = common
        for _ in range(r.randint(1, most)):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                k = r.randrange(len(copy))
                copy[k : k + r.randint(0, 1)] = r.choices(words, k=r.randint(0, 2))
            out.append(" ".join(copy))
    docs = [(k, x) for k, x in enumerate(out[:n])]
    odd = [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "One"), (n + 4, "one"), (n + 5, "a a a a a a"), (n + 6, "a a a"), (n + 7, "a a"), (None, docs[0][1]), (3, docs[3][1]), (3, docs[3][1])]
    r.shuffle(docs)
    return docs + odd


@pytest.mark.parametrize("seed,block,share", [(1, 1 << 20, (90, 100)), (2, 400, (90, 100)), (3, 300, (70, 100))])
def test_components_equal_all_pairs(spark, seed, block, share):
    docs = families(seed, 350)
    frame = spark.createDataFrame([(d, x, 0, "k") for d, x in docs], "doc_id long, text string, node int, label string").repartition(5)
    got = J.join_components(frame, similarity=share, block=block).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, *share)


def test_a_large_family(spark):
    """All copies of one text, most of them under 0.9 to it: one cluster in many blocks."""
    r = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    docs = []
    for d in range(300):
        copy = list(base)
        for k in r.sample(range(60), r.randint(0, 4)):
            copy[k] = f"e{r.randrange(30)}"
        docs.append((d, " ".join(copy)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for block in (1 << 20, 2000):
        assert sorted(map(tuple, J.join_components(frame, block=block).collect()), key=str) == brute(docs)


def test_empty_table(spark):
    assert J.join_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lists_find_every_link(spark):
    docs = families(4, 400, most=30)
    sets = [sorted(s) for s in (shingle_set(x) for _, x in docs) if s]
    ids = {g: k for k, g in enumerate(sorted({g for s in sets for g in s}))}
    offsets = np.cumsum([0, *map(len, sets)])
    value = np.array([ids[g] for s in sets for g in s], np.uint64)
    for across in (False, True):
        side = np.arange(len(sets)) % 2 if across else np.zeros(len(sets), int)
        lists = J.Lists(value, offsets, (90, 100))
        lists.search(side, across)
        label = lists.forest.labels()
        for i in range(len(sets)):
            for j in range(i):
                one, two = set(sets[i]), set(sets[j])
                if 10 * len(one & two) >= 9 * len(one | two) and (not across or side[i] != side[j]):
                    assert label[i] == label[j]
