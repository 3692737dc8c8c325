"""Importance resampling against brute force over whole texts, for runs of one and of one to three words."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gramloom.llm import importance

WORD = re.compile(b"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def runs(text, n_min, n_max):
    words = WORD.findall((text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))
    return len(words), [b" ".join(words[i : i + n]) for n in range(n_min, n_max + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, n_min=1, n_max=1, buckets=10_000, least=20, percent=10):
    bucket = lambda g: zlib.crc32(g) % buckets
    s, t = (Counter(bucket(g) for x in texts for g in runs(x, n_min, n_max)[1]) for texts in ([x for _, x in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for i, x in docs:
        n, grams = runs(x, n_min, n_max)
        weight = sum(gain(bucket(g)) for g in grams)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * percent // 100], 1):
        r[5] = k
    return sorted(((r[0], *r[2:]) for r in rows), key=str)


def some_texts(seed, n):
    r = random.Random(seed)
    words = ["Alpha", "beta", "gämma", "x1", "don't", "東京", "w" * 90, "Tea", "ΩMEGA"]
    line = lambda: r.choice([" ", ", ", "\t"]).join(r.choices(words, k=r.randint(0, 9)))
    common = [line() for _ in range(6)]
    docs = [(i, "\n".join(r.choice(common) if r.random() < 0.5 else line() for _ in range(r.randint(1, 9)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "\n\n \n"), (n + 3, " ".join(words * 2000)), (4, docs[4][1]), (4, docs[4][1]), (None, docs[5][1])]
    return docs, [line() for _ in range(20)] + [None]


@pytest.mark.parametrize("n_min,n_max", [(1, 1), (1, 3), (2, 2)])
def test_brute_force(spark, n_min, n_max):
    docs, target = some_texts(n_max, 120)
    frame = spark.createDataFrame([(i, x, 1.0, "a") for i, x in docs], "doc_id long, text string, score double, rank string")
    goal = spark.createDataFrame([(x,) for x in target], "text string")
    got = importance.resample(frame, goal, n_min=n_min, n_max=n_max, percent=25).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, target, n_min, n_max, percent=25)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 10)], "doc_id long, text string")
    assert importance.resample(none, some).count() == 0
    assert [tuple(r) for r in importance.resample(some, none, percent=100).collect()] == brute([(1, "a b c " * 10)], [], percent=100)


def test_crc_of_long_and_short_words():
    data = np.frombuffer(b"a" * 70 + b"bc", np.uint8)
    got = importance.crc_on(np.array([0, zlib.crc32(b"x ")], np.uint32), data, np.array([0, 70]), np.array([70, 2]))
    assert got.tolist() == [zlib.crc32(b"a" * 70), zlib.crc32(b"x bc")]
