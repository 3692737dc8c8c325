"""Centroid clusters against brute force in Python numbers, with nulls, ties, repeats and empty tables."""

import hashlib
import math
import random

from gramloom.llm import centroids


def brute(rows, clusters=16, rounds=3, n=64):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == n and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: "1" if i is None else f"1:{i}"
    cs = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(name(r[0]).encode()).hexdigest(), r[1]))[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(cs))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for k in range(len(cs)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == k]
            if mine:
                cs[k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    total = sum(d for _, d, _ in found)
    sums = {k: sum(d for _, d, c in found if c == k) for k in range(len(cs))}
    return sorted((i is None, i or 0, k, d, sums[k], total, hashlib.sha256(",".join(map(str, cs[k])).encode()).hexdigest()) for i, d, k in found)


def plain(df):
    return sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


KIND = "vec_id long, embedding array<float>, cluster string, v int"


def rows_of(seed, n):
    r = random.Random(seed)
    rows = [(i, [r.randrange(-96, 96) / 64 for _ in range(64)]) for i in range(n)]
    rows += [(n, None), (n + 1, [1.0] * 63), (n + 2, [float("nan")] * 64), (n + 3, [math.inf] + [0.0] * 63), (n + 4, [None] + [0.0] * 63), (n + 5, [])]
    return rows + [(None, [0.5] * 64), (3, rows[3][1]), (3, rows[3][1])]  # a null id, and one row three times


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], KIND)


def test_brute_force(spark):
    rows = rows_of(1, 150)
    assert plain(centroids.cluster(frame(spark, rows))) == brute(rows)


def test_ties_take_the_smaller_number(spark):
    rows = [(i, [float(i % 3)] + [0.0] * 63) for i in range(40)]  # equal centroids: all ties
    assert plain(centroids.cluster(frame(spark, rows))) == brute(rows)


def test_few_and_none(spark):
    rows = [(7, [1.0] * 64), (8, [2.0] * 64), (9, None)]
    assert plain(centroids.cluster(frame(spark, rows))) == brute(rows)
    none = centroids.cluster(frame(spark, [(9, None)]))
    assert none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and none.count() == 0


def test_very_wide_components(spark):
    got = centroids.cluster(frame(spark, [(1, [3e38] * 64), (2, [-3e38] * 64)]), clusters=1).collect()
    assert len(got) == 2 and all(0 <= r.distance < 1 << 63 for r in got)
