"""As-of scans against brute force, within one task and dealt out by range."""

import random

import pytest

from gramloom.operators import scan


def tables(spark, seed, keyed):
    r = random.Random(seed)
    keys = lambda: (r.choice(["a", "b", None]), r.choice([1, 2])) if keyed else ()
    events = [(*keys(), p, r.randint(1, 9)) for p in r.sample(range(200), 120)]
    asks = [(k, *keys(), r.randrange(220)) for k in range(150)] + [(1000, *keys(), 5), (1000, *keys(), 5)]
    names = "x string, y int, " if keyed else ""
    return events, asks, spark.createDataFrame(events, f"{names}place long, v int"), spark.createDataFrame(asks, f"id int, {names}at long")


@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("few", [scan.FEW, 0])
def test_carried_and_sums(spark, keyed, few):
    events, asks, e, a = tables(spark, 3, keyed)
    names = ["x", "y"] if keyed else []
    for strictly in (False, True):
        got = scan.carried(a, e.withColumn("p", e["place"]), names, "at", "place", ["p", "v"], strictly, few).collect()
        want = []
        for ask in asks:
            mine = [x for x in events if x[:-2] == ask[1:-1] and (x[-2] < ask[-1] if strictly else x[-2] <= ask[-1])]
            want.append((*ask, *(max(mine, key=lambda x: x[-2])[-2:] if mine else (None, None))))
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    got = scan.sums_before(a, e, names, "at", "place", "v", "before", few).collect()
    want = [(*ask, sum(x[-1] for x in events if x[:-2] == ask[1:-1] and x[-2] < ask[-1])) for ask in asks]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("few", [scan.FEW, 0])
def test_nothing_to_find(spark, few):
    _, _, e, a = tables(spark, 4, True)
    assert scan.carried(a, e.limit(0), ["x", "y"], "at", "place", ["v"], few=few).filter("v IS NULL").count() == a.count()
    assert scan.carried(a.limit(0), e, ["x", "y"], "at", "place", ["v"], few=few).count() == 0
    assert scan.sums_before(a, e.limit(0), ["x", "y"], "at", "place", "v", "s", few).filter("s = 0").count() == a.count()
