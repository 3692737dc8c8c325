"""Files of records: written, read by ranges of bytes and of ids, and left alone by a write that fails."""

import os
import random

import pytest

from gramloom.sources import binary, records
from gramloom.sources.store import scratch


def table(n_rows=3000, seed=1):
    rng = random.Random(seed)
    return {(rng.randint(1, 400), rng.randint(1, 400)): rng.randint(1, 2**40) for _ in range(n_rows)}


def frame(spark, own):
    return spark.createDataFrame([(*k, v) for k, v in own.items()], "w1 int, w2 int, count long")


def pairs(df):
    got = df.select("w1", "w2", "count").collect()
    assert len({(r.w1, r.w2) for r in got}) == len(got)
    return {(r.w1, r.w2): r["count"] for r in got}


def test_write_and_read(spark):
    own, path = table(), scratch(spark, "records")
    records.write_records(frame(spark, own), path, 2, 4)
    whole = records.read_records(spark, path, 2)
    assert pairs(whole) == own == pairs(binary.read_counts(spark, path, 2))
    order = [(r.w1, r.w2) for r in whole.orderBy("file", "rid").collect()]
    assert order == sorted(own)


@pytest.mark.parametrize(("first", "last"), [(None, None), (100, 200), (1, 1), (390, None), (None, 7), (500, 600), (200, 100)])
def test_ranges(spark, first, last):
    own, path = table(), scratch(spark, "records")
    records.write_records(frame(spark, own), path, 2, 3)
    cut = records.read_records(spark, path, 2, first, last, span=1000)
    assert cut.rdd.getNumPartitions() > 40  # no file is one task
    assert pairs(cut) == {k: v for k, v in own.items() if (first is None or k[0] >= first) and (last is None or k[0] <= last)}


def test_modes_and_failures(spark):
    one, path = {(1, 2): 3, (4, 5): 6}, scratch(spark, "records")
    at = path.removeprefix("file://")
    records.write_records(frame(spark, {}), path, 2, 2)
    assert pairs(records.read_records(spark, path, 2)) == {}
    records.write_records(frame(spark, one), path, 2, 2)
    twice = spark.createDataFrame([(7, 7, 1), (7, 7, 1)], "w1 int, w2 int, count long")
    for bad in (twice, spark.createDataFrame([(7, None, 1)], "w1 int, w2 int, count long")):
        with pytest.raises(Exception, match="records"):
            records.write_records(bad, path, 2, 1)
    assert pairs(records.read_records(spark, path, 2)) == one and all(x.endswith(".bin") for x in os.listdir(at))
    records.write_records(frame(spark, {(9, 9): 9}), path, 2, 2)
    assert pairs(records.read_records(spark, path, 2)) == one | {(9, 9): 9}
    records.write_records(frame(spark, {(8, 8): 8}), path, 2, 2, "overwrite")
    assert pairs(records.read_records(spark, path, 2)) == {(8, 8): 8}
    with open(os.path.join(at, "torn.bin"), "wb") as f:
        f.write(b"12345")
    with pytest.raises(Exception, match="whole number"):
        records.read_records(spark, path, 2).collect()
