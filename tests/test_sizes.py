"""What large tables need: few rows shuffled, and no row for each letter."""

import random
import time
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from gramloom.functions import intervals as I
from gramloom.functions import text as T
from gramloom.operators import codec, counts, ngrams


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


@pytest.mark.parametrize("kind", ["string", "int"])
@pytest.mark.parametrize("n_max", [1, 2, 3, 5])
def test_key_counts(spark, kind, n_max):
    r = random.Random(3)
    rows = [([r.choice("abcd") if kind == "string" else r.randint(-1, 3) for _ in range(r.randint(0, 9))],) for _ in range(200)]
    got = counts.every_count(spark.createDataFrame(rows, f"tokens array<{kind}>"), n_max)
    assert exchanges(got) == (1 if n_max <= 3 else 2)  # orders 3 to n_max of a place are one row of one exchange
    want = Counter(tuple(t[i : i + n]) for (t,) in rows for n in range(1, n_max + 1) for i in range(len(t) - n + 1))
    assert sorted((r["n"], tuple(r["ngram"]), r["count"]) for r in got.collect()) == sorted((len(k), k, c) for k, c in want.items())


def test_character_counts(spark):
    texts = ["Straße ÆON\n", "", None, "K İΣ😀 end.", "a" * 100_000 + " "]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["char"]: r["count"] for r in ngrams.character_counts(df).collect()}
    assert got == Counter("".join(t or "" for t in texts))
    letters = F.regexp_extract_all(F.lower(T.to_ascii(F.col("x"))), F.lit("[a-z .]"), F.lit(0))
    one = df.select(F.explode(F.regexp_extract_all(F.lower(T.to_ascii(F.col("text"))), F.lit("[a-z .]"), F.lit(0))).alias("l")).groupBy("l").count()
    two = ngrams.character_counts(df).withColumnRenamed("char", "x").select(F.explode(letters).alias("l"), "count").groupBy("l").agg(F.sum("count"))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_bits_of_a_long_message():
    r = random.Random(5)
    begins = [r.randint(0, 9 * 10**8) for _ in range(2000)]
    i = I.nested([(b, b + r.randint(1, 10**8), 10**9) for b in begins])
    began = time.process_time()
    bits = I.to_bits(i, "sub")
    assert time.process_time() - began < 0.5  # some seconds, when every bit was a step over whole numbers of this size
    got = I.from_bits(bits)
    assert got[0] >= i[0] and got[0] + got[1] <= i[0] + i[1]
    around = I.from_bits(I.to_bits(i, "super"))
    assert around[0] <= i[0] and i[0] + i[1] <= around[0] + around[1]


def test_letters_are_encoded_where_they_are(spark):
    ranges = spark.createDataFrame([("a", 0, 5, 9), ("b", 5, 9, 9)], "token string, cf1 long, cf2 long, total long")
    own = spark.createDataFrame([(1, ["a", "b"]), (2, ["z"]), (3, []), (4, None), (5, ["b", "z"])], "id int, tokens array<string>")
    got = codec.encode_independent(own, ranges, ["id"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" not in plan and "SortMergeJoin" not in plan
    assert [(r["id"], I.unpack(r["interval"].asDict())) for r in got.collect()] == [(1, (Fraction(25, 81), Fraction(20, 81)))]
