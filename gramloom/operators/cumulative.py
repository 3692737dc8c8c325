"""Cumulative-frequency models: ranges of n-grams, ranges of contexts, and two queries answered by them.

A context of n-1 words has the range [CF1, CF2) of all n-grams it begins; a word after it the part [cf1, cf2) of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gramloom.functions import exact
from gramloom.operators.counts import part_rank, prefix_sums
from gramloom.operators.scan import carried
from gramloom.sources.store import saved


def words(n: int) -> list[str]:
    return [f"w{i}" for i in range(1, n + 1)]


def cumulative(table: DataFrame, n: int) -> DataFrame:
    """w1..wn, cf1, cf2 in the order of the ids."""
    return prefix_sums(table, words(n)).select(*words(n), "cf1", "cf2")


def contexts(ranges: DataFrame, n: int) -> DataFrame:
    """w1..w(n-1) and the range of each context; for n = 1 one row, that of all."""
    return ranges.groupBy(*words(n - 1)).agg(F.min("cf1").alias("cf1"), F.max("cf2").alias("cf2"))


def partition_ranges(unigrams: DataFrame) -> DataFrame:
    """part, lo, hi: the range of cumulative counts of each vocabulary partition. unigrams: part, count."""
    sums = unigrams.groupBy("part").agg(F.sum("count").alias("_sum"))  # 37 rows at most
    upto = Window.orderBy(part_rank(F.col("part"))).rowsBetween(Window.unboundedPreceding, 0)
    return sums.withColumn("hi", F.sum("_sum").over(upto)).select("part", (F.col("hi") - F.col("_sum")).alias("lo"), "hi")


def index_ranges(vocab: DataFrame) -> DataFrame:
    """part, first, last id of each vocabulary partition."""
    return vocab.groupBy("part").agg(F.min("token_id").alias("first"), F.max("token_id").alias("last"))


def asked_only(table: DataFrame, asks: DataFrame, keys: list[str], few: bool = False) -> DataFrame:
    """The rows of a table that some request (a written table) has the keys of; all of them without keys. Requests are
    few as a rule, and Spark then broadcasts their keys, so that the table is neither shuffled nor sorted. few: their
    number has been checked, and they are broadcast as they are."""
    if not keys:
        return table
    return table.join(F.broadcast(asks.select(*keys)) if few else asks.select(*keys).distinct(), keys, "left_semi")


class CumulativeModel:
    """ranges: by order n, w1..wn, cf1, cf2. Contexts are shortened from the left until they are known."""

    def __init__(self, ranges: dict[int, DataFrame]):
        self.n_max = max(ranges)
        self.ranges = ranges

    def _asked(self, requests: DataFrame, n: int, keys: list[str]) -> DataFrame:
        """The ranges of order n behind the contexts that are asked for: keys, w, cf1, cf2."""
        named = self.ranges[n].select(*(F.col(f"w{i}").alias(k) for i, k in enumerate(keys, 1)), F.col(f"w{n}").alias("w"), "cf1", "cf2")
        return asked_only(named, requests, keys)

    def probabilities(self, requests: DataFrame) -> DataFrame:
        """Requests of columns c1..c(n_max-1) (context, oldest first) and w, with lo, hi, total and level.

        The word's conditional range is [lo / total, hi / total). level is the order that answered; a word that no
        order knows has nulls.
        """
        m = self.n_max - 1
        ask = [f"c{i}" for i in range(1, m + 1)]
        requests = out = saved(requests, "asks")
        for n in range(self.n_max, 0, -1):
            keys = ask[len(ask) - (n - 1) :]
            here = self._asked(requests, n, keys)
            out = out.join(asked_only(here.select(*keys, "w", F.col("cf1").alias(f"a{n}"), F.col("cf2").alias(f"b{n}")), requests, [*keys, "w"]), [*keys, "w"], "left")
            whole = here.groupBy(*keys).agg(F.min("cf1").alias(f"from{n}"), F.max("cf2").alias(f"to{n}"))
            out = out.join(whole, keys, "left") if keys else out.crossJoin(F.broadcast(whole))  # one row
        pick = lambda f: F.coalesce(*(F.when(F.col(f"a{n}").isNotNull(), f(n)) for n in range(self.n_max, 0, -1)))
        return out.select(
            *ask,
            "w",
            *(c for c in requests.columns if c not in (*ask, "w")),
            pick(lambda n: F.col(f"a{n}") - F.col(f"from{n}")).alias("lo"),
            pick(lambda n: F.col(f"b{n}") - F.col(f"from{n}")).alias("hi"),
            pick(lambda n: F.col(f"to{n}") - F.col(f"from{n}")).alias("total"),
            pick(lambda n: F.lit(n)).alias("level"),
        )

    def next_words(self, requests: DataFrame) -> DataFrame:
        """Requests of c1..c(n_max-1), and num, size, den (longs: the interval [num/den, (num+size)/den)), with w and
        level: the word whose range holds the whole interval in the longest known context; null if it straddles two."""
        asked = requests.withColumn("interval", exact.of_longs(F.col("num"), F.col("size"), F.col("den")))
        return self.next_tokens(asked).drop("interval")

    def next_tokens(self, requests: DataFrame) -> DataFrame:
        """The same for requests of c1..c(n_max-1) and interval (exact.EXACT, of any size).

        An interval's begin is a place on the axis of cumulative counts of its order, and each place there lies in one
        range: an as-of scan of places and ranges finds it, in whatever context, without comparing any two of a context.
        """
        m = self.n_max - 1
        ask = [f"c{i}" for i in range(1, m + 1)]
        asked = saved(requests.withColumn("_id", F.monotonically_increasing_id()), "asks")
        behind = {}
        level = asked.select("_id", *ask, "interval")
        for n in range(self.n_max, 0, -1):
            keys = ask[len(ask) - (n - 1) :]
            behind[n] = saved(self._asked(asked, n, keys)) if keys else self._asked(asked, n, keys)
            whole = behind[n].groupBy(*keys).agg(F.min("cf1").alias(f"from{n}"), F.max("cf2").alias(f"to{n}"))
            level = level.join(whole, keys, "left") if keys else level.crossJoin(F.broadcast(whole))  # one row
        orders = range(self.n_max, 0, -1)
        level = level.withColumn("level", F.coalesce(*(F.when(F.col(f"from{n}").isNotNull(), n) for n in orders)))
        base = F.coalesce(*(F.col(f"from{n}") for n in orders))
        total = F.coalesce(*(F.col(f"to{n}") - F.col(f"from{n}") for n in orders))
        placed = level.select("_id", "level", base.alias("_base"), exact.scaled(F.col("interval"), total).alias("_to"))
        placed = saved(placed.select("_id", "level", (F.col("_base") + F.col("_to.at")).alias("_lo"), (F.col("_base") + F.col("_to.upto")).alias("_hi")))
        found = []
        for n in orders:
            here = placed.filter(F.col("level") == n)
            met = carried(here, behind[n].select("w", "cf1", "cf2"), [], "_lo", "cf1", ["w", "cf2"])
            found.append(met.filter("cf2 >= _hi").select("_id", "w"))
        return asked.join(placed.select("_id", "level"), "_id").join(reduce(DataFrame.unionByName, found), "_id", "left").drop("_id")
