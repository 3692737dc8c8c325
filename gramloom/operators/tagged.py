"""Tagged corpora: cumulative frequencies in file order, marginals of all orders in one rollup, and interval queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramloom.operators.counts import prefix_sums, row_ids
from gramloom.operators.cumulative import asked_only
from gramloom.operators.scan import carried
from gramloom.schemas import PLACEHOLDER
from gramloom.sources.store import saved


def words(n: int) -> list[str]:
    return [f"w{i}" for i in range(1, n + 1)]


def known_words(n: int) -> Column:
    """No word is withheld; a null word drops the row, as SQL's comparison does."""
    return reduce(lambda a, b: a & b, (F.col(w) != PLACEHOLDER for w in words(n)))


def cumulate(raw: DataFrame, order: list[str], n: int) -> DataFrame:
    """Rows of known words with the range [c1, c2) of their frequency p in the given order."""
    return prefix_sums(raw, order, "p", "c1", "c2").filter(known_words(n))


def marginals(cumulated: DataFrame, n: int, by: str = "i") -> DataFrame:
    """n, i, w1..wN, p, c1, c2 of all orders N to 0: frequencies summed, ranges spanned; i numbers an order's rows by
    their first row. Sums, least and greatest values can all be taken from parts, so that one rollup does it."""
    lower = cumulated.select(F.col(by).alias("_i"), *(F.lower(w).alias(w) for w in words(n)), "p", "c1", "c2")
    rolled = lower.rollup(*words(n)).agg(F.sum("p").alias("p"), F.min("c1").alias("c1"), F.max("c2").alias("c2"), F.min("_i").alias("_i"), F.grouping_id().alias("_g"))
    level = F.lit(n) - F.round(F.log2(F.col("_g") + 1)).cast("int")
    # numbers through all orders, less where the order begins: no order has to fit into one task
    numbered = saved(row_ids(rolled.withColumn("n", level), ["n", "_i", *words(n)], "_row"))
    begins = numbered.groupBy("n").agg((F.min("_row") - 1).alias("_begin"))  # a row per order
    return numbered.join(F.broadcast(begins), "n").select("n", (F.col("_row") - F.col("_begin")).alias("i"), *words(n), "p", "c1", "c2")


class TaggedModel:
    """Marginal rows of all orders: n, w1..wN, p, c1, c2. Contexts lose their first word until they are known."""

    def __init__(self, rows: DataFrame, n_max: int):
        self.n_max = n_max
        self.level = {n: rows.filter(F.col("n") == n).select(*words(n), "p", "c1", "c2") for n in range(n_max + 1)}

    def _side(self, n: int, keys: list[str], tag: str) -> DataFrame:
        return self.level[n].select(*(F.col(f"w{i}").alias(k) for i, k in enumerate(keys, 1)), *(F.col(c).alias(f"{tag}{c}") for c in ("p", "c1", "c2")))

    def probabilities(self, requests: DataFrame) -> DataFrame:
        """Requests of c1..c(N-1) and w, with probability, lo and hi (the word's part of its context), and level."""
        ask = [f"c{i}" for i in range(1, self.n_max)]
        requests = out = saved(requests, "asks")
        for n in range(self.n_max, 0, -1):
            keys = ask[len(ask) - (n - 1) :]
            out = out.join(asked_only(self._side(n, [*keys, "w"], f"g{n}"), requests, [*keys, "w"]), [*keys, "w"], "left")
            whole = asked_only(self._side(n - 1, keys, f"x{n}"), requests, keys)
            out = out.join(whole, keys, "left") if keys else out.crossJoin(F.broadcast(whole))  # one row
        pick = lambda f: F.coalesce(*(F.when(F.col(f"g{n}p").isNotNull() & F.col(f"x{n}p").isNotNull(), f(n)) for n in range(self.n_max, 0, -1)))
        return out.select(
            *requests.columns,
            pick(lambda n: F.col(f"g{n}p") / F.col(f"x{n}p")).alias("probability"),
            pick(lambda n: (F.col(f"g{n}c1") - F.col(f"x{n}c1")) / F.col(f"x{n}p")).alias("lo"),
            pick(lambda n: (F.col(f"g{n}c2") - F.col(f"x{n}c1")) / F.col(f"x{n}p")).alias("hi"),
            pick(lambda n: F.lit(n)).alias("level"),
        )

    def matching_words(self, requests: DataFrame) -> DataFrame:
        """Requests of id, c1..c(N-1) (context words, oldest first), num, size, den, with the word that matches the
        interval [num/den, (num+size)/den) of its context's range: one whose range holds it; else the first inside it;
        else of the two that it straddles the one with the larger part. A context loses its first words until it is
        known, as far as one word; one without a known word gives null."""
        ask = [f"c{i}" for i in range(1, self.n_max)]
        wide = lambda x: x.cast("decimal(38,0)")
        requests = left = saved(requests, "asks")
        found = []
        for n in range(self.n_max, 1, -1):
            keys = ask[len(ask) - (n - 1) :]
            here = left.join(asked_only(self._side(n - 1, keys, "x"), requests, keys), keys)
            behind = asked_only(self._side(n, [*keys, "w"], "g"), requests, keys)
            found.append(here.join(behind, keys).select("id", "num", "size", "den", "w", *(f"{t}{c}" for t in "xg" for c in ("p", "c1", "c2"))))
            left = left.join(here.select("id"), "id", "left_anti")
        both = reduce(DataFrame.unionByName, found)
        lo = F.col("xc1") + F.call_function("div", wide(F.col("xp")) * wide(F.col("num")), wide(F.col("den")))
        hi = F.col("xc1") + F.call_function("div", wide(F.col("xp")) * wide(F.col("num") + F.col("size")) + wide(F.col("den") - 1), wide(F.col("den")))
        both = both.withColumns({"a": F.greatest(lo, "xc1"), "b": F.least(hi, "xc2")})
        kind = F.when((F.col("gc1") <= F.col("a")) & (F.col("gc2") >= F.col("b")), 1).when((F.col("gc1") >= F.col("a")) & (F.col("gc2") <= F.col("b")), 2)
        before = (F.col("gc1") < F.col("a")) & (F.col("gc2") > F.col("a"))
        behind = (F.col("gc1") < F.col("b")) & (F.col("gc2") > F.col("b"))
        kind = kind.when(before | behind, 3)
        share = F.when(before, F.col("gc2") - F.col("a")).otherwise(F.col("b") - F.col("gc1"))
        rated = both.withColumn("kind", kind).filter("kind is not null").withColumn("share", F.when(F.col("kind") == 3, share).otherwise(0))
        best = F.min(F.struct("kind", -F.col("share"), "gc1", "w"))
        return requests.join(rated.groupBy("id").agg(best.alias("_b")).select("id", F.col("_b.w").alias("w"), F.col("_b.kind").alias("kind")), "id", "left")


class SequenceModel:
    """Marginal rows of all orders as one table of ngram (array; empty for order 0), p, c1, c2, asked by sequences.

    Contexts are arrays, oldest word first, of any length; null counts as empty. All orders are asked at once: a request
    names the n-grams it may need, those are picked from the table by one join, and each request takes the longest
    context that has what it asks for. Equal requests are equal rows; rows of requests stay as they are."""

    def __init__(self, rows: DataFrame, n_max: int):
        self.n_max = n_max
        self.rows = rows.select(F.slice(F.array(*words(n_max)), 1, F.col("n")).alias("ngram"), "p", "c1", "c2")

    def _told(self, asked: DataFrame, kinds: list[str]) -> DataFrame:
        """asked (_r, _k, and an n-gram for each kind) with p, c1, c2 of each kind's n-gram, where the model has it. The
        row of order 0, which everything may ask for, is one row, broadcast by itself."""
        whole = self.rows.filter(F.size("ngram") == 0)
        for kind in kinds:
            some = asked.filter(F.size(kind) > 0).select(F.col(kind).alias("ngram")).distinct()
            picked = self.rows.join(some, "ngram", "left_semi")
            named = lambda df, kind=kind: df.select(F.col("ngram").alias(kind), *(F.col(c).alias(f"{kind}_{c}") for c in ("p", "c1", "c2")))
            found = asked.join(named(picked), kind)
            empty = asked.filter(F.size(kind) == 0).join(F.broadcast(named(whole)), kind)
            asked = found.unionByName(empty)
        return asked

    def _contexts(self, requests: DataFrame, longest: Column) -> DataFrame:
        """Requests by number _r, once for each length _k of context that they may be asked with, and that context `part`."""
        context = F.coalesce("context", F.array().cast("array<string>"))
        each = requests.withColumn("_k", F.explode(F.sequence(F.lit(0), F.least(F.size(context), longest))))
        return each.withColumn("part", F.slice(context, F.size(context) - F.col("_k") + 1, F.col("_k")))

    def probabilities(self, requests: DataFrame) -> DataFrame:
        """Requests of context and words (arrays; a sequence of one word or more) with probability of the words after the
        context, lo and hi (their part of the context's range), and used, the words of context that it was told with: the
        most for which both are known. Nulls where nothing is known, for sequences over the model's order, and for none."""
        requests = saved(requests.withColumn("_r", F.monotonically_increasing_id()), "asks")
        sane = requests.filter((F.size("words") > 0) & (F.size("words") <= self.n_max))
        each = self._contexts(sane, F.lit(self.n_max) - F.size("words")).select("_r", "_k", "part", F.concat("part", "words").alias("whole"))
        told = self._told(each, ["whole", "part"])
        best = told.groupBy("_r").agg(F.max(F.struct("_k", *(F.col(f"{t}_{c}") for t in ("whole", "part") for c in ("p", "c1", "c2")))).alias("_b")).select("_r", "_b.*")
        share = lambda c: ((F.col(f"whole_{c}") - F.col("part_c1")) / F.col("part_p")).alias({"c1": "lo", "c2": "hi"}[c])
        found = best.select("_r", (F.col("whole_p") / F.col("part_p")).alias("probability"), share("c1"), share("c2"), F.col("_k").alias("used"))
        return requests.join(found, "_r", "left").drop("_r")

    def matching_words(self, requests: DataFrame) -> DataFrame:
        """Requests of context, num, size, den with the word that matches the interval [num/den, (num+size)/den) of the
        context's range, and kind: 1, a word whose range holds it (of several the one that begins first); else 2, a word
        whose range lies inside (the one that ends first); else 3, of the words that straddle its ends the one with the
        larger part. A context loses its first words until it is known, down to none; used tells how many are left. Word
        and kind are null where no range meets the interval.

        Ranges of one context may overlap, as letters' cases and tags are summed. Three scans tell all kinds: the first
        beginning among ranges that end at b or later, the last end among those that begin before a, the first end among
        those that begin at a or later. An ask meets one range in each."""
        wide = lambda x: x.cast("decimal(38,0)")
        requests = saved(requests.withColumn("_r", F.monotonically_increasing_id()), "asks")
        told = self._told(self._contexts(requests, F.lit(self.n_max - 1)).select("_r", "_k", "part"), ["part"])
        best = told.groupBy("_r").agg(F.max(F.struct("_k", "part", "part_p", "part_c1", "part_c2")).alias("_b")).select("_r", "_b.*")
        lo = F.col("part_c1") + F.call_function("div", wide(F.col("part_p")) * wide(F.col("num")), wide(F.col("den")))
        hi = F.col("part_c1") + F.call_function("div", wide(F.col("part_p")) * wide(F.col("num") + F.col("size")) + wide(F.col("den") - 1), wide(F.col("den")))
        asks = requests.select("_r", "num", "size", "den").join(best, "_r").select("_r", "_k", "part", F.greatest(lo, "part_c1").cast("long").alias("a"), F.least(hi, "part_c2").cast("long").alias("b"))
        asks = saved(asks.withColumns({"_a": -F.col("a"), "_b": -F.col("b")}), "asks")
        ranges = self.rows.filter(F.size("ngram") > 0).select(F.expr("slice(ngram, 1, size(ngram) - 1)").alias("part"), F.element_at("ngram", -1).alias("w"), "c1", "c2")
        ranges = saved(ranges.join(asks.select("part").distinct(), "part", "left_semi").withColumns({"_c1": -F.col("c1"), "_c2": -F.col("c2")}), "ranges")

        def scanned(asks: DataFrame, at: str, place: str, most: str, tag: str, strictly: bool = False) -> DataFrame:
            tagged = ranges.select("part", *(F.col(c).alias(f"{tag}{c}") for c in ("w", "c1", "c2", "_c1", "_c2")))
            return carried(asks, tagged, ["part"], at, f"{tag}{place}", [f"{tag}{c}" for c in ("c1", "c2", "w")], strictly, most=f"{tag}{most}")

        out = scanned(asks, "_b", "_c2", "_c1", "x")
        out = scanned(out, "a", "c1", "c2", "y", True)
        out = scanned(out, "_a", "_c1", "_c2", "z")
        before = F.when(F.col("yc2") > F.col("a"), F.col("yc2") - F.col("a"))
        behind = F.when(F.col("xc1") < F.col("b"), F.col("b") - F.col("xc1"))
        kind = F.when(F.col("xc1") <= F.col("a"), 1).when(F.col("zc2") <= F.col("b"), 2).when(before.isNotNull() | behind.isNotNull(), 3)
        larger = F.when(F.coalesce(before, F.lit(-1)) >= F.coalesce(behind, F.lit(-1)), F.col("yw")).otherwise(F.col("xw"))
        word = F.when(kind == 1, F.col("xw")).when(kind == 2, F.col("zw")).when(kind == 3, larger)
        return requests.join(out.select("_r", word.alias("word"), kind.alias("kind"), F.col("_k").alias("used")), "_r", "left").drop("_r")
