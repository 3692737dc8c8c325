"""Count tables: aggregation, marginals, consistency, vocabulary, merges, and prefix sums in two phases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gramloom.functions import text as T
from gramloom.schemas import PARTITIONS
from gramloom.sources.store import saved


def integrate_years(raw: DataFrame, n: int) -> DataFrame:
    """ngram, count: match counts summed over years, without n-grams that hold a tagged word."""
    ngram = F.array(*(f"w{i}" for i in range(1, n + 1)))
    return raw.select(ngram.alias("ngram"), "match_count").filter(T.valid_ngram(F.col("ngram"))).groupBy("ngram").agg(F.sum("match_count").alias("count"))


def integrate(counts: DataFrame, key: str = "ngram") -> DataFrame:
    return counts.groupBy(key).agg(F.sum("count").alias("count"))


def _strings(sentences: DataFrame) -> bool:
    return sentences.schema["tokens"].dataType.elementType.typeName() == "string"


def _keys(sentences: DataFrame, orders: list[int], longest: int | None = None) -> DataFrame:
    """_key: at each place the run of tokens of each order (longest: one of so many or fewer where at least the order's
    are left). Runs of strings, which hold no blanks, are joined by blanks: one short value is hashed, shuffled and
    compared in place of an array."""
    if _strings(sentences):
        run = lambda n: F.concat_ws(" ", *(F.get("tokens", F.col("_i") + k) for k in range(n)))
    else:
        run = lambda n: F.slice("tokens", F.col("_i") + 1, n)
    # outer: else Spark infers a filter from the explode and makes all tokens twice
    at = F.when(F.size("tokens") >= min(orders), F.sequence(F.lit(0), F.size("tokens") - min(orders)))
    each = sentences.select("tokens", F.explode_outer(at).alias("_i")).filter("_i IS NOT NULL")
    if len(orders) == 1:
        return each.select(run(longest or orders[0]).alias("_key"))
    runs = F.array(*(F.when(F.col("_i") + n <= F.size("tokens"), run(n)) for n in orders))
    return each.select(F.explode(runs).alias("_key")).filter("_key IS NOT NULL")


def _size(key: str, strings: bool) -> Column:
    return F.length(key) - F.length(F.replace(key, F.lit(" "), F.lit(""))) + 1 if strings else F.size(key)


def key_counts(sentences: DataFrame, n_max: int) -> DataFrame:
    """n, _key, count of the n-grams of all orders; those of strings are joined by blanks.

    Low orders repeat, so that they shrink before they are shuffled. Of orders above 3, which hardly do, and of order 3
    beside them, a place's longest n-gram alone is shuffled, by its first three tokens: the shorter ones are its begins,
    and are counted there.
    """
    strings = _strings(sentences)
    low = _keys(sentences, list(range(1, (n_max if n_max <= 3 else 2) + 1))).groupBy("_key").agg(F.count("*").alias("count"))
    found = low.select(_size("_key", strings).alias("n"), "_key", "count")
    if n_max <= 3:
        return found
    begin = lambda n: F.call_function("substring_index", F.col("_key"), F.lit(" "), n) if strings else F.slice("_key", 1, n)
    lead = begin(F.lit(3))
    whole = _keys(sentences, [3], n_max).repartition(lead).groupBy(lead.alias("_lead"), "_key").agg(F.count("*").alias("_count"))
    each = whole.select("_lead", "_key", "_count", F.explode(F.sequence(F.lit(3), _size("_key", strings))).alias("n")).select("_lead", "n", begin(F.col("n")).alias("_key"), "_count")
    return found.unionByName(each.groupBy("_lead", "n", "_key").agg(F.sum("_count").alias("count")).select("n", "_key", "count"))


def _ngram(sentences: DataFrame) -> Column:
    return F.split("_key", " ") if _strings(sentences) else F.col("_key")


def order_counts(sentences: DataFrame, n: int) -> DataFrame:
    """ngram, count of one order."""
    return _keys(sentences, [n]).groupBy("_key").agg(F.count("*").alias("count")).select(_ngram(sentences).alias("ngram"), "count")


def every_count(sentences: DataFrame, n_max: int) -> DataFrame:
    """n, ngram, count of all orders."""
    return key_counts(sentences, n_max).select("n", _ngram(sentences).alias("ngram"), "count")


def ngram_counts(sentences: DataFrame, n_max: int) -> dict[int, DataFrame]:
    """ngram, count of each order: folders of one table, which is counted and written once."""
    table = saved(every_count(sentences, n_max), "ngram-counts", ("n",))
    return {n: table.filter(F.col("n") == n).select("ngram", "count") for n in range(1, n_max + 1)}


def without_digits(counts: DataFrame) -> DataFrame:
    return counts.filter(~F.exists("ngram", T.numeric_token))


def left_marginal(counts: DataFrame) -> DataFrame:
    """Counts of all but the last token."""
    return counts.groupBy(F.expr("slice(ngram, 1, size(ngram) - 1)").alias("ngram")).agg(F.sum("count").alias("count"))


def right_marginal(counts: DataFrame) -> DataFrame:
    """Counts of all but the first token."""
    return counts.groupBy(F.expr("slice(ngram, 2, size(ngram) - 1)").alias("ngram")).agg(F.sum("count").alias("count"))


def max_merge(*counts: DataFrame) -> DataFrame:
    """Each n-gram with its largest count in any of the tables: one shuffle instead of full outer joins."""
    return reduce(DataFrame.unionByName, counts).groupBy("ngram").agg(F.max("count").alias("count"))


def consistent(tables: dict[int, DataFrame]) -> dict[int, DataFrame]:
    """Tables in which no n-gram counts less than the n-grams one order higher that begin or end with it."""
    out = {}
    for n in sorted(tables, reverse=True):
        out[n] = tables[n] if n + 1 not in out else saved(max_merge(tables[n], left_marginal(out[n + 1]), right_marginal(out[n + 1])))
    return out


def inconsistencies(tables: dict[int, DataFrame]) -> DataFrame:
    """n, ngram, count, needed of the n-grams that count less than their extensions; none in consistent tables."""
    found = []
    for n in sorted(tables):
        if n + 1 in tables:
            needed = max_merge(left_marginal(tables[n + 1]), right_marginal(tables[n + 1])).withColumnRenamed("count", "needed")
            lacking = needed.join(tables[n], "ngram", "left").filter(F.coalesce("count", F.lit(0)) < F.col("needed"))
            found.append(lacking.select(F.lit(n).alias("n"), "ngram", F.coalesce("count", F.lit(0)).alias("count"), "needed"))
    return reduce(DataFrame.unionByName, found)


def mark(items: DataFrame, rejects: DataFrame, key: str = "ngram") -> DataFrame:
    """All items, with whether they are among the rejects."""
    known = rejects.select(key).distinct().withColumn("reject", F.lit(True))
    return items.join(known, key, "left").withColumn("reject", F.coalesce("reject", F.lit(False)))


# -- order --------------------------------------------------------------------------------------------------------


def prefix_sums(df: DataFrame, order: list[str], value: str = "count", cf1: str = "cf1", cf2: str = "cf2", parts: int | None = None) -> DataFrame:
    """df with the half-open range [cf1, cf2) of the running sum of `value` in the given order.

    A window over all rows would put them into one task. Instead the rows are dealt out by range and saved; sums of
    the parts (one row each) give each part its offset, and windows inside the parts do the rest.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = saved(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    first = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_part").agg(F.sum(value).alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(first), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumn("_run", F.sum(value).over(inside)).join(F.broadcast(offsets), "_part")  # a row per part
    end = F.col("_offset") + F.col("_run")
    return out.withColumn(cf1, (end - F.col(value)).cast("long")).withColumn(cf2, end.cast("long")).drop("_part", "_run", "_offset")


def row_ids(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """df with row numbers from 1 in the given total order, by the same two phases."""
    return prefix_sums(df.withColumn("_one", F.lit(1)), order, "_one", "_zero", name).drop("_one", "_zero")


def part_rank(part: Column) -> Column:
    return F.instr(F.lit(PARTITIONS), part)


def vocabulary(unigrams: DataFrame) -> DataFrame:
    """token_id (from 1), token, part of all distinct tokens; by partition, then by code points."""
    tokens = unigrams.select(F.element_at("ngram", 1).alias("token")).distinct().withColumn("part", T.token_part(F.col("token")))
    ordered = row_ids(tokens.withColumn("_rank", part_rank(F.col("part"))), ["_rank", "token"], "token_id")
    return ordered.select(F.col("token_id").cast("int").alias("token_id"), "token", "part")


def translate(counts: DataFrame, vocab: DataFrame, n: int, part_of: Column | None = None) -> DataFrame:
    """w1..wn as ids, count, reject: null, or why the n-gram can't be told: `bad_partition` if part_of, the vocabulary
    partition that the row was filed under, isn't that of its first token; else `unindexed` if a token has no id.

    One equi-join per position: Spark broadcasts the vocabulary only if it is small.
    """
    misplaced = F.lit(False) if part_of is None else ~part_of.eqNullSafe(T.token_part(F.element_at("ngram", 1)))
    out = counts.select(*(F.col("ngram")[i - 1].alias(f"t{i}") for i in range(1, n + 1)), "count", misplaced.alias("_misplaced"))
    for i in range(1, n + 1):
        out = out.join(vocab.select(F.col("token").alias(f"t{i}"), F.col("token_id").alias(f"w{i}")), f"t{i}", "left")
    unknown = reduce(lambda a, b: a | b, (F.col(f"w{i}").isNull() for i in range(1, n + 1)))
    return out.select(*(f"w{i}" for i in range(1, n + 1)), "count", F.when(F.col("_misplaced"), "bad_partition").when(unknown, "unindexed").alias("reject"), *(f"t{i}" for i in range(1, n + 1)))


def id_table(translated: DataFrame, n: int) -> DataFrame:
    """The accepted rows, equal ids summed: w1..wn, count."""
    words = [f"w{i}" for i in range(1, n + 1)]
    return translated.filter("reject is null").groupBy(*words).agg(F.sum("count").alias("count"))


def letter_ranges(counts: DataFrame, order: list[str]) -> DataFrame:
    """Counts with range and share of the total."""
    total = counts.agg(F.sum("count").alias("_total"))
    return prefix_sums(counts, order).crossJoin(F.broadcast(total)).withColumn("p", F.col("count") / F.col("_total")).drop("_total")  # one row


def parse_text(texts: DataFrame, vocab: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """id, sent, pos, token, token_id of each text's normalised tokens; a null token_id tells an unknown token."""
    from gramloom.operators.ngrams import sentence_table

    each = sentence_table(texts, id_col, text_col).select(id_col, "sent", F.posexplode("tokens").alias("pos", "token"))
    return each.join(vocab.select("token", "token_id"), "token", "left").select(id_col, "sent", "pos", "token", "token_id")


def numbered(table: DataFrame, n: int) -> DataFrame:
    """w1..wn, count with row_id (from 1, in the order of the ids), written in that order: readers of a range of rows or
    of ids skip the files that hold others. Number a table once, and look rows up as often as needed."""
    words = [f"w{i}" for i in range(1, n + 1)]
    return saved(row_ids(table, words).sortWithinPartitions("row_id"), "numbered")


def explore(table: DataFrame, n: int, first: int, last: int, step: int = 1, vocab: DataFrame | None = None) -> DataFrame:
    """Rows number first, first + step, ... up to last of a numbered table, with words if a vocabulary is given."""
    words = [f"w{i}" for i in range(1, n + 1)]
    rows = table.filter((F.col("row_id") >= first) & (F.col("row_id") <= last) & ((F.col("row_id") - first) % step == 0))
    for w in words if vocab is not None else []:
        rows = rows.join(vocab.select(F.col("token_id").alias(w), F.col("token").alias(f"{w}_token")), w, "left")
    return rows
