"""Line and n-gram files: reading, slicing, writing, side outputs, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.functions.text import trailing_integer
from gramloom.operators.counts import prefix_sums, row_ids
from gramloom.schemas import cumulative_schema, raw_schema, tagged_schema, vocabulary_schema
from gramloom.sources.store import saved


def read_ngrams(spark: SparkSession, path: str, n: int) -> DataFrame:
    """ngram, count, reject from lines of n tokens and a count, parted by tabs. reject: null, or why a line is none:
    `width` (another number of fields: ngram holds all of them) or `count` (no whole number). Compressed files can't be
    split: each is one task, and rows are dealt out again."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).select(parts.alias("_p"))
    count = F.element_at("_p", -1).try_cast("long")
    whole = F.size("_p") == n + 1
    reject = F.when(~whole, "width").when(count.isNull(), "count")
    rows = rows.select(F.when(whole, F.slice("_p", 1, n)).otherwise(F.col("_p")).alias("ngram"), F.when(whole, count).alias("count"), reject.alias("reject"))
    return rows.repartition(F.col("ngram")) if path.endswith(".gz") else rows


def read_raw(spark: SparkSession, path: str, n: int) -> DataFrame:
    return spark.read.schema(raw_schema(n)).option("sep", "\t").option("quote", "").csv(path)


def read_tagged(spark: SparkSession, path: str, n: int) -> DataFrame:
    return spark.read.schema(tagged_schema(n)).option("sep", "\t").option("quote", "").csv(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(vocabulary_schema()).option("sep", "\t").option("quote", "").option("escape", "").csv(path)


def read_cumulative(spark: SparkSession, path: str, n: int) -> DataFrame:
    return spark.read.schema(cumulative_schema(n)).option("sep", "\t").csv(path)


def descriptions(spark: SparkSession, path: str) -> DataFrame:
    """n, prefix from a JSON object of arrays, sorted with n as text."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return whole.select(F.explode("m").alias("n", "prefixes")).select("n", F.explode("prefixes").alias("prefix")).orderBy("n", "prefix")


def write_ngrams(counts: DataFrame, path: str) -> None:
    """One tab-parted line per n-gram, the count last."""
    counts.select(F.concat_ws("\t", "ngram", F.col("count").cast("string")).alias("value")).write.text(path)


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    """token_id, token, part as tab-parted lines; nothing is quoted."""
    vocab.select(F.concat_ws("\t", "token_id", "token", "part").alias("value")).write.text(path)


def write_histogram(grams: DataFrame, path: str) -> None:
    """n, gram, count in one folder for each n, its rows from the most frequent down."""
    grams.repartitionByRange("n", F.desc("count")).sortWithinPartitions("n", F.desc("count"), "gram").write.partitionBy("n").parquet(path)


def write_ranges_json(ranges: DataFrame, path: str) -> None:
    """part, lo, hi (a row per partition of the vocabulary) as one JSON object of pairs."""
    pairs = ranges.agg(F.map_from_entries(F.collect_list(F.struct("part", F.array(F.col("lo").cast("long"), F.col("hi").cast("long"))))).alias("m"))
    pairs.select(F.to_json("m").alias("value")).coalesce(1).write.text(path)


def read_ranges_json(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<bigint>>").alias("m"))
    return whole.select(F.explode("m").alias("part", "r")).select("part", F.col("r")[0].alias("lo"), F.col("r")[1].alias("hi"))


def write_partitioned(counts: DataFrame, path: str, *by: str) -> None:
    """One folder per order and prefix; rows of a folder come from one task each, and hot ones may be split."""
    counts.hint("rebalance", *by).write.partitionBy(*by).mode("append").parquet(path)


def write_with_rejects(translated: DataFrame, path: str, reject_col: str = "reject") -> None:
    """Accepted and rejected rows go to folders of their own, rejected=false and rejected=true, in one pass."""
    translated.withColumn("rejected", F.col(reject_col).isNotNull()).write.partitionBy("rejected").parquet(path)


def reject_counts(translated: DataFrame, reject_col: str = "reject") -> DataFrame:
    return translated.filter(F.col(reject_col).isNotNull()).groupBy(reject_col).agg(F.count("*").alias("rows"))


def numbered_lines(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, line_no (from 0), line of each text; a line break at the end starts no further line."""
    body = F.regexp_replace(F.col(text_col), r"\n\z", "")
    return texts.filter(F.col(text_col) != "").select(id_col, F.posexplode(F.split(body, "\n")).alias("line_no", "line"))


def line_slice(lines: DataFrame, order: list[str], start: int, stop: int | None, step: int = 1) -> DataFrame:
    """Rows number start, start + step, ... below stop, numbered from 0 in the given order."""
    at = F.col("row_id") - 1
    keep = (at >= start) & ((at - start) % step == 0)
    return row_ids(lines, order).filter(keep if stop is None else keep & (at < stop)).withColumn("row_id", at)


def trailing_integers(lines: DataFrame, by: str, line_col: str = "line") -> DataFrame:
    """Sum, least and greatest of the integers at the ends of lines; files without any are left out."""
    found = lines.withColumn("_i", trailing_integer(F.col(line_col))).filter("_i is not null")
    return found.groupBy(by).agg(F.sum("_i").alias("sum"), F.min("_i").alias("min"), F.max("_i").alias("max"))


def strip_notices(lines: DataFrame, by: str, start: str, end: str, line_col: str = "line") -> DataFrame:
    """The lines strictly between the first that matches `start` and the next that matches `end` (case aside); without
    a start none, without an end all behind the start."""
    hit = lambda p: F.lower(line_col).rlike(p.lower())
    first = lines.filter(hit(start)).groupBy(by).agg(F.min("line_no").alias("_from"))
    begun = lines.join(first, by).filter("line_no > _from")
    last = begun.filter(hit(end)).groupBy(by).agg(F.min("line_no").alias("_to"))
    return begun.join(last, by, "left").filter("_to is null OR line_no < _to").drop("_from", "_to")


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """path and length of files, without reading them."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def running_size(sizes: DataFrame, part: str | None, order: str, length: str = "length") -> DataFrame:
    """Sizes with the running total in GB, in each part if there are parts; a part need not fit into one task."""
    keys = [part] if part else []
    summed = saved(prefix_sums(sizes, [*keys, order], length, "_from", "_to"))
    begins = summed.groupBy(*keys).agg(F.min("_from").alias("_begin"))
    summed = summed.join(begins, keys) if keys else summed.crossJoin(F.broadcast(begins))  # one row
    return summed.withColumn("total_gb", (F.col("_to") - F.col("_begin")) / (1024**3)).drop("_from", "_to", "_begin")


def longest_partition(prefixes: DataFrame, partitions: list[str]) -> Column:
    """The longest partition that begins the column `prefix`: a fixed list makes a fixed expression, and no join."""
    ordered = sorted(partitions, key=len, reverse=True)
    out = F.lit(None).cast("string")
    for p in reversed(ordered):
        out = F.when(prefixes["prefix"].startswith(p), p).otherwise(out)
    return out
