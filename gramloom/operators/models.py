"""A model folder: vocabulary, counts of all orders, cumulative ranges and back-off tables, each made once and asked often.

Tables that are asked by a context are bucketed and sorted by it. Few requests are broadcast to them, and many are
shuffled to their buckets; the tables themselves are never shuffled again. What a folder has is in its manifest, so that
another session can read a finished folder; a table that was not finished is made anew.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.functions import text as T
from gramloom.operators import backoff, counts, cumulative
from gramloom.operators.counts import part_rank, row_ids
from gramloom.schemas import END, START, word_columns
from gramloom.sources import store
from gramloom.sources.store import saved

#: The id of a token that the vocabulary doesn't have.
UNKNOWN = -1
#: A token with more than this share of all tokens is hot: there are fewer than HOT such tokens.
HOT = 1000


class Folder:
    """Named tables below a path, each written once."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._open: dict[str, DataFrame] = {}

    def _catalog_name(self, name: str) -> str:
        return f"gramloom_{hashlib.md5(self.path.encode()).hexdigest()[:12]}_{name.replace('-', '_')}"

    def table(self, name: str, build: Callable[[], DataFrame], keys: list[str] | tuple[str, ...] = ()) -> DataFrame:
        """The table, built if the folder doesn't have it finished; bucketed and sorted by keys if there are any."""
        if name not in self._open:
            told = self._told(name)
            if told is None:
                df, keys = build(), list(keys)
                told = {"keys": keys, "buckets": self.buckets, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)}
                out = df.repartition(self.buckets, *keys) if keys else df
                self._declare(name, told)
                out.write.mode("overwrite").insertInto(self._catalog_name(name)) if keys else out.write.mode("overwrite").parquet(self._at(name))
                self.spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/{name}")
            else:
                self._declare(name, told)
            self._open[name] = self.spark.table(self._catalog_name(name)) if told["keys"] else self.spark.read.schema(told["schema"]).parquet(self._at(name))
        return self._open[name]

    def _at(self, name: str) -> str:
        return f"{self.path}/tables/{name}"

    def _told(self, name: str) -> dict | None:
        path = f"{self.path}/manifest/{name}"
        return json.loads(self.spark.read.text(path).first()[0]) if store.exists(self.spark, path) else None

    def _declare(self, name: str, told: dict) -> None:
        """Tell the session's catalog how the table is bucketed."""
        if told["keys"]:
            by = ", ".join(f"`{k}`" for k in told["keys"])
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._catalog_name(name)} ({told['schema']}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {told['buckets']} BUCKETS LOCATION '{self._at(name)}'")


def counted_vocabulary(sentences: DataFrame) -> DataFrame:
    """token_id (from 1), token, part, count of all distinct tokens; by partition, then by code points."""
    tokens = sentences.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("count"))
    ordered = row_ids(tokens.withColumn("part", T.token_part(F.col("token"))).withColumn("_rank", part_rank(F.col("part"))), ["_rank", "token"], "token_id")
    return ordered.select(F.col("token_id").cast("int").alias("token_id"), "token", "part", "count")


def sentence_ids(sentences: DataFrame, vocab: DataFrame, keys: list[str]) -> DataFrame:
    """keys (which tell sentences apart) and ids: the ids of each sentence's tokens, UNKNOWN for those without one.

    One join for all orders of n-grams that come from the sentences. The few hot tokens, whose rows would meet in one
    task, are broadcast (fewer than HOT rows). vocab: a written counted vocabulary.
    """
    each = sentences.select(*keys, F.posexplode("tokens").alias("_pos", "token"))
    total = vocab.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    hot = F.col("count") * HOT > total
    near = each.join(F.broadcast(vocab.filter(hot).select("token", "token_id")), "token", "left")
    far = near.filter("token_id IS NULL").drop("token_id").join(vocab.filter(~hot).select("token", "token_id"), "token", "left")
    known = near.filter("token_id IS NOT NULL").unionByName(far.withColumn("token_id", F.coalesce("token_id", F.lit(UNKNOWN))))
    ordered = known.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_pos", "token_id"))).alias("_s"))
    return ordered.select(*keys, F.col("_s.token_id").alias("ids"))


class NgramModel:
    """The models of a corpus up to order n_max in a folder. sentences: called for a table of tokens when it is needed."""

    def __init__(self, folder: Folder, sentences: Callable[[], DataFrame], n_max: int):
        self.folder, self._source, self.n_max = folder, sentences, n_max

    def sentences(self) -> DataFrame:
        return self.folder.table("sentences", lambda: self._source().select("tokens", F.monotonically_increasing_id().alias("_sentence")))

    def vocabulary(self) -> DataFrame:
        return self.folder.table("vocabulary", lambda: counted_vocabulary(self.sentences()))

    def _every(self) -> DataFrame:
        def build() -> DataFrame:
            ids = saved(sentence_ids(self.sentences(), self.vocabulary(), ["_sentence"]))
            return counts.every_count(ids.withColumnRenamed("ids", "tokens"), self.n_max)

        return self.folder.table("every", build)

    def _wide(self, ngrams: DataFrame, n: int) -> DataFrame:
        return ngrams.select(*(F.col("ngram")[i].alias(w) for i, w in enumerate(word_columns(n))), "count")

    def counts(self, n: int) -> DataFrame:
        """w1..wn (ids), count. The vocabulary counts its tokens already."""
        if n == 1:
            return self.vocabulary().select(F.col("token_id").alias("w1"), "count")
        return self._wide(self._every().filter(F.col("n") == n).select("ngram", "count"), n)

    def ranges(self, n: int) -> DataFrame:
        """w1..wn, cf1, cf2: bucketed by the context."""
        return self.folder.table(f"ranges-{n}", lambda: cumulative.cumulative(self.counts(n), n), word_columns(n - 1))

    def contexts(self, n: int) -> DataFrame:
        """w1..w(n-1), and the range of all that order n has behind it: of single tokens from their counts as any but
        the last of a sentence, without a table of pairs."""
        if n != 2:
            return cumulative.contexts(self.ranges(n), n)
        each = self.sentences().select(F.explode_outer(F.expr("slice(tokens, 1, size(tokens) - 1)")).alias("token")).filter("token IS NOT NULL")
        known = each.groupBy("token").agg(F.count("*").alias("count")).join(self.vocabulary().select("token", "token_id"), "token")
        return cumulative.cumulative(known.select(F.col("token_id").alias("w1"), "count"), 1)

    def consistent(self, n: int) -> DataFrame:
        """w1..wn, count, no less than the n-grams one order higher that begin or end with it."""

        def build() -> DataFrame:
            own = self._every().filter(F.col("n") == n).select("ngram", "count")
            if n == self.n_max:
                return self._wide(own, n)
            above = self.consistent(n + 1).select(F.array(*word_columns(n + 1)).alias("ngram"), "count")
            return self._wide(counts.max_merge(own, counts.left_marginal(above), counts.right_marginal(above)), n)

        return self.folder.table(f"consistent-{n}", build, word_columns(n - 1))

    def id_of(self, token: str) -> int:
        row = self.vocabulary().filter(F.col("token") == token).select("token_id").first()
        return row[0] if row else UNKNOWN

    def cumulative(self, n_max: int | None = None) -> cumulative.CumulativeModel:
        return cumulative.CumulativeModel({n: self.ranges(n) for n in range(1, (n_max or self.n_max) + 1)})

    def backoff(self, n_max: int | None = None, beta: float = 0.1, gamma: float = 0.01, offset: int = 0, times: int = 1) -> backoff.BackoffModel:
        """The back-off model of some order; times: every count is told so often."""
        n_max = n_max or self.n_max
        tables = {n: self.consistent(n).withColumn("count", F.col("count") * times) for n in range(1, n_max + 1)}
        keep = lambda name, build, by: self.folder.table(f"backoff-{n_max}-{offset}-{times}-{name}", build, by)
        return backoff.BackoffModel(tables, beta, gamma, offset, self.id_of(START), self.id_of(END), keep)

    def words(self, rows: DataFrame, column: str, name: str) -> DataFrame:
        """rows with the token of an id column; null for a null id."""
        return rows.join(self.vocabulary().select(F.col("token_id").alias(column), F.col("token").alias(name)), column, "left")

    def asked_ids(self, sentences: DataFrame, keys: list[str]) -> DataFrame:
        """keys, tokens and ids of other sentences: what is asked of the model."""
        own = saved(sentences.select(*keys, "tokens", F.monotonically_increasing_id().alias("_sentence")))
        return saved(own.join(sentence_ids(own, self.vocabulary(), ["_sentence"]), "_sentence").select(*keys, "tokens", "ids"))


def context_windows(asked: DataFrame, keep: list[str], n: int) -> DataFrame:
    """For each token of sentences with tokens and ids: keep, pos, c1..c(n-1) and w (ids; nulls in front of the first),
    and t1..tn, the tokens of the same places."""
    each = asked.select(*keep, "tokens", "ids", F.posexplode("ids").alias("pos", "w"))
    before = lambda a, k: F.when(F.col("pos") >= k, F.get(a, F.col("pos") - k))
    back = lambda a, p: [before(a, n - i).alias(f"{p}{i}") for i in range(1, n)]
    tokens: list[Column] = [*back("tokens", "t"), F.get("tokens", F.col("pos")).alias(f"t{n}")]
    return each.select(*keep, "pos", *back("ids", "c"), "w", *tokens)
