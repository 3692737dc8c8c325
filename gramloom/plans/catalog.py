"""The registered queries over n-gram data, each with the same query in SQL as its oracle where SQL can express it.

Documents are the corpus; benchmark items and conversations are what is looked up in it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.functions import intervals as I
from gramloom.functions import text as T
from gramloom.operators import backoff, codec, counts, cumulative, loads, models, ngrams, stego, tagged
from gramloom.plans import oracle as O
from gramloom.schemas import END, PARTITIONS, START
from gramloom.sources import lines as L
from gramloom.sources.store import saved, scratch
from gramloom.streaming import status

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def sentences(spark: SparkSession, sf_dir: str, name: str = "documents", id_col: str = "doc_id", normalise: bool = True) -> DataFrame:
    return ngrams.sentence_table(table(spark, sf_dir, name).select(id_col, "text"), id_col, "text", normalise)


def spoken(spark: SparkSession, sf_dir: str, normalise: bool = False) -> DataFrame:
    """doc_id, n (sentences) and t (tokens) of each document that has a sentence."""
    return ngrams.document_tokens(documents(spark, sf_dir), "doc_id", "text", normalise)


def told(counts_: DataFrame) -> DataFrame:
    return counts_.select(F.array_join("ngram", " ").alias("ngram"), "count")


_models: dict[tuple[str, str], models.NgramModel] = {}


def model(spark: SparkSession, sf_dir: str) -> models.NgramModel:
    """The documents' models of orders 1 to 3: a folder that an application makes once and asks often."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _models:
        _models[key] = models.NgramModel(models.Folder(spark, scratch(spark, "model")), lambda: sentences(spark, sf_dir), 3)
    return _models[key]


def asked(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Every token of the benchmark's sentences behind its n - 1 predecessors, as ids and as tokens."""
    own = model(spark, sf_dir).asked_ids(sentences(spark, sf_dir, "benchmark", "item_id"), ["item_id", "sent"])
    return models.context_windows(own, ["item_id", "sent"], n)


# -- text -----------------------------------------------------------------------------------------------------------


@query(O.with_raw("SELECT doc_id, count(*) AS n_sentences, sum(len(tokens))::BIGINT AS n_tokens, md5(string_agg(array_to_string(tokens, ' '), ' ' ORDER BY sent)) AS tokens_md5 FROM raw GROUP BY doc_id"))
def token_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spoken(spark, sf_dir).select("doc_id", F.col("n").cast("long").alias("n_sentences"), F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query(O.with_raw("SELECT doc_id, md5(string_agg(array_to_string(tokens[2:len(tokens) - 1], ' '), '  ' ORDER BY sent)) AS text_md5 FROM raw GROUP BY doc_id"))
def tokens_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spoken(spark, sf_dir).select("doc_id", F.md5(T.tokens_to_text(F.col("t"))).alias("text_md5"))


@query(O.with_sentences("SELECT doc_id, sum(len(tokens))::BIGINT AS n_tokens, md5(string_agg(array_to_string(tokens, ' '), ' ' ORDER BY sent)) AS tokens_md5 FROM sentences GROUP BY doc_id"))
def normalise_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spoken(spark, sf_dir, normalise=True).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query(
    O.with_sentences("""
    SELECT doc_id, count(*) AS n_sentences, sum(len(list_filter(tokens, lambda t: regexp_matches(t, '[a-z0-9]') AND t NOT IN ('_START_', '_END_'))))::BIGINT AS n_words,
           round(avg(len(tokens) - 2), 6) AS mean_length FROM sentences GROUP BY doc_id
    """)
)
def token_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = sentences(spark, sf_dir)
    words = F.size(F.filter("tokens", lambda t: t.rlike("[a-z0-9]") & ~t.isin(START, END)))
    return own.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(words).cast("long").alias("n_words"), F.round(F.avg(F.size("tokens") - 2), 6).alias("mean_length"))


def tagged_tokens(own: DataFrame) -> DataFrame:
    """Words with a made-up tag by their length, as the corpus has none: every fourth length stays untagged."""
    tag = lambda w: F.element_at(F.array(*map(F.lit, ("", "_NOUN", "_X", "_VERB_"))), F.length(w) % 4 + 1)
    return own.withColumn("tokens", F.transform("tokens", lambda w: F.when(w.isin(START, END), w).otherwise(F.concat(w, tag(w)))))


@query(
    O.with_raw(f"""
    , t AS (SELECT doc_id, list_transform(tokens, lambda w: {O.TAGGED}) AS tokens FROM raw),
    g AS (SELECT doc_id, {O.windows(2)} AS g FROM t)
    SELECT doc_id, count(*) FILTER (NOT list_bool_or(list_transform(g, lambda w: {O.IS_TAGGED}))) AS kept,
           count(*) FILTER (list_bool_or(list_transform(g, lambda w: {O.IS_TAGGED}))) AS dropped FROM g GROUP BY doc_id
    """)
)
def pos_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = ngrams.explode_windows(tagged_tokens(sentences(spark, sf_dir, normalise=False)), 2, ("doc_id",)).withColumn("ok", T.valid_ngram(F.col("ngram")))
    return own.groupBy("doc_id").agg(F.count_if("ok").alias("kept"), F.count_if(~F.col("ok")).alias("dropped"))


@query(
    O.with_raw(f"""
    , g AS (SELECT doc_id, {O.windows(2)} AS g FROM (SELECT doc_id, tokens FROM raw))
    SELECT array_to_string(g, ' ') AS ngram, count(*) AS count FROM g WHERE NOT regexp_matches(array_to_string(g, ' '), '[0-9]') GROUP BY ALL
    """)
)
def digit_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(counts.without_digits(counts.order_counts(sentences(spark, sf_dir, normalise=False), 2)))


@query(O.with_sentences(f", t AS (SELECT unnest(tokens) AS t FROM sentences) SELECT {O.prefix('t', 1)} AS prefix_1, {O.prefix('t', 2)} AS prefix_2, count(*) AS n FROM t GROUP BY ALL"))
def token_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = sentences(spark, sf_dir).select(F.explode("tokens").alias("t")).groupBy("t").count()
    return own.groupBy(T.token_prefix(F.col("t"), 1).alias("prefix_1"), T.token_prefix(F.col("t"), 2).alias("prefix_2")).agg(F.sum("count").alias("n"))


@query(
    O.with_sentences(f"""
    , t AS (SELECT unnest(tokens) AS t FROM sentences), p AS (SELECT {O.prefix('t', 2)} AS prefix, count(*) AS n FROM t GROUP BY ALL),
    parts AS (SELECT unnest(list_concat(string_split('0123456789abcdefghijklmnopqrstuvwxyz', ''), ['other', 'punctuation', 'th', 'in'])) AS part)
    SELECT prefix, arg_max(part, len(part)) AS part, any_value(n) AS n FROM p LEFT JOIN parts ON starts_with(prefix, part) GROUP BY prefix
    """)
)
def longest_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = token_prefix(spark, sf_dir).groupBy(F.col("prefix_2").alias("prefix")).agg(F.sum("n").alias("n"))
    parts = [*PARTITIONS.replace("_", ""), "other", "punctuation", "th", "in"]
    return own.withColumn("part", L.longest_partition(own, parts))


# -- counting -------------------------------------------------------------------------------------------------------


@query(
    O.with_raw(f"""
    , t AS (SELECT list_transform(tokens, lambda w: {O.TAGGED}) AS tokens FROM raw), g AS (SELECT {O.windows(2)} AS g FROM t)
    SELECT array_to_string(g, ' ') AS ngram, count(*) AS count FROM g WHERE NOT list_bool_or(list_transform(g, lambda w: {O.IS_TAGGED})) GROUP BY ALL
    """)
)
def year_integration(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = ngrams.explode_windows(tagged_tokens(sentences(spark, sf_dir, normalise=False)), 2, ("doc_id",))
    yearly = own.groupBy(F.col("ngram")[0].alias("w1"), F.col("ngram")[1].alias("w2"), (1990 + F.col("doc_id") % 20).alias("year"))
    raw = yearly.agg(F.count("*").alias("match_count"), F.count_distinct("doc_id").alias("volume_count"))
    return told(counts.integrate_years(raw, 2))


@query(O.with_sentences(" UNION ALL ".join(f"(SELECT {n} AS n, array_to_string(g, ' ') AS ngram, count(*) AS count FROM (SELECT {O.windows(n)} AS g FROM sentences) GROUP BY ALL)" for n in range(1, 6))))
def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.key_counts(sentences(spark, sf_dir), 5).select("n", F.col("_key").alias("ngram"), "count")


@query(O.EDGE)
def edge_explosion(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = counts.every_count(sentences(spark, sf_dir, normalise=False), 3).filter("n >= 2")
    return told(counts.integrate(ngrams.edge_explosion(raw, 3)))


@query(O.SINGLE)
def single_explosion(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = counts.order_counts(sentences(spark, sf_dir, normalise=False), 1)
    return told(counts.integrate(ngrams.single_explosion(raw, 3)))


@query(O.LETTERS)
def letter_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.letter_ngrams(documents(spark, sf_dir), 3)


@query(O.with_vocab("SELECT token_id::INT AS token_id, token, part FROM vocab"))
def vocab_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.vocabulary(counts.order_counts(sentences(spark, sf_dir), 1))


@query(O.with_vocab(f", g AS (SELECT {O.windows(2)} AS g FROM sentences) SELECT a.token_id::INT AS w1, b.token_id::INT AS w2, count(*) AS count FROM g JOIN vocab a ON a.token = g[1] JOIN vocab b ON b.token = g[2] GROUP BY ALL"))
def index_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = counts.ngram_counts(sentences(spark, sf_dir), 2)
    return counts.id_table(counts.translate(found[2], saved(counts.vocabulary(found[1])), 2), 2)


@query(
    O.with_vocab(
        f"""
    , g AS (SELECT {O.windows(2)} AS g FROM asked), c AS (SELECT g, count(*) AS n FROM g GROUP BY ALL)
    SELECT 'unindexed' AS reject, count(*) AS n_rows, coalesce(sum(n), 0)::BIGINT AS total FROM c LEFT JOIN vocab a ON a.token = g[1] LEFT JOIN vocab b ON b.token = g[2]
    WHERE a.token IS NULL OR b.token IS NULL HAVING count(*) > 0
    """,
        "conversations",
    )
)
def index_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = saved(counts.vocabulary(counts.order_counts(sentences(spark, sf_dir), 1)))
    asked = counts.order_counts(sentences(spark, sf_dir, "conversations", "conv_id"), 2)
    return counts.translate(asked, vocab, 2).filter("reject is not null").groupBy("reject").agg(F.count("*").alias("n_rows"), F.sum("count").alias("total"))


@query(O.with_counts("SELECT w1 || ' ' || w2 AS ngram, sum(count)::BIGINT AS count FROM t3 GROUP BY w1, w2"))
def left_marginal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(counts.left_marginal(counts.order_counts(sentences(spark, sf_dir), 3)))


@query(O.with_counts("SELECT w2 || ' ' || w3 AS ngram, sum(count)::BIGINT AS count FROM t3 GROUP BY w2, w3"))
def right_marginal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(counts.right_marginal(counts.order_counts(sentences(spark, sf_dir), 3)))


@query(O.with_consistent("SELECT 1 AS n, w1 AS ngram, count FROM k1 UNION ALL SELECT 2, w1 || ' ' || w2, count FROM k2"))
def counts_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = counts.consistent(counts.ngram_counts(sentences(spark, sf_dir), 3))
    both = [told(found[n]).select(F.lit(n).alias("n"), "ngram", "count") for n in (1, 2)]
    return both[0].unionByName(both[1])


@query(O.with_asked("SELECT ngram, max(count) AS count FROM (SELECT ngram, count(*) AS count FROM (SELECT unnest(tokens) AS ngram FROM sentences) GROUP BY ALL UNION ALL SELECT ngram, count(*) FROM (SELECT unnest(tokens) AS ngram FROM asked) GROUP BY ALL) GROUP BY ngram", "conversations"))
def max_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = (counts.order_counts(s, 1) for s in (sentences(spark, sf_dir), sentences(spark, sf_dir, "conversations", "conv_id")))
    return told(counts.max_merge(one, two))


@query(O.with_asked("SELECT ngram, ngram IN (SELECT unnest(tokens) FROM asked) AS reject FROM (SELECT DISTINCT unnest(tokens) AS ngram FROM sentences)", "conversations"))
def mark_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = (counts.order_counts(s, 1) for s in (sentences(spark, sf_dir), sentences(spark, sf_dir, "conversations", "conv_id")))
    return counts.mark(one, two).select(F.array_join("ngram", " ").alias("ngram"), "reject")


# -- cumulative models ----------------------------------------------------------------------------------------------


@query(O.with_ranges("SELECT w1, cf1, cf2 FROM r1"))
def cumfreq_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model(spark, sf_dir).ranges(1)


@query(O.with_ranges("SELECT a.token || ' ' || b.token AS ngram, (cf2 - cf1)::BIGINT AS count, cf1, cf2 FROM r2 JOIN vocab a ON a.token_id = w1 JOIN vocab b ON b.token_id = w2"))
def second_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the documents, loaded in two halves, and the second half once more, which changes nothing."""
    found = saved(ngrams.explode_windows(sentences(spark, sf_dir), 2, ("doc_id",)).groupBy("ngram", (F.col("doc_id") % 2).alias("half")).agg(F.count("*").alias("count")))
    store = loads.CountStore(spark, scratch(spark, "loads"))
    for half in (0, 1, 1):
        store.load(f"half {half}", found.filter(F.col("half") == half).select("ngram", "count"))
    return store.ranges().select(F.array_join("ngram", " ").alias("ngram"), "count", "cf1", "cf2")


@query(O.with_ranges("SELECT w1, min(cf1) AS cf1, max(cf2) AS cf2 FROM r2 GROUP BY w1"))
def context_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model(spark, sf_dir).contexts(2)


@query(
    O.with_ranges("""
    SELECT part, min(cf1) AS lo, max(cf2) AS hi, min(token_id)::INT AS first, max(token_id)::INT AS last FROM r1 JOIN vocab ON token_id = w1 GROUP BY part
    """)
)
def partition_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = saved(counts.order_counts(sentences(spark, sf_dir), 1))
    by_part = found.select(T.token_part(F.element_at("ngram", 1)).alias("part"), "count")
    return cumulative.partition_ranges(by_part).select("part", F.col("lo").cast("long").alias("lo"), "hi").join(cumulative.index_ranges(counts.vocabulary(found)), "part")


@query(O.PROBABILITIES)
def conditional_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ask = asked(spark, sf_dir, 3).filter("c1 IS NOT NULL").select("c1", "c2", "w", "t1", "t2", "t3").distinct()
    out = model(spark, sf_dir).cumulative().probabilities(ask)
    return out.select(F.concat_ws(" ", "t1", "t2", "t3").alias("ngram"), *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("lo", "hi", "total", "level")))


def marked(rows: DataFrame, marks: list[tuple[int, int]], den: int) -> DataFrame:
    """rows with each of the intervals [num/den, (num+size)/den)."""
    long = lambda x: F.lit(x).cast("long")
    several = F.explode(F.array(*(F.struct(long(a).alias("num"), long(b).alias("size"), long(den).alias("den")) for a, b in marks)))
    return rows.withColumn("_m", several).select("*", "_m.*").drop("_m")


@query(O.NEXT)
def next_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = asked(spark, sf_dir, 2).filter("c1 IS NOT NULL").select("c1", F.col("w").alias("c2"), "t1", "t2").distinct()
    base = model(spark, sf_dir)
    out = base.words(base.cumulative().next_words(marked(own, [(13, 1), (500, 10), (999, 1)], 1000)), "w", "word")
    return out.select(F.concat_ws(" ", "t1", "t2").alias("context"), "num", "level", F.coalesce("word", F.lit("")).alias("word"))


# -- tagged corpora -------------------------------------------------------------------------------------------------


def tagged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of words of conversations with their role as tag; one-letter words are withheld, as a publisher might."""
    own = ngrams.spread(table(spark, sf_dir, "conversations").select("conv_id", "role", "text"))
    each = own.select("role", F.explode(ngrams.windows(F.filter(F.split("text", rf"[{T.SPACE}]+"), lambda w: w != ""), 2)).alias("g"))
    hide = lambda i: F.when(F.length(F.col("g")[i]) == 1, "q!").otherwise(F.col("g")[i])
    return each.select("role", hide(0).alias("w1"), hide(1).alias("w2")).groupBy("role", "w1", "w2").agg(F.count("*").alias("p"))


def tagged_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged.cumulate(tagged_rows(spark, sf_dir), ["role", "w1", "w2"], 2)


@query(O.with_tagged("SELECT role, w1, w2, p, c1, c2 FROM cum"))
def tagged_cumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged_ranges(spark, sf_dir)


@query(O.with_tagged("SELECT n, i, coalesce(w1, '') AS w1, coalesce(w2, '') AS w2, p, c1, c2 FROM marg"))
def tagged_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tagged.marginals(tagged_ranges(spark, sf_dir), 2, "c1")
    return found.select("n", F.col("i").cast("long").alias("i"), *(F.coalesce(w, F.lit("")).alias(w) for w in ("w1", "w2")), "p", "c1", "c2")


def tagged_model(spark: SparkSession, sf_dir: str) -> tagged.TaggedModel:
    return tagged.TaggedModel(saved(tagged.marginals(tagged_ranges(spark, sf_dir), 2, "c1")), 2)


def raw_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = ngrams.spread(table(spark, sf_dir, "benchmark").select("text")).select(F.explode(ngrams.windows(F.filter(F.split(F.lower("text"), rf"[{T.SPACE}]+"), lambda w: w != ""), 2)).alias("g"))
    return own.select(F.col("g")[0].alias("c1"), F.col("g")[1].alias("w")).distinct()


@query(O.TAGGED_PROBABILITY)
def tagged_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tagged_model(spark, sf_dir).probabilities(raw_pairs(spark, sf_dir))
    return out.select(F.concat_ws(" ", "c1", "w").alias("pair"), *(F.round(F.coalesce(c, F.lit(-1.0)), 9).alias(c) for c in ("probability", "lo", "hi")), F.coalesce("level", F.lit(0)).alias("level"))


@query(O.TAGGED_MATCH)
def tagged_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.explode(F.array(*(F.struct(F.lit(a).alias("num"), F.lit(b).alias("size"), F.lit(100).alias("den")) for a, b in ((7, 1), (30, 40), (90, 10)))))
    asks = raw_pairs(spark, sf_dir).select("c1").distinct().withColumn("m", marks).select(F.concat_ws(" ", "c1", "m.num").alias("id"), "c1", "m.*")
    out = tagged_model(spark, sf_dir).matching_words(asks)
    return out.select("id", F.coalesce("w", F.lit("")).alias("word"), F.coalesce("kind", F.lit(0)).alias("kind"))


def tagged_triples(spark: SparkSession, sf_dir: str) -> tagged.SequenceModel:
    """Triples of words of conversations with their role as tag, one-letter words withheld, as marginals of all orders."""
    own = ngrams.spread(table(spark, sf_dir, "conversations").select("role", "text"))
    each = own.select("role", F.explode(ngrams.windows(F.filter(F.split("text", rf"[{T.SPACE}]+"), lambda w: w != ""), 3)).alias("g"))
    hide = lambda i: F.when(F.length(F.col("g")[i]) == 1, "q!").otherwise(F.col("g")[i]).alias(f"w{i + 1}")
    raw = each.select("role", *map(hide, range(3))).groupBy("role", "w1", "w2", "w3").agg(F.count("*").alias("p"))
    cumulated = tagged.cumulate(raw, ["role", "w1", "w2", "w3"], 3)
    return tagged.SequenceModel(saved(tagged.marginals(cumulated, 3, "c1")), 3)


def raw_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = ngrams.spread(table(spark, sf_dir, "benchmark").select("text"))
    return own.select(F.explode(ngrams.windows(F.filter(F.split(F.lower("text"), rf"[{T.SPACE}]+"), lambda w: w != ""), 3)).alias("g")).distinct()


@query(O.TAGGED_SEQUENCES)
def tagged_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely one, two and three words of the benchmark are after the two, one or no words before them."""
    cut = F.explode(F.array(*(F.struct(F.slice("g", 1, k).alias("context"), F.slice("g", k + 1, 3 - k).alias("words")) for k in range(3)))).alias("a")
    out = tagged_triples(spark, sf_dir).probabilities(raw_triples(spark, sf_dir).select(cut).select("a.*").distinct())
    told = (F.round(F.coalesce(c, F.lit(-1.0)), 9).alias(c) for c in ("probability", "lo", "hi"))
    return out.select(F.array_join("context", " ").alias("context"), F.array_join("words", " ").alias("words"), *told, F.coalesce("used", F.lit(-1)).alias("used"))


@query(O.TAGGED_TRIPLES)
def tagged_matching_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that match three intervals behind one and two words of the benchmark, and behind none."""
    context = F.explode(F.array(F.slice("g", 1, 2), F.slice("g", 1, 1), F.slice("g", 1, 0))).alias("context")
    marks = F.explode(F.array(*(F.struct(F.lit(a).alias("num"), F.lit(b).alias("size"), F.lit(100).alias("den")) for a, b in ((7, 1), (30, 40), (90, 10)))))
    asks = raw_triples(spark, sf_dir).select(context).distinct().withColumn("m", marks).select("context", "m.*")
    out = tagged_triples(spark, sf_dir).matching_words(asks)
    return out.select(F.array_join("context", " ").alias("context"), "num", F.coalesce("word", F.lit("")).alias("word"), F.coalesce("kind", F.lit(0)).alias("kind"), F.coalesce("used", F.lit(-1)).alias("used"))


# -- the back-off model ---------------------------------------------------------------------------------------------


@query(O.DISTRIBUTION)
def backoff_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = model(spark, sf_dir)
    out = base.words(base.words(base.backoff(2).distribution(2), "w1", "context"), "token", "word")
    return out.select("context", F.coalesce("word", F.lit("")).alias("token"), "cum", "len")


def scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every token of the benchmark with its context, and the score of each distinct one."""
    each = asked(spark, sf_dir, 3)
    return each, model(spark, sf_dir).backoff().score(each.select("c1", "c2", "w", "t1", "t2", "t3").distinct())


@query(O.SCORES)
def backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, out = scored(spark, sf_dir)
    return out.select(F.concat_ws(" ", "t1", "t2", "t3").alias("ngram"), F.round(F.coalesce("bits", F.lit(-1.0)), 6).alias("bits"), F.coalesce("level", F.lit(0)).alias("level"))


@query(O.ENTROPY)
def text_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    each, out = scored(spark, sf_dir)
    joined = each.join(out, each["t1"].eqNullSafe(out["t1"]) & each["t2"].eqNullSafe(out["t2"]) & (each["t3"] == out["t3"]))
    # the start mark is no word; a word counts its letters and the blank behind it
    sure = F.col("bits").isNotNull() & (F.col("pos") > 0)
    total, words, letters_ = F.sum(F.when(sure, F.col("bits"))), F.sum(F.when(sure, 1)), F.sum(F.when(sure, F.length("token") + 1))
    per_unit = [F.round(x, 4).alias(c) for c, x in (("bits_per_word", total / words), ("bits_per_character", total / letters_), ("perplexity", F.pow(F.lit(2.0), total / words)))]
    joined = joined.select("item_id", "pos", each["t3"].alias("token"), "bits")
    return joined.groupBy("item_id").agg(F.count("*").alias("n_tokens"), F.count_if(F.col("bits").isNull()).alias("n_impossible"), F.round(F.coalesce(F.sum("bits"), F.lit(0.0)), 4).alias("bits"), *per_unit)


def offset_model(spark: SparkSession, sf_dir: str, n_max: int) -> backoff.BackoffModel:
    """The documents' model with an offset of 35, from forty-fold counts."""
    return model(spark, sf_dir).backoff(n_max, offset=O.OFFSET, times=O.TIMES)


@query(O.INTERVALS)
def backoff_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact way to each token of the benchmark behind its two predecessors, back-offs and all."""
    out = offset_model(spark, sf_dir, 3).intervals(asked(spark, sf_dir, 3).select("c1", "c2", "w", "t1", "t2", "t3").distinct())
    parts = F.array_join(F.transform("parts", lambda p: F.concat_ws("/", p["lo"], p["hi"], p["total"])), " ")
    return out.select(F.concat_ws(" ", "t1", "t2", "t3").alias("ngram"), F.coalesce(parts, F.lit("-")).alias("parts"))


@query(O.NEXT_BACKOFF)
def backoff_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token that holds three intervals behind each word of the benchmark."""
    own = asked(spark, sf_dir, 2).filter("c1 IS NOT NULL").select("c1", "t1").distinct()
    out = offset_model(spark, sf_dir, 2).next_words(marked(own, [(13, 1), (500, 10), (999, 1)], 1061))
    return model(spark, sf_dir).words(out, "w", "word").select(F.col("t1").alias("context"), "num", F.coalesce("word", F.lit("")).alias("word"), F.coalesce("level", F.lit(0)).alias("level"))


@query(O.REPORT)
def sentence_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sentence of the benchmark as the model of order 3 with an offset of 35 has it: text, entropy, and whether its
    bits (at most as many as its entropy) are told."""
    base = model(spark, sf_dir)
    own = base.asked_ids(sentences(spark, sf_dir, "benchmark", "item_id"), ["item_id", "sent"])
    out = stego.report(offset_model(spark, sf_dir, 3), own.select("item_id", "sent", "ids", "tokens"), base.vocabulary(), ["item_id", "sent"])
    out = out.drop("tokens", "text").join(own.select("item_id", "sent", "tokens"), ["item_id", "sent"])  # words that the vocabulary lacks too
    told = F.coalesce(F.size("bits") <= F.col("entropy"), F.lit(False))
    return out.select("item_id", "sent", F.size("tokens").alias("n_tokens"), F.array_join(F.slice("tokens", 2, F.size("tokens") - 2), " ").alias("text"), F.round(F.coalesce("entropy", F.lit(-1.0)), 4).alias("entropy"), told.alias("told"))


@query(O.DECODED)
def sentence_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token that the exact interval of the rest of a sentence gives, at every place of the benchmark's sentences
    that the model of order 3 with an offset of 35 can say: the sentence's own."""
    base, lm = model(spark, sf_dir), offset_model(spark, sf_dir, 3)
    own = base.asked_ids(sentences(spark, sf_dir, "benchmark", "item_id"), ["item_id", "sent"])
    out = lm.next_tokens(stego.remaining(lm, own.select("item_id", "sent", "ids"), ["item_id", "sent"]))
    return base.words(out, "w", "word").select("item_id", "sent", "pos", F.coalesce("word", F.lit("")).alias("word"))


# -- letters, bits, codec -------------------------------------------------------------------------------------------


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' letters with ranges: a-z, blank and full stop. Characters are counted before they become letters."""
    own = ngrams.character_counts(documents(spark, sf_dir))
    own = own.select(F.explode(F.regexp_extract_all(F.lower(T.to_ascii(F.col("char"))), F.lit("[a-z .]"), F.lit(0))).alias("token"), "count")
    return counts.letter_ranges(own.groupBy("token").agg(F.sum("count").alias("count")), ["token"])


@query(O.with_letters("SELECT token, count, (sum(count) OVER (ORDER BY token) - count)::BIGINT AS cf1, (sum(count) OVER (ORDER BY token))::BIGINT AS cf2, round(count / (sum(count) OVER ()), 12) AS p FROM lc"))
def letter_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return letters(spark, sf_dir).withColumn("p", F.round("p", 12))


@query(
    O.with_letters("""
    SELECT doc_id, sum(n)::BIGINT AS n_letters, round(sum(-n * log2(count / (SELECT sum(count) FROM lc))), 3) AS bits FROM (SELECT doc_id, token, count(*) AS n FROM l GROUP BY ALL) JOIN lc USING (token) GROUP BY doc_id
    """)
)
def letter_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = letters(spark, sf_dir).select("token", "p")
    own = documents(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all(F.lower(T.to_ascii(F.col("text"))), F.lit("[a-z .]"), F.lit(0))).alias("token"))
    each = own.groupBy("doc_id", "token").agg(F.count("*").alias("n")).join(F.broadcast(model), "token")  # 28 letters at most
    return each.groupBy("doc_id").agg(F.sum("n").alias("n_letters"), F.round(F.sum(-F.col("n") * F.log2("p")), 3).alias("bits"))


def number_bits(c: str, n: int) -> Column:
    return F.transform(F.split(F.lpad(F.bin(F.col(c)), n, "0"), ""), lambda b: b.cast("tinyint"))


@query("SELECT doc_id, n_chars / 16777216.0::DOUBLE AS value FROM documents")
def bits_to_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", number_bits("n_chars", 24).alias("bits"))
    return own.select("doc_id", I.short_bits_value(F.col("bits")).alias("value"))


@query("""
    WITH b AS (SELECT doc_id, lpad(bin(doc_id), 24, '0') AS m, lpad(bin(n_chars), 20, '0') AS k FROM documents)
    SELECT doc_id, array_to_string(list_transform(range(1, 25), lambda i: CASE WHEN m[i] = k[(i - 1) % 20 + 1] THEN '0' ELSE '1' END), '') AS mixed FROM b
""")
def xor_cipher(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", number_bits("doc_id", 24).alias("m"), number_bits("n_chars", 20).alias("k"))
    return own.select("doc_id", F.array_join(I.xor_bits(F.col("m"), F.col("k")).cast("array<string>"), "").alias("mixed"))


def letter_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as letters."""
    text = F.regexp_extract_all(F.lower(T.to_ascii(F.col("text"))), F.lit("[a-z .]"), F.lit(0))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("tokens")).filter(F.size("tokens") > 0)


@query(
    O.with_letters("""
    , m AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(x), '[a-z .]')) AS token FROM (SELECT conv_id, turn, {x} AS x FROM conversations)), t AS (SELECT sum(count) AS n FROM lc)
    SELECT conv_id, turn, count(*) AS n_tokens, round(sum(-log2(count / n)), 6) AS entropy, true AS exact, true AS few_bits FROM m JOIN lc USING (token), t GROUP BY 1, 2
    """.replace("{x}", O.ascii_("text")))
)
def letter_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode each conversation turn under the documents' letters: whether its bits give it back, and whether
    they are no more than two over its entropy."""
    own = letter_messages(spark, sf_dir)
    out = codec.round_trips(own.repartition(spark.sparkContext.defaultParallelism), codec.letter_model(letters(spark, sf_dir)), ["conv_id", "turn"])
    return out.select("conv_id", "turn", "n_tokens", F.round("entropy", 6).alias("entropy"), "exact", (F.col("n_bits") <= F.ceil("entropy") + 2).alias("few_bits"))


def character_tables(spark: SparkSession, sf_dir: str, n_max: int) -> dict[int, DataFrame]:
    """Consistent counts of runs of characters (a-z, digits and marks, blank as `_`), within sentences; 70**n_max rows at most."""
    own = sentences(spark, sf_dir, normalise=False).select(characters(F.expr("slice(tokens, 2, size(tokens) - 2)")).alias("tokens"))
    return counts.consistent(counts.ngram_counts(own, n_max))


def characters(words: Column) -> Column:
    line = F.regexp_replace(F.lower(T.to_ascii(F.array_join(words, "_"))), "[^!-~]", "")
    return F.concat(F.array(F.lit(START)), F.filter(F.split(line, ""), lambda c: c != ""), F.array(F.lit(END)))


@query(
    rf"""WITH {O._asked('benchmark')}, l AS (SELECT item_id, sent, regexp_replace(lower({O.ascii_("array_to_string(tokens[2:len(tokens) - 1], '_')")}), '[^!-~]', '', 'g') AS s FROM raw_asked)
    SELECT item_id, sent::INT AS sent, length(s)::INT + 2 AS n_tokens, true AS revealed, true AS differs FROM l"""
)
def hide_and_reveal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hide each benchmark item's sentences in sentences of the documents' characters, under the item's id as the key, and reveal them."""
    own = sentences(spark, sf_dir, "benchmark", "item_id", normalise=False)
    own = own.select("item_id", "sent", characters(F.expr("slice(tokens, 2, size(tokens) - 2)")).alias("tokens"))
    key = characters(F.split(F.concat(F.lit("the key of item "), F.col("item_id").cast("string")), " "))
    asks = own.select("item_id", "sent", "tokens", key.alias("key")).repartition(spark.sparkContext.defaultParallelism)
    model = codec.backoff_model(character_tables(spark, sf_dir, 3))
    out = codec.hide_and_reveal(asks, model, ["item_id", "sent"]).join(own, ["item_id", "sent"])
    return out.select("item_id", "sent", F.size("tokens").alias("n_tokens"), "revealed", (F.col("stego") != F.array_join("tokens", " ")).alias("differs"))


# -- lines, files, streams ------------------------------------------------------------------------------------------


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.numbered_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


@query(
    O.with_lines("""
    SELECT doc_id % 100 AS file, sum(i)::BIGINT AS sum, min(i) AS min, max(i) AS max FROM
    (SELECT doc_id, TRY_CAST(regexp_extract(CASE WHEN line_no % 3 = 0 THEN line || ' ' || length(line) ELSE line END, '\\s([0-9]+)$', 1) AS BIGINT) AS i FROM lines) WHERE i IS NOT NULL GROUP BY ALL
    """)
)
def trailing_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("line_no") % 3 == 0, F.concat("line", F.lit(" "), F.length("line").cast("string"))).otherwise(F.col("line"))
    return L.trailing_integers(numbered(spark, sf_dir).select((F.col("doc_id") % 100).alias("file"), line.alias("line")), "file")


@query(O.with_lines("SELECT i AS row_id, doc_id, line_no::INT AS line_no FROM (SELECT *, row_number() OVER (ORDER BY doc_id, line_no) - 1 AS i FROM lines) WHERE i >= 5 AND (i - 5) % 7 = 0"))
def line_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.line_slice(numbered(spark, sf_dir).select("doc_id", "line_no"), ["doc_id", "line_no"], 5, None, 7).select("row_id", "doc_id", "line_no")


@query(
    O.with_lines("""
    , f AS (SELECT doc_id, min(line_no) AS a FROM lines WHERE regexp_matches(lower(line), '^[a-m]') GROUP BY doc_id),
    b AS (SELECT lines.* FROM lines JOIN f USING (doc_id) WHERE line_no > a),
    e AS (SELECT doc_id, min(line_no) AS z FROM b WHERE regexp_matches(lower(line), '^[n-z]') GROUP BY doc_id)
    SELECT doc_id, line_no::INT AS line_no, md5(line) AS line_md5 FROM b LEFT JOIN e USING (doc_id) WHERE z IS NULL OR line_no < z
    """)
)
def strip_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.strip_notices(numbered(spark, sf_dir), "doc_id", "^[a-m]", "^[n-z]").select("doc_id", "line_no", F.md5("line").alias("line_md5"))


@query("SELECT doc_id, source, round(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) / 1073741824.0, 12) AS total_gb FROM documents")
def running_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return L.running_size(own, "source", "doc_id", "n_chars").select("doc_id", "source", F.round("total_gb", 12).alias("total_gb"))


@query("SELECT event_id AS id, json_extract_string(props, '$.k') AS text FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def status_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = table(spark, sf_dir, "events")
    stream = status.read_stream(spark, f"{sf_dir}/events.parquet", batch.schema)
    return status.drained(status.with_text(stream, "event_id", "props", "k"))
