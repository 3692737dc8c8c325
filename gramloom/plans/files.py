"""Registered queries over files and exact numbers: each writes what the documents give, reads it back, and tells it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.functions import intervals as I
from gramloom.functions import text as T
from gramloom.operators import codec, counts, cumulative, ngrams, tagged
from gramloom.plans import catalog as C
from gramloom.plans import oracle as O
from gramloom.plans.catalog import query
from gramloom.schemas import ngram_file_name
from gramloom.sources import binary, lines, records
from gramloom.sources.store import saved, scratch, stage


def bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.order_counts(C.sentences(spark, sf_dir), 2)


# -- text files -----------------------------------------------------------------------------------------------------


@query(O.with_sentences(f"SELECT array_to_string(g, ' ') AS ngram, count(*) AS count FROM (SELECT {O.windows(2)} AS g FROM sentences) GROUP BY ALL"))
def ngram_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts written as lines and read again."""
    path = scratch(spark, "ngram-file")
    lines.write_ngrams(bigrams(spark, sf_dir), path)
    return C.told(lines.read_ngrams(spark, path, 2).filter("reject is null"))


@query(
    O.with_lines("""
    SELECT coalesce(reject, '') AS reject, count(*) AS rows FROM (
        SELECT CASE WHEN len(p) <> 3 THEN 'width' WHEN NOT regexp_full_match(p[3], '[0-9]+') THEN 'count' END AS reject
        FROM (SELECT string_split(replace(line, ' ', chr(9)), chr(9)) AS p FROM (SELECT CASE WHEN line_no % 5 = 0 THEN 'of the ' || length(line) WHEN line_no % 5 = 1 THEN 'of the x' ELSE line END AS line FROM lines))) GROUP BY 1
    """)
)
def malformed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' lines, of which every fifth is made an n-gram and the one behind it almost one, as an n-gram file."""
    path = scratch(spark, "lines")
    made = F.when(F.col("line_no") % 5 == 0, F.concat(F.lit("of the "), F.length("line"))).when(F.col("line_no") % 5 == 1, "of the x").otherwise(F.col("line"))
    C.numbered(spark, sf_dir).select(F.replace(made, F.lit(" "), F.lit("\t")).alias("value")).write.text(path)
    return lines.read_ngrams(spark, path, 2).groupBy(F.coalesce("reject", F.lit("")).alias("reject")).agg(F.count("*").alias("rows"))


@query(O.with_sentences(f", p AS (SELECT DISTINCT {O.prefix('t', 2)} AS prefix FROM (SELECT unnest(tokens) AS t FROM sentences)) SELECT n, prefix, 'corpus-' || n || 'gram-' || prefix AS file FROM p, (VALUES ('1'), ('2'), ('10')) AS v(n)"))
def prefix_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON object of the prefixes that each order has, written and read as a list of files."""
    own = C.sentences(spark, sf_dir).select(F.explode("tokens").alias("t")).select(T.token_prefix(F.col("t"), 2).alias("prefix")).distinct()
    listed = own.agg(F.array_sort(F.collect_set("prefix")).alias("p"))  # prefixes of two letters: some hundred
    path = scratch(spark, "descriptions")
    listed.select(F.to_json(F.create_map(*(x for n in ("1", "2", "10") for x in (F.lit(n), F.col("p")))))).coalesce(1).write.text(path)
    return lines.descriptions(spark, path).select("n", "prefix", ngram_file_name(F.col("n"), F.col("prefix")).alias("file"))


@query(O.with_vocab("SELECT token_id::INT AS token_id, token, part FROM vocab"))
def vocabulary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary dumped as lines, tokens of quotes and backslashes too, and read again."""
    path = scratch(spark, "vocabulary")
    lines.write_vocabulary(counts.vocabulary(counts.order_counts(C.sentences(spark, sf_dir), 1)), path)
    return lines.read_vocabulary(spark, path)


@query(O.with_ranges("SELECT w1, w2, cf1, cf2 FROM r2"))
def cumulative_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "cumulative")
    C.model(spark, sf_dir).ranges(2).write.option("sep", "\t").csv(path)
    return lines.read_cumulative(spark, path, 2)


@query(O.with_tagged("SELECT role AS pos1, w1, w2, p, c1, c2 FROM cum"))
def tagged_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged pairs written as lines of frequency, words and tags, and accumulated from there."""
    path = scratch(spark, "tagged")
    C.tagged_rows(spark, sf_dir).select("p", "w1", "w2", F.col("role").alias("pos1"), F.col("role").alias("pos2")).write.option("sep", "\t").option("quote", "").option("escapeQuotes", "false").csv(path)
    return tagged.cumulate(lines.read_tagged(spark, path, 2), ["pos1", "w1", "w2"], 2).drop("pos2")


@query(O.with_letters("SELECT token, count, (sum(count) OVER (ORDER BY token) - count)::BIGINT AS cf1, (sum(count) OVER (ORDER BY token))::BIGINT AS cf2, round(count / (sum(count) OVER ()), 12) AS p FROM lc"))
def letters_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letter counts as a file of lines, imported and accumulated."""
    path = scratch(spark, "letters")
    lines.write_ngrams(C.letters(spark, sf_dir).select(F.array("token").alias("ngram"), "count"), path)
    found = lines.read_ngrams(spark, path, 1).select(F.element_at("ngram", 1).alias("token"), "count")
    return counts.letter_ranges(found, ["token"]).withColumn("p", F.round("p", 12))


@query(O.LETTERS.replace("SELECT n, substr", "SELECT 'n=' || n AS folder, substr").replace("GROUP BY 1, 2", "GROUP BY n, 2"))
def letter_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letter n-grams in one folder for each n, most frequent first."""
    path = scratch(spark, "letter-ngrams")
    lines.write_histogram(ngrams.letter_ngrams(C.documents(spark, sf_dir), 3), path)
    return spark.read.parquet(path).select(F.concat(F.lit("n="), F.col("n")).alias("folder"), "gram", "count")


@query(O.with_ranges("SELECT part, min(cf1) AS lo, max(cf2) AS hi FROM r1 JOIN vocab ON token_id = w1 GROUP BY part"))
def ranges_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The partitions' ranges as one JSON object, written and read."""
    own = counts.order_counts(C.sentences(spark, sf_dir), 1).select(T.token_part(F.element_at("ngram", 1)).alias("part"), "count")
    path = scratch(spark, "ranges")
    lines.write_ranges_json(cumulative.partition_ranges(own), path)
    return lines.read_ranges_json(spark, path)


@query("SELECT source, sum(strlen(line) + 1)::BIGINT AS bytes FROM (SELECT coalesce(source, '') AS source, replace(text, chr(10), ' ') AS line FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def folder_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the files that each source's texts take, as the file system tells them."""
    path = scratch(spark, "sources")
    own = C.table(spark, sf_dir, "documents").filter("text is not null").select(F.hex(F.coalesce("source", F.lit(""))).alias("s"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("value"))
    own.write.partitionBy("s").text(path)
    found = lines.file_sizes(spark, f"{path}/*").withColumn("s", F.regexp_extract("path", "/s=([0-9A-F]*)/", 1))
    return found.groupBy(F.unhex("s").cast("string").alias("source")).agg(F.sum("length").alias("bytes"))


# -- binary tables and numbering ------------------------------------------------------------------------------------


@query(O.with_vocab(f", g AS (SELECT {O.windows(2)} AS g FROM sentences) SELECT a.token_id::INT AS w1, b.token_id::INT AS w2, count(*) AS count FROM g JOIN vocab a ON a.token = g[1] JOIN vocab b ON b.token = g[2] GROUP BY ALL"))
def binary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted counts of ids as fixed-width records, a blob for each range of ids, and their records read again."""
    found = counts.ngram_counts(C.sentences(spark, sf_dir), 2)
    ids = counts.id_table(counts.translate(found[2], saved(counts.vocabulary(found[1])), 2), 2)
    return binary.unpacked(saved(binary.packed(ids, 2, 16), "binary"), 2).select("w1", "w2", "count")


@query(O.with_vocab(f", g AS (SELECT {O.windows(2)} AS g FROM sentences) SELECT a.token_id::INT AS w1, b.token_id::INT AS w2, count(*) AS count FROM g JOIN vocab a ON a.token = g[1] JOIN vocab b ON b.token = g[2] WHERE a.token_id BETWEEN (SELECT count(*) // 3 FROM vocab) AND (SELECT 2 * count(*) // 3 FROM vocab) GROUP BY ALL"))
def record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted counts of ids written as files of records, and those of the vocabulary's middle third read by bisection."""
    found = counts.ngram_counts(C.sentences(spark, sf_dir), 2)
    vocab, path = saved(counts.vocabulary(found[1])), scratch(spark, "records")
    records.write_records(counts.id_table(counts.translate(found[2], vocab, 2), 2), path, 2, 16)
    size = vocab.count()
    return records.read_records(spark, path, 2, size // 3, 2 * size // 3, 1 << 20).select("w1", "w2", "count")


@query(
    O.with_vocab(f"""
    , g AS (SELECT {O.windows(2)} AS g FROM sentences), c AS (SELECT a.token_id AS w1, b.token_id AS w2, a.token AS t1, b.token AS t2, count(*) AS count FROM g JOIN vocab a ON a.token = g[1] JOIN vocab b ON b.token = g[2] GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (ORDER BY w1, w2) AS row_id FROM c)
    SELECT row_id, t1 || ' ' || t2 AS ngram, count FROM r WHERE row_id BETWEEN 11 AND 5000 AND (row_id - 11) % 13 = 0
    """)
)
def explore_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a table of ids by their number, with words."""
    found = counts.ngram_counts(C.sentences(spark, sf_dir), 2)
    vocab = saved(counts.vocabulary(found[1]))
    table = counts.numbered(counts.id_table(counts.translate(found[2], vocab, 2), 2), 2)
    return counts.explore(table, 2, 11, 5000, 13, vocab).select("row_id", F.concat_ws(" ", "w1_token", "w2_token").alias("ngram"), "count")


@query(O.with_vocab("SELECT item_id, sent::INT AS sent, pos::INT AS pos, t AS token, coalesce(token_id, -1)::INT AS token_id FROM (SELECT item_id, sent, unnest(tokens) AS t, generate_subscripts(tokens, 1) - 1 AS pos FROM asked) LEFT JOIN vocab ON token = t", "benchmark"))
def parsed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's tokens with their ids in the documents' vocabulary."""
    vocab = counts.vocabulary(counts.order_counts(C.sentences(spark, sf_dir), 1))
    return counts.parse_text(C.table(spark, sf_dir, "benchmark").select("item_id", "text"), vocab, "item_id").withColumn("token_id", F.coalesce("token_id", F.lit(-1)))


@query(
    O.with_vocab(f"""
    , g AS (SELECT {O.windows(2)} AS g FROM asked), c AS (SELECT g, count(*) AS n FROM g GROUP BY ALL)
    SELECT CASE WHEN length(g[1]) % 4 = 0 AND (SELECT {O.PART.replace('token', 'x')} FROM (SELECT g[1] AS x)) <> 'a' THEN 'bad_partition' WHEN a.token IS NULL OR b.token IS NULL THEN 'unindexed' ELSE '' END AS reject, count(*) AS n_rows, sum(n)::BIGINT AS total
    FROM c LEFT JOIN vocab a ON a.token = g[1] LEFT JOIN vocab b ON b.token = g[2] GROUP BY 1
    """, "conversations")
)
def misplaced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of conversations, of which those with a first word of 4, 8, ... letters are filed under `a`; accepted and
    rejected rows go to folders of their own."""
    vocab = saved(counts.vocabulary(counts.order_counts(C.sentences(spark, sf_dir), 1)))
    asked = counts.order_counts(C.sentences(spark, sf_dir, "conversations", "conv_id"), 2)
    first = F.element_at("ngram", 1)
    filed = F.when(F.length(first) % 4 == 0, "a").otherwise(T.token_part(first))
    path = scratch(spark, "rejects")
    lines.write_with_rejects(counts.translate(asked, vocab, 2, filed), path)
    return spark.read.parquet(path).groupBy(F.coalesce("reject", F.lit("")).alias("reject")).agg(F.count("*").alias("n_rows"), F.sum("count").alias("total"))


@query("SELECT doc_id, n_chars FROM documents")
def stage_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage that finds its finished table doesn't build it again."""
    path, built = scratch(spark, "stage"), []
    own = C.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    for _ in range(2):
        out = stage(spark, path, lambda: built.append(1) or own)
    if len(built) != 1:
        raise RuntimeError("a finished stage was built again")
    return out


@query(O.with_raw("SELECT doc_id, array_to_string(t[:5], ' ') AS first, array_to_string(t[-5:], ' ') AS last FROM (SELECT doc_id, flatten(list(tokens ORDER BY sent)) AS t FROM raw GROUP BY doc_id)"))
def taken_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = C.spoken(spark, sf_dir)
    return own.select("doc_id", F.array_join(T.take(F.col("t"), 5), " ").alias("first"), F.array_join(T.take(F.col("t"), -5), " ").alias("last"))


# -- exact numbers --------------------------------------------------------------------------------------------------


@query("""
    WITH x AS (SELECT doc_id, doc_id % 7 AS b, doc_id % 5 + 1 AS l, doc_id % 3 AS rb, n_chars % 4 + 1 AS rl FROM documents)
    SELECT doc_id, round(b / 16, 9) AS base, round(l / 16, 9) AS length, round(b / 16 + (rb / 8) * (l / 16), 9) AS part_base, round((l / 16) * (rl / 8), 9) AS part_length,
           true AS inside, round(rb / 8, 9) AS ratio_base, round(rl / 8, 9) AS ratio_length, round(b / 16, 9) AS around_base, round(l / 16, 9) AS around_length FROM x
""")
def interval_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals made, a part of each, whether it lies inside, what it is of the whole, and the whole from the part."""
    k = lambda c: F.col(c).cast("long")
    own = C.table(spark, sf_dir, "documents").select("doc_id", I.created(k("doc_id") % 7, k("doc_id") % 5 + 1, F.lit(16)).alias("i"), I.created(k("doc_id") % 3, k("n_chars") % 4 + 1, F.lit(8)).alias("r"))
    own = own.withColumn("s", I.selected(F.col("i"), F.col("r"))).withColumn("q", I.ratio(F.col("s"), F.col("i")))
    own = own.withColumn("u", I.around(F.col("s"), F.col("r"))).withColumn("inside", I.is_within(F.col("s"), F.col("i")))
    ends = lambda c, name: [F.round(I.number(F.col(c), x), 9).alias(f"{name}{y}") for x, y in (("b", "base"), ("l", "length"))]
    return own.select("doc_id", *ends("i", ""), *ends("s", "part_"), "inside", *ends("q", "ratio_"), *ends("u", "around_"))


def digits(bits: Column) -> Column:
    return F.array_join(bits.cast("array<string>"), "")


@query("""
    WITH b AS (SELECT doc_id, lpad(bin(doc_id), 24, '0') || lpad(bin(n_chars), 40, '0') AS bits FROM documents)
    SELECT doc_id, bits, bits AS around, bits AS inside, 64.0::DOUBLE AS entropy FROM b
""")
def bits_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 bits as an interval and back, both ways."""
    bits = F.concat(C.number_bits("doc_id", 24), C.number_bits("n_chars", 40))
    own = C.table(spark, sf_dir, "documents").select("doc_id", bits.alias("b")).withColumn("i", I.bits_interval(F.col("b")))
    return own.select("doc_id", digits(F.col("b")).alias("bits"), *(digits(I.interval_bits(F.col("i"), m)).alias(c) for m, c in (("super", "around"), ("sub", "inside"))), I.interval_entropy(F.col("i")).alias("entropy"))


@query("SELECT doc_id, bin(n_chars // 1024) || CASE WHEN n_chars % 1024 = 0 THEN '' ELSE '.' || rtrim(lpad(bin(n_chars % 1024), 10, '0'), '0') END AS digits FROM documents")
def binary_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "documents").select("doc_id", I.binary_digits(F.col("n_chars") / 1024.0).alias("digits"))


@query("SELECT doc_id, lpad(bin(('0x' || substr(sha256('key ' || doc_id || '/0'), 1, 8))::BIGINT), 32, '0') AS bits FROM documents")
def seeded_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32 bits that follow from each id."""
    return C.table(spark, sf_dir, "documents").select("doc_id", digits(I.bits_of_seed(F.concat(F.lit("key "), F.col("doc_id").cast("string")), 32)).alias("bits"))


@query(
    O.with_letters("""
    , m AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(x), '[a-z .]')) AS token FROM (SELECT conv_id, turn, {x} AS x FROM conversations)), t AS (SELECT sum(count) AS n FROM lc)
    SELECT conv_id, turn, count(*) AS n_letters, round(sum(-log2(count / n)), 6) AS entropy FROM m JOIN lc USING (token), t GROUP BY 1, 2
    """.replace("{x}", O.ascii_("text")))
)
def encoded_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation turn as one exact interval: letters joined with their ranges, folded in order."""
    model = saved(C.letters(spark, sf_dir), "letters")
    total = model.agg(F.max("cf2").alias("total"))
    own = codec.encode_independent(C.letter_messages(spark, sf_dir), model.crossJoin(F.broadcast(total)), ["conv_id", "turn"])  # one row
    sizes = C.letter_messages(spark, sf_dir).select("conv_id", "turn", F.size("tokens").cast("long").alias("n_letters"))
    return own.join(sizes, ["conv_id", "turn"]).select("conv_id", "turn", "n_letters", F.round(I.interval_entropy(F.col("interval")), 6).alias("entropy"))
