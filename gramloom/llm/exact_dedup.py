"""Exact deduplication by content-defined chunk recipes, in DataFrame operations only.

A text is cut where its own characters say so, so that equal passages give equal chunks wherever they stand.
Chunks are deduplicated to identifiers, each verified to stand for one content only, and a document becomes the
ordered list of its chunks' identifiers: its recipe. Documents are equal when their recipes are, so that after
the chunks have been verified no long text moves again.

* Shuffles: each distinct chunk's characters once (after a combine on the map side), then recipes only.
* A hot chunk is one row of a task after that combine, and a hot recipe is combined before its shuffle too. A group's result comes back to its documents by a join
  that broadcasts the few groups with over a thousandth of all rows, and shuffles the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramloom.llm._shared import fresh, given_back, text_of, written

#: Fewest and most characters of a chunk. Between them a chunk ends at the first place where CUT_RUN characters in
#: a row are marks: below U+0100 those whose code point has one of CUT_RESIDUES modulo 16, above it those of every
#: eighth block of 32. In prose a cut comes every few hundred characters, so that a chunk has about 600.
CHUNK_LEAST, CHUNK_MOST, CUT_RESIDUES, CUT_RUN = 256, 4096, (1, 4), 3
#: Chunks of a recipe that may be broadcast as the key of a hot group (some 40 bytes each).
LONG_RECIPE = 1000


def folded(column: Column) -> Column:
    """Lower case for A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut_pattern(least: int = CHUNK_LEAST, most: int = CHUNK_MOST, residues: tuple[int, ...] = CUT_RESIDUES, run: int = CUT_RUN) -> str:
    """A pattern whose matches, one after the other, are the chunks of a text: all of it, nothing twice."""
    latin = "".join(f"\\u{c:04x}" for c in range(32, 256) if c % 16 in residues)
    other = "".join(f"\\u{c:04x}-\\u{c + 31:04x}" for c in range(256, 0xD800, 256))
    return f"(?s).{{{least},{most - run}}}?(?:[{latin}]{{{run}}}|[\\u0100-\\ud7ff&&[{other}]]{{{run}}})|.{{1,{most}}}"


def chunks(text: Column) -> Column:
    """The text's chunks in order; the empty text has none."""
    return F.regexp_extract_all(text, F.lit(cut_pattern()), F.lit(0))


def _digest(column: Column) -> Column:
    return F.unhex(F.sha2(column, 256))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_row, doc_id, text_sha256 and recipe (the chunks' identifiers in order) of each row of docs.

    An identifier is the SHA-256 of its chunk. The chunk table, which holds each distinct content once, shows that
    no identifier has two contents; should one ever have, this stops instead of merging documents. As the check needs
    no row of the documents, no occurrence of a chunk is ever joined or shuffled. A very long text is a long recipe.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), folded(text_of(text_col)).alias("_text"))
    cut = base.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.sha2("_text", 256).alias("text_sha256"), chunks(F.col("_text")).alias("_chunks"))
    contents = cut.select(F.explode("_chunks").alias("chunk")).select(_digest(F.col("chunk")).alias("_ident"), "chunk").distinct()  # combined before the shuffle
    if contents.groupBy("_ident").agg(F.count("*").alias("_contents")).filter("_contents > 1").count():
        raise ValueError("two chunks share an identifier")
    return cut.select("_row", "doc_id", "text_sha256", F.transform("_chunks", _digest).alias("recipe"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty, and all empty texts are
    equal. The row with the largest id of a group stays (a null id only if the group has no other); of rows that
    repeat both id and text exactly one is kept. Other columns of docs are ignored. An empty table gives no rows.
    """
    rows = written(recipes(docs, id_col, text_col), "recipes")  # read twice: for the groups, and to tell each row its own
    groups = rows.groupBy("recipe").agg(
        F.max("doc_id").alias("keep_id"),
        F.count("*").alias("group_size"),
        F.coalesce(F.max_by("_row", "doc_id"), F.min("_row")).alias("_keep_row"),
    )
    shared = written(groups.filter("group_size > 1"), "groups")
    return given_back(rows, shared, ["recipe"], "group_size", F.size("recipe") <= LONG_RECIPE).select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("_row") == F.col("_keep_row"), F.lit(True)).alias("kept"),
        "text_sha256",
        F.size("recipe").alias("n_chunks"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that repeat an id and a text one stays at most."""
    named = lambda c: F.concat_ws("", F.col(c).isNull().cast("string"), F.col(c).cast("string"))  # no id is another one than "null"
    key = fresh(docs, "_id", "_sha")
    stay = exact_groups(docs, id_col, text_col).filter("kept").select(named("doc_id").alias(key[0]), F.col("text_sha256").alias(key[1]))
    own = docs.withColumn(key[0], named(id_col)).withColumn(key[1], F.sha2(folded(text_of(text_col)), 256))
    return own.join(stay, key, "left_semi").dropDuplicates(key).drop(*key)
