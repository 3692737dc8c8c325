"""Schemas and fixed values of n-gram tables; widths follow from the order n, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

START, END = "_START_", "_END_"
#: Partitions of the vocabulary, in their order; tokens of `_` begin with anything else.
PARTITIONS = "0123456789_abcdefghijklmnopqrstuvwxyz"
#: Part-of-speech tags.
POS_TAGS = ["NOUN", "VERB", "ADJ", "ADV", "PRON", "DET", "ADP", "NUM", "CONJ", "PRT", ".", "X"]
#: Fixed value: the word that tagged corpora put where a word is withheld.
PLACEHOLDER = "q!"


def word_columns(n: int) -> list[str]:
    return [f"w{i}" for i in range(1, n + 1)]


def raw_schema(n: int) -> StructType:
    """A raw yearly n-gram line: n tokens, year, match count, volume count."""
    return StructType([StructField(c, StringType()) for c in word_columns(n)] + [StructField("year", IntegerType()), StructField("match_count", LongType()), StructField("volume_count", LongType())])


def cumulative_schema(n: int) -> StructType:
    """Ids of n words with the half-open range [cf1, cf2) of their cumulative frequency."""
    return StructType([StructField(c, IntegerType()) for c in word_columns(n)] + [StructField("cf1", LongType()), StructField("cf2", LongType())])


def tagged_schema(n: int) -> StructType:
    """A tagged corpus row: frequency, n words, n parts of speech."""
    return StructType([StructField("p", LongType())] + [StructField(c, StringType()) for c in word_columns(n)] + [StructField(f"pos{i}", StringType()) for i in range(1, n + 1)])


def vocabulary_schema() -> StructType:
    return StructType([StructField("token_id", IntegerType()), StructField("token", StringType()), StructField("part", StringType())])


def ngram_file_name(n: Column, prefix: Column, corpus: str = "corpus") -> Column:
    """The name of the file that holds a prefix of an order."""
    return F.concat(F.lit(f"{corpus}-"), n.cast("string"), F.lit("gram-"), prefix)
