"""Text to tokens and back, as column expressions: no Python runs per row."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from gramloom.schemas import END, POS_TAGS, START

#: Letters that become several ASCII ones.
SEVERAL = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th", "ĳ": "ij", "Ĳ": "IJ"}
#: Letters without a decomposition that become one.
SINGLE = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L", "ı": "i", "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "."}


@lru_cache(1)
def transliteration() -> tuple[str, str]:
    """Accented letters, and what each becomes: its base letter, by canonical decomposition."""
    pairs = dict(SINGLE)
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        base = unicodedata.normalize("NFKD", c)[0]
        if c not in SEVERAL and base.isascii() and base != c:
            pairs[c] = base
    return "".join(pairs), "".join(pairs.values())


def to_ascii(text: Column) -> Column:
    for c, more in SEVERAL.items():
        text = F.replace(text, F.lit(c), F.lit(more))
    return F.translate(text, *transliteration())


POS_PATTERN = "_(" + "|".join(t.replace(".", r"\.") for t in POS_TAGS) + ")_?$"


def pos_tagged(word: Column) -> Column:
    """Whether a word ends in a part-of-speech tag; sentence marks do not."""
    return word.rlike(POS_PATTERN)


def valid_ngram(ngram: Column) -> Column:
    """Whether no word of the array is tagged."""
    return ~F.exists(ngram, pos_tagged)


def numeric_token(token: Column) -> Column:
    return to_ascii(token).rlike("[0-9]")


TOKEN_PATTERN = r"[a-z0-9]+|[!-/:-@\[-`{-~]"


def normalised_text(text: Column) -> Column:
    """ASCII, lower case, and nothing but letters, digits and punctuation marks."""
    return F.regexp_replace(F.lower(to_ascii(text)), "[^!-~]", "")


def normalise_token(token: Column) -> Column:
    """The array of tokens that one becomes: split before and after each punctuation mark; sentence marks stay."""
    return F.when(token.isin(START, END), F.array(token)).otherwise(F.regexp_extract_all(normalised_text(token), F.lit(TOKEN_PATTERN), F.lit(0)))


def normalise_tokens(tokens: Column) -> Column:
    return F.flatten(F.transform(tokens, normalise_token))


def token_prefix(token: Column, n: int) -> Column:
    """The prefix that files of n-grams beginning with the token go by."""
    first, second = F.substring(token, 1, 1), F.substring(token, 2, 1)
    special = token.isin(START, END) | first.rlike(r"[!-/:-@\[-`{-~]")
    short = F.lit(n == 1) | first.rlike("[0-9]")
    return F.when(special, "other").when(short, first).when((F.length(token) < 2) | ~second.rlike("[a-z]"), F.concat(first, F.lit("_"))).otherwise(F.substring(token, 1, 2))


def token_part(token: Column) -> Column:
    """The vocabulary partition of a token."""
    first = F.substring(token, 1, 1)
    return F.when(first.rlike("[0-9a-z]") & ~token.isin(START, END), first).otherwise(F.lit("_"))


#: White space, as Unicode has it: what stands inside the brackets of a class of patterns. (Java's \\s is ASCII only.)
SPACE = r"\s\x1C-\x1F\x85\p{Z}"


#: The same characters, one by one.
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def sanitised(text: Column) -> Column:
    """Sentence marks that occur in the text as words are taken apart. Patterns run only over texts that hold a mark."""
    out = text
    for mark in (START, END):
        out = F.regexp_replace(out, rf"(?<![^{SPACE}]){mark}(?![^{SPACE}])", f"_ {mark.strip('_')} _")
    return F.when(F.contains(text, F.lit(START)) | F.contains(text, F.lit(END)), out).otherwise(text)


def sentences(text: Column) -> Column:
    """The text's sentences, which two or more white-space characters part; no empty ones."""
    return F.array_remove(F.split(F.trim(sanitised(text), F.lit(SPACES)), rf"[{SPACE}]{{2,}}"), "")


def sentence_tokens(sentence: Column) -> Column:
    """The words of a sentence between sentence marks."""
    return F.concat(F.array(F.lit(START)), F.array_remove(F.split(sentence, rf"[{SPACE}]+"), ""), F.array(F.lit(END)))


def normal_sentence_tokens(sentence: Column) -> Column:
    """normalise_tokens(sentence_tokens(sentence)), in one pass over the sentence: no token holds white space, so that the
    pattern finds the parts of all words at once. Sentences of ASCII alone need no transliteration."""
    plain = F.octet_length(sentence) == F.char_length(sentence)
    line = F.when(plain, F.lower(sentence)).otherwise(F.regexp_replace(F.lower(to_ascii(sentence)), rf"[^!-~{SPACE}]", ""))
    # what is left to drop of ASCII: control characters that are no white space
    line = F.regexp_replace(line, r"[\x00-\x08\x0E-\x1B\x7F]+", "")
    return F.concat(F.array(F.lit(START)), F.regexp_extract_all(line, F.lit(TOKEN_PATTERN), F.lit(0)), F.array(F.lit(END)))


def text_to_tokens(text: Column, normalise: bool = False) -> Column:
    """All tokens of a text; the empty text is one sentence without words."""
    empty = F.array(F.lit(START), F.lit(END))
    body = F.flatten(F.transform(sentences(text), normal_sentence_tokens if normalise else sentence_tokens))
    return F.when(text.rlike(rf"[^{SPACE}]"), body).otherwise(empty)


def tokens_to_text(tokens: Column) -> Column:
    """The tokens joined by spaces, two between sentences."""
    marked = F.transform(tokens, lambda t: F.when(t.isin(START, END), F.lit(" ")).otherwise(t))
    return F.regexp_replace(F.trim(F.array_join(marked, " ")), r"\s{2,}", "  ")


def take(array: Column, n: int) -> Column:
    """The first n elements, or the last -n; none for 0."""
    if n == 0:
        return F.slice(array, 1, 0)
    return F.slice(array, 1, n) if n > 0 else F.when(F.size(array) <= -n, array).otherwise(F.slice(array, n, -n))


def trailing_integer(line: Column) -> Column:
    """The integer at a line's end behind white space, else null."""
    return F.nullif(F.regexp_extract(line, r"\s([0-9]+)$", 1), F.lit("")).try_cast("bigint")
