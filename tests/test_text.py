"""Tokens, prefixes and explosion against worked examples."""

from pyspark.sql import functions as F

from gramloom.functions import text as T
from gramloom.operators import ngrams
from gramloom.sources import lines as L


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_pos_tags(spark):
    assert column(spark, ["eat_VERB", "_VERB_", "_START_", "U._X", "snake_case", "run_._"], T.pos_tagged) == [True, True, False, True, False, True]


def test_normalise(spark):
    got = column(spark, ["Don't", "U.S.", "--", "_x", "café", "_END_", "", "Straße", "…"], T.normalise_token)
    assert got == [["don", "'", "t"], ["u", ".", "s", "."], ["-", "-"], ["_", "x"], ["cafe"], ["_END_"], [], ["strasse"], ["."]]


def test_prefix(spark):
    assert column(spark, ["_START_", ",", "7up", "a", "x1", "the"], lambda c: T.token_prefix(c, 2)) == ["other", "other", "7", "a_", "x_", "th"]
    assert column(spark, ["the", "_END_"], lambda c: T.token_prefix(c, 1)) == ["t", "other"]


def test_sentences(spark):
    (got,) = column(spark, ["Hi there.  Bye _END_ x"], T.text_to_tokens)
    assert got == "_START_ Hi there. _END_ _START_ Bye _ END _ x _END_".split()
    assert column(spark, ["", "  "], T.text_to_tokens) == [["_START_", "_END_"]] * 2
    (back,) = column(spark, ["a  b c"], lambda c: T.tokens_to_text(T.text_to_tokens(c)))
    assert back == "a  b c"


def test_take(spark):
    for n, want in ((2, [1, 2]), (-2, [2, 3]), (0, []), (9, [1, 2, 3]), (-9, [1, 2, 3])):
        assert column(spark, [[1, 2, 3]], lambda c, n=n: T.take(c, n), "array<int>") == [want]


def grams(df):
    return sorted((" ".join(r["ngram"]), r["count"]) for r in df.collect())


def test_edge_explosion(spark):
    def run(ngram, n_max):
        return grams(ngrams.edge_explosion(spark.createDataFrame([(ngram, 5)], "ngram array<string>, count long"), n_max))

    assert run(["don't", "go"], 3) == [("' t go", 5), ("t go", 5)]
    assert run(["u.s.", "u.k."], 3) == [(". u", 5), (". u .", 5), ("s . u", 5)]
    assert run(["a-b", "!", "c"], 3) == [("b ! c", 5)]
    assert run(["…", "c"], 3) == [(". c", 5)]
    assert run(["€", "c"], 3) == []


def test_single_explosion(spark):
    got = grams(ngrams.single_explosion(spark.createDataFrame([(["don't"], 2)], "ngram array<string>, count long"), 2))
    assert got == sorted((x, 2) for x in ("don", "don '", "'", "' t", "t"))


def test_letter_ngrams(spark):
    got = {(r["n"], r["gram"]): r["count"] for r in ngrams.letter_ngrams(spark.createDataFrame([("ab a\n",)], "text string"), 3).collect()}
    assert got == {(1, "a"): 2, (1, "b"): 1, (1, " "): 2, (2, " a"): 2, (2, "ab"): 1, (2, "b "): 1, (2, "a "): 1, (3, " ab"): 1, (3, "ab "): 1, (3, " a "): 1}


def test_trailing_integers_and_notices(spark):
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(["a 3", "b 10", "none", "x7"])], "file string, line_no int, line string")
    assert L.trailing_integers(lines, "file").collect()[0][1:] == (13, 3, 10)
    book = ["x", "***START of the Project***", "body", "***END of the Project***", "y"]
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(book)], "file string, line_no int, line string")
    got = L.strip_notices(lines, "file", r"\*\*\*start", r"\*\*\*end").collect()
    assert [r["line"] for r in got] == ["body"]


def test_longest_partition(spark):
    df = spark.createDataFrame([(p,) for p in ("punctuation", "other", "aa", "q_", "1")], "prefix string")
    parts = ["other", "punctuation", "a", "q"]
    assert [r[0] for r in df.select(L.longest_partition(df, parts)).collect()] == ["punctuation", "other", "a", "q", None]


def test_white_space_is_that_of_unicode(spark):
    text = "foo\u00a0bar\u2003\u2003next\u3000one\x0b_END_\u2028 last"
    row = spark.createDataFrame([(text,)], "text string").select(T.text_to_tokens(F.col("text")).alias("raw"), T.text_to_tokens(F.col("text"), normalise=True).alias("normal")).first()
    want = [["foo", "bar"], ["next", "one", "_", "END", "_"], ["last"]]
    assert row.raw == [w for s in want for w in ("_START_", *s, "_END_")]
    assert row.normal == [w.lower() if w == "END" else w for s in want for w in ("_START_", *s, "_END_")]
