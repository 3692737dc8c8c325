"""Files in and out, side outputs, stages that are skipped when done, streams."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from gramloom.operators import counts
from gramloom.sources import binary, lines, store
from gramloom.streaming import status


def test_ngram_lines(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("of\tthe\t7\nbad\tline\nno\tnumber\tx\n")
    with gzip.open(tmp_path / "b.gz", "wt") as f:
        f.write("to\tbe\t3\n")
    got = lines.read_ngrams(spark, str(tmp_path / "a.tsv"), 2)
    assert [tuple(r) for r in got.collect()] == [(["of", "the"], 7, None), (["bad", "line"], None, "width"), (["no", "number"], None, "count")]
    assert {tuple(r) for r in lines.reject_counts(got).collect()} == {("width", 1), ("count", 1)}
    got = lines.read_ngrams(spark, str(tmp_path / "b.gz"), 2)
    assert [(r["ngram"], r["count"]) for r in got.collect()] == [(["to", "be"], 3)]
    lines.write_ngrams(got, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == "to\tbe\t3"


def test_descriptions(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"2": ["b", "a"], "1": ["z"]}))
    assert [tuple(r) for r in lines.descriptions(spark, str(tmp_path / "d.json")).collect()] == [("1", "z"), ("2", "a"), ("2", "b")]


def test_raw_and_vocabulary(spark, tmp_path):
    (tmp_path / "r.tsv").write_text('of\t"the\t1990\t3\t2\n')
    assert tuple(lines.read_raw(spark, str(tmp_path / "r.tsv"), 2).first()) == ("of", '"the', 1990, 3, 2)
    (tmp_path / "v.tsv").write_text("1\t\\\t_\n2\t\"\t_\n")
    assert [tuple(r) for r in lines.read_vocabulary(spark, str(tmp_path / "v.tsv")).orderBy("token_id").collect()] == [(1, "\\", "_"), (2, '"', "_")]


def test_rejects_go_their_own_way(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "unindexed")], "w1 int, reject string")
    lines.write_with_rejects(df, str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out" / "rejected=false")).collect()] == [(1, None)]
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out" / "rejected=true")).collect()] == [(2, "unindexed")]
    assert [tuple(r) for r in lines.reject_counts(df).collect()] == [("unindexed", 1)]


def test_partitioned(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "n int, prefix string, count long")
    lines.write_partitioned(df, str(tmp_path / "p"), "n", "prefix")
    assert spark.read.parquet(str(tmp_path / "p")).filter("prefix = 'b'").first()["count"] == 6
    assert lines.file_sizes(spark, str(tmp_path / "p/n=1/*")).filter("length > 0").count() >= 1


def test_binary_records(spark, tmp_path):
    df = spark.createDataFrame([(2, 1, 5), (1, 9, 4), (1, 2, 2**40)], "w1 int, w2 int, count long")
    blobs = binary.packed(df, 2, 2).orderBy("part").collect()
    assert sum(r["rows"] for r in blobs) == 3 and all(len(r["content"]) == 16 * r["rows"] for r in blobs)
    (tmp_path / "t.bin").write_bytes(b"".join(bytes(r["content"]) for r in blobs))
    got = binary.read_counts(spark, str(tmp_path / "t.bin"), 2).orderBy("rid").collect()
    assert [tuple(r) for r in got] == [(1, 1, 2, 2**40), (2, 1, 9, 4), (3, 2, 1, 5)]


def test_stage_is_built_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert store.stage(spark, str(tmp_path / "s"), build).count() == 3
    assert len(built) == 1


def test_slices(spark):
    df = spark.createDataFrame([(i, f"l{i}") for i in range(20)], "line_no int, line string")
    got = [r["line_no"] for r in lines.line_slice(df, ["line_no"], 3, 15, 5).orderBy("line_no").collect()]
    assert got == [3, 8, 13]
    one = lines.numbered_lines(spark.createDataFrame([(1, "a\n\nb\n"), (2, None), (3, "")], "id int, text string"), "id", "text")
    assert [tuple(r) for r in one.orderBy("line_no").collect()] == [(1, 0, "a"), (1, 1, ""), (1, 2, "b")]


def test_stream(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "events"))
    for path in (str(tmp_path / "events"), f"{sf}/events.parquet"):
        got = status.drained(status.with_text(status.read_stream(spark, path, batch.schema, 1), "event_id", "props", "k"))
        assert got.count() == batch.filter(F.get_json_object("props", "$.k").isNotNull()).count()


def test_parse_and_explore(spark):
    vocab = spark.createDataFrame([(1, "_END_", "_"), (2, "_START_", "_"), (3, "hi", "h")], "token_id int, token string, part string")
    got = counts.parse_text(spark.createDataFrame([(1, "Hi you")], "id int, text string"), vocab, "id").orderBy("pos").collect()
    assert [(r["token"], r["token_id"]) for r in got] == [("_START_", 2), ("hi", 3), ("you", None), ("_END_", 1)]
    table = spark.createDataFrame([(3, 9), (1, 7), (2, 8)], "w1 int, count long")
    got = counts.explore(counts.numbered(table, 1), 1, 1, 3, 2, vocab).orderBy("row_id").collect()
    assert [(r["w1"], r["w1_token"]) for r in got] == [(1, "_END_"), (3, "hi")]


@pytest.mark.parametrize("order", [["n"], ["n", "k"]])
def test_row_numbers(spark, order):
    df = spark.createDataFrame([(i % 7, i) for i in range(50)], "n int, k int")
    got = [r["row_id"] for r in counts.row_ids(df, order).collect()]
    assert sorted(got) == list(range(1, 51))
