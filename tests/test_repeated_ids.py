"""Queries by document equal their SQL where ids repeat, and where texts have no sentence."""

import duckdb
import pytest

from gramloom.plans import catalog, files

ROWS = [
    (1, "One here.  Two there.\nThree."),
    (1, "One here.  Two there.\nThree."),
    (1, "One here.  Two there.\nThree."),
    (2, "Only this"),
    (3, ""),
    (4, None),
    (5, " \n \n"),
    (6, "  Ends \n"),
    (None, "no id"),
    (None, "no id"),
]


@pytest.mark.parametrize("name", ["token_sentences", "tokens_to_text", "taken_tokens", "normalise_explode"])
@pytest.mark.parametrize("repeated", [True, False])
def test_repeated_ids(spark, tmp_path, name, repeated):
    assert files
    rows = ROWS if repeated else list(dict.fromkeys(ROWS))
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = catalog.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
