"""Queries over documents against their SQL on odd rows."""

import duckdb
import pytest

import __spark_entry__ as E

ROWS = [(1, "a", "One two two"), (2, "a", "-- 1 2 3"), (3, "a", "two"), (4, "a", ""), (5, "a", "5"), (5, "a", "one one two"), (5, "a", "two three"), (6, "a", "İstanbul kırmızı KK"), (7, "a", None), (8, "a", "istanbul"), (5, "b", "one"), (6, "b", "two three"), (9, None, "x"), (None, "b", "x")]


@pytest.mark.parametrize("name", ["weighted_jaccard_documents"])
def test_odd_documents_agree_with_the_sql(spark, tmp_path, name):
    spark.createDataFrame(ROWS, "doc_id long, source string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = E.queries()[name](spark, str(tmp_path)).collect()
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = db.execute(E.oracle_sql()[name]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 5
