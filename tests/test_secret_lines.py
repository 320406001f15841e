from tidemark.plans import queries as Q


def test_every_assignment_is_found(spark, tmp_path):
    a, b = "0123456789abcdef" * 2 + "01234567", "fedcba98" * 5
    text = f'intro token = "{a}" and\nthen token = "" or token = "{b}" end'
    spark.createDataFrame([(1, text, "s"), (2, "none", "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, Q.every_secret_finding(spark, str(tmp_path)).collect())) == [("s/1.py", 1), ("s/1.py", 3)]
