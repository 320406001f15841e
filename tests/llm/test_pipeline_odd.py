"""Stages and the whole pipeline on nulls, ties, repeated rows, empty tables and clashing columns."""

import pytest

import corpus_pipeline as pipeline
from tests.llm.test_quality import labelled

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def folder(spark, sentences, tmp_path):
    def make(rows, extra=False, item=None):
        docs = spark.createDataFrame([(d, t, "en", f"s{(d or 0) % 2}", len(t or "")) for d, t in rows], DOCS)
        if extra:
            docs = docs.selectExpr("*", *(f"'x' AS {c}" for c in ("_id", "_hash", "text_hash", "size", "taken", "score", "predicted", "sid", "comp", "line", "key", "h1", "pos")))
        docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        labels = [(i, q, 0) for i, q, _ in labelled(sentences)[1]]
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        spark.createDataFrame([(1, item or sentences(30, 31337))], "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return make


def through(spark, docs, folder, k):
    return pipeline.STAGES[k][1](spark, docs, folder)


def test_near_copies_of_ids_that_repeat(spark, sentences, folder):
    a, b, c = sentences(60, 1), sentences(60, 2), sentences(60, 3)
    rows = [(5, a), (5, b), (3, b), (None, c), (None, a + " x"), (7, c), (8, None), (9, ""), (9, ""), (10, sentences(60, 4)), (10, sentences(60, 4))]
    where = folder(rows, extra=True)
    got = sorted(((r["doc_id"], r["text"]) for r in through(spark, spark.read.parquet(f"{where}/documents.parquet"), where, 2).collect()), key=str)
    assert got == sorted([(None, a + " x"), (3, b), (None, c), (8, None), (9, ""), (9, ""), (10, rows[-1][1]), (10, rows[-1][1])], key=str)


def test_decontamination_of_ids_that_repeat(spark, sentences, folder):
    item = sentences(30, 5)
    rows = [(5, item), (5, "clean words here"), (None, f"x {item}"), (None, "clean words too"), (6, None), (7, "")]
    where = folder(rows, extra=True, item=item)
    got = sorted(((r["doc_id"], r["text"]) for r in through(spark, spark.read.parquet(f"{where}/documents.parquet"), where, 3).collect()), key=str)
    assert got == sorted([(5, "clean words here"), (None, "clean words too"), (6, None), (7, "")], key=str)


def test_mix_of_ids_that_repeat(spark, folder):
    rows = [(5, "one two three"), (5, "four"), (None, "five six"), (None, "seven"), (6, None), (7, ""), (8, "w " * 100_000)]
    where = folder(rows, extra=True)
    got = sorted(((r["doc_id"], r["text"], r["size"]) for r in through(spark, spark.read.parquet(f"{where}/documents.parquet"), where, 4).collect()), key=str)
    assert {(d, t, n) for d, t, n in got} <= {(d, t, len((t or "").split())) for d, t in rows} and all(n for _, _, n in got) and len(got) >= 3


def test_run_equals_its_stages_on_odd_rows(spark, sentences, folder):
    rows = [r for r in labelled(sentences)[0][:120]] + [(500, None), (501, ""), (None, sentences(40, 8)), (502, "w " * 50_000), (7, sentences(50, 9)), (7, sentences(50, 9))]
    where = folder(rows, extra=True)
    docs = spark.read.parquet(f"{where}/documents.parquet")
    for k in range(len(pipeline.STAGES)):
        docs = through(spark, docs, where, k)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    key = lambda r: (str(r["doc_id"]), r["text"], r["taken"])
    assert sorted(map(key, pipeline.run(spark, where).collect())) == sorted(map(key, docs.collect())) and docs.count() > 20


def test_empty_tables(spark, folder):
    where = folder([])
    got = pipeline.run(spark, where)
    assert got.collect() == [] and got.columns[:5] == list(pipeline.COLUMNS)
