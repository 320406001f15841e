import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import quality


def labelled(sentences):
    rows, labels = [], []
    for i in range(400):
        text = sentences(30 + i % 60, i).capitalize() + "."
        junk = i % 4 == 0
        if junk:
            text = [text.upper().replace(" ", "!! "), text.replace(" ", " | "), " ".join(w for w in text.split() for _ in range(6))][i // 4 % 3]
        rows.append((i, text))
        labels.append((i, int(not junk), 0))
    return rows, labels


def test_held_out_accuracy(spark, docs, sentences):
    rows, labels = labelled(sentences)
    got = {r["doc_id"]: r for r in quality.classify(docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i in got) and len(held) > 50
    assert np.mean([got[i]["predicted"] == labels[i][1] for i in held]) > 0.95
    again = quality.classify(docs(rows[::-1]), spark.createDataFrame(labels[::-1], "doc_id long, quality int, toxic int")).collect()
    assert {r["doc_id"]: r["score"] for r in again} == {i: r["score"] for i, r in got.items()}


def test_labels_of_held_out_rows_teach_nothing(spark, docs, sentences):
    rows, labels = labelled(sentences)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    a, b = (quality.fit_quality(docs(rows), spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped))
    assert a == b and a.rules


def test_column_expression_equals_the_rules(spark, docs, sentences):
    rows, labels = labelled(sentences)
    model = quality.fit_quality(docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    stats = quality.with_statistics(docs(rows)).select("doc_id", *(F.col(f"_q_{n}").alias(n) for n in quality.STATISTICS)).collect()
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs(rows), model).collect()}
    for r in stats:
        total = model.intercept + sum(w for w, rule in model.rules if all((r[n] > limit) == above for n, above, limit in rule))
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-total))) < 1e-9


def test_odd_tables(spark, docs, sentences):
    rows, labels = labelled(sentences)
    schema = "doc_id long, quality int, toxic int"
    some = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0)], schema)
    got = quality.classify(docs([(1, None), (2, ""), (None, "a b"), (4, "w " * 100_000), (4, "w " * 100_000), *rows[10:]]), some).collect()
    assert len(got) == 395 and all(0 <= r["score"] <= 1 for r in got)
    none = spark.createDataFrame([], schema)
    assert [r["score"] for r in quality.classify(docs([(1, "x")]), none).collect()] == [0.5]
    assert quality.classify(docs([]), some).collect() == []
