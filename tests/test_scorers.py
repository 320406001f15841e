"""Scorers, label layouts and the audit."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import scoring
from tidemark.plans import queries as Q
from tidemark.plans import scorers
from tidemark.plans.corpora import CORPORA, EXPECTED, FOUND
from tidemark.sources import labels


@pytest.fixture(scope="module")
def corpora(spark):
    files = spark.createDataFrame([(c, x.path, x.source) for c, found in CORPORA.items() for x in found], "corpus string, path string, content string").persist()
    marks = spark.createDataFrame([(c, x.path, line, EXPECTED[m]) for c, found in CORPORA.items() for x in found for line, m in x.labels], "corpus string, file string, line int, expected boolean").persist()
    return files, marks


def test_every_scorer_counts_as_labelled(corpora):
    got = {r["corpus"]: r for r in scorers.score(*corpora).collect()}
    assert set(got) == set(CORPORA) == {s.corpus for s in scorers.SCORERS.values()} and len(got) == 8
    for corpus, found in CORPORA.items():
        marks = [m for x in found for _, m in x.labels]
        r = got[corpus]
        assert (r["tp"], r["fp"], r["fn"], r["tn"]) == tuple(marks.count(m) for m in "+!?-") and r["stale"] == 0 and r["labels"] == len(marks)
        assert r["rule"] == corpus.split(".")[1] and r["precision"] == r["tp"] / (r["tp"] + r["fp"]) and r["recall"] == r["tp"] / (r["tp"] + r["fn"])


def test_every_labelled_line_is_as_marked(corpora):
    files, _ = corpora
    for s in scorers.SCORERS.values():
        hits = {(r["file"], r["line"]) for r in s.hits(files).collect()}
        assert hits == {(x.path, line) for x in CORPORA[s.corpus] for line, m in x.labels if m in FOUND}, s.code


def test_stale_corpora_and_the_audit(spark, corpora, tmp_path):
    files, marks = corpora
    some = [scorers.SCORERS["SQL-001"], scorers.SCORERS["PROSE-004"], scorers.SCORERS["CMT-007"]]
    assert scorers.audit(files, marks, tmp_path / "a.json", {"version": "1"}, some, runs=2) == 0
    whole = json.loads((tmp_path / "a.json").read_text())
    assert whole["metadata"] == {"version": "1"} and [a["rule"] for a in whole["accuracy"]] == ["SQL-001", "PROSE-004", "CMT-007"]
    assert whole["performance"]["prose.PROSE-004"]["files"] == 6 and whole["performance"]["prose.PROSE-004"]["seconds"] > 0
    fewer = marks.filter(~((F.col("corpus") == "security_patterns.SQL-001") & F.col("expected"))).filter("corpus <> 'prose.PROSE-004'")
    assert scorers.audit(files, fewer, tmp_path / "b.json", {}, some, runs=0) == 1
    errors = {a["rule"]: a.get("error") for a in json.loads((tmp_path / "b.json").read_text())["accuracy"]}
    assert errors == {"SQL-001": "10 findings without a label", "PROSE-004": "no labels", "CMT-007": None}
    assert scorers.timings(files.limit(0), some[:1], 1) == {"security_patterns.SQL-001": {"skipped": "no files"}}


def test_no_label_and_no_finding(spark):
    none = spark.createDataFrame([], "corpus string, path string, content string")
    assert scorers.score(none, none.select("corpus", F.col("path").alias("file"), F.lit(0).alias("line"), F.lit(True).alias("expected"))).collect() == []


def write(path, value):
    path.write_text(json.dumps(value, indent=1))
    return str(path)


def test_layouts_of_labels(spark, tmp_path):
    lines = write(tmp_path / "a.json", {"_comment": "x", "p/a.py": [{"line": 3, "label": "secret", "note": "n"}, {"line": 9, "label": "ok"}], "p/b.py": []})
    flags = write(tmp_path / "b.json", {"_comment": "x", "p/a.py:12": True, "p/c:d.py:4": False, "p/e.py": True})
    verdicts = write(tmp_path / "c.json", {"a.md": {"should_fire": True}, "b.md": {"should_fire": False, "note": "y"}})
    key = lambda r: (r["file"], r["line"], r["expected"])
    read = lambda p: sorted(map(key, labels.read_labels(spark, p).collect()))
    assert read(lines) == [("p/a.py", 3, True), ("p/a.py", 9, False)]
    assert read(flags) == [("p/a.py", 12, True), ("p/c:d.py", 4, False), ("p/e.py", 0, True)]
    assert read(verdicts) == [("a.md", 0, True), ("b.md", 0, False)]
    mixed = write(tmp_path / "d.json", {"a.md": {"should_fire": True}, "b.py:1": False, "c.py": [{"line": 2, "label": "OK"}]})
    assert read(mixed) == [("a.md", 0, True), ("b.py", 1, False), ("c.py", 2, False)]
    files = spark.createDataFrame([("x/positives/a.py",), ("negatives/b.py",), ("x/other/c.py",), ("positives/negatives/d.py",)], "path string")
    assert sorted(map(key, labels.folder_labels(files).collect())) == [("negatives/b.py", 0, False), ("positives/negatives/d.py", 0, False), ("x/positives/a.py", 0, True)]


def test_events_and_their_rates(spark, tmp_path):
    events = write(tmp_path / "events.json", {"_comment": "c", "tasks": {"t1": {"premise": "p", "events": [{"id": "t1.a", "severity": "critical", "claim": "x"}, {"id": "t1.b", "severity": "minor", "claim": "y"}]}, "t2": {"events": [{"id": "t2.a", "severity": "critical", "claim": "z"}]}}})
    verdicts = write(tmp_path / "verdicts.json", {"_comment": "c", "t1.a": {"handled": True, "in_code": True, "in_report": False, "overclaim": True, "note": "n"}, "t2.a": {"handled": True}})
    rows = {r["id"]: r for r in labels.read_events(spark, events, verdicts).collect()}
    assert len(rows) == 3 and rows["t1.a"]["overclaim"] and not rows["t2.a"]["in_code"] and rows["t1.b"]["note"] == "" and rows["t2.a"]["task"] == "t2"
    rates = {r["severity"]: r for r in scoring.handled_rates(labels.read_events(spark, events, verdicts)).collect()}
    assert (rates["critical"]["events"], rates["critical"]["handled"], rates["critical"]["in_code"], rates["minor"]["handled"]) == (2, 1.0, 0.5, 0.0)


def test_files_of_a_small_table_are_made_by_many_tasks(spark, tmp_path):
    spark.range(1, 60).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    for table in Q.labelled_files(spark, str(tmp_path), CORPORA):
        tasks = table.groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert len(tasks) > 2
    assert Q.labelled_files(spark, str(tmp_path), CORPORA)[0].count() == 59 * len(CORPORA)
