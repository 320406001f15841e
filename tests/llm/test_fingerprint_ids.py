"""Ids of any kind: texts, none at all, many of the same."""

import hashlib

import pytest

from tidemark.llm.fingerprints import fingerprint_edits, with_next
from tidemark.llm.shared import Scratch


def edits(rows, order):
    """Sha-256 of every text with its last half replaced, by row, in the order of ids."""
    ids = sorted(rows, key=order)
    out = {}
    for (doc_id, text), (_, after) in zip(ids, ids[1:] + ids[:1], strict=True):
        moved = len(text) // 2
        out[doc_id] = hashlib.sha256((text[: len(text) - moved] + after[:moved]).encode()).hexdigest()
    return out


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_ids_that_are_texts(spark, sentences, monkeypatch, parts):
    names = ["", "a", "a-very-long-name-1", "a-very-long-name-2", "ä", "Z", "\U0001f600", "zz", "é"] + [f"id-{i * 37 % 101}" for i in range(101)]
    rows = [(n, sentences(3 + i % 9, i)) for i, n in enumerate(names)]
    monkeypatch.setattr("tidemark.llm.fingerprints.with_next.__defaults__", (len(rows) // parts,))
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprint_edits(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == edits(rows, lambda r: r[0].encode())


def test_rows_without_ids_are_spread(spark, sentences):
    rows = [(None, sentences(5, i)) for i in range(400)] + [(i, sentences(6, 1000 + i)) for i in range(50)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    parts = with_next(table, Scratch(spark, "test")).filter("own").groupBy("part").count().collect()
    assert len(parts) > 40 and max(r["count"] for r in parts if r["part"] < 0) < 30
    got = fingerprint_edits(table).collect()
    assert len(got) == 450 and {r["doc_id"]: r["edited_sha256"] for r in got if r["doc_id"] in range(49)} == {k: v for k, v in edits(rows[400:], lambda r: r[0]).items() if k < 49}


def test_all_rows_of_one_id(spark, sentences):
    rows = [(7, sentences(5, i)) for i in range(30)] + [(7, "same")] * 5
    assert len(fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == 35
