import pytest

import corpus_pipeline
from tests.llm.test_decontamination import brute as hits
from tests.llm.test_decontamination import split
from tests.llm.test_line_dedup import brute as kept_lines
from tests.llm.test_ngram_join import brute as near
from tests.llm.test_quality import labelled


@pytest.fixture(scope="module")
def tables(spark, sentences, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rows, labels = labelled(sentences)
    item = sentences(30, 31337)
    rows += [(500 + i, rows[1][1]) for i in range(3)] + [(600, rows[5][1].replace(" ", "  ") + " ende"), (700, sentences(20, 999) + " " + item), (701, None), (702, "")]
    rows += [(800 + i, sentences(70, 4000 + i) + "\nThis line stands in many of the documents here.") for i in range(5)]
    docs = spark.createDataFrame([(d, t, "en", f"s{d % 4}", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, labels, item


def test_each_stage_against_brute_force(spark, tables):
    folder, rows, labels, item = tables
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stage(spark, docs, folder)
        seen[name] = before, {r["doc_id"]: r for r in docs.collect()}
        if name != "mixing sources":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    texts = lambda x: {d: r["text"] for d, r in x.items()}
    before, after = map(texts, seen["quality classifier"])
    assert {d for d, q, _ in labels if q == 0} & set(after) == set() and set(before) - set(after) <= {d for d, q, _ in labels if q == 0} | {701, 702}
    before, after = map(texts, seen["line dedup"])
    want = kept_lines(list(before.items()), 20, 1)
    assert all(after[d] == want[d] for d in after if after[d] is not None)
    assert all(not any(len(x) >= 20 for x in want[d].split("\n")) for d in set(before) - set(after))
    before, after = map(texts, seen["n-gram Jaccard join"])
    assert set(after) == {c for _, _, c in near(list(before.items()))}
    before, after = map(texts, seen["benchmark decontamination"])
    assert set(after) == {d for d, t in before.items() if not hits(t, [(1, split(item))])[-1]} and 700 in before and 700 not in after
    before, after = seen["mixing sources"]
    assert all(0 < r["taken"] <= 3 * r["size"] for r in after.values())
    assert abs(sum(r["taken"] for r in after.values()) - sum(len((r["text"] or "").split()) for r in before.values())) <= 4


def test_run_equals_its_stages(spark, tables):
    folder = tables[0]
    got = sorted((r["doc_id"], r["taken"]) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == sorted((r["doc_id"], r["taken"]) for r in corpus_pipeline.run(spark, folder).collect()) and len(got) > 200
