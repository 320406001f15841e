"""Baselines and reports ask for findings several times: documents are not gone through again for each."""

import pytest

from tidemark.plans import queries as Q

NAMES = ("baseline_suppress", "baseline_stale", "baseline_drift", "sink_json_lines", "sink_human_lines")


@pytest.mark.parametrize("name", NAMES)
def test_documents_are_gone_through_once(spark, tmp_path, name):
    spark.createDataFrame([(i, f"src{i % 3}", "a scum\nx\n" * (i % 20 + 1)) for i in range(40)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = Q.QUERIES[name](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and found.count() > 0  # no document is cut to lines again
