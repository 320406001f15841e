"""The driver's contract: names, columns and that the rest stands without the corpus subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parents[1]


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert [r["check"] for r in rows] and {r["status"] for r in rows} <= {"PASS", "WARN", "FAIL"}


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_corpus_subpackage(tmp_path):
    shutil.copytree(REPO / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert int(out.stdout.split()[0]) > 90 and out.stdout.split()[1] == "False"
