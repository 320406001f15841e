"""What files are like to read, ordered sinks, hooks of plug-ins, and settings that every rule checks."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import baseline as B
from tidemark.operators import scoring as S
from tidemark.plans import check as P
from tidemark.plans import config as K
from tidemark.plans import report
from tidemark.rules.base import FINDING, RULES, findings, rule
from tidemark.sources.facts import python_facts

SOURCE = '''# why this is so
import os  # noqa


def total(ab, rows, _q, __w):
    """Add up."""
    i = 0
    return sum(r.price for r in rows if r.ok if r.price > i)


class Shop:
    def names(self):
        """The names of all that is sold, in the order of the shelf."""
        return {k: [x.upper() for x in v] for k, v in self.kept.items() for _ in v} if self.kept else None
'''


def test_reading_of_a_file(spark):
    files = spark.createDataFrame([("a.py", SOURCE), ("b.py", ""), ("c.py", "def f(:\n")], "path string, content string")
    got = {r["path"]: r for r in S.reading(P.source(files).facts).collect()}
    a, b = got["a.py"], got["b.py"]
    assert set(got) == {"a.py", "b.py"}
    # lines of code: import, def, doc, i, return, class, def, doc, return, and one for the encoding
    assert a["effective_lines"] == 10 and a["comments_per_100_lines"] == 10.0
    assert a["short_names"] == ["_q", "ab", "r", "v"] and a["short_name_rate"] == round(4 / 14, 3)
    assert (a["docstring_coverage"], a["undocumented_definitions"], a["trivial_docstrings"]) == (0.667, 1, 1)
    assert (a["max_comprehension_load"], a["heavy_comprehensions"], a["max_expression_depth"]) == (4, 0, 6)
    assert (b["effective_lines"], b["short_name_rate"], b["max_comprehension_load"], b["max_expression_depth"]) == (1, 0.0, 0, 0)


def test_loads_of_comprehensions(spark):
    loads = {"[x for x in y]": 0, "[x for x in y if x if z]": 2, "[f(x) for x in y for z in x]": 2, "{k: (1 if v else g(k)) for k, v in z}": 2, "[[a for a in b] for b in c]": 1}
    for text, load in loads.items():
        assert max(python_facts("a.py", f"q = {text}\n")["reading"]["loads"]) == load
    files = spark.createDataFrame([(f"{i}.py", f"q = {text}\n") for i, text in enumerate(loads)], "path string, content string")
    r = S.comprehension_loads(P.source(files).facts, []).first()
    assert (r["comprehensions"], r["median"], r["most"]) == (6, 1.5, 2) and 1.9 < r["p90"] <= 2
    assert S.comprehension_loads(P.source(files).facts, ["path"]).count() == 5


def made(spark, rows):
    kind = "check string, severity string, file string, line int, rule string, code string, category string, message string, fix string, ord int"
    return spark.createDataFrame([(c, s, f, n, f"{k}: what", k, k.split("-")[0], m, 'say "why"', n) for c, s, f, n, k, m in rows], kind).select(*FINDING)


ROWS = [("b", "error", "x/b.py", 3, "A-001", "mé \\ \"q\""), ("b", "error", "x/b.py", 3, "A-001", "mé \\ \"q\""), ("b", "error", "x.py", 9, "A-001", "n"), ("b", "warning", "a.py", 1, "A-002", "w"), ("c", "warning", "a.py", 1, "A-003", "v\nv"), ("other", "error", "z.py", 1, "Z-001", "z")]


def test_lines_in_order_are_the_reports(spark):
    found, checks = made(spark, ROWS), spark.createDataFrame([("a",), ("b",), ("c",)], "check string")
    for passed in (False, True):
        whole = "".join(r["value"] + "\n\n" for r in report.human(found, checks, passed).collect())
        assert "".join(r["value"] + "\n" for r in report.in_order(report.human_lines(found, checks, passed)).collect()) == whole
    lines = [r["value"] for r in report.in_order(report.json_lines(found, checks)).collect()]
    documents = json.loads("[" + "\n".join(lines) + "]")
    plain = lambda ds: [{k: sorted(map(json.dumps, v)) if isinstance(v, list) else v for k, v in d.items()} for d in ds]
    assert plain(documents) == plain(sorted((json.loads(r["value"]) for r in P.as_json(found, checks).collect()), key=lambda d: d["check"]))
    assert [d["check"] for d in documents] == ["a", "b", "c"] and len(documents[1]["violations"]) == 3 and documents[0]["violations"] == []
    none = found.limit(0)
    assert json.loads("[" + "\n".join(r["value"] for r in report.in_order(report.json_lines(none, checks)).collect()) + "]")[2]["status"] == "PASS"
    assert report.in_order(report.json_lines(none, checks.limit(0))).collect() == []


def test_changes_of_a_baseline(spark):
    anchored = made(spark, ROWS).withColumn("anchor", F.concat(F.lit("sha:"), "message"))
    old = spark.createDataFrame([("x.py", "A-001", "sha:n", "error", 1), ("gone.py", "A-001", "sha:n", "error", 4)], "file string, code string, anchor string, severity string, count int")
    assert B.changes(anchored, old) == {"now": 5, "was": 2, "added": 4, "pruned": 1, "findings": 6}
    assert B.changes(anchored, old.limit(0)) == {"now": 5, "was": 0, "added": 5, "pruned": 0, "findings": 6}
    assert B.changes(anchored.limit(0), old) == {"now": 0, "was": 2, "added": 0, "pruned": 2, "findings": 0}


def test_only_lines_with_findings_are_hashed(spark):
    found = made(spark, [("b", "error", "./a.py", 2, "A-001", "m"), ("b", "error", "a.py", 1, "A-001", "m"), ("b", "error", "a.py", 3, "A-001", "m")])
    lines = spark.createDataFrame([("a.py", 1, "one"), ("a.py", 2, "  two "), ("a.py", 3, " \t"), ("a.py", 4, "four")], "path string, line int, text string")
    got = {r["line"]: r["anchor"] for r in B.anchored(found, lines).collect()}
    import hashlib

    assert got[2] == "sha:" + hashlib.sha256(b"two").hexdigest() and got[1].startswith("desc:") and got[1] == got[3]


def test_hooks_of_rules_complete_or_reject_settings(spark):
    def complete(settings):
        if settings.get("limit", 1) < 1:
            raise ValueError("limit has to be positive")
        return {"limit": 2} | dict(settings)

    @rule("HOOK-001", "hooked", "Has a hook", configure=complete)
    def hooked(src):
        return findings(src.files.filter(F.length("content") > src.of("hooked", "limit", 0)), "hooked", "HOOK-001: long", "error", 1, "m", "f")

    try:
        assert K.configured({})["hooked"] == {"limit": 2} and K.configured({"hooked": {"limit": 5}})["hooked"] == {"limit": 5}
        with pytest.raises(ValueError, match=r"\[hooked\] HOOK-001: limit has to be positive"):
            K.configured({"hooked": {"limit": 0}})
        files = spark.createDataFrame([("a", "xx"), ("b", "xxx")], "path string, content string")
        assert {r["file"] for r in P.find(P.source(files, K.configured({})), [RULES[("hooked", "HOOK-001")]]).collect()} == {"b"}
    finally:
        RULES.pop(("hooked", "HOOK-001"))


@pytest.mark.parametrize(("check", "key", "bad"), [("naming_scope", "max_short_length", "x"), ("naming_scope", "allow", 3), ("stray_artifacts", "patterns", "x"), ("stray_artifacts", "extensions", [1]), ("stray_artifacts", "exclude", {}), ("stray_artifacts", "assets", True)])
def test_every_setting_that_a_rule_reads_is_checked(check, key, bad):
    with pytest.raises(ValueError, match=rf"\[{check}\] {key} takes"):
        K.validated({check: {key: bad}})


def test_settings_that_rules_read_are_all_known():
    import inspect
    import re

    for (check, _), r in RULES.items():
        source = inspect.getsource(inspect.getmodule(r.build))
        for found, key in re.findall(r'src\.(?:of|limit)\("(\w+)", "(\w+)"', source):
            assert key == "enabled" or key in K.SETTINGS.get(found, {}), (found, key)
