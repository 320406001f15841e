"""The command line on small trees: targets, configuration, regions, baselines, plug-ins, reports, exit codes."""

import json
import sys

import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.plans import check as P
from tidemark.plans import config as K
from tidemark.plans import report
from tidemark.rules.base import RULES, findings, rule
from tidemark.sources import tree as T

BAD = "def f(x):\n    return eval(x)\n"
WIDE = "class C:\n" + "".join(f"    def m{i}(self): pass\n" for i in range(11))


@pytest.fixture
def tree(tmp_path):
    def make(files):
        for name, text in files.items():
            path = tmp_path / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text, "utf-8")
        return tmp_path

    return make


def run(spark, capsys, *args):
    code = cli.main([str(a) for a in args], spark)
    said = capsys.readouterr()
    return code, said.out, said.err


def lines(out):
    return {(r["file"], r["code"], r["severity"]) for r in map(json.loads, out.splitlines())}


def test_formats_and_exit_codes(spark, capsys, tree):
    root = tree({"tidemark.toml": "", "bad.py": BAD, "ok.py": "x = 1\n"})
    code, out, _ = run(spark, capsys, "check", root, "--output-format", "ndjson", "--select", "EVAL")
    assert code == 1 and lines(out) == {("bad.py", "EVAL-001", "error")}
    code, out, _ = run(spark, capsys, "check", root, "--select", "EVAL")
    assert "[FAIL] security_calls\n  VIOLATION: bad.py:2 — " in out and "--- security_calls: 1 violations, 0 warnings ---" in out and "Summary: " in out and "[PASS]" not in out
    code, out, _ = run(spark, capsys, "check", root, "--select", "EVAL", "--output-format", "full")
    assert out.count("[PASS]") > 10 and "Summary" not in out
    code, out, _ = run(spark, capsys, "check", root, "--select", "EVAL", "--json")
    found = {x["check"]: x for x in json.loads(out)}
    assert found["security_calls"]["status"] == "FAIL" and found["security_calls"]["violations"][0]["line"] == 2 and found["prose"]["violations"] == []
    code, out, _ = run(spark, capsys, "check", root, "--ignore", "EVAL", "--check", "EVAL")
    assert code == 0 and out.startswith("All 1 checks passed.")


def test_command_line_wins_and_empty_lists_fall_through(spark, capsys, tree):
    root = tree({"tidemark.toml": 'ignore = ["EVAL"]\nexclude = ["b*"]\n', "a.py": BAD, "b.py": BAD})
    assert run(spark, capsys, "check", root, "--select", "EVAL")[0] == 0
    assert run(spark, capsys, "check", root, "--select", "EVAL", "--ignore", " , ")[0] == 0
    code, out, _ = run(spark, capsys, "check", root, "--select", "EVAL", "--ignore", "NONE-001", "--output-format", "ndjson")
    assert code == 1 and lines(out) == {("a.py", "EVAL-001", "error")}


def test_promotion(spark, capsys, tree):
    root = tree({"tidemark.toml": "", "w.py": WIDE})
    assert run(spark, capsys, "check", root, "--check", "SIZE-003")[0] == 0
    code, out, _ = run(spark, capsys, "check", root, "--check", "SIZE-003", "--promote", "all")
    assert code == 1 and "file_limits: 1 violations, 0 warnings" in out


def test_targets(spark, capsys, tree):
    root = tree({"tidemark.toml": "", "a/x.py": BAD, "a/y.py": BAD, "b/z.py": BAD})
    out = run(spark, capsys, "check", root / "a/x.py", root / "b", "--select", "EVAL", "--output-format", "ndjson")[1]
    assert {f for f, _, _ in lines(out)} == {"a/x.py", "b/z.py"}
    out = run(spark, capsys, "check", root / "a", "--select", "EVAL", "--output-format", "ndjson")[1]
    assert {f for f, _, _ in lines(out)} == {"a/x.py", "a/y.py"}
    code, _, err = run(spark, capsys, "check", root / "none")
    assert code == 2 and "does not exist" in err


def test_wrong_use(spark, capsys, tree):
    root = tree({"tidemark.toml": "[file_limits]\nfile_warn = 'many'\n", "a.py": BAD})
    code, _, err = run(spark, capsys, "check", root)
    assert code == 2 and "[file_limits] file_warn takes a number" in err
    (root / "tidemark.toml").write_text("select = 'TYPE'\n")
    assert run(spark, capsys, "check", root)[0] == 2
    (root / "tidemark.toml").write_text("extends = ['none']\n")
    assert "no profile 'none'" in run(spark, capsys, "check", root)[2]
    (root / "tidemark.toml").write_text("= broken")
    assert run(spark, capsys, "check", root)[0] == 2
    (root / "tidemark.toml").write_text("plugins = ['no_such_module_here']\n")
    assert "no plug-in" in run(spark, capsys, "check", root)[2]
    (root / "tidemark.toml").write_text("baseline = 'none.json'\n")
    assert "baseline" in run(spark, capsys, "check", root)[2]
    assert run(spark, capsys, "check", "--output-format", "x")[0] == 2 and run(spark, capsys, "nothing")[0] == 2
    assert run(spark, capsys, "check", root, "--check", "NOPE-1", "--no-baseline")[0] == 2


def test_regions(spark, capsys, tree):
    root = tree({"tidemark.toml": "[file_limits]\nclass_method_warn = 20\n", "a.py": WIDE, "sub/tidemark.toml": "[file_limits]\nclass_method_warn = 10\n", "sub/b.py": WIDE, "sub/deep/c.py": WIDE, "other/.tidemark.toml": "root = true\n", "other/d.py": WIDE})
    out = run(spark, capsys, "check", root, "--output-format", "ndjson", "--select", "SIZE-003")[1]
    assert {f for f, _, _ in lines(out)} == {"sub/b.py", "sub/deep/c.py", "other/d.py"}


def test_baseline(spark, capsys, tree):
    root = tree({"tidemark.toml": "select = ['EVAL']\n", "a.py": BAD})
    code, out, _ = run(spark, capsys, "baseline", "write", root)
    assert code == 0 and "Wrote 1 baseline entries (1 findings): +1 new, -0 pruned (was 0)." in out
    (root / "tidemark.toml").write_text("select = ['EVAL']\nbaseline = 'tidemark-baseline.json'\n")
    assert run(spark, capsys, "check", root)[0] == 0 and run(spark, capsys, "check", root, "--no-baseline")[0] == 1
    assert "Baseline is current: all 1 entries" in run(spark, capsys, "baseline", "status", root)[1]
    (root / "a.py").write_text("x = 1\n\n" + BAD)  # moved, but the line is the same
    assert run(spark, capsys, "check", root)[0] == 0
    (root / "a.py").write_text(BAD.replace("eval(x)", "eval(x) + 1"))  # the line is another one
    code, out, _ = run(spark, capsys, "check", root)
    assert code == 1 and "Note: 1 finding above has a baseline entry that matches no longer:\n  a.py  EVAL-001" in out
    assert "a.py  EVAL-001" in run(spark, capsys, "baseline", "status", root)[1]
    assert run(spark, capsys, "baseline", "write", root / "a.py")[0] == 2


def test_show_config_rules_and_rule(spark, capsys, tree):
    root = tree({"tidemark.toml": "ignore = ['CMT']\n[prose]\nspellings = {a = 'b'}\n"})
    code, out, _ = run(spark, capsys, "check", root, "--show-config")
    assert code == 0 and "tidemark.toml" in out and "ignore = ['CMT']" in out and "prose              enabled=False spellings={'a': 'b'}   (opt-in, not enabled)" in out
    code, out, _ = run(spark, capsys, "rules")
    assert code == 0 and "## comments" in out and "  CMT-001: " in out and "(opt-in)" in out
    code, out, _ = run(spark, capsys, "rule", "cmt-001")
    assert code == 0 and out.startswith("### CMT-001: ") and "CMT-002" not in out
    assert run(spark, capsys, "rule", "NOPE-999")[0] == 2


def test_plug_ins(spark, capsys, tree, monkeypatch):
    root = tree({"src/tidemark.toml": "plugins = ['own_rules_of_test']\n", "src/a.py": "x = 1\n", "own_rules_of_test.py": "from pyspark.sql import functions as F\nfrom tidemark.rules.base import findings, rule\n@rule('OWN-001', 'own', 'Files are seen')\ndef seen(src):\n    return findings(src.files, 'own', 'OWN-001: seen', 'error', 1, F.lit('seen'), 'none')\n"})
    monkeypatch.syspath_prepend(str(root))
    try:
        code, out, _ = run(spark, capsys, "check", root / "src", "--select", "OWN", "--output-format", "ndjson")
        assert code == 1 and {("a.py", "OWN-001", "error"), ("tidemark.toml", "OWN-001", "error")} == lines(out)
    finally:
        RULES.pop(("own", "OWN-001"), None)
        sys.modules.pop("own_rules_of_test", None)


def test_generated_documents(spark, capsys, tmp_path):
    assert run(spark, capsys, "docs", "check", tmp_path)[0] == 1
    assert run(spark, capsys, "docs", "write", tmp_path)[0] == 0 and run(spark, capsys, "docs", "check", tmp_path)[0] == 0
    assert json.loads((tmp_path / "config.schema.json").read_text())["properties"]["file_limits"]["properties"]["file_warn"] == {"type": "number"}
    (tmp_path / "RULES.md").write_text("old")
    code, out, _ = run(spark, capsys, "docs", "check", tmp_path)
    assert code == 1 and "RULES.md is stale" in out


def test_every_setting_that_a_case_uses_is_known():
    from tidemark.plans.cases import CASES

    for key, (settings, _) in CASES.items():
        check = key.partition(".")[0]
        assert set(settings) - {"enabled"} <= set(K.SETTINGS.get(check, {})), key
        assert K.validated({check: settings})


def test_source_root_reaches_the_layout_checks():
    got = K.with_source_root({"source_root": "src", "port_coverage": {"source_root": "own"}})
    assert got["layer_deps"] == {"source_root": "src"} and got["port_coverage"] == {"source_root": "own"} and "file_limits" not in got


def test_meta(spark):
    src = P.source(spark.createDataFrame([("a.py", BAD)], "path string, content string"))

    @rule("ODD-001", "odd", " ")
    def odd(src):
        return findings(src.files, "elsewhere", "ODD-001: odd", "warning", 1, F.lit(" "), "fix")

    try:
        own = [r for k, r in RULES.items() if k[0] in ("odd", "security_calls")]
        got = P.with_meta(P.find(src, own), own)
        assert {(r["code"], r["file"]) for r in got.filter("check = 'meta'").collect()} == {("META-002", "odd"), ("META-004", "a.py"), ("META-005", "a.py")}
        assert got.filter("code = 'EVAL-001'").count() == 1
    finally:
        RULES.pop(("odd", "ODD-001"))


def test_rules_that_fail_while_they_run(spark, tmp_path):
    src = P.source(spark.createDataFrame([("a.py", BAD)], "path string, content string"))

    @rule("RUN-001", "runs", "Fails late")
    def late(src):
        return findings(src.files, "runs", "RUN-001: late", "error", 1, F.raise_error(F.lit("late")).cast("string"), "fix")

    try:
        rules = [RULES[("runs", "RUN-001")], RULES[("security_calls", "EVAL-001")]]
        got = {(r["code"], r["file"], r["severity"]) for r in P.isolated(src, rules, str(tmp_path)).collect()}
        assert got == {("RUN-000", "", "warning"), ("EVAL-001", "a.py", "error")}
    finally:
        RULES.pop(("runs", "RUN-001"))


def test_folded_paths(spark):
    from tidemark.functions import text as X

    rows = {"a/../b": "b", "./a//b/.": "a/b", "../a": "../a", "a/../../b": "../b", "": "", "a/b/../../c/": "c"}
    got = spark.createDataFrame([(p,) for p in rows], "p string").select("p", X.folded_path(F.col("p")).alias("f")).collect()
    assert {r["p"]: r["f"] for r in got} == rows


def test_links_of_skills_are_resolved(spark):
    files = [("a/s/SKILL.md", "---\nname: s\n---\n[x](../other/SKILL.md)\n[y](../../none.md)\n[z](./ref/../ref/r.md)\n[u](../../../up)\n"), ("a/other/SKILL.md", "---\nname: other\n---\n"), ("a/s/ref/r.md", "x")]
    src = P.source(spark.createDataFrame(files, "path string, content string"))
    assert sorted(r["line"] for r in P.find(src, [RULES[("skills", "SKILL-005")]]).collect()) == [5, 7]


def test_bundled_profiles(spark, capsys, tree):
    root = tree({"tidemark.toml": "extends = ['layered']\n", "business/a.py": "import presentation.x\nimport persistence.y\n"})
    code, out, _ = run(spark, capsys, "check", root, "--select", "LAYER", "--output-format", "ndjson")
    assert code == 1 and len(lines(out)) == 1
    assert T.extended({"extends": ["strict", "clean"], "promote": ["TYPE"]})["promote"] == ["TYPE"]
    assert "### LAYER" in report.rule_reference()
