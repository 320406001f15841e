"""The chain, the baseline, regions, scores, sources and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import baseline as B
from tidemark.operators import chain as C
from tidemark.operators import scoring as S
from tidemark.plans import check as P
from tidemark.rules.base import FINDING
from tidemark.sources import tree as T

SCHEMA = "check string, severity string, file string, line int, rule string, code string, category string, message string, fix string, ord int"


def found(spark, rows):
    """rows: file, line, code, severity"""
    return spark.createDataFrame([(c.split("-")[0].lower(), s, f, n, f"{c}: text of {c}", c, c.split("-")[0], f"m{n}", "fix", n) for f, n, c, s in rows], SCHEMA)


ROWS = [("a/x.py", 1, "TYPE-001", "error"), ("a/x.py", 2, "TYPE-002", "warning"), ("b/y.py", 3, "SQL-001", "error"), ("b/y.py", 4, "SQL-000", "warning"), ("", 0, "RUN-000", "warning")]
keys = lambda df: sorted((r["file"], r["line"], r["code"]) for r in df.collect())


def test_select_and_ignore(spark):
    df = found(spark, ROWS)
    assert keys(C.select_ignore(df, ["type"], ["TYPE-002"])) == [("a/x.py", 1, "TYPE-001")]
    assert len(keys(C.select_ignore(df, ["", " "], []))) == 5 and keys(C.select_ignore(df, [], ["all"])) == []


def test_excludes_and_targets(spark):
    df = found(spark, ROWS)
    assert keys(C.exclude(df, ["a*.py", "zz"])) == [("", 0, "RUN-000"), ("b/y.py", 3, "SQL-001"), ("b/y.py", 4, "SQL-000")]
    assert keys(C.per_file_ignores(df, {"b/*": ["SQL"], "a/*": ["TYPE-002"]})) == [("", 0, "RUN-000"), ("a/x.py", 1, "TYPE-001")]
    targets = lambda *t: spark.createDataFrame([(x,) for x in t], "target string")
    assert keys(C.keep_targets(df, targets("b", "a/x"))) == [("b/y.py", 3, "SQL-001"), ("b/y.py", 4, "SQL-000")]
    assert len(keys(C.keep_targets(df, targets("")))) == 5 and len(keys(C.keep_targets(df, None))) == 5
    assert keys(C.reanchor(df, "src/"))[0] == ("", 0, "RUN-000") and keys(C.reanchor(df, "src"))[1][0] == "src/a/x.py"


@pytest.mark.parametrize(
    ("line", "codes"),
    [("x  # noqa", set()), ("x  # NOQA: type-001, E501", {"SQL-001", "SUPPRESS-001"}), ("x # tidemark: ignore[SQL]", {"TYPE-001", "SUPPRESS-001"}), ("x # tidemark: ignore", set()), ("'# noqa: ALL'", set()), ("# noqa: A # noqa: SQL-001", {"TYPE-001", "SQL-001", "SUPPRESS-001"}), ("x", {"TYPE-001", "SQL-001", "SUPPRESS-001"})],
)
def test_inline_ignores(spark, line, codes):
    df = found(spark, [("f", 1, c, "error") for c in ("TYPE-001", "SQL-001", "SUPPRESS-001")])
    lines = spark.createDataFrame([("f", 1, line)], "path string, line int, text string")
    assert {r["code"] for r in C.inline_ignores(df, lines).collect()} == codes | {"SUPPRESS-001"}


def test_promotion_spares_notices(spark):
    got = {(r["code"]): r["severity"] for r in C.promote(found(spark, ROWS), ["all"]).collect()}
    assert got == {"TYPE-001": "error", "TYPE-002": "error", "SQL-001": "error", "SQL-000": "warning", "RUN-000": "warning"}


def test_rollup_and_summary(spark):
    checks = spark.createDataFrame([("type",), ("sql",), ("quiet",), ("run",)], "check string")
    got = C.rollup(found(spark, ROWS), checks)
    assert sorted(tuple(r) for r in got.collect()) == [("quiet", "PASS", 0, 0), ("run", "WARN", 0, 1), ("sql", "FAIL", 1, 1), ("type", "FAIL", 1, 1)]
    assert tuple(C.summary(got).first()) == (1, 1, 2) and P.exit_code(got) == 1


def test_nearest_region(spark):
    files = spark.createDataFrame([(p,) for p in ("a/b/c.py", "a/x.py", "z.py", "ab/c.py")], "path string")
    regions = spark.createDataFrame([("",), ("a",), ("a/b",)], "directory string")
    assert {r["path"]: r["region"] for r in C.nearest_regions(files, regions).collect()} == {"a/b/c.py": "a/b", "a/x.py": "a", "z.py": "", "ab/c.py": ""}


def test_baseline_round_trip(spark, tmp_path):
    text = [("f", 2, "bad line"), ("f", 3, "bad line"), ("f", 50, "bad line"), ("f", 4, "  ")]
    lines = spark.createDataFrame(text, "path string, line int, text string")
    df = B.anchored(found(spark, [("f", 2, "A-001", "error"), ("./f", 3, "A-001", "warning"), ("f", 4, "B-001", "warning"), ("f", 1, "C-001", "error")]), lines)
    assert {r["anchor"][:5] for r in df.collect()} == {"sha:" + X_sha("bad line")[0], "desc:"}
    B.write(df, one := str(tmp_path / "one.json"))
    B.write(df.repartition(3), two := str(tmp_path / "two.json"))
    assert open(one).read() == open(two).read() and json.load(open(one))["version"] == 1
    base = B.load(spark, one)
    assert {(r["code"], r["severity"], r["count"]) for r in base.collect()} == {("A-001", "error", 2), ("B-001", "warning", 1), ("C-001", "error", 1)}
    assert B.suppress(df, base).isEmpty() and B.stale(df, base).isEmpty() and B.added(df, base).isEmpty()
    moved = B.anchored(found(spark, [("f", 50, "A-001", "error"), ("f", 3, "A-001", "error"), ("f", 2, "A-001", "error"), ("f", 50, "B-001", "warning")]), lines)
    left = B.suppress(moved, base).collect()
    assert sorted((r["code"], r["line"]) for r in left) == [("A-001", 50), ("B-001", 50)]
    assert [tuple(r) for r in B.drift(moved, base).collect()] == [("f", "B-001")]
    assert {r["code"] for r in B.stale(moved, base).collect()} == {"B-001", "C-001"}
    (tmp_path / "bad.json").write_text('{"version": 2, "entries": []}')
    with pytest.raises(ValueError):
        B.load(spark, str(tmp_path / "bad.json"))


def X_sha(text):
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


def test_an_error_needs_an_error_entry(spark):
    lines = spark.createDataFrame([("f", 2, "x"), ("f", 3, "x")], "path string, line int, text string")
    known = B.folded(spark.createDataFrame([("f", "A-001", "sha:" + X_sha("x"), "warning", "m", 1)], B.ENTRY))
    df = B.anchored(found(spark, [("f", 2, "A-001", "error"), ("f", 3, "A-001", "warning")]), lines)
    assert [(r["line"], r["severity"]) for r in B.suppress(df, known).collect()] == [(2, "error")]


def test_globs_span_slashes_and_end_at_the_end(spark):
    df = spark.createDataFrame([("a/x/b.py",), ("a/x/b.py\n",), ("a/b.pyc",), ("a/[b].py",)], "s string")
    hit = lambda g: [r["s"] for r in df.filter(X.matches_any(F.col("s"), [g])).collect()]
    assert hit("a/*.py") == ["a/x/b.py", "a/[b].py"] and hit("a/[[]b].py") == ["a/[b].py"] and hit("?/?.py?") == ["a/b.pyc"]


def test_scalar_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(X.split_lines(F.lit("a\r\nb\u2028c\n"))) == ["a", "b", "c"] and one(X.split_lines(F.lit("a\n\n"))) == ["a", ""]
    assert one(X.code_of(F.lit(" SQL-001 x: y: z"))) == "SQL-001" and one(X.described(F.lit("SQL-001: y: z"))) == "y: z" and one(X.described(F.lit("SHELL-001"))) == "SHELL-001"
    assert one(X.category_of(F.lit("LAYER"))) == "LAYER" and one(X.norm_path(F.lit(".\\a\\b"))) == "a/b"
    assert one(X.github_escape(F.lit("a%\r\nb"))) == "a%25%0D%0Ab" and one(X.without_code(F.lit("a ``b ` c`` d `e`"))) == "a   d  "
    assert one(X.word_count(F.lit("é naïve color"))) == 3 and one(F.size(X.sentences(F.lit("A b. C!  D?")))) == 3
    assert one(X.identifier_parts(F.lit("parseHTTPBody_v2"))) == ["parse", "http", "body", "v", "2"]
    assert [one(X.stem(F.lit(w))) for w in ("loading", "sing", "stories", "classes", "bus")] == ["load", "sing", "stor", "class", "bus"]
    m = lambda **k: F.create_map(*(F.lit(x) for kv in k.items() for x in kv))
    none = F.create_map().cast("map<string,int>")
    assert one(X.weighted_jaccard(m(a=2, b=1), m(a=1, c=1))) == 0.25 and one(X.weighted_jaccard(none, none)) == 1.0
    assert one(X.weighted_jaccard(m(a=1), none)) == 0.0 and one(X.weighted_jaccard(m(a=1), none, True)) == 1.0


def test_scores(spark):
    labels = spark.createDataFrame([("r", i, i < 5) for i in range(10)], "rule string, k int, expected boolean")
    hits = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 7)], "k int")
    r = S.confusion(labels, hits, ["k"], ["rule"]).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"], r["precision"], r["recall"], round(r["f1"], 6)) == (4, 1, 1, 4, 0.8, 0.8, 0.8)
    none = S.confusion(labels.withColumn("expected", F.lit(False)), hits.limit(0), ["k"], ["rule"]).first()
    assert (none["precision"], none["recall"], none["f1"]) == (0.0, 0.0, 0.0)
    assert S.unlabelled(labels.filter("k < 5"), hits, ["k"]).count() == 1
    assert S.median_seconds(spark.createDataFrame([("a", 1.0), ("a", 9.0), ("a", 2.0)], "name string, seconds double")).first()["seconds"] == 2.0


def test_readability(spark):
    src = P.source(spark.createDataFrame([("a.py", "# c\ndef f(ab, long):\n    'd'\n\nclass C:\n    x = 1\n")], "path string, content string"))
    r = S.readability(src.facts).first()
    assert (r["effective_lines"], r["comments_per_100_lines"], r["docstring_coverage"], r["undocumented_definitions"], r["short_name_rate"]) == (4, 25.0, 0.5, 1, 0.5)


def test_tree_and_config(spark, tmp_path):
    for name, text in {"a/x.py": b"eval(x)\n", "a/bin.py": b"\xff\xfe", "node_modules/y.py": b"eval(x)\n", "gen/z.py": b"eval(x)\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text)
    files = T.read_tree(spark, str(tmp_path), excludes=["gen/*"])
    assert {r["path"]: r["content"] for r in files.collect()} == {"a/x.py": "eval(x)\n", "a/bin.py": None}
    (tmp_path / "pyproject.toml").write_text("[tool.tidemark]\nignore = ['X']\n")
    (tmp_path / "a" / "tidemark.toml").write_text("[comments]\nem_dash = true\n")
    assert T.find_config(tmp_path / "a") == {"comments": {"em_dash": True}} and T.find_config(tmp_path / "gen") == {"ignore": ["X"]}
    assert T.merged({"a": {"b": 1, "c": [1]}}, {"a": {"c": [2]}}) == {"a": {"b": 1, "c": [2]}}
    assert T.extended({"extends": ["strict"], "prose": {"enabled": False}})["prose"] == {"enabled": False}
    with pytest.raises(ValueError):
        T.extended({"extends": "nope"})
    assert T.region_configs({"": {"x": {"a": 1}}, "p": {"x": {"b": 2}}, "p/q": {"root": True, "y": {}}, "p/q/r": {"x": {"c": 3}}}) == {"": {"x": {"a": 1}}, "p": {"x": {"a": 1, "b": 2}}, "p/q": {"y": {}}, "p/q/r": {"y": {}, "x": {"c": 3}}}
    assert T.section_of("# SQL\nx\n## SQL-001: raw\ny\n### more\nz\n## T\n", "sql-001") == "## SQL-001: raw\ny\n### more\nz" and T.section_of("# SQL\nx\n", "SQL-009") == "# SQL\nx"


def test_whole_run_and_sinks(spark, tmp_path):
    files = spark.createDataFrame([("m/a.py", "eval(x)\nexec(y)  # noqa\ndef f(d: dict): ...\n"), ("m/b.py", "def f(:\n"), ("m/c.bak", "")], "path string, content string")
    got = P.check(files, {"ignore": ["JUNK"], "promote": ["TYPE"]}, prefix="src")
    rows = {(r["file"], r["code"], r["line"]) for r in got.collect()}
    assert {("src/m/a.py", "EVAL-001", 1), ("src/m/a.py", "TYPE-002", 3), ("src/m/b.py", "TYPE-000", 0)} <= rows and not any(line == 2 or c == "JUNK-001" for _, c, line in rows)
    assert {r["code"] for r in P.check(files, single="EVAL-001").collect()} == {"EVAL-001"}
    with pytest.raises(ValueError):
        P.chosen({}, "NOPE")
    docs = [json.loads(r["value"]) for r in P.ndjson(got).collect()]
    assert all(set(d) == {"check", "severity", "file", "line", "code", "rule", "message", "fix"} for d in docs)
    assert all(r["value"].startswith(("::error file=src/m/", "::warning file=src/m/")) for r in P.github(got).collect())
    reports = {d["check"]: d for d in (json.loads(r["value"]) for r in P.as_json(got, P.checks_table(spark)).collect())}
    assert reports["security_calls"]["status"] == "FAIL" and reports["prose"] == {"check": "prose", "status": "PASS", "violations": [], "warnings": []}
    assert P.well_formed(got, P.RULES.values()).isEmpty() and P.output_format(environment={"GITHUB_ACTIONS": "true"}) == "github"
    assert set(FINDING) == set(got.columns) and P.rules_table(spark).count() == len(P.RULES)


def test_a_broken_rule_is_a_notice(spark):
    bad = P.Rule("X-001", "x", True, "d", lambda src: src.nothing)
    src = P.source(spark.createDataFrame([("a.py", "x = 1\n")], "path string, content string"))
    (row,) = P.find(src, [bad]).collect()
    assert (row["code"], row["file"], row["severity"]) == ("RUN-000", "", "warning")
    assert {r["code"] for r in P.well_formed(P.find(src, [bad]), [P.Rule("", " ", True, "", bad.build)]).collect()} == {"META-001", "META-002", "META-003", "META-004"}
