"""Settings by folder as columns, rules that fail while a run goes on, pairs without all pairs, fences in linear time."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import chain as C
from tidemark.operators import similarity as M
from tidemark.plans import check as P
from tidemark.rules import prose
from tidemark.rules.base import RULES, findings, rule

LONG = "def f(a, b, c):\n" + "    a = 1\n" * 20


def files_of(spark, found):
    return spark.createDataFrame(list(found.items()), "path string, content string")


def test_nearest_region_with_its_settings(spark):
    files = spark.createDataFrame([("a.py",), ("p/b.py",), ("p/q/c.py",), ("pq/d.py",), ("p/q/r/s/e.py",), ("p",)], "path string")
    places = [("", {"x.a": 1.0}, {"x": 0}), ("p", {}, {"x": 1}), ("p/q", {"x.a": 3.0}, {}), ("p/q/r/s", {"y.b": 4.0}, {"x": 2})]
    got = {r["path"]: (r["region"], dict(r["limits"]), dict(r["kinds"])) for r in C.with_regions(files, places).collect()}
    root = ("", {"x.a": 1.0}, {"x": 0})
    assert got["a.py"] == got["pq/d.py"] == root and got["p/b.py"] == ("p", {}, {"x": 1}) and got["p/q/c.py"] == ("p/q", {"x.a": 3.0}, {})
    assert got["p/q/r/s/e.py"] == ("p/q/r/s", {"y.b": 4.0}, {"x": 2})


def test_a_thousand_regions_are_one_plan(spark):
    files = files_of(spark, {f"r{i}/a.py": LONG for i in range(1000)} | {"top.py": LONG})
    src = P.source(files, {"file_limits": {"func_warn": 30, "func_error": 40}})
    src.facts.write.mode("overwrite").format("noop").save()
    regions = {f"r{i}": {"file_limits": {"func_warn": 15 + i % 10, "func_error": 18 + i % 20}} for i in range(1000)}
    own = RULES[("file_limits", "SIZE-002")]
    jobs = P.passes(src, [own], regions, "SIZE-002")
    assert len(jobs) == 1
    got = {(r["file"], r["severity"]) for r in P.regional(src, [own], regions, "SIZE-002").collect()}
    want = {(f"r{i}/a.py", "error" if 18 + i % 20 <= 21 else "warning") for i in range(1000) if min(15 + i % 10, 18 + i % 20) <= 21}
    assert got == want


def test_numbers_that_a_region_does_not_set_are_the_defaults(spark):
    files = files_of(spark, {"a.py": LONG, "p/b.py": LONG, "q/c.py": LONG, "p/d.py": "x = 1\n" * 310})
    src = P.source(files, {"file_limits": {"func_warn": 10}})
    got = {(r["file"], r["code"]) for r in P.regional(src, [], {"p": {"file_limits": {"param_warn": 2}}, "q": {}}, "file_limits").collect() if r["code"][:4] in ("SIZE", "PARA")}
    assert got == {("a.py", "SIZE-002"), ("p/b.py", "PARAM-001"), ("p/d.py", "SIZE-001")}


def test_other_settings_have_a_plan_for_each_table(spark):
    files = files_of(spark, {f"{d}/a.py": "def f(aa):\n" + "    x = 1\n" * 22 + "    return aa\n" for d in ("p", "q", "r", "s")})
    src = P.source(files, {"naming_scope": {"enabled": True}})
    regions = {"p": {"naming_scope": {"enabled": True, "allow": ["aa"]}}, "q": {"naming_scope": {"enabled": False}}, "r": {"naming_scope": {"enabled": True, "max_span": 30}}, "s": {"naming_scope": {"enabled": True, "max_span": 5}}}
    jobs = [j for j in P.passes(src, [], regions) if j[1].code == "NAMING-005"]
    assert len(jobs) == 2
    assert {r["file"] for r in P.together(jobs, files).collect()} == {"s/a.py"}


def test_suppressions_are_counted_by_region(spark):
    noisy = "x = 1  # noqa\ny = 2  # noqa: E501\n"
    files = files_of(spark, {"a.py": noisy, "p/b.py": noisy, "p/c.py": noisy + noisy, "p/d.py": noisy, "p/e.py": noisy, "q/f.py": noisy})
    src = P.source(files, {"suppressions": {"enabled": True, "max_total": 1}})
    regions = {"p": {"suppressions": {"enabled": True, "max_total": 9}}, "q": {"suppressions": {"enabled": True, "max_total": 2}}}
    own = RULES[("suppressions", "SUPPRESS-001")]
    got = sorted((r["file"], r["line"], r["message"]) for r in P.regional(src, [], regions, "SUPPRESS-001").collect())
    assert got == [("a.py", 1, "2 suppressions in 1 files. Most: a.py (2)"), ("p/b.py", 1, "10 suppressions in 4 files. Most: p/c.py (4), p/b.py (2), p/d.py (2)")]
    whole = P.find(src, [own]).collect()
    assert [(r["file"], r["message"]) for r in whole] == [("a.py", "14 suppressions in 6 files. Most: p/c.py (4), a.py (2), p/b.py (2)")]


@pytest.mark.parametrize("bad", [1, 3])
def test_rules_that_fail_at_run_time_leave_the_others(spark, tmp_path, bad):
    def late(src):
        return findings(src.files.filter("path = 'b.py'"), "runs", "LATE-001: late", "error", 1, F.raise_error(F.lit("late")).cast("string"), "fix")

    for k in range(bad):
        rule(f"LATE-00{k + 1}", "runs", "Fails on one file")(late)
    try:
        files = files_of(spark, {"a.py": "eval(x)\n", "b.py": "eval(y)\n", "c.py": "import os\nos.system('x')\n"})
        got = P.check(files, {"select": ["LATE", "EVAL", "SHELL", "RUN"]}, folder=str(tmp_path)).collect()
        assert {(r["code"], r["file"]) for r in got} == {("EVAL-001", "a.py"), ("EVAL-001", "b.py"), ("SHELL-001", "c.py"), ("RUN-000", "")}
        assert sorted(r["message"].split(":")[0] for r in got if r["code"] == "RUN-000") == [f"LATE-00{k + 1}" for k in range(bad)]
        assert all(r["severity"] == "warning" and r["check"] == "runs" for r in got if r["code"] == "RUN-000")
        good = P.check(files.filter("path <> 'b.py'"), {"select": ["LATE", "EVAL", "RUN"]}).collect()
        assert {(r["code"], r["file"]) for r in good} == {("EVAL-001", "a.py")}
    finally:
        for k in range(bad):
            RULES.pop(("runs", f"LATE-00{k + 1}"))


BAGS = "path string, idx int, name string, line int, shape array<string>, calls map<string,int>, strs map<string,int>, ops map<string,int>, attrs map<string,int>"
LIMITS = {"struct": 0.55, "str": 0.6, "op": 0.6, "call": 0.35, "attr": 0.1}


def all_pairs(functions, limits):
    """The same gates over all pairs of a file."""
    cols = ("idx", "name", "line", "shape", "calls", "strs", "ops", "attrs")
    a, b = (functions.select("path", *(F.col(c).alias(f"{c}_{k}") for c in cols)) for k in "ab")
    pairs = a.join(b, "path").filter("idx_a < idx_b")
    near = lambda c, empty=False: M.X.weighted_jaccard(F.col(f"{c}_a"), F.col(f"{c}_b"), empty)
    some = (F.size("strs_a") + F.size("strs_b") + F.size("calls_a") + F.size("calls_b")) > 0
    gates = some & (near("strs") >= limits["str"]) & (near("ops", True) >= limits["op"]) & (near("calls") >= limits["call"]) & (near("attrs", True) >= limits["attr"])
    return pairs.filter(gates).withColumn("ratio", M.sequence_ratio("shape_a", "shape_b")).filter(F.col("ratio") >= limits["struct"]).select("path", "line_a", "line_b")


def some_functions(n, seed, path="m.py"):
    rng = random.Random(seed)
    bag = lambda words, most: {w: rng.randint(1, 3) for w in rng.sample(words, rng.randint(0, most))}
    words, out = [f"w{i}" for i in range(12)], []
    for i in range(n):
        if out and rng.random() < 0.5:
            _, _, _, _, shape, *bags = rng.choice(out)
            bags = [dict(x) for x in bags]
            for x in bags:
                if rng.random() < 0.4:
                    x[rng.choice(words)] = rng.randint(1, 2)
            shape = [s if rng.random() < 0.9 else "z" for s in shape]
        else:
            shape, bags = [rng.choice("abcd") for _ in range(rng.randint(1, 9))], [bag(words, 4), bag(words, rng.choice((0, 3))), bag(words[:3], 2), bag(words[:3], 1)]
        out.append((path, i, f"f{i}", i + 1, shape, *bags))
    return out


@pytest.mark.parametrize("change", [{}, {"str": 1.0}, {"str": 0.0}, {"call": 0.0}, {"str": 0.34, "call": 0.7}])
def test_pairs_are_those_of_all_pairs(spark, change):
    rows = spark.createDataFrame([r for k in range(6) for r in some_functions(40, k, f"m{k}.py")], BAGS)
    limits = LIMITS | change
    key = lambda df: sorted((r["path"], r["line_a"], r["line_b"]) for r in df.collect())
    got = key(M.similar_pairs(rows, limits))
    assert got == key(all_pairs(rows, limits)) and len(got) > 3


def test_a_generated_file_does_not_make_all_pairs(spark):
    rng = random.Random(4)
    rows = []
    for i in range(5000):
        twin = i - i % 5
        rows.append(("gen.py", i, f"f{i}", i + 1, ["a", "b"], {"common": 2, "log": 1, f"call{twin}": 3}, {"id": 1, "name": 1, f"text{twin}": 2, f"more{twin}": 1}, {"Add": rng.randint(1, 2)}, {}))
    table = spark.createDataFrame(rows, BAGS).repartition(4)
    pairs = M.candidates(table, F.lit(0.6), F.lit(0.35))
    assert pairs.count() == 1000 * 10
    assert M.similar_pairs(table, LIMITS | {"op": 0.0}).count() == 1000 * 10


def plain_outside(lines):
    out, open_ = [], False
    for k, x in enumerate(lines, 1):
        if x.lstrip(" ").startswith(("```", "~~~")):
            open_ = not open_
        elif not open_:
            out.append((k, x))
    return out


def test_lines_outside_fences(spark):
    rng = random.Random(5)
    pages = {f"p{i}.md": [rng.choice(("```", "~~~py", "  ```", "text", "", "a ``` b", "# h")) for _ in range(rng.randint(0, 30))] for i in range(60)} | {"e.md": [], "f.md": ["```"], "g.md": ["x"], "h.md": ["```", "```"]}
    got = {}
    for r in prose.outside_fences(spark.createDataFrame(list(pages.items()), "path string, lines array<string>")).collect():
        got.setdefault(r["path"], []).append((r["line"], r["text"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: plain_outside(v) for k, v in pages.items() if plain_outside(v)}


def test_long_pages_take_linear_time(spark):
    taken = []
    for n in (20_000, 160_000):
        page = spark.createDataFrame([("p.md", ["text of a line"] * n + ["```", "code", "```"] + ["more"] * n)], "path string, lines array<string>").persist()
        page.count()
        began = time.perf_counter()
        assert prose.outside_fences(page).count() == 2 * n
        taken.append(time.perf_counter() - began)
    assert taken[1] < 8 * taken[0] + 10
