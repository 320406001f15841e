"""The parse stage: spread over tasks, by pieces of bounded size, equal texts once, no more facts than are read."""

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.plans import check as P
from tidemark.plans.cases import CASES
from tidemark.rules.base import RULES
from tidemark.sources import facts as S

TEXT = "def f(ab, rows):\n    'd'\n    # note\n    return rows.get(ab, 'x')\n"


def test_few_partitions_become_many_tasks(spark):
    files = spark.range(200).select(F.format_string("m/a_%d.py", "id").alias("path"), F.lit(TEXT).alias("content")).coalesce(1)
    assert S.parse(files).groupBy(F.spark_partition_id().alias("task")).count().count() >= 4


def test_pieces_are_bounded():
    texts = ["a" * 1000] * 2000 + [None] + [str(i) * 300 for i in range(1000, 3000)]
    for once in (True, False):
        runs = list(S._pieces(texts, once))
        assert [i for i, _ in runs[1:]] == [k for _, k in runs[:-1]] and (runs[0][0], runs[-1][1]) == (0, len(texts))
        sizes = [sum(map(len, (x or "" for x in (set(texts[i:k]) if once else texts[i:k])))) for i, k in runs]
        assert max(sizes) <= S.CHARS and len(runs) > 1
    assert next(S._pieces(texts, True))[1] > 2000  # equal ones count once
    assert list(S._pieces(["a" * (S.CHARS + 1), "b"], False)) == [(0, 1), (1, 2)] and list(S._pieces([], True)) == []


def test_copies_nulls_and_pieces_have_their_own_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "CHARS", 200)
    texts = [TEXT, "def g(", TEXT, None, "x = 1\n", TEXT] * 5
    rows = spark.createDataFrame([(f"{i}.py", t) for i, t in enumerate(texts)], "path string, content string")
    got = {r["path"]: r.asDict(True) for r in S.parse(rows).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = S.python_facts(f"{i}.py", t)
        assert got[f"{i}.py"]["error"] == want["error"] and got[f"{i}.py"]["lines"] == want["lines"] and [f["calls"] for f in got[f"{i}.py"]["functions"]] == [f["calls"] for f in want["functions"]]


def test_read_facts_are_those_of_the_whole():
    odd = ["x = " + "+".join(["a"] * 400) + "\n", "x = 0x" + "f" * 5000 + "\n", "def f(", TEXT]  # too deep, too long, broken, plain
    reads = [r.reads for r in RULES.values() if r.reads]
    assert reads
    for text in [*odd, *(c.source for _, cases in CASES.values() for c in cases)]:
        whole = S.python_facts("p", text)
        for some in reads:
            got = S.python_facts("p", text, 3, some)
            assert got["error"] == whole["error"]
            for name, _, field in (x.partition(".") for x in some):
                assert [x[field] for x in got[name]] == [x[field] for x in whole[name]] if field else got[name] == whole[name]


def test_facts_that_are_not_read_are_not_made(spark):
    files = spark.createDataFrame([("m/a.py", TEXT)], "path string, content string")
    facts = P.source(files, {}, [RULES[("naming_scope", "NAMING-005")]]).facts
    assert facts.columns == ["path", "functions"] and facts.schema["functions"].dataType.elementType.names == ["idx", "name", "extents"]
    assert len(P.source(files, {}).facts.columns) == len(P.source(files, {}, [RULES[("naming_scope", "NAMING-005")], RULES[("naming_consistency", "NAMING-001")]]).facts.columns) == 14


def test_terms_go_through_the_facts_once(spark):
    files = spark.createDataFrame([("m/a.py", "idiot = 1  # a scum\n'poor idiot'\n")], "path string, content string")
    settings = {"domain_terms": {"rules": [{"id": f"TERM-{i}", "canonical": "c", "forbidden": [w]} for i, w in enumerate(("idiot", "scum", "none"))]}}
    found = P.find(P.source(files, settings), [RULES[("domain_terms", "TERM-NNN")]])
    assert sorted((r["code"], r["line"]) for r in found.collect()) == [("TERM-0", 1), ("TERM-1", 1)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_later_pieces_and_batches_take_the_facts_of_equal_texts(monkeypatch):
    kind, met, whole = S.T.StructType.fromDDL(S.FACTS), [], S.python_facts
    monkeypatch.setattr(S, "python_facts", lambda path, text, *more: met.append(text) or whole(path, text, *more))
    few = [TEXT, "x = 1\n", None, "def f("]
    many = [f"x = {i}\n" + "# note\n" * 5000 for i in range(20)]  # more than is held at once
    batches = [few * 3, few[::-1], many, [*few, many[-1]]]
    got = list(S._parsed((pa.RecordBatch.from_pydict({"path": [f"{k}-{i}.py" for i in range(len(b))], "content": b}) for k, b in enumerate(batches)), kind))
    assert sorted(map(str, met[: len(few)])) == sorted(map(str, few)) and met.count(TEXT) == 2 and met.count(many[0]) == 1
    rows = {r["path"]: r for b in got for r in b.to_pylist()}
    want = {f"{k}-{i}.py": whole("", t) for k, b in enumerate(batches) for i, t in enumerate(b)}
    assert rows.keys() == want.keys() and all(rows[p]["error"] == f["error"] and rows[p]["lines"] == f["lines"] and len(rows[p]["functions"]) == len(f["functions"]) for p, f in want.items())
