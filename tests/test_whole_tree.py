from pyspark.sql import functions as F

from tidemark.plans import check as P
from tidemark.plans import queries as Q
from tidemark.plans.cases import CASES


def test_whole_run_has_every_case(spark, tmp_path):
    most = max(len(cases) for _, cases in CASES.values())
    spark.createDataFrame([(i,) for i in range(1, most + 1)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    files = Q.case_tree(spark, str(tmp_path)).collect()
    paths = [r["path"] for r in files]
    assert len(set(paths)) == len(paths)
    tags = {"".join(c for c in key.lower() if c.isalnum()) + "x" for key in CASES}
    assert {t for t in tags if any(t in p for p in paths)} == tags
    got = {(r["code"], r["file"].rpartition("/")[2]) for r in Q.whole_run(spark, str(tmp_path)).collect()}
    for key in ("strong_types.TYPE-001", "strong_types.TYPE-002", "file_limits.SIZE-001", "file_limits.COMPLEXITY-001"):
        cases, tag = CASES[key][1], "".join(c for c in key.lower() if c.isalnum()) + "x"
        for i in range(1, most + 1):
            case = cases[i % len(cases)]
            name = case.path.replace("{k}", f"{tag}{i}").rpartition("/")[2]
            assert all((code, name) in got for code, _, _ in case.found), (key, name)


def test_rows_of_one_part_are_dealt_to_tasks_and_make_the_same_files(spark, tmp_path):
    keys = [3, 5, 5, *range(40, 60)]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    tasks = Q._keys(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 2 and sum(r["count"] for r in tasks) == len(set(keys))
    tag = lambda key: "".join(c for c in key.lower() if c.isalnum()) + "x"
    made = set()
    for key, (_, cases) in CASES.items():
        for k in keys:
            c = cases[k % len(cases)]
            made |= {((p if "{k}" in p else f"{tag(key)}/{p}").replace("{k}", f"{tag(key)}{k}"), s.replace("{k}", f"{tag(key)}{k}")) for p, s in ((c.path, c.source), *c.beside)}
        some = {(p.replace("{k}", str(k)), s.replace("{k}", str(k))) for k in keys for c in [cases[k % len(cases)]] for p, s in ((c.path, c.source), *c.beside)}
        if cases[0].beside or any("{k}" in c.source for c in cases):
            assert sorted(map(tuple, Q.dealt_files(spark, str(tmp_path), cases).collect())) == sorted(some), key
    assert sorted(map(tuple, Q.case_tree(spark, str(tmp_path)).collect())) == sorted(made)


def test_a_check_makes_its_files_once(spark):
    files = spark.range(3).select(F.format_string("m/a_%d.py", "id").alias("path"), F.lit("eval(x)\neval(y)  # noqa\n").alias("content"))
    found = P.check(files)
    assert "Range" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["file"], r["line"]) for r in found.filter("code = 'EVAL-001'").collect()) == [(f"m/a_{i}.py", 1) for i in range(3)]
