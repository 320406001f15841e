"""How well rules do against labels, and how code reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import vocabulary as V


def _measures(rows: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """rows: expected, hit. by, more, tp, fp, fn, tn, precision, recall, f1."""
    count = lambda e, h: F.count_if((F.col("expected") == F.lit(e)) & (F.col("hit") == F.lit(h)))
    out = rows.groupBy(*by).agg(*more, count(True, True).alias("tp"), count(False, True).alias("fp"), count(True, False).alias("fn"), count(False, False).alias("tn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = out.withColumns({"precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def confusion(labels: DataFrame, hits: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """by, tp, fp, fn, tn, precision, recall, f1. labels: key, by, expected; hits: keys that a rule found."""
    rows = labels.join(hits.select(*key).distinct().withColumn("hit", F.lit(True)), key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return _measures(rows, by)


def scored(labels: DataFrame, hits: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """As confusion, with labels (how many) and stale: hits that no label covers. by is part of key."""
    hits = hits.select(*key).distinct().withColumn("hit", F.lit(True))
    rows = labels.select(*key, "expected").join(hits, key, "full").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return _measures(rows, by, F.count("expected").alias("labels"), F.count_if(F.col("expected").isNull()).alias("stale"))


def unlabelled(labels: DataFrame, hits: DataFrame, key: list[str]) -> DataFrame:
    """Findings without a label: the corpus is out of date."""
    return hits.join(labels, key, "left_anti")


def tally(found: DataFrame) -> DataFrame:
    return found.groupBy("code").agg(F.count("*").alias("findings"))


def median_seconds(runs: DataFrame) -> DataFrame:
    """runs: name, seconds."""
    return runs.groupBy("name").agg(F.median("seconds").alias("seconds"))


def handled_rates(events: DataFrame) -> DataFrame:
    """events: severity, handled, in_code, in_report, overclaim (booleans) to the share of each by severity."""
    share = lambda c: F.avg(F.col(c).cast("double")).alias(c)
    return events.groupBy("severity").agg(F.count("*").alias("events"), *map(share, ("handled", "in_code", "in_report", "overclaim")))


def readability(facts: DataFrame) -> DataFrame:
    """Per file: effective_lines, comments_per_100_lines, docstring_coverage, undocumented_definitions, short_name_rate."""
    lines = X.effective_lines(F.col("lines"))
    defs = F.concat(F.transform("functions", lambda f: F.struct(f["name"].alias("name"), f["doc"].alias("doc"))), F.transform("classes", lambda c: F.struct(c["name"].alias("name"), c["doc"].alias("doc"))))
    public = F.filter(defs, lambda d: ~d["name"].startswith("_"))
    bare = F.size(F.filter(public, lambda d: d["doc"].isNull()))
    names = F.flatten(F.transform("functions", lambda f: F.transform(f["extents"], lambda e: e["name"])))
    rate = lambda a, b, n: F.bround(F.when(b > 0, a / b).otherwise(0.0), n)
    rows = facts.filter("error IS NULL").withColumns({"effective_lines": lines, "public": F.size(public), "undocumented_definitions": bare, "bound": F.size(names), "short": F.size(F.filter(names, lambda n: F.length(n) <= 2)), "n_comments": F.size("comments")})
    return rows.select("path", "effective_lines", rate(F.col("n_comments") * 100.0, F.col("effective_lines"), 2).alias("comments_per_100_lines"), rate(F.col("public") - F.col("undocumented_definitions"), F.col("public"), 3).alias("docstring_coverage"), "undocumented_definitions", rate(F.col("short"), F.col("bound"), 3).alias("short_name_rate"))


def reading(facts: DataFrame) -> DataFrame:
    """What each file is like to read: path, effective_lines, short_name_rate, short_names, comments_per_100_lines, docstring_coverage,
    undocumented_definitions, trivial_docstrings, heavy_comprehensions, max_comprehension_load, max_expression_depth."""
    rate = lambda a, b, n: F.bround(F.when(b > 0, a / b).otherwise(0.0), n)
    r = facts.filter("reading IS NOT NULL").select("path", "reading.*")
    return r.select(
        "path",
        F.col("code_lines").alias("effective_lines"),
        rate(F.size("short"), F.col("identifiers"), 3).alias("short_name_rate"),
        F.array_sort(F.array_distinct("short")).alias("short_names"),
        rate(F.col("comments") * 100.0, F.col("code_lines"), 2).alias("comments_per_100_lines"),
        rate(F.col("documented"), F.col("definitions"), 3).alias("docstring_coverage"),
        (F.col("definitions") - F.col("documented")).alias("undocumented_definitions"),
        F.col("trivial").alias("trivial_docstrings"),
        F.size(F.filter("loads", lambda x: x > V.LOAD_BUDGET)).alias("heavy_comprehensions"),
        F.coalesce(F.array_max("loads"), F.lit(0)).alias("max_comprehension_load"),
        F.col("depth").alias("max_expression_depth"),
    )


def comprehension_loads(facts: DataFrame, by: list[str]) -> DataFrame:
    """by, comprehensions, median, p90 and most of their loads. by: columns of facts."""
    rows = facts.select(*by, F.explode("reading.loads").alias("load"))
    return rows.groupBy(*by).agg(F.count("*").alias("comprehensions"), F.median("load").alias("median"), F.percentile("load", F.lit(0.9)).alias("p90"), F.max("load").alias("most"))
