"""Known debt: findings folded to counted keys, suppressed while a key's budget lasts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as X

VERSION = 1
KEY = ["file", "code", "anchor"]
ENTRY = "file string, code string, anchor string, severity string, message string, count int"


def anchored(found: DataFrame, lines: DataFrame) -> DataFrame:
    """found with anchor: the hash of the finding's line, stripped, or of the rule's description where there is no line to
    speak of. lines: path, line, text. Only lines that have findings are hashed: the places are few, so they go to the lines."""
    found = found.withColumn("file", X.norm_path(F.col("file")))
    bare = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    places = found.filter("line >= 2").select(F.col("file").alias("path"), "line").distinct()
    here = lines.filter("line >= 2").join(places, ["path", "line"], "left_semi")
    here = here.select(F.col("path").alias("file"), "line", F.when(bare != "", X.sha(bare)).alias("hash")).filter("hash IS NOT NULL")
    rows = found.join(here, ["file", "line"], "left")
    anchor = F.when(F.col("hash").isNotNull(), F.concat(F.lit("sha:"), "hash")).otherwise(F.concat(F.lit("desc:"), X.sha(X.described(F.col("rule")))))
    return rows.withColumn("anchor", anchor).drop("hash")


def _in_order(found: DataFrame) -> list:
    return [F.col("check"), (F.col("severity") != "error"), X.parts_of(F.col("file")), F.col("ord"), F.col("line"), F.col("message")]


def entries(found: DataFrame) -> DataFrame:
    """Counted entries of anchored findings; the first finding's message speaks for its key, and an error for its severity."""
    order = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(_in_order(found))))
    rows = found.filter("file <> ''").groupBy(*KEY).agg(F.max((F.col("severity") == "error").cast("int")).alias("e"), F.min_by("message", order).alias("message"), F.count("*").cast("int").alias("count"))
    return rows.select(*KEY, F.when(F.col("e") == 1, "error").otherwise("warning").alias("severity"), "message", "count")


def write(found: DataFrame, path: str) -> None:
    """A stable document: sorted by key, so that equal findings give equal bytes. A baseline is debt that people read, so it is one file."""
    rows = [r.asDict() for r in entries(found).orderBy(*KEY).toLocalIterator()]
    with open(path, "w", encoding="utf-8") as out:
        json.dump({"version": VERSION, "entries": rows}, out, indent=2, ensure_ascii=False)
        out.write("\n")


def load(spark: SparkSession, path: str) -> DataFrame:
    """Entries; those of one key are summed, and an error among them counts."""
    raw = spark.read.schema(f"version int, entries array<struct<{', '.join(f.replace(' ', ':', 1) for f in ENTRY.split(', '))}>>").json(path, multiLine=True)
    if not raw.filter(f"version IS NULL OR version <> {VERSION}").isEmpty():
        raise ValueError(f"{path}: not a baseline of version {VERSION}")
    return folded(raw.select(F.explode("entries").alias("e")).select("e.*"))


def folded(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.max((F.col("severity") == "error").cast("int")).alias("e"), F.sum("count").cast("int").alias("count")).select(*KEY, F.when(F.col("e") == 1, "error").otherwise("warning").alias("severity"), "count")


def suppress(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """Anchored findings beyond what the baseline knows. A key suppresses its first count eligible findings; an error is eligible only where the entry is one."""
    known = baseline.select(*KEY, F.col("severity").alias("known"), "count")
    rows = found.join(known, KEY, "left").withColumn("eligible", F.col("known").isNotNull() & ((F.col("severity") == "warning") | (F.col("known") == "error")))
    turn = F.row_number().over(W.partitionBy(*KEY, "eligible").orderBy(*_in_order(found)))
    return rows.withColumn("turn", turn).filter(~(F.col("eligible") & (F.col("turn") <= F.col("count")))).select(found.columns)


def stale(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """Entries that no finding meets."""
    return baseline.join(found, KEY, "left_anti")


def added(found: DataFrame, baseline: DataFrame) -> DataFrame:
    return entries(found).join(baseline, KEY, "left_anti")


def changes(found: DataFrame, baseline: DataFrame) -> dict[str, int]:
    """What writing a baseline of anchored findings changes: entries now, was, added and pruned, and findings, as counts of one full join."""
    now, was = entries(found).select(*KEY, "count"), baseline.select(*KEY, F.lit(True).alias("old"))
    both = now.join(was.distinct(), KEY, "full")
    new, old = F.col("count").isNotNull(), F.col("old").isNotNull()
    row = both.agg(F.count_if(new).alias("now"), F.count_if(old).alias("was"), F.count_if(new & ~old).alias("added"), F.count_if(old & ~new).alias("pruned"), F.coalesce(F.sum("count"), F.lit(0)).alias("findings")).first()
    return row.asDict()


def drift(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """file, code: where an entry met nothing while a finding of that file and code met no entry; its anchor has moved."""
    unmet = found.filter("file <> ''").join(baseline, KEY, "left_anti").select("file", "code")
    return stale(found, baseline).select("file", "code").intersect(unmet).orderBy("file", "code")
