"""Labels of evaluation corpora as one relation, whatever layout they are kept in.

Five layouts: a list of labelled lines by file; a flag by file:line; a verdict by document; folders of positives and
negatives; events by task with reviewers' verdicts apart. The first three share a file name, and every entry tells its
own layout, so one file may mix them. Entries whose key begins with an underscore are remarks.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = "file string, line int, expected boolean, label string, note string"
FOLDERS = {"positives": True, "negatives": False}


def _entries(texts: DataFrame) -> DataFrame:
    """texts: value, a JSON object; to key and the entry's JSON text."""
    return texts.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "entry")).filter(~F.col("key").startswith("_"))


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def labels_of(texts: DataFrame, negative: Iterable[str] = ("ok", "negative")) -> DataFrame:
    """The labels that JSON objects tell: LABELS; line 0 is the whole file. negative: labels of lines that no finding belongs on."""
    rows = _entries(texts).withColumns({
        "lines": F.from_json("entry", "array<struct<line:int,label:string,note:string>>"),
        "flag": F.col("entry").isin("true", "false"),
        "verdict": F.from_json("entry", "struct<should_fire:boolean,note:string>"),
    })
    expected: Column = ~F.lower("x.label").isin(*negative)
    lists = rows.filter("entry LIKE '[%'").select(F.col("key").alias("file"), F.explode("lines").alias("x"))
    lists = lists.select("file", F.col("x.line").alias("line"), expected.alias("expected"), F.col("x.label").alias("label"), F.col("x.note").alias("note"))
    place = F.regexp_extract("key", r"^(.*):(\d+)$", 2)
    file = F.when(place == "", F.col("key")).otherwise(F.regexp_extract("key", r"^(.*):(\d+)$", 1))
    line = F.when(place == "", F.lit(0)).otherwise(F.expr("try_cast(regexp_extract(key, '^(.*):([0-9]+)$', 2) AS int)"))
    flags = rows.filter("flag").select(file.alias("file"), line.alias("line"), (F.col("entry") == "true").alias("expected"), F.col("entry").alias("label"), F.lit(None).cast("string").alias("note"))
    verdicts = rows.filter("entry LIKE '{%'").select(F.col("key").alias("file"), F.lit(0).alias("line"), F.coalesce("verdict.should_fire", F.lit(False)).alias("expected"), F.col("verdict.should_fire").cast("string").alias("label"), F.col("verdict.note").alias("note"))
    return lists.unionByName(flags).unionByName(verdicts)


def read_labels(spark: SparkSession, path: str, negative: Iterable[str] = ("ok", "negative")) -> DataFrame:
    """LABELS of a file of one or more of the first three layouts."""
    return labels_of(_whole(spark, path), negative)


def folder_labels(files: DataFrame) -> DataFrame:
    """LABELS of files (path) by the innermost folder of FOLDERS that they are in; files in none have no label."""
    folder = F.regexp_extract("path", rf".*(?:^|/)({'|'.join(FOLDERS)})/", 1)
    rows = files.select(F.col("path").alias("file"), folder.alias("label")).filter("label <> ''")
    return rows.select("file", F.lit(0).alias("line"), F.col("label").isin(*(k for k, v in FOLDERS.items() if v)).alias("expected"), "label", F.lit(None).cast("string").alias("note"))


def read_events(spark: SparkSession, events: str, verdicts: str) -> DataFrame:
    """task, id, severity, claim, handled, in_code, in_report, overclaim, note: planted events with their verdicts; what was not said is false."""
    tasks = _whole(spark, events).select(F.explode(F.from_json("value", "struct<tasks:map<string,struct<events:array<struct<id:string,severity:string,claim:string>>>>>")["tasks"]).alias("task", "x"))
    planted = tasks.select("task", F.explode("x.events").alias("e")).select("task", "e.*")
    said = _entries(_whole(spark, verdicts)).select(F.col("key").alias("id"), F.from_json("entry", "struct<handled:boolean,in_code:boolean,in_report:boolean,overclaim:boolean,note:string>").alias("v")).select("id", "v.*")
    told = {c: F.coalesce(c, F.lit(False)) for c in ("handled", "in_code", "in_report", "overclaim")} | {"note": F.coalesce("note", F.lit(""))}
    return planted.join(said, "id", "left").withColumns(told).select("task", "id", "severity", "claim", *told)
