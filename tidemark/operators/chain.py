"""The steps that findings go through, in this order: target, reanchor, select and ignore, exclude, per-file ignores,
inline ignores, baseline, promotion, rollup. Each takes and gives the finding relation."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.rules.prose import NOQA, directive



def matches(codes: Iterable[str], code: str | Column = "code") -> Column:
    """The code, or its category, is listed; or ALL is."""
    wanted = [c.strip().upper() for c in codes if c.strip()]
    upper = F.upper(code)
    return F.lit("ALL" in wanted) | upper.isin(*wanted) | X.category_of(upper).isin(*wanted) if wanted else F.lit(False)


def keep_targets(found: DataFrame, targets: DataFrame | None) -> DataFrame:
    """Those in a target file or below a target directory (column target); all without targets. Every ancestor of a file is a key, so it is an equi-join."""
    if targets is None:
        return found
    parts = X.parts_of(F.col("file"))
    ways = F.when(F.col("file") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))))
    keys = found.select("file").distinct().select("file", F.explode(ways).alias("target")).join(targets.select(X.norm_path(F.col("target")).alias("target")).distinct(), "target").select("file").distinct()
    return found.join(keys, "file", "left_semi").select(found.columns)


def reanchor(found: DataFrame, prefix: str) -> DataFrame:
    """Paths below the scan root become paths below the project root; the empty one stays."""
    prefix = prefix.strip("/")
    return found.withColumn("file", F.when((F.col("file") == "") | F.lit(prefix == ""), F.col("file")).otherwise(F.concat(F.lit(prefix + "/"), F.col("file"))))


def select_ignore(found: DataFrame, select: Iterable[str] = (), ignore: Iterable[str] = ()) -> DataFrame:
    select, ignore = [c for c in select if c.strip()], list(ignore)
    kept = matches(select) if select else F.lit(True)
    return found.filter(kept & ~matches(ignore))


def exclude(found: DataFrame, globs: Iterable[str]) -> DataFrame:
    return found.filter(~X.matches_any(X.norm_path(F.col("file")), list(globs)))


def per_file_ignores(found: DataFrame, table: Mapping[str, Iterable[str]]) -> DataFrame:
    silent = F.lit(False)
    for glob, codes in table.items():
        silent = silent | (X.matches_any(X.norm_path(F.col("file")), [glob]) & matches(codes))
    return found.filter(~silent)


def silences(line: Column, word: str = "tidemark") -> Column:
    """Whether the first directive of either kind on the line covers the finding's code; without a list it covers all."""
    out = F.lit(False)
    for pattern in (NOQA, directive(word)):
        listed = F.regexp_extract(line, pattern, 1)
        codes = F.transform(F.split(listed, ","), lambda c: F.upper(F.trim(c)))
        covered = F.arrays_overlap(codes, F.array(F.upper("code"), X.category_of(F.upper("code")), F.lit("ALL")))
        out = out | (line.rlike(pattern) & ((listed == "") | covered))
    return out


def silencing(text: Column, word: str = "tidemark") -> Column:
    """Whether the text has a directive. A whole file without one has no line with one."""
    return text.rlike(NOQA) | text.rlike(directive(word))


def inline_ignores(found: DataFrame, lines: DataFrame, word: str = "tidemark") -> DataFrame:
    """lines: path, line, text. Findings that suppressions themselves cause cannot be suppressed."""
    here = lines.filter(silencing(F.col("text"), word)).select(F.col("path").alias("file"), "line", "text")
    rows = found.join(here, ["file", "line"], "left")
    quiet = silences(F.coalesce("text", F.lit("")), word) & (F.col("category") != "SUPPRESS")
    return rows.filter(~quiet).select(found.columns)


def promote(found: DataFrame, codes: Iterable[str]) -> DataFrame:
    raised = (F.col("severity") == "warning") & matches(codes) & ~F.col("code").endswith("-000")
    return found.withColumn("severity", F.when(raised, "error").otherwise(F.col("severity")))


def rollup(found: DataFrame, checks: DataFrame) -> DataFrame:
    """check, status, n_violations, n_warnings of every check, those without findings too."""
    counts = found.groupBy("check").agg(F.count_if(F.col("severity") == "error").alias("n_violations"), F.count_if(F.col("severity") == "warning").alias("n_warnings"))
    rows = checks.select("check").distinct().join(counts, "check", "left").fillna(0, ["n_violations", "n_warnings"])
    status = F.when(F.col("n_violations") > 0, "FAIL").when(F.col("n_warnings") > 0, "WARN").otherwise("PASS")
    return rows.select("check", status.alias("status"), "n_violations", "n_warnings")


def summary(results: DataFrame) -> DataFrame:
    return results.agg(*(F.count_if(F.col("status") == s).alias(n) for s, n in (("PASS", "passed"), ("WARN", "warned"), ("FAIL", "failed"))))


def nearest_regions(files: DataFrame, regions: DataFrame) -> DataFrame:
    """files with region: the longest directory of regions (column directory) that is an ancestor of path, '' the root's."""
    parts = X.parts_of(F.col("path"))
    ways = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    above = files.select("path", F.explode(ways).alias("directory")).join(regions.select("directory").distinct(), "directory")
    return files.join(above.groupBy("path").agg(F.max_by("directory", F.length("directory")).alias("region")), "path", "left")


def with_regions(files: DataFrame, places: Sequence[tuple[str, Mapping[str, float], Mapping[str, int]]]) -> DataFrame:
    """files with region, limits and kinds of the nearest folder that is in places ('' is the root's, which has to be there).

    A folder so many levels deep can only be the beginning of that length of a path: one join for each depth that there
    is, on that beginning, so the files are gone through once and never shuffled while the folders fit a broadcast.
    """
    spark, kind = files.sparkSession, "directory string, region string, limits map<string,double>, kinds map<string,int>"
    rows = {name: (name, name, dict(limits), dict(kinds)) for name, limits, kinds in places}
    found = []
    for depth in sorted({name.count("/") + 1 for name in rows if name}, reverse=True):
        here = spark.createDataFrame([r for name, r in rows.items() if name and name.count("/") + 1 == depth], kind)
        here = here.select(F.col("directory").alias(f"_at{depth}"), F.struct("region", "limits", "kinds").alias(f"_of{depth}"))
        files = files.join(here, F.substring_index("path", "/", depth) == F.col(f"_at{depth}"), "left").drop(f"_at{depth}")
        found.append(f"_of{depth}")
    table = lambda d, t: F.create_map(*(F.lit(x) for kv in d.items() for x in kv)).cast(t)
    _, _, limits, kinds = rows[""]
    root = F.struct(F.lit("").alias("region"), table(limits, "map<string,double>").alias("limits"), table(kinds, "map<string,int>").alias("kinds"))
    return files.withColumn("_of", F.coalesce(*found, root)).select("*", "_of.*").drop("_of", *found)
