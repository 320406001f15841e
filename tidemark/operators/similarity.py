"""Similar functions within a file: cheap gates in the plan, the sequence ratio last and in batches."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.functions import text as X
from tidemark.functions import vocabulary as V
from tidemark.rules.base import Source, findings, rule


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """As difflib has it, with its handling of frequent items in long sequences; the order of the two matters."""
    return pd.Series([difflib.SequenceMatcher(None, tuple(x), tuple(y)).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _elements(bag: str) -> Column:
    """A multiset as a set: an entry's n-th time is an element of its own. Weighted Jaccard of two is Jaccard of these."""
    return F.flatten(F.transform(F.map_entries(bag), lambda e: F.transform(F.sequence(F.lit(1), e["value"]), lambda n: F.concat_ws("\x00", e["key"], n.cast("string")))))


def candidates(functions: DataFrame, str_limit: Column, call_limit: Column) -> DataFrame:
    """path, idx_a, idx_b: pairs of a file that may pass the gates on strings and calls, each once.

    A pair that passes has strings in both, or none in both and calls in both. With a limit t, two sets of which one has n
    elements share one of the first n - ceil(t n) + 1 of each, in any order that holds for all: here those that few functions
    of the file have come first. So functions meet by rare elements only; sizes have to agree within the limit too.
    A limit of zero or less lets all pairs pass: these meet under one key.
    """
    tag = F.when(F.size("strs") > 0, "s").when(F.size("calls") > 0, "c").otherwise("-")
    limit = F.when(tag == "s", str_limit).otherwise(call_limit).cast("double")
    rows = functions.withColumns({"tag": tag, "t": limit, "all": (str_limit <= 0) | ((call_limit <= 0) & (F.size("strs") == 0)), "set": F.when(tag == "s", _elements("strs")).otherwise(_elements("calls"))})
    rows = rows.select("path", "idx", "tag", "t", "all", F.size("set").alias("n"), "set")
    each = rows.filter("NOT all").select("path", "idx", "tag", "t", "n", F.explode("set").alias("key"))
    common = each.groupBy("path", "tag", "key").agg(F.count("*").alias("holders"))
    place = F.row_number().over(W.partitionBy("path", "idx").orderBy("holders", "key"))
    first = each.join(common.filter("holders > 1"), ["path", "tag", "key"], "left").withColumn("holders", F.coalesce("holders", F.lit(1)))
    first = first.withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(F.col("t") * F.col("n") - 1e-9) + 1).filter("holders > 1")
    met = first.select("path", "tag", "key", "idx", "n", "t").unionByName(rows.filter("all").select("path", F.lit("*").alias("tag"), F.lit("").alias("key"), "idx", F.lit(1).alias("n"), F.lit(0.0).alias("t")))
    a, b = (met.select("path", "tag", "key", F.col("idx").alias(f"idx_{k}"), F.col("n").alias(f"n_{k}"), F.col("t").alias(f"t_{k}")) for k in "ab")
    fits = F.least("n_a", "n_b") >= F.col("t_a") * F.greatest("n_a", "n_b") - 1e-9
    return a.join(b, ["path", "tag", "key"]).filter((F.col("idx_a") < F.col("idx_b")) & fits).select("path", "idx_a", "idx_b").distinct()


def similar_pairs(functions: DataFrame, limits: dict[str, Column | float], carried: tuple[str, ...] = ()) -> DataFrame:
    """path, a, b (names), line_a, line_b, ratio. functions: path, idx, name, line, shape and the four multisets.

    Pairs are of one file, earlier function first. limits are numbers, or columns of carried, which is the same for a file's functions.
    """
    of = {k: v if isinstance(v, Column) else F.lit(v) for k, v in limits.items()}
    cols = ("name", "line", "shape", "calls", "strs", "ops", "attrs")
    a, b = (functions.select("path", F.col("idx").alias(f"idx_{k}"), *(carried if k == "a" else ()), *(F.col(c).alias(f"{c}_{k}") for c in cols)) for k in "ab")
    pairs = candidates(functions, of["str"], of["call"]).join(a, ["path", "idx_a"]).join(b, ["path", "idx_b"])
    some = lambda c: (F.size(f"{c}_a") > 0) | (F.size(f"{c}_b") > 0)
    near = lambda c, empty=False: X.weighted_jaccard(F.col(f"{c}_a"), F.col(f"{c}_b"), empty)
    gates = (some("strs") | some("calls")) & (near("strs") >= of["str"]) & (near("ops", True) >= of["op"]) & (near("calls") >= of["call"]) & (near("attrs", True) >= of["attr"])
    pairs = pairs.filter(gates).withColumn("ratio", sequence_ratio("shape_a", "shape_b")).filter(F.col("ratio") >= of["struct"])
    return pairs.select("path", F.col("name_a").alias("a"), F.col("name_b").alias("b"), "line_a", "line_b", "idx_a", "ratio")


@rule("SIMILAR-001", "similarity", "Functions of a file differ", on=False, reads=("functions.idx", "functions.name", "functions.line", "functions.n_body", "functions.boilerplate", "functions.shape", "functions.calls", "functions.strs", "functions.ops", "functions.attrs"))
def similar(src: Source) -> DataFrame:
    get = lambda k, d: src.limit("similarity", k, d)
    path = F.col("path")
    rows = src.functions.filter(~X.in_any(path, (*V.SKIP_DIRS, *V.MIGRATIONS)) & ~X.name_of(path).isin("__init__.py", "conftest.py") & ~X.name_of(path).startswith("test_"))
    rows = rows.filter((F.col("n_body") >= get("min_statements", 5)) & ~F.col("boilerplate"))
    pairs = similar_pairs(rows, {"struct": get("struct_ratio", 0.55), "str": get("str_jaccard", 0.60), "op": get("op_jaccard", 0.60), "call": get("call_jaccard", 0.35), "attr": get("attr_jaccard", 0.10)}, src.carried)
    return findings(pairs, "similarity", "SIMILAR-001: similar functions", "warning", "line_a", F.format_string("'%s' is like '%s' on line %d", "a", "b", "line_b"), "Share what they have in common", "idx_a")
