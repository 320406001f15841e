"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source, documents are range-sorted by that key: the key's leading
hex digits cut the range in 256 coarse parts of 256 fine parts each, so no task holds more of a hot source than one
fine part. Prefix sums of sizes add up three levels: coarse parts of the source, fine parts of the coarse one,
documents of the fine one. The budget of a source is its target, rounded; it takes whole epochs while they fit and
cuts the last one at the exact word.

Defined results: null text has size 0; documents of size 0 take nothing; a null source is a source of its own, last in
order; repeated rows are documents of their own; an empty table gives an empty result; sources of size 0 have target 0.
Columns beyond the named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.shared import Scratch, tokens


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = 3) -> DataFrame:
    """Targets of sources: (src, source, source_size) gain target. The share of all words goes by weight; where that is
    above most_epochs times a source's size, it stops there and the rest is shared anew.

    Sources sorted by how soon they are full (cap over weight): a source is full if the share of what its predecessors
    left exceeds its cap. The first that is not full sets the words per weight for it and all after it.
    The table has one row per source, so its windows run in one task.
    """
    by_name, by_fill = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("fills_at", "rank")
    ranked = sizes.withColumn("rank", F.row_number().over(by_name))
    ranked = ranked.withColumn("weight", F.get(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights)).cast("int")).cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * most_epochs)
    ranked = ranked.withColumn("fills_at", F.col("cap").cast("double") / F.col("weight"))
    before, after = by_fill.rowsBetween(W.unboundedPreceding, -1), by_fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy()
    ranked = ranked.withColumns({
        "place": F.row_number().over(by_fill),
        "left": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "weights_left": F.sum("weight").over(after),
    })
    ranked = ranked.withColumn("per_weight", F.col("left").cast("double") / F.col("weights_left"))
    ranked = ranked.withColumn("open_place", F.min(F.when(F.col("per_weight") < F.col("fills_at"), F.col("place"))).over(everything))
    ranked = ranked.withColumn("level", F.max(F.when(F.col("place") == F.col("open_place"), F.col("per_weight"))).over(everything))
    full = F.col("open_place").isNull() | (F.col("place") < F.col("open_place"))
    return ranked.select("src", "source", "source_size", F.when(full, F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken, epochs (whole repeats) and words of a last, partial one of every document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary"))
    rows = docs.select("doc_id", "source", F.size(tokens(F.col("text"))).cast("long").alias("size"), key.alias("key"))
    rows = rows.withColumns({"src": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")), "coarse": F.substring("key", 1, 2), "fine": F.substring("key", 1, 4)})
    rows = scratch.save(rows, "rows")
    fine = scratch.save(rows.groupBy("src", "coarse", "fine").agg(F.sum("size").alias("words")), "fine")
    coarse = fine.groupBy("src", "coarse").agg(F.sum("words").alias("words"))
    earlier = lambda *by, order: W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    before = lambda w: F.coalesce(F.sum("words").over(w), F.lit(0))
    coarse = coarse.select("src", "coarse", before(earlier("src", order="coarse")).alias("before_coarse"))
    sizes = rows.groupBy("src", "source").agg(F.sum("size").alias("source_size"))
    targets = scratch.save(source_targets(sizes, weights, most_epochs), "targets")
    starts = fine.withColumn("before_fine", before(earlier("src", "coarse", order="fine"))).join(coarse, ["src", "coarse"])
    starts = starts.select("src", "fine", (F.col("before_fine") + F.col("before_coarse")).alias("start"))
    within = W.partitionBy("src", "fine").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["src", "fine"])
    placed = placed.drop("source").join(targets, "src")
    placed = placed.withColumn("budget", F.round("target").cast("long")).withColumn("start", F.col("start") + F.col("before"))
    placed = placed.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("long"))
    placed = placed.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    placed = placed.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start"))))
    placed = placed.withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))
    return placed.select("doc_id", "size", "source_size", "target", "taken", "epochs", "part", "key")
