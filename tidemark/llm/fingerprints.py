"""Document fingerprints: bottom-k sketches of shingle hashes.

A shingle is five consecutive words; a text of fewer words is one shingle, and one without words has none. The sketch
holds the k smallest distinct 64-bit hashes in unsigned order. Sketches of parts merge to the sketch of the whole (k
smallest of the union), and two sketches tell resemblance, containment and the number of distinct shingles. All of it
is column expressions over arrays in a row: nothing is exploded, and no shuffle is needed for a text's own sketch.

Defined results: ids may be numbers or texts, in their own order; null counts as empty; empty texts have the empty fingerprint, resemble each other fully and anything
else not at all; repeated rows have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import Scratch, words

K = 128
SHINGLE = 5
#: Hashes are kept as longs with the sign bit flipped, so that signed order is the unsigned order of the hash.
_LOWEST, _RANGE = float(-(2**63)), float(2**64)


def with_sketch(df: DataFrame, text: str, name: str, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """df with the column name: the sketch of the column text, a sorted array of longs. Words are hashed once a row, then windows of their hashes."""
    hashed = F.transform(words(F.col(text)), lambda w: F.xxhash64(w))
    df = df.withColumn(f"_{name}", hashed)
    h = F.col(f"_{name}")
    parts = lambda i: [F.get(h, i + j) for j in range(shingle)]  # noqa: E731  past the end: null, which leaves the hash as it is
    starts = F.when(F.size(h) > 0, F.sequence(F.lit(0), F.greatest(F.size(h) - shingle, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    sketch = F.slice(F.sort_array(F.array_distinct(F.transform(starts, lambda i: F.xxhash64(*parts(i)).bitwiseXOR(F.lit(-(2**63)))))), 1, k)
    return df.withColumn(name, sketch).drop(f"_{name}")


def merge(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_estimate(a: Column, k: int = K) -> Column:
    """Number of distinct shingles: exact below k."""
    share = (F.get(a, F.lit(k - 1)).cast("double") - _LOWEST) / _RANGE
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the k smallest of the union that both have; exact where the union has at most k shingles."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: resemblance times the size of the union over a's size."""
    share = resemblance(a, b, k) * distinct_estimate(merge(a, b, k), k) / distinct_estimate(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), share))


def encode(a: Column) -> Column:
    """A sketch as text: 16 hex digits a hash, in order."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def merged(df: DataFrame, by: list[str], sketch: str, k: int = K) -> DataFrame:
    """The sketch of all rows of each group. A hot group is merged in 64 parts first, each held by its k smallest."""
    part = df.withColumn("_part", F.pmod(F.hash(sketch), F.lit(64))).select(*by, "_part", F.explode_outer(sketch).alias("_h"))
    lowest = lambda keys: W.partitionBy(*keys).orderBy("_h")
    part = part.groupBy(*by, "_part", "_h").count().withColumn("_n", F.row_number().over(lowest([*by, "_part"]))).filter(f"_n <= {k} OR _h IS NULL")
    whole = part.groupBy(*by, "_h").count().withColumn("_n", F.row_number().over(lowest(by))).filter(f"_n <= {k} + 1 OR _h IS NULL")
    return whole.groupBy(*by).agg(F.slice(F.sort_array(F.collect_list("_h")), 1, k).alias(sketch))


def range_key(docs: DataFrame) -> Column:
    """A long that rises with doc_id: the number itself, or the first seven bytes of what isn't a whole number as text."""
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return F.col("doc_id").cast("long")
    return F.conv(F.rpad(F.hex(F.encode(F.col("doc_id").cast("string"), "UTF-8")), 14, "0"), 16, 10).cast("long")


def with_next(docs: DataFrame, scratch: Scratch, rows_a_part: int = 2000) -> DataFrame:
    """Rows (doc_id, text, hash, part, own) so that a window over a part, ordered by doc_id and hash, sees every row's successor.

    The ids are cut in ranges of about rows_a_part rows at approximate quantiles of their keys, a bounded array of numbers; rows
    without an id, which come first, in 64 ranges of their texts' hashes. The first row of a range is copied to the end of
    the one before (own = false), and the first of all to the end of the last. One shuffle moves the texts; no task holds
    more than one range at a time.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", range_key(docs).alias("key"), text.alias("text"), F.xxhash64(text).alias("hash"))
    keys = rows.select("key").filter("key IS NOT NULL")
    n = keys.count()
    parts = max(1, min(n // rows_a_part, 1 << 14))
    cuts = sorted(set(keys.approxQuantile("key", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    cuts = [int(c) for c in cuts]
    steps = 1 << max(len(cuts), 1).bit_length()
    limits = F.array(*(F.lit(c).cast("long") for c in [*cuts, *[2**63 - 1] * (steps - len(cuts))]))
    # binary search: how many cuts are at most the key
    found = F.aggregate(F.array(*(F.lit(steps >> i) for i in range(1, steps.bit_length()))), F.lit(0), lambda at, step: F.when(F.get(limits, at + step - 1) <= F.col("key"), at + step).otherwise(at))
    rows = rows.withColumn("part", F.when(F.col("key").isNull(), F.shiftright("hash", 58).cast("int") - 32).otherwise(found)).drop("key")
    firsts = rows.groupBy("part").agg(F.min(F.struct("doc_id", "hash")).alias("first"))
    in_order = W.orderBy("part")  # at most (1 << 14) + 64 rows
    into = F.coalesce(F.lag("part").over(in_order), F.max("part").over(in_order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    firsts = scratch.save(firsts.select(F.col("part").alias("of"), F.col("first.doc_id").alias("id"), F.col("first.hash").alias("its_hash"), into.alias("into")), "firsts")
    same = (F.col("part") == F.col("of")) & (F.col("hash") == F.col("its_hash")) & F.col("doc_id").eqNullSafe(F.col("id"))
    copies = rows.join(F.broadcast(firsts), same).dropDuplicates(["of"])
    return rows.withColumn("own", F.lit(True)).unionByName(copies.select("doc_id", "text", "hash", F.col("into").alias("part"), F.lit(False).alias("own")))


def fingerprint_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half is the start of the next document's text.

    The next document is that of the next doc_id (null first; of rows with the same id, the texts' hashes decide), and
    the first one's after the last.
    """
    scratch = Scratch(docs.sparkSession, "fingerprints")
    rows = with_next(docs, scratch)
    parts = rows.withColumn("last", (~F.col("own")).cast("int"))
    order = W.partitionBy("part").orderBy("last", "doc_id", "hash")
    rows = with_sketch(parts.withColumn("next_text", F.lead("text").over(order)), "text", "sketch", k)
    rows = rows.withColumn("next_sketch", F.lead("sketch").over(order)).filter("own")
    chars = F.char_length("text").cast("long")
    rows = rows.withColumn("n_chars", chars).withColumn("moved", F.expr("cast(n_chars div 2 as int)"))
    edited = F.concat(F.left(F.col("text"), (F.col("n_chars") - F.col("moved")).cast("int")), F.left(F.coalesce("next_text", "text"), F.col("moved")))
    rows = with_sketch(rows.withColumn("edited", edited), "edited", "edited_sketch", k)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        encode(F.col("sketch")).alias("fingerprint"),
        encode(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.coalesce("next_sketch", "sketch"), k).alias("near_next"),
        distinct_estimate(F.col("sketch"), k).alias("distinct_shingles"),
        containment(F.col("edited_sketch"), F.col("sketch"), k).alias("edited_within"),
    )
