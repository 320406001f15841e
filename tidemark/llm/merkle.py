"""Merkle manifest of a dataset: a digest a document, a tree a language, a tree over these, and a proof a document.

Leaves are range-sorted by tree and doc_id and numbered without a window over a whole tree: a row's number is its place in
its task's sorted part plus what the parts before it hold of the tree. Floor-dividing the numbers by the fanout gives runs;
a run's sorted children are hashed into the next level's node, level by level, each a written table an eighth as large as
the one below. Proofs come back down: joined with its run's node, a child has that node's siblings after its own. Only
digests are shuffled, never texts, and the keys are (tree, run), so that a tree with most of the rows is spread as any other.

Defined results: nulls in any column are told by `-`; a null doc_id comes first in its tree and is not tampered with; rows
of the same doc_id are in order of their leaves, and equal rows are leaves of their own; a tree of one leaf is that leaf and
one tree's subroot is the root; without siblings a proof is the digest of nothing; an empty table gives an empty result and
no root. Texts of any length are hashed whole. Columns beyond the named ones are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.shared import UPPER, Scratch, small

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 8


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def leaf(**replaced: Column) -> Column:
    """The digest of a row's FIELDS; replaced: other values for some of them."""
    told = []
    for name in FIELDS:
        value = replaced.get(name, F.col(name)).cast("string")
        told.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return digest(F.concat(*told))


def numbered(rows: DataFrame, order: tuple[str, ...], scratch: Scratch, name: str) -> DataFrame:
    """rows, which have a `tree` that isn't null, with idx, their place from 0 in it by order, and n, the rows of the tree."""
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ranged = scratch.save(ranged.withColumn("at", F.monotonically_increasing_id()), f"{name}-sorted")  # the task's number, then the row's in the task
    ranged = ranged.withColumn("part", F.shiftright("at", 33))
    parts = ranged.groupBy("tree", "part").agg(F.count("*").alias("n_part"), F.min("at").alias("first"))
    whole = W.partitionBy("tree")  # has a row a task
    before = F.coalesce(F.sum("n_part").over(whole.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("tree", "part", F.sum("n_part").over(whole).alias("n"), (before - F.col("first")).alias("shift"))
    parts = scratch.save(parts, f"{name}-parts")
    return ranged.join(small(parts), ["tree", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift")


@dataclass(frozen=True)
class Levels:
    """runs: from the leaves up, (tree, run, n, nodes, hash): the children in order and their run's digest; n counts the level's nodes in the tree.
    tops: (tree, hash) of the last node of every tree."""

    runs: list[DataFrame]
    tops: DataFrame
    fanout: int


def grow(leaves: DataFrame, scratch: Scratch, name: str, fanout: int = FANOUT) -> Levels:
    """leaves: tree, idx, n, hash and any other columns, which stay with the leaves."""
    runs, tops, nodes = [], [], leaves
    while True:
        tops.append(nodes.filter("n = 1").select("tree", "hash"))
        others = [c for c in nodes.columns if c not in ("tree", "idx", "n", "hash")]
        found = nodes.filter("n > 1").groupBy("tree", F.expr(f"idx div {fanout}").alias("run"))
        found = found.agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("idx", "hash", *others))).alias("nodes"))
        found = scratch.save(found.withColumn("hash", digest(F.array_join("nodes.hash", ""))), f"{name}-{len(runs)}")
        if found.isEmpty():
            return Levels(runs, reduce(DataFrame.union, tops), fanout)
        runs.append(found)
        nodes = found.select("tree", F.col("run").alias("idx"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), "hash")


def descend(levels: Levels, tops: DataFrame) -> DataFrame | None:
    """The leaves of trees of several with what tops (tree, path, others) says of their tree. path: by level, from the leaf up,
    the digests before and after the node in its run, each joined to one string. None if no tree has several leaves."""
    below = None
    others = [c for c in tops.columns if c not in ("tree", "path")]
    for runs in reversed(levels.runs):
        told = runs.filter(f"n <= {levels.fanout}").join(tops, "tree")
        if below is not None:
            above = below.select("tree", F.col("idx").alias("run"), "path", *others)
            told = told.unionByName(runs.filter(f"n > {levels.fanout}").join(above, ["tree", "run"]))
        told = told.select("tree", "path", *others, F.col("nodes.hash").alias("hashes"), F.posexplode("nodes").alias("place", "node"))
        own = F.struct(F.array_join(F.slice("hashes", F.lit(1), F.col("place")), "").alias("before"), F.array_join(F.slice("hashes", F.col("place") + 2, F.lit(levels.fanout)), "").alias("after"))
        below = told.select("tree", F.concat(F.array(own), F.col("path")).alias("path"), *others, "node.*")
    return below


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda h, level: digest(F.concat(level["before"], h, level["after"])))


def siblings(path: Column) -> Column:
    """All digests of a path, level by level, left to right, as one string."""
    return F.array_join(F.transform(path, lambda level: F.concat(level["before"], level["after"])), "")


NO_PATH = "cast(array() as array<struct<before: string, after: string>>)"


@dataclass(frozen=True)
class Manifest:
    """proofs: the leaves' columns with leaf, subroot and path; trees: lang and subroot; root: None of an empty table."""

    proofs: DataFrame
    trees: DataFrame
    root: str | None


def build_manifest(leaves: DataFrame, scratch: Scratch, fanout: int = FANOUT) -> Manifest:
    """leaves: doc_id, lang, leaf and any columns that should stay with them; a tree a lang."""
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))  # null first, then by bytes
    rows = numbered(scratch.save(leaves.withColumn("tree", tree).withColumnRenamed("leaf", "hash"), "leaves"), ("doc_id", "hash"), scratch, "docs")
    levels = grow(rows, scratch, "docs", fanout)
    tops = scratch.save(levels.tops.select(F.lit("").alias("tree"), F.col("tree").alias("lang_tree"), "hash"), "subroots")
    upper_rows = numbered(tops, ("lang_tree",), scratch, "langs")
    upper = grow(upper_rows, scratch, "langs", fanout)
    found = upper.tops.head()
    root = found["hash"] if found else None
    alone = upper_rows.filter("n = 1").select("lang_tree", "hash", F.expr(NO_PATH).alias("path"))
    several = descend(upper, upper.tops.select("tree", F.expr(NO_PATH).alias("path")))
    named = alone if several is None else alone.unionByName(several.select("lang_tree", "hash", "path"))
    named = scratch.save(named.select(F.col("lang_tree").alias("tree"), F.col("hash").alias("subroot"), "path"), "named")
    wanted = ["doc_id", "lang", F.col("hash").alias("leaf"), *(c for c in leaves.columns if c not in ("doc_id", "lang", "leaf")), "subroot", "path"]
    proofs = rows.filter("n = 1").join(named, "tree").select(*wanted)
    below = descend(levels, named)
    proofs = proofs if below is None else proofs.unionByName(below.select(*wanted))
    trees = named.select(F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30)).alias("lang"), "subroot")
    return Manifest(proofs, trees, root)


def verify_tampering(docs: DataFrame, fanout: int = FANOUT, tampered_in: int = 3) -> DataFrame:
    """The manifest of docs and what its proofs say of texts put into lower case (A-Z) where tampered_in divides the doc_id's crc32:
    doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    lower = F.translate(F.col("text"), UPPER, UPPER.lower())
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % tampered_in == 0, F.lit(False))
    leaves = docs.select("doc_id", "lang", leaf().alias("leaf"), F.when(chosen & (lower != F.col("text")), leaf(text=lower)).alias("tampered"))
    made = build_manifest(leaves, Scratch(docs.sparkSession, "merkle"), fanout)
    again = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    found = made.proofs.select("doc_id", "leaf", "subroot", F.lit(made.root).cast("string").alias("root"), digest(siblings(F.col("path"))).alias("proof_sha256"), again.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
