"""Benchmark decontamination: a prefix-filtered set join of document shingles with item windows.

An item is cut in windows of 10 consecutive words (one window, if it has fewer), a window in shingles of 5 words (or
of the whole, shorter window). Shingles are ordered by rarity: how often all documents have a shingle's words, rarest
word first, which bounds how often they have the shingle; words are counted by partial aggregates, shingles aren't.
As a window has to be contained whole, its prefix is its rarest shingle alone. Only prefixes meet the documents: where
one stands, a window begins at the place less the shingle's offset; length and position bounds drop starts at which the
window would not fit, and the words from the start on are compared with the window's, one by one, in the same pass. A
window with a word that no document has cannot occur and is dropped before.

The prefixes are broadcast; beyond the bound of a broadcast they are cut in pieces that keep it, and each piece goes over
the documents in a pass of its own, as a shuffle would move every shingle of the corpus.

Defined results: null and empty texts have no words; items without words have no windows; repeated documents have
equal results, repeated items count once by item_id; a null item_id is no item; empty tables give no hits, or an empty
result. Columns beyond the ids and texts are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.shared import BROADCAST_BYTES, BROADCAST_ROWS, Scratch, fits, small, words

WINDOW, SHINGLE = 10, 5
DOC = ("doc_id", "text_hash")


def document_words(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, w: words, h: their hashes."""
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), words(F.col("text")).alias("w")).withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))


def shingles(h: str, size: int) -> Column:
    """Hashes of all runs of so many words of the column h, in order."""
    runs = F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(size))))
    return F.when(F.size(h) >= size, runs).otherwise(F.array().cast("array<long>"))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, win (the window's words), window (the same as one string)."""
    items = benchmark.filter("item_id IS NOT NULL").select("item_id", words(F.col("text")).alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    wins = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, F.lit(window)))).alias("win")).distinct()
    return wins.withColumn("window", F.array_join("win", " "))


def word_counts(docs: DataFrame, item_words: DataFrame) -> DataFrame:
    """word (its hash), n: how often all documents have each of the item words (a written table)."""
    # outer, as an inner explode would split the texts once more to see if there are any
    seen = docs.select(F.explode_outer(F.transform(words(F.col("text")), lambda w: F.xxhash64(w))).alias("word"))
    if fits(item_words):
        return seen.join(F.broadcast(item_words), "word").groupBy("word").agg(F.count("*").alias("n"))
    return seen.groupBy("word").agg(F.count("*").alias("n")).join(item_words, "word")


def prefixes(wins: DataFrame, docs: DataFrame, scratch: Scratch, shingle: int = SHINGLE) -> DataFrame:
    """s, j (the rarest shingle's hash and its offset), q (its words), win: once for each distinct window that may occur."""
    distinct = scratch.save(wins.select("win", "window").dropDuplicates(["window"]), "distinct")
    placed = scratch.save(distinct.select("window", F.posexplode(F.transform("win", lambda w: F.xxhash64(w))).alias("at", "word")), "window-words")
    counts = scratch.save(word_counts(docs, scratch.save(placed.select("word").distinct(), "item-words")), "word-counts")
    placed = placed.join(small(counts), "word", "left").groupBy("window")
    known = placed.agg(F.array_sort(F.collect_list(F.struct("at", "n", "word"))).alias("of"), F.count_if(F.col("n").isNull()).alias("absent"))
    known = known.filter("absent = 0").select("window", F.col("of.n").alias("ns"), F.col("of.word").alias("h"), F.least(F.size("of"), F.lit(shingle)).alias("q"))

    def rarest(q: int) -> Column:
        each = F.transform(shingles("h", q), lambda s, j: F.struct(F.array_sort(F.slice("ns", j + 1, F.lit(q))).alias("rarity"), s.alias("s"), j.alias("j")))
        return F.when(F.col("q") == q, F.array_min(each))

    known = known.withColumn("rarest", F.coalesce(*(rarest(q) for q in range(1, shingle + 1))))
    return scratch.save(known.join(distinct, "window").select("rarest.s", "rarest.j", "q", "win"), "prefixes")


def pieces(prefix: DataFrame) -> list[DataFrame]:
    """The prefixes, a written table, in as few equal pieces by their windows as are broadcast safely."""
    row = prefix.agg(F.count("*").alias("rows"), F.sum(F.octet_length(F.array_join("win", "")) + 16 * F.size("win") + 64).alias("bytes")).first()
    n = 1 + int(2 * max(row["rows"] / BROADCAST_ROWS, (row["bytes"] or 0) / BROADCAST_BYTES))
    part = F.pmod(F.xxhash64("win"), F.lit(n))
    return [F.broadcast(prefix.filter(part == k) if n > 1 else prefix) for k in range(n)]


def find_windows(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Occurrences (doc_id, text_hash, start, len, window), and the windows (item_id, window)."""
    wins = scratch.save(item_windows(benchmark, window), "windows")
    prefix = prefixes(wins, docs, scratch, shingle)
    sizes = sorted(r["q"] for r in prefix.select("q").distinct().collect())  # at most as many as a shingle has words
    placed, long = document_words(docs), F.size("win")
    start = F.col("pos") - F.col("j")
    fitting = (start >= 0) & (start + long <= F.size("w")) & (F.slice("w", F.greatest(start, F.lit(0)) + 1, long) == F.col("win"))
    hits = docs.select("doc_id", F.lit(0).cast("long").alias("text_hash"), F.lit(0).alias("start"), F.lit(0).alias("len"), F.lit("").alias("window")).limit(0)
    for piece in pieces(prefix):
        for q in sizes:
            # the shingles are a column before they are exploded, so that a document's words are not copied to each of them
            runs = placed.select(*DOC, "w", shingles("h", q).alias("runs")).select(*DOC, "w", F.posexplode_outer("runs").alias("pos", "s"))
            met = runs.join(piece.filter(F.col("q") == q), "s").filter(fitting)
            hits = hits.unionByName(met.select(*DOC, start.alias("start"), long.alias("len"), F.array_join("win", " ").alias("window")))
    return hits.distinct(), wins.select("item_id", "window")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    scratch = Scratch(docs.sparkSession, "decontamination")
    hits, wins = find_windows(docs, benchmark, scratch, window, shingle)
    hits = scratch.save(hits, "hits")
    order = W.partitionBy(*DOC).orderBy("start", "len")
    before = F.coalesce(F.max(F.col("start") + F.col("len")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = hits.select(*DOC, "start", "len").distinct()
    covered = spans.withColumn("new", F.greatest(F.lit(0), F.col("start") + F.col("len") - F.greatest("start", before)))
    covered = covered.groupBy(*DOC).agg(F.sum("new").alias("n_hit"))
    items = hits.select(*DOC, "window").distinct().join(small(scratch.save(wins, "item-windows")), "window").select(*DOC, "item_id").distinct()
    items = items.groupBy(*DOC).agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ",").alias("ids"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("-null-")).alias("_id")
    texts = docs.select("doc_id", key, F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = texts.join(covered.select(key, "text_hash", "n_hit"), ["_id", "text_hash"], "left").join(items.select(key, "text_hash", "n_items", "ids"), ["_id", "text_hash"], "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
