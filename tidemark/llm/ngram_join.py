"""N-gram Jaccard join: near-duplicate documents as connected components, exactly.

A document's set holds the distinct hashes of its 5-word shingles. Documents of equal sets are one class. As linked
sets A and B share at least n - n div 5 of A's n shingles, all sieves are necessary conditions, so no link is lost:

1. Sieve: of the shingles in five sixteenths of the hash range, those that only one class has are at most n div 5.
2. Among the classes left, shingles get their exact count. A class with more than n div 5 that no other has is out;
   the rest keep their shared shingles only, rarest first, and of these the prefix that any link must meet.
3. Tiles: classes of two neighbouring size bands that have a prefix shingle in common. Hashed bitmaps bound the overlap
   of a pair from above by bit counts, and what passes is intersected exactly. A pair within a component needs no look.
   First come two rounds of stars, in which a class meets one class of its tiles, drawn anew each round, so that groups
   of near copies fall together; they settle the most part of the rows that would fill tiles.
4. Tile rounds: of the tiles that still join several components, every class puts forward its best candidates by
   bitmap, a few in the first round and sixteen times as many in each further one. The links found join components, so a
   group of near copies becomes one long before its pairs are through. The rounds end when no class had more candidates
   than it put forward: then every pair of different components that the bitmaps let pass has been intersected. Tiles of
   very many classes are cut in blocks, two to a task.

Defined results: null and empty texts have no set, link with nothing and are their own component; repeated rows share
a component; a document with a null doc_id counts in its component but is not its name, unless all are null; an empty
table gives an empty result. Columns beyond doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.shared import Scratch, ascii_lower, small, tasks, tokens, whole_groups

SHINGLE = 5
#: Classes of a block; two blocks' bitmaps are held in a task, and their pairs bounded there.
BLOCK_ROWS = 2048
STAR_ROUNDS = 2
#: Candidates that a class puts forward in a tile in the first round, and how many times more in the next one.
CANDIDATES, MORE = 4, 16


def with_set(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns named in keep, arr: the sorted distinct shingle hashes."""
    rows = docs.select("doc_id", *keep, F.transform(tokens(ascii_lower(F.col("text"))), lambda w: F.xxhash64(w)).alias("h"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("h") - SHINGLE, F.lit(0)))
    runs = F.transform(starts, lambda i: F.xxhash64(*(F.get("h", i + j) for j in range(SHINGLE))))
    return rows.select("doc_id", *keep, F.when(F.size("h") > 0, F.sort_array(F.array_distinct(runs))).otherwise(F.array().cast("array<long>")).alias("arr"))


def may_miss(n: str = "n") -> Column:
    """So many shingles of a set may be missing from one it links with."""
    return F.expr(f"{n} div 5")


def band(n: str = "n") -> Column:
    """Sets that link are of one band or of two neighbouring ones."""
    return F.floor(F.log(F.col(n).cast("double")) / F.log(F.lit(1.25)) - 1e-9).cast("int")


def linked(common: Column, n_a: Column, n_b: Column) -> Column:
    """common / union >= 0.8"""
    return 9 * common >= 4 * (n_a + n_b)


def sieve(members: DataFrame, scratch: Scratch) -> DataFrame:
    """sid, doc_id: classes that may link with another, and the document that stands for each."""
    classes = members.filter("n > 0").groupBy("sid", "n").agg(F.min(_key()).alias("id"), F.count("*").alias("times"), F.max(F.size("part")).alias("part"))
    classes = scratch.save(classes, "classes")
    copies = members.select("sid", _key().alias("id")).join(classes.filter("times > 1").select("sid", F.col("id").alias("keep")), "sid").filter("id <> keep")
    copies = scratch.save(copies.select("id", "sid").distinct(), "copies")
    total = classes.agg(F.sum("part")).first()[0] or 1
    mask = (1 << min(59, max(24, int(total).bit_length() + 8))) - 1  # enough bits that few shingles meet by chance, which only lets more pass
    rows = members.select(_key().alias("id"), "sid", "part").join(small(copies), ["id", "sid"], "left_anti")
    rows = _exploded(rows, "part", "sid").withColumn("s", F.col("s").bitwiseAND(F.lit(mask)))
    again = rows.groupBy("s").count().filter("count > 1").select("s")
    met = rows.join(again, "s").groupBy("sid", "s").agg(F.lit(1).alias("one")).groupBy("sid").agg(F.count("*").alias("met"))
    left = classes.join(met, "sid", "left").filter(F.coalesce("met", F.lit(0)) >= F.col("part") - may_miss())
    return scratch.save(left.select("sid", "id"), "left")


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("-null-"))


def _exploded(df: DataFrame, array: str, *keep: str) -> DataFrame:
    """keep and s, for each s of the array. Outer, as an inner explode would make the array once more to see if it is empty."""
    return df.select(*keep, F.explode_outer(array).alias("s")).filter("s IS NOT NULL")


def _part() -> Column:
    """Five sixteenths of the set, without the bits that tell which."""
    return F.transform(F.filter("arr", lambda s: s.bitwiseAND(F.lit(15)) < 5), lambda s: F.shiftrightunsigned(s, 4))


def shared_sets(docs: DataFrame, left: DataFrame, scratch: Scratch) -> DataFrame:
    """sid, n, arr (its shared shingles, sorted), prefix: of the classes that may still link."""
    texts = docs.select("doc_id", "text", _key().alias("id")).join(small(left), "id")
    # written before its hash is compared: a filter on it would be pushed below and make the sets' parts over and over
    full = scratch.save(with_set(texts.select("doc_id", "text", "sid"), "sid").select("sid", F.size("arr").alias("n"), "arr", F.xxhash64("arr").alias("own")), "candidates")
    full = scratch.save(full.filter("own = sid").select("sid", "n", "arr").dropDuplicates(["sid"]), "full")
    rows = _exploded(full, "arr", "sid", "n")
    counts = rows.groupBy("s").agg(F.count("*").alias("df")).filter("df > 1")
    lists = rows.join(counts, "s").groupBy("sid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("r"))
    need = F.col("n") - may_miss()
    lists = lists.filter(F.size("r") >= need)
    lists = lists.select("sid", "n", F.sort_array("r.s").alias("arr"), F.slice("r.s", F.lit(1), (F.size("r") - need + 1).cast("int")).alias("prefix"))
    return scratch.save(lists, "shared")


def tiles(prefixes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """s, tile, high, sid, comp: a class lies in the tile of its size band, and as high in that of the band below."""
    rows = prefixes.withColumn("comp", F.col("sid"))
    if labels is not None:
        rows = prefixes.join(labels.select(F.col("node").alias("sid"), "comp"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    places = F.array(F.struct(F.col("band").alias("tile"), F.lit(False).alias("high")), F.struct((F.col("band") - 1).alias("tile"), F.lit(True).alias("high")))
    return rows.select("s", "sid", "comp", F.explode(places).alias("t")).select("s", "t.tile", "t.high", "sid", "comp")


def verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that link."""
    a, b = (sets.select(F.col("sid").alias(k), F.col("n").alias(f"n_{k}"), F.col("arr").alias(f"arr_{k}")) for k in ("a", "b"))
    pairs = pairs.select("a", "b").join(a, "a").join(b, "b")
    return pairs.filter(linked(F.size(F.array_intersect("arr_a", "arr_b")), F.col("n_a"), F.col("n_b"))).select("a", "b")


def star_pairs(tiled: DataFrame, turn: int) -> DataFrame:
    """a, b: each class with the class of another component that it meets most often among those drawn for its tiles in this turn."""
    drawn = F.min(F.struct(F.xxhash64("sid", F.lit(turn)).alias("lot"), "comp", "sid")).alias("drawn")
    drawn = tiled.groupBy("s", "tile").agg(drawn, F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("s", "tile", "drawn")
    met = tiled.join(drawn, ["s", "tile"]).filter("comp <> drawn.comp").groupBy("sid", F.col("drawn.sid").alias("pivot")).agg(F.count("*").alias("shared"))
    return met.groupBy(F.col("sid").alias("a")).agg(F.max(F.struct("shared", "pivot")).alias("best")).select("a", F.col("best.pivot").alias("b"))


def with_bitmaps(sets: DataFrame) -> DataFrame:
    """sid, n, count, bitmap: hashed bits of each set, at least four times as many as it has elements."""

    def sign(batches):
        for batch in batches:
            arrays = [np.asarray(a.values.to_numpy(zero_copy_only=False), np.int64) for a in batch.column(2)]
            maps = [bitmap(a) for a in arrays]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(len, arrays), pa.int64()), pa.array(maps, pa.binary())], names=["sid", "n", "count", "bitmap"])

    return sets.select("sid", F.col("n").cast("long"), "arr").mapInArrow(sign, "sid long, n long, count long, bitmap binary")


def bitmap(values: np.ndarray) -> bytes:
    bits = 64 << max(2, int(len(values) // 16).bit_length())
    out = np.zeros(bits, bool)
    out[(values.view(np.uint64) >> np.uint64(7)) % np.uint64(bits)] = True
    return np.packbits(out, bitorder="little").tobytes()


def folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps of one width, the smallest: halves of a wider one are put on each other."""
    width, out = min(map(len, maps)) // 8, []
    for m in maps:
        words = np.frombuffer(m, np.uint64)
        while len(words) > width:
            words = words[: len(words) // 2] | words[len(words) // 2 :]
        out.append(words)
    return np.array(out)


def bounded(signs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bitmaps leave room for a link."""
    x, y = (signs.select(F.col("sid").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("n", "count", "bitmap"))) for k in "ab")

    def bound(batches):
        for batch in batches:
            n_a, n_b, count_a, count_b = (batch.column(f"{c}_{k}").to_numpy() for c in ("n", "count") for k in "ab")
            apart = np.array([int(np.bitwise_count(np.bitwise_xor(*folded([m.as_py(), o.as_py()]))).sum()) for m, o in zip(batch.column("bitmap_a"), batch.column("bitmap_b"), strict=True)], np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(9 * ((count_a + count_b - apart) // 2) >= 4 * (n_a + n_b)))

    return pairs.join(x, "a").join(y, "b").filter("5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)").mapInArrow(bound, "a long, b long")


def candidates(sid: np.ndarray, n: np.ndarray, count: np.ndarray, comp: np.ndarray, high: np.ndarray, block: np.ndarray, maps: np.ndarray, apart: bool, most: int) -> tuple[list[tuple[int, int]], bool]:
    """Of a tile, for each class at most so many smaller ones of other components, the best by bitmap; and whether there were more.

    apart: of two blocks, so that pairs within one are left to the tile that it forms with itself.
    """
    order = np.lexsort((sid, n))
    sid, n, count, comp, high, block, maps = (v[order] for v in (sid, n, count, comp, high, block, maps))
    found, more = [], False
    for x in range(1, len(sid)):
        low = int(np.searchsorted(n, -(-4 * n[x] // 5)))  # smaller ones can't link
        could = (comp[low:x] != comp[x]) & ~(high[low:x] & high[x])
        if apart:
            could &= block[low:x] != block[x]
        ys = np.flatnonzero(could) + low
        if not len(ys):
            continue
        common = (count[ys] + count[x] - np.bitwise_count(maps[ys] ^ maps[x]).sum(1, dtype=np.int64)) // 2
        room = 9 * common >= 4 * (n[ys] + n[x])
        ys, common = ys[room], common[room]
        if len(ys) > most:
            more = True
            ys = ys[np.argsort(-(common / (n[ys] + n[x])), kind="stable")[:most]]
        found += [(int(sid[x]), int(sid[y])) for y in ys]
    return found, more


def tile_candidates(signs: DataFrame, tiled: DataFrame, scratch: Scratch, turn: int, most: int) -> DataFrame:
    """a, b, more: the candidates of all tiles of several components, and in rows without a pair, that a tile has more."""
    open_tiles = tiled.groupBy("s", "tile").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("rows"), F.count_if(~F.col("high")).alias("low")).filter("x <> y AND low > 0")
    rows = scratch.save(tiled.join(open_tiles.select("s", "tile", "rows"), ["s", "tile"]), f"open-tiles-{turn}")
    rows = rows.withColumn("blocks", F.ceil(F.col("rows") / BLOCK_ROWS))
    rows = rows.withColumns({"block": F.pmod(F.xxhash64("sid"), F.col("blocks")), "tile": F.col("tile").cast("long")})
    other = F.when(F.col("blocks") > 1, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(F.lit(0).cast("long")))
    rows = rows.withColumn("other", F.explode(other)).withColumns({"first_block": F.least("block", "other"), "last_block": F.greatest("block", "other")})
    keys = ("s", "tile", "first_block", "last_block")
    rows = rows.join(signs, "sid").select(*keys, "sid", "n", "count", "comp", "high", "block", "bitmap")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts in whole_groups(batches, keys):
            sid, n, count, comp, high, block, first, last = (part.column(c).to_numpy() for c in ("sid", "n", "count", "comp", "high", "block", "first_block", "last_block"))
            maps, pairs, more = part.column("bitmap").combine_chunks(), set(), False
            for i, j in zip(starts[:-1], starts[1:], strict=True):
                if j - i > 1:
                    found, rest = candidates(sid[i:j], n[i:j], count[i:j], comp[i:j], high[i:j], block[i:j], folded(maps[i:j].to_pylist()), first[i] != last[i], most)
                    pairs.update((min(p), max(p)) for p in found)
                    more |= rest
            rows = [(a, b, False) for a, b in sorted(pairs)] + [(None, None, True)] * more
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.bool_())], names=["a", "b", "more"])

    found = rows.repartition(tasks(signs), *keys).sortWithinPartitions(*keys).mapInArrow(scan, "a long, b long, more boolean")
    return scratch.save(found.distinct(), f"pairs-{turn}")


def tile_rounds(sets: DataFrame, signs: DataFrame, prefixes: DataFrame, labels: DataFrame | None, scratch: Scratch) -> DataFrame:
    """labels with all components that the tiles join."""
    turn, most, tested = 0, CANDIDATES, None
    while True:
        found = tile_candidates(signs, tiles(prefixes, labels), scratch, turn, most)
        pairs = found.filter("NOT more").select("a", "b")
        new = pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")
        edges = scratch.save(verified(sets, new), f"rest-{turn}")
        labels = joined_labels(labels, edges, scratch, f"rest-{turn}")
        if found.filter("more").isEmpty():
            return labels
        tested = pairs if tested is None else tested.unionByName(pairs)
        turn, most = turn + 1, most * MORE


def joined_labels(labels: DataFrame | None, edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """labels (node, comp) with the components that edges (a, b) of nodes connect."""
    if labels is None:
        return components(edges, scratch, name)
    if edges.isEmpty():
        return labels
    to = lambda e, c: e.join(labels.select(F.col("node").alias(c), F.col("comp").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    merged = components(scratch.save(to(to(edges, "a"), "b"), f"{name}-between"), scratch, name)
    moved = labels.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("further")), "comp", "left").select("node", F.coalesce("further", "comp").alias("comp"))
    return scratch.save(moved.unionByName(merged).distinct(), f"{name}-labels")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    scratch = Scratch(docs.sparkSession, "ngrams")
    members = with_set(docs).select("doc_id", F.size("arr").cast("long").alias("n"), F.xxhash64("arr").alias("sid"), _part().alias("part"))
    members = scratch.save(members, "members")
    left = sieve(members, scratch)
    sets = shared_sets(docs, left, scratch)
    prefixes = scratch.save(_exploded(sets.withColumn("band", band()), "prefix", "sid", "band"), "prefixes")
    signs = scratch.save(with_bitmaps(sets), "bitmaps")
    labels: DataFrame | None = None
    for k in range(STAR_ROUNDS):
        pairs = scratch.save(bounded(signs, star_pairs(tiles(prefixes, labels), k)), f"star-pairs-{k}")
        edges = scratch.save(verified(sets, pairs), f"stars-{k}")
        labels = joined_labels(labels, edges, scratch, f"star-{k}")
    labels = tile_rounds(sets, signs, prefixes, labels, scratch)
    named = members.join(labels.select(F.col("node").alias("sid"), "comp"), "sid", "left")
    named = scratch.save(named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "sid").alias("comp")), "named")
    # only components of several documents have to be named by a join; written, so that a hot one's rows can be dealt to several tasks
    names = named.filter("n_shingles > 0").groupBy("comp").agg(F.min("doc_id").alias("name"), F.count("*").alias("documents")).filter("documents > 1")
    names = scratch.save(names.select("comp", "name"), "names")
    out = named.join(small(names), "comp", "left").withColumn("alone", F.col("name").isNull() | (F.col("n_shingles") == 0))
    return out.select("doc_id", "n_shingles", F.when(F.col("alone"), F.col("doc_id")).otherwise(F.col("name")).alias("component_id"))
