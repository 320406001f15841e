"""Line deduplication by a deletion-neighbourhood join.

A line of at least min_chars code points is dropped if an earlier line of the corpus is equal to it, within one edit
(a code point inserted, deleted or replaced), or, with run, within (m - run) // (run + 1) word edits, m being the words
of the longer line. Earlier means smaller (doc_id, text hash, line number), that of a distinct line being its first
occurrence; what an earlier line's own fate is does not matter. Shorter lines stay or, with short_equal, go too if an
earlier line is equal; lines of white space alone stay.

The variants of a line are: the line with one code point blanked, keyed with its place, and the line with one code
point deleted, which the line one shorter meets with itself. Lines that share a blanked variant are all one edit apart,
and a shared deletion links the shorter line with each longer one; so the earliest line of a key is all that its others
need, and no pairs within a group are made. Emitting every variant of every line would be many times the corpus; two
coarser neighbourhoods come first, each necessary for the next: lines one edit apart agree on one half, and then on
all but one sixteenth; only places in the sixteenths that agree elsewhere emit variants. Found pairs are verified by
their edit distance.

Word edits: a word is what stands from one start to the next; a line's start, the first code point after white space, and
every code point from U+0800 (scripts without spaces) are starts. Lines within k word edits keep all but k of the words
of the longer one, so of its k + 1 first words, in any order that holds for all lines, the two share one that no edit
has touched. Longer words come first, as they are rarer. These k + 1 words are a line's keys; places and lengths have
to agree within the bound too, and of 64 parities of words two at most differ for each edit. Rows that have no such
partner under their key leave; those that stay get 256 parities. In rounds, each line that is not yet near puts forward
a few earlier ones, sixteen times as many in each further round, and their edit distance is verified; the rounds end
when no such line had more to put forward. So a group of near lines costs rows in proportion to its lines, and none of its lines is left unseen. Lines
so long that two word edits are allowed need no variants of code points, as one code point is two word edits at most.

Defined results: a null text stays null and has no lines; an empty one stays empty; repeated rows of a doc_id with the
same text are one document and share its fate; a null doc_id comes first in order; an empty table gives an empty
result. Columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import BROADCAST_ROWS, Scratch, fits, small, tasks, whole_groups

MIN_CHARS = 20
PARTS = 16
#: Words of an unchanged run that near lines share at least: of 17 words one may differ, of each 9 more another one.
RUN = 8
#: Earlier lines that a line puts forward in the first round, and how many times more in the next one.
CANDIDATES, MORE = 2, 16
_STARTS = re.compile(r"(?<=[\t-\r ])(?=[^\t-\r ])|(?=[\u0800-\U0010ffff])")
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
LINE = ["h1", "h2"]


def _lines(docs: DataFrame, min_chars: int, short: bool = False) -> DataFrame:
    """doc_id, text_hash, pos, line, n, h1, h2: every line that may be dropped."""
    rows = docs.filter("text IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("text_hash"))  # before lines are made, or it would be hashed for each of them
    rows = rows.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.withColumn("n", F.char_length("line")).filter((F.col("n") >= min_chars) | (F.lit(short) & F.col("line").rlike(r"(?U)\S")))
    return rows.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def _half_keys() -> Column:
    """Of the line as one of n code points, and as one with a code point more than n - 1."""
    keys = []
    for m in (F.col("n"), F.col("n") - 1):
        half = F.floor(m / 2).cast("int")
        keys += [F.xxhash64(F.left("line", half), m, F.lit(0)), F.xxhash64(F.right("line", m - half), m, F.lit(1))]
    return F.array(*keys)


def _two_word_edits(run: int) -> Column:
    """Lines that surely have the words for a bound of two, told without splitting them: single spaces in between."""
    return (F.instr("line", "  ") == 0) & (F.col("n") - F.char_length(F.replace("line", F.lit(" "), F.lit(""))) >= 3 * run + 2)


def _at_first() -> Column:
    return F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.text_hash") == F.col("text_hash")) & (F.col("first.pos") == F.col("pos"))


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key other rows have too."""
    again = rows.groupBy(key).count().filter("count > 1").select(key)
    return rows.join(again, key)


def _without(start: Column, stop: Column) -> list[Column]:
    """The line's text before and after what is left out."""
    return [F.left("line", start), F.substring("line", stop + 1, F.greatest(F.col("n") - stop, F.lit(0)))]


def half_sharers(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """h1 of the lines that share a half with another one. lines: h1, h2, first, halves."""
    halves = lines.filter("halves IS NOT NULL").select("h1", F.explode("halves").alias("key"))
    again = scratch.save(halves.groupBy("key").count().filter("count > 1").select("key"), "again")
    return scratch.save(halves.join(small(again), "key").select("h1").distinct(), "chosen")


def near_lines(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """h1, h2 of the distinct lines within one edit of an earlier one. texts: h1, h2, first, line, n."""
    # the line as one of m code points (long = 0), and as one with a code point more (long = 1); all but one part of it
    roles = F.explode(F.sequence(F.lit(0), F.lit(2 * PARTS - 1))).alias("role")
    parts = texts.select("*", roles).withColumns({"long": F.expr(f"role div {PARTS}").cast("int"), "part": F.col("role") % PARTS})
    parts = parts.withColumn("m", F.col("n") - F.col("long"))
    parts = parts.withColumns({"lo": F.floor(F.col("part") * F.col("m") / PARTS).cast("int"), "hi": F.floor((F.col("part") + 1) * F.col("m") / PARTS).cast("int")})
    keyed = parts.select(*LINE, "long", "part", "lo", "hi", F.xxhash64(*_without(F.col("lo"), F.col("hi") + F.col("long")), "m", "part").alias("key"))
    places = scratch.save(_shared(keyed, "key").select(*LINE, "long", "lo", "hi").distinct(), "places")

    open_lines = texts.join(places, LINE)
    spots = open_lines.select(*LINE, "first", "line", "n", "long", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1 + F.col("long"))).alias("p"))
    blank_or_cut = F.when(F.col("long") == 0, F.xxhash64(*_without(F.col("p"), F.col("p") + 1), "n", "p")).otherwise(F.xxhash64(F.lit("cut"), F.concat(*_without(F.col("p"), F.col("p") + 1))))
    variants = spots.select(*LINE, "first", F.when(F.col("long") == 0, "blank").otherwise("cut").alias("kind"), blank_or_cut.alias("key"))
    whole = open_lines.filter("long = 0").select(*LINE, "first", F.lit("whole").alias("kind"), F.xxhash64(F.lit("cut"), "line").alias("key")).distinct()
    variants = scratch.save(variants.unionByName(whole).distinct(), "variants")
    earliest = variants.groupBy("key").agg(*(F.min(F.when(F.col("kind") == k, F.col("first"))).alias(k) for k in ("blank", "cut", "whole")), F.count("*").alias("n")).filter("n > 1").drop("n")
    partner = F.when(F.col("kind") == "blank", F.col("blank")).when(F.col("kind") == "cut", F.col("whole")).otherwise(F.col("cut"))
    pairs = variants.join(earliest, "key").withColumn("partner", partner).filter(F.col("partner") < F.col("first"))
    pairs = pairs.groupBy(*LINE).agg(F.min("partner").alias("partner"))
    own = texts.select(*LINE, "line")
    other = texts.select(F.struct(*(F.coalesce(F.col(f"first.{c}").cast("string"), F.lit("")).alias(c) for c in ("doc_id", "text_hash", "pos"))).alias("at"), F.col("line").alias("other"))
    at = F.struct(*(F.coalesce(F.col(f"partner.{c}").cast("string"), F.lit("")).alias(c) for c in ("doc_id", "text_hash", "pos"))).alias("at")
    checked = pairs.select(*LINE, at).join(own, LINE).join(other, "at")
    return checked.filter(F.levenshtein("line", "other", 1).between(0, 1)).select(*LINE).distinct()


def split_words(line: str) -> list[str]:
    """Words with the white space after them; together they are the line."""
    return [w for w in _STARTS.split(line) if w]


def word_bound(words: int, run: int) -> int:
    """Word edits that lines are near within, by the words of the longer one."""
    return max(0, (words - run) // (run + 1))


def within(a: list[str], b: list[str], bound: int) -> bool:
    """Whether a and b are at most bound words inserted, deleted or replaced apart."""
    goal = len(b) - len(a)
    if abs(goal) > bound or len(set(a) - set(b)) > bound or len(set(b) - set(a)) > bound:
        return False
    # of each diagonal (place in b less place in a), how far in a so many edits reach at most
    reach: dict[int, int] = {}
    for edits in range(bound + 1):
        new: dict[int, int] = {}
        left = bound - edits
        for d in range(max(-edits, goal - left), min(edits, goal + left) + 1):
            i = max(reach.get(d, -2) + 1, reach.get(d - 1, -2), reach.get(d + 1, -2) + 1) if edits else 0
            i = min(i, len(a), len(b) - d)
            if i < 0 or i + d < 0:
                continue
            while i < len(a) and i + d < len(b) and a[i] == b[i + d]:
                i += 1
            if d == goal and i == len(a):
                return True
            new[d] = i
        reach = new
    return False


@cache
def _powers(bits: int, base: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full((1 << bits) - 1, base, np.uint64))))


def _mixed(value: np.ndarray) -> np.ndarray:
    for shift, factor in zip((30, 27), _MIX, strict=True):
        value = (value ^ (value >> np.uint64(shift))) * factor
    return value ^ (value >> np.uint64(31))


def _word_hashes(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and bytes of each word, from sums over all bytes."""
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    bits = max(16, int(len(data)).bit_length())
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(bits, _BASE)[: len(data)], out=sums[1:])
    back = _powers(bits, pow(_BASE, -1, 1 << 64))
    return _mixed((sums[offsets[1:]] - sums[offsets[:-1]]) * back[offsets[:-1]]), np.diff(offsets)


KEYS = "key long, id long, place long, parities long"


def _first_words(batch: pa.RecordBatch, split: pa.ListArray, run: int) -> pa.RecordBatch:
    """KEYS of up to 256 lines: words that come first, with their place (words of the line, and the word's number below them) and the parities of the line's words. batch: id; split: words without the white space after them."""
    enough = pc.greater_equal(pc.list_value_length(split), 2 * run)  # a line that is longer by a word may have a bound of one
    batch, split = batch.filter(enough), split.filter(enough)
    count = pc.list_value_length(split).to_numpy().astype(np.int64)
    hashed, size = _word_hashes(split.flatten())
    line, first = np.repeat(np.arange(len(count)), count), np.cumsum(count) - count
    key = ((255 - np.minimum(size, 255)).astype(np.uint64) << np.uint64(47)) | (hashed >> np.uint64(17))
    order = np.argsort((line.astype(np.uint64) << np.uint64(55)) | key, kind="stable")
    kept = order[np.arange(len(order)) - first[line] <= np.maximum(0, (count - run) // (run + 1))[line]]
    parities = np.bitwise_xor.reduceat(np.uint64(1) << (hashed & np.uint64(63)), first) if len(first) else np.zeros(0, np.uint64)
    of = line[kept]
    place = (count[of] << 32) | (kept - first[of])
    rows = pa.array(of)
    return pa.RecordBatch.from_arrays([pa.array(key[kept].view(np.int64)), batch.column(0).take(rows), pa.array(place), pa.array(parities[of].view(np.int64))], names=["key", "id", "place", "parities"])


def _splits(batch: pa.RecordBatch, lines: int) -> Iterator[tuple[pa.RecordBatch, pa.ListArray]]:
    """Rows and the words of their lines (the column of that number), without the white space after them."""
    plain = pc.invert(pc.match_substring_regex(batch.column(lines), r"[\x{0800}-\x{10FFFF}]"))
    for rows, by_space in ((batch.filter(plain), True), (batch.filter(pc.invert(plain)), False)):
        if rows.num_rows:
            texts = rows.column(lines).cast(pa.string())
            if by_space:
                yield rows, pc.ascii_split_whitespace(pc.ascii_rtrim_whitespace(texts))
            else:
                yield rows, pa.array([[w.rstrip("\t\n\x0b\x0c\r ") for w in split_words(x)] for x in texts.to_pylist()], pa.list_(pa.string()))


SIGNATURE = ("p0", "p1", "p2", "p3")


def _signatures(batch: pa.RecordBatch, split: pa.ListArray) -> pa.RecordBatch:
    """batch (id, at), and 256 parities of the line's words. No line is without words."""
    hashed, _ = _word_hashes(split.flatten())
    first = np.cumsum(count := pc.list_value_length(split).to_numpy().astype(np.int64)) - count
    bit, part = np.uint64(1) << ((hashed >> np.uint64(8)) & np.uint64(63)), (hashed >> np.uint64(14)) & np.uint64(3)
    columns = [np.bitwise_xor.reduceat(np.where(part == k, bit, np.uint64(0)), first).view(np.int64) for k in range(4)]
    return pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, columns)], names=["id", "at", *SIGNATURE])


def _fit(x: np.ndarray, y: np.ndarray, words: np.ndarray, spot: np.ndarray, bound: np.ndarray, parities: np.ndarray, places: bool = True) -> np.ndarray:
    """Whether rows x and y of a key may be near by places, lengths and parities (a row of words for each)."""
    longer = np.maximum(bound[x], bound[y])
    before, more = spot[x] - spot[y] if places else 0, words[x] - words[y]
    near = np.abs(before) + np.abs(more - before) <= longer
    near[near] = np.bitwise_count(parities[x[near]] ^ parities[y[near]]).sum(1, dtype=np.int64) <= 2 * longer[near]
    return near


def _meetings(key: np.ndarray, words: np.ndarray, bound: np.ndarray, x: np.ndarray, through: np.ndarray, same: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Rows x with rows y of their keys whose lengths are within the bound, nearest places first, until x is through.

    same: of each row, the first one of its key and line. With it, what is left after a while goes by lines, not rows: a
    first row with all first rows, whatever their places (then told by the third value), as a word that a line repeats
    has as many rows.

    Many rows go side by side, each with the one so many places further; once fewer are left than places have been gone,
    each goes with all the rest.
    """
    rest = [x[:0]]
    for sign in (-1, 1):
        here, s = x[~through[x]], 0
        while len(here) > abs(s) and (same is None or abs(s) < 256):
            s += sign
            here = here[(here + s >= 0) & (here + s < len(key))]
            here = here[(key[here] == key[here + s]) & (np.abs(words[here] - words[here + s]) <= np.maximum(bound[here], bound[here + s]))]
            yield here, here + s, False
            here = here[~through[here]]
        rest.append(here)
        for i in here if same is None else ():
            j = np.arange(np.searchsorted(key, key[i]), i + s) if sign < 0 else np.arange(i + s + 1, np.searchsorted(key, key[i], "right"))
            j = j[np.abs(words[i] - words[j]) <= np.maximum(bound[i], bound[j])]
            yield np.full(len(j), i), j, False
    if same is not None:
        firsts = np.flatnonzero(same == np.arange(len(same)))
        for i in np.unique(same[np.concatenate(rest)]):
            j = firsts[np.searchsorted(firsts, np.searchsorted(key, key[i])) : np.searchsorted(firsts, np.searchsorted(key, key[i], "right"))]
            j = j[np.abs(words[i] - words[j]) <= np.maximum(bound[i], bound[j])]
            yield np.full(len(j), i), j, True


def _opened_groups(key: np.ndarray, ids: np.ndarray, place: np.ndarray, parities: np.ndarray, run: int) -> np.ndarray:
    """As _opened, for rows in order of key alone. Rows that have their key to themselves are not looked at."""
    out, new = np.zeros(len(key), bool), np.ones(len(key) + 1, bool)
    new[1:-1] = key[1:] != key[:-1]
    some = np.flatnonzero(~(new[1:] & new[:-1]))
    some = some[np.lexsort((ids[some], place[some], key[some]))]
    out[some] = _opened(key[some], ids[some], place[some], parities[some], run)
    return out


def _opened(key: np.ndarray, ids: np.ndarray, place: np.ndarray, parities: np.ndarray, run: int) -> np.ndarray:
    """The rows that have a partner under their key. Rows are in order of key, place. A row is through once it has one."""
    words, spot = place >> 32, place & 0xFFFFFFFF
    bound, out = np.maximum(0, (words - run) // (run + 1)), np.zeros(len(key), bool)
    for x, y, _ in _meetings(key, words, bound, np.arange(len(key)), out):
        near = _fit(x, y, words, spot, bound, parities) & (ids[x] != ids[y])
        out[x[near]] = out[y[near]] = True
    return out


def _put_forward(key: np.ndarray, ids: np.ndarray, place: np.ndarray, at: np.ndarray, seeks: np.ndarray, parities: np.ndarray, run: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of lines and of those no later that they put forward, about so many for a row; ids of lines that may have more."""
    words, spot = place >> 32, place & 0xFFFFFFFF
    bound, got, through, pairs = np.maximum(0, (words - run) // (run + 1)), np.zeros(len(key), np.int64), np.zeros(len(key), bool), [np.zeros((0, 2), np.int64)]
    order = np.lexsort((ids, key))
    new = np.ones(len(key), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (ids[order][1:] != ids[order][:-1])
    same = np.empty(len(key), np.int64)
    same[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
    for x, y, by_line in _meetings(key, words, bound, np.flatnonzero(seeks), through, same):
        near = np.flatnonzero(_fit(x, y, words, spot, bound, parities, not by_line) & (ids[x] != ids[y]) & (at[y] <= at[x]))
        if by_line and len(x):
            through[x[0]] |= len(near) > most - got[x[0]]
            near = near[: most - got[x[0]]]
            got[x[0]] += len(near)
        else:
            got[x[near]] += 1
            through[x[near]] = got[x[near]] >= most
        pairs.append(np.stack((ids[x[near]], ids[y[near]]), 1))
    found = np.unique(np.concatenate(pairs), axis=0)
    return found[:, 0], found[:, 1], np.unique(ids[through])


def key_sharers(docs: DataFrame, lines: DataFrame, scratch: Scratch, min_chars: int, run: int) -> DataFrame:
    """KEYS of the first occurrences of lines that may be near another one by words; a written table."""
    again = scratch.save(lines.filter("times > 1").select(*LINE, "first"), "repeats")
    rows = _lines(docs, min_chars).join(small(again), LINE, "left").filter(F.col("first").isNull() | _at_first())

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                for part, split in _splits(batch.slice(k, 256), 1):
                    yield _first_words(part.select(["id"]), split, run)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _ in whole_groups(batches, ("key",)):
            key, ids, place, parities = (part.column(c).to_numpy() for c in ("key", "id", "place", "parities"))
            yield from part.filter(pa.array(_opened_groups(key, ids, place, parities.view(np.uint64)[:, None], run))).to_batches()

    found = rows.select(F.col("h1").alias("id"), "line").mapInArrow(keys, KEYS)
    # one long to sort by, which Spark sorts by its digits; a key's rows are put in order by _opened_groups
    return scratch.save(found.repartition(tasks(docs), "key").sortWithinPartitions("key").mapInArrow(opened, KEYS), "key-sharers")


def near_by_words(sharers: DataFrame, texts: DataFrame, scratch: Scratch, run: int) -> DataFrame:
    """h1, h2 of the distinct lines within the bound of word edits of an earlier one. texts: h1, h2, first, line."""

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("line").to_pylist(), batch.column("other").to_pylist(), strict=True)
            cut = ((split_words(x), split_words(y)) for x, y in pairs)
            near = [within(x, y, word_bound(max(len(x), len(y)), run)) for x, y in cut]
            yield batch.select(LINE).filter(pa.array(near, pa.bool_()))

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                for part, split in _splits(batch.slice(k, 256), 2):
                    yield _signatures(part.select(["id", "at"]), split)

    def rounds(most: int):
        def put_forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, _ in whole_groups(batches, ("key",)):
                parities = np.stack([part.column(c).to_numpy() for c in SIGNATURE], 1).view(np.uint64)
                x, y, more = _put_forward(*(part.column(c).to_numpy() for c in ("key", "id", "place", "at", "seeks")), parities, run, most)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((x, more))), pa.array([*y.tolist(), *[None] * len(more)], pa.int64())], names=["a", "b"])

        return put_forward

    side = lambda k: texts.select(F.col("h1").alias(k), F.struct("first", "line", *LINE).alias(f"of_{k}"))
    at = F.coalesce(F.col("first.doc_id").cast("long"), F.lit(-(2**63))) if isinstance(texts.schema["first"].dataType["doc_id"].dataType, T.IntegralType) else F.lit(0).cast("long")
    signed = texts.select(F.col("h1").alias("id"), at.alias("at"), "line").mapInArrow(signatures, "id long, at long, p0 long, p1 long, p2 long, p3 long")
    keyed, sharers = sharers.select("key", "id"), sharers.join(small(scratch.save(signed, "signatures")), "id").drop("parities")
    rows, near, tested, turn, most = sharers.withColumn("seeks", F.lit(True)), None, None, 0, CANDIDATES
    while True:
        found = rows.repartition(tasks(texts), "key").sortWithinPartitions("key", "place", "id").mapInArrow(rounds(most), "a long, b long")
        found = scratch.save(found.distinct(), f"put-forward-{turn}")
        pairs = found.filter("b IS NOT NULL")
        new = pairs if tested is None else scratch.save(pairs.join(tested, ["a", "b"], "left_anti"), f"new-{turn}")
        if fits(new):  # texts are looked up where they lie, and only those of pairs are shuffled
            both = F.broadcast(new).join(side("a"), "a").join(F.broadcast(new).join(side("b"), "b"), ["a", "b"])
        else:
            both = new.join(side("a"), "a").join(side("b"), "b")
        later = F.when(F.col("of_a.first") > F.col("of_b.first"), F.col("of_a")).otherwise(F.col("of_b"))
        other = F.when(F.col("of_a.first") > F.col("of_b.first"), F.col("of_b")).otherwise(F.col("of_a"))
        both = both.select(later.alias("x"), other["line"].alias("other")).select("x.h1", "x.h2", "x.line", "other")
        now = scratch.save(both.mapInArrow(verified, "h1 long, h2 long").distinct(), f"near-{turn}")
        near = now if near is None else near.unionByName(now)
        seekers = found.filter("b IS NULL").select(F.col("a").alias("id")).join(near.select(F.col("h1").alias("id")), "id", "left_anti")
        seekers = scratch.save(seekers.distinct().withColumn("seeks", F.lit(True)), f"seekers-{turn}")
        if seekers.isEmpty():
            return near.distinct()
        # keys that no line seeks under have nothing more to put forward
        sought = scratch.save(keyed.join(small(seekers), "id", "left_semi").select("key").distinct(), f"sought-{turn}")
        rows = sharers.join(small(sought), "key", "left_semi").join(small(seekers), "id", "left").withColumn("seeks", F.coalesce("seeks", F.lit(False)))
        tested = pairs if tested is None else tested.unionByName(pairs)
        turn, most = turn + 1, most * MORE


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, max_edits: int = 1, keep: tuple[str, ...] = (), run: int = 0, short_equal: bool = False) -> DataFrame:
    """doc_id, text (what stays of it), n_lines, n_equal, n_near (lines dropped for an equal or a near one), n_long (lines of min_chars that stay), and the columns of docs named in keep."""
    if max_edits not in (0, 1):
        raise ValueError("max_edits, of code points, is 0 or 1; run sets the bound of word edits")
    if run and run < 2:
        raise ValueError("run is 0 (no word edits) or 2 words at least")
    scratch = Scratch(docs.sparkSession, "lines")
    where = F.struct("doc_id", "text_hash", "pos")
    rows = _lines(docs, min_chars, short_equal)
    variants = (F.col("n") >= min_chars) & F.lit(bool(max_edits)) & (~_two_word_edits(run) if run else F.lit(True))
    lines = rows.withColumn("halves", F.when(variants, _half_keys())).groupBy(*LINE).agg(F.min(where).alias("first"), F.first("halves").alias("halves"), F.count("*").alias("times"))
    lines = scratch.save(lines, "distinct")
    known = lines.select(*LINE, "first", "times")
    by_halves = half_sharers(lines, scratch) if max_edits else None
    by_words = key_sharers(docs, lines, scratch, min_chars, run) if run else None
    if max_edits or run:
        # the lines that may be near another one, with their texts, read once
        ids = [x for x in (by_halves, by_words.select(F.col("id").alias("h1")) if run else None) if x is not None]
        ids = scratch.save(reduce(DataFrame.unionByName, ids).distinct(), "wanted")
        wanted = scratch.save(known.select(*LINE, "first").join(small(ids), "h1"), "firsts")
        texts = scratch.save(_lines(docs, min_chars).join(small(wanted), LINE).filter(_at_first()).select(*LINE, "first", "line", "n").dropDuplicates(LINE), "texts")
        found = [near_lines(texts.join(small(by_halves), "h1", "left_semi"), scratch)] if max_edits else []
        found += [near_by_words(by_words, texts, scratch, run)] if run else []
        near = scratch.save(reduce(DataFrame.unionByName, found).distinct(), "near")
        known = known.join(small(near).withColumn("near", F.lit(True)), LINE, "left")
    else:
        known = known.withColumn("near", F.lit(None).cast("boolean"))
    known = scratch.save(known.withColumn("near", F.coalesce("near", F.lit(False))).filter("near OR times > 1"), "known")
    seen = rows.select("doc_id", "text_hash", "pos", *LINE).join(small(known), LINE)
    seen = seen.withColumn("equal", ~_at_first()).filter("equal OR near")
    drops = seen.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("pos", "equal")).alias("drops"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("-null-")).alias("_id")
    drops = scratch.save(drops.select(key, "text_hash", "drops"), "drops")  # a row is a list, so fewer of them are broadcast
    texts = docs.select("doc_id", "text", F.struct(*keep).alias("_keep") if keep else F.lit(None).alias("_keep"), key, F.xxhash64("text").alias("text_hash")).join(small(drops, BROADCAST_ROWS // 4), ["_id", "text_hash"], "left")
    texts = texts.withColumns({"_lines": F.split("text", "\n"), "_drop": F.col("drops.pos")})
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_drop"), lambda i: F.get("_lines", i))
    texts = texts.withColumn("_kept", F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(kept))
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    dropped = lambda equal: F.when(F.col("drops").isNull(), F.lit(0)).otherwise(F.size(F.filter("drops", lambda d: d["equal"] == F.lit(equal)))).cast("long")
    long_lines = F.filter("_kept", lambda x: F.char_length(x) >= min_chars)
    return texts.select(
        "doc_id",
        F.when(F.col("_drop").isNull(), F.col("text")).otherwise(F.array_join("_kept", "\n")).alias("text"),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(count("_lines")).cast("long").alias("n_lines"),
        dropped(True).alias("n_equal"),
        dropped(False).alias("n_near"),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(count(long_lines)).cast("long").alias("n_long"),
        *(F.col(f"_keep.{c}") for c in keep),
    )
