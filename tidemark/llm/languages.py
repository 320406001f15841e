"""Language identification as inference of a mixture: a text may hold several languages, in proportions to be found.

Learning counts the letter trigrams of every labelled text, by language, in a fixed number of hash buckets. Tasks add up
counts of whole texts, Spark adds up those of tasks; the model's size is languages times buckets, at most MODEL_SIZE
whatever the corpus, and the number of buckets follows from that of languages alone. Telling a text's languages starts at the single
language of highest likelihood; then the language of steepest ascent is put in, expectation-maximisation finds the proportions
anew, and the larger set stays if its log-likelihood gains more than a penalty, until none does. The likelihood is
concave in the proportions, so the ascent bounds what any further language can gain: texts whose bound is below the
penalty are done without a trial.

Defined results: texts that are null or have no letter are `und` with score 0, as is everything if no language was learned;
documents of a null lang or a null text teach nothing; a null doc_id is not held out; repeated rows count as often as they
are there and are told alike; of equal likelihoods the language first by name wins; an empty table gives an empty result.
Texts are read whole, in pieces of bounded memory. Columns beyond the named ones are not read.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS, HELD_OUT = 4, 2
MODEL_SIZE, MOST_BITS, LEAST_BITS = 1 << 22, 16, 8
#: Trigrams that all texts together lend to every language, so that none has a probability of zero.
LENT = 200.0
#: Code points that are worked on at once.
PIECE = 1 << 20
SPACE = 32


@functools.cache
def letters() -> np.ndarray:
    """By code point: the letter in lower case, a mark as it is, a space for all else."""
    found = np.full(sys.maxunicode + 1, SPACE, np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if unicodedata.category(c)[0] in "LM":
            lower = c.lower()
            found[i] = ord(lower) if len(lower) == 1 else i
    return found


def trigrams(codes: np.ndarray, before: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of code points: the buckets of trigrams within words, a space at either end of a word; the trigrams' last places; what to put before the next piece."""
    own = np.concatenate([before, letters()[codes]])
    kept = np.ones(len(own), bool)
    kept[1:] = (own[1:] != SPACE) | (own[:-1] != SPACE)
    places = np.flatnonzero(kept)
    own = own[kept]
    if len(own) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64), own[-2:]
    inside = own[1:-1] != SPACE
    wide = own.astype(np.uint64)
    mixed = ((wide[:-2] << np.uint64(42)) ^ (wide[1:-1] << np.uint64(21)) ^ wide[2:])[inside] * np.uint64(0x9E37_79B9_7F4A_7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58_476D_1CE4_E5B9)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64), places[2:][inside] - len(before), own[-2:]


def counted(texts: list[str | None], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Entries (text's place, bucket, count) of some texts after the other, in order of places; short texts together, long ones in pieces."""
    start, first = np.array([SPACE], np.uint32), 0

    def codes(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)

    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last] or "") <= PIECE):
            size += len(texts[last] or "") + 1
            last += 1
        if size <= PIECE + 1:
            some = [t or "" for t in texts[first:last]]
            ends = np.cumsum([len(t) + 1 for t in some])
            buckets, places, _ = trigrams(codes(" ".join(some) + " "), start, bits)
            key, n = np.unique(np.searchsorted(ends, places, side="right") << bits | buckets, return_counts=True)
            yield first + (key >> bits), key & ((1 << bits) - 1), n
        else:  # one long text
            total, before = np.zeros(1 << bits, np.int64), start
            for at in range(0, len(texts[first]), PIECE):
                buckets, _, before = trigrams(codes(texts[first][at : at + PIECE]), before, bits)
                total += np.bincount(buckets, minlength=1 << bits)
            buckets, _, _ = trigrams(start, before, bits)
            total += np.bincount(buckets, minlength=1 << bits)
            found = np.flatnonzero(total)
            yield np.full(len(found), first), found, total[found]
        first = last


@dataclass(frozen=True)
class LanguageModel:
    """languages by name; chances: bucket by language, the probability of a trigram."""

    languages: tuple[str, ...]
    chances: np.ndarray
    bits: int


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def fit_languages(docs: DataFrame) -> LanguageModel:
    """Counts all documents that aren't held out. A model is larger than MODEL_SIZE only with more than 16,384 languages, which is an error."""
    taught = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("lang").cast("string").alias("lang"), "text")
    names = taught.select("lang").distinct()
    n = names.count()
    if n > MODEL_SIZE >> LEAST_BITS:
        raise ValueError(f"{n} languages are more than {MODEL_SIZE >> LEAST_BITS}")
    bits = min(MOST_BITS, (MODEL_SIZE // max(n, 1)).bit_length() - 1)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, counts in total.items():
                found = np.flatnonzero(counts)
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(found), "bucket": found.astype(np.int32), "n": counts[found]})
            total.clear()

        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for place, bucket, count in counted(texts, bits):
                for i, j in _groups(place):
                    if (lang := langs[place[i]]) not in total:
                        if (len(total) + 1) << bits > MODEL_SIZE:
                            yield from told()
                        total[lang] = np.zeros(1 << bits, np.int64)
                    total[lang][bucket[i:j]] += count[i:j]
        yield from told()

    counts = taught.mapInArrow(per_task, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(r["lang"] for r in names.collect())
    at = {lang: i for i, lang in enumerate(langs)}
    total = np.zeros((1 << bits, len(langs)))
    total[counts.column("bucket").to_numpy(), [at[x] for x in counts.column("lang").to_pylist()]] = counts.column("n").to_numpy()
    every = total.sum(1, keepdims=True) + 0.5
    return LanguageModel(tuple(langs), (total + LENT * every / every.sum()) / (total.sum(0) + LENT), bits)


def _groups(place: np.ndarray) -> Iterator[tuple[int, int]]:
    bounds = np.flatnonzero(np.diff(place, prepend=-1, append=-1))
    return zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)


def mixtures(place: np.ndarray, chances: np.ndarray, count: np.ndarray, penalty: float = 3.0, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Of entries in order of their texts' places (from 0, none left out): the proportions by text and language, and the
    single languages' log-likelihoods. chances: each entry's probability by language; penalty: of a further language, times the log of a text's trigrams."""
    starts = np.flatnonzero(np.diff(place, prepend=-1))
    n, by_text = np.add.reduceat(count, starts).astype(float), functools.partial(np.add.reduceat, indices=starts)
    single = by_text(count[:, None] * np.log(chances), axis=0)
    share = np.zeros_like(single)
    rows = np.arange(len(n))
    share[rows, single.argmax(1)] = 1.0
    value = single.max(1)
    cost = penalty * np.log(np.maximum(n, 2.0))
    active = rows
    while len(active):
        inside = np.isin(place, active) if len(active) < len(n) else slice(None)
        of, p, c = place[inside], chances[inside], count[inside]
        begin = np.flatnonzero(np.diff(of, prepend=-1))
        own = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(of))))
        pi = share[active]
        slope = np.add.reduceat(c[:, None] * p / (p * pi[own]).sum(1, keepdims=True), begin, axis=0) / n[active][:, None]
        slope[pi > 0] = -np.inf
        more = slope.argmax(1)
        hopeful = n[active] * (slope[np.arange(len(active)), more] - 1) > cost[active]
        if not hopeful.any():
            break
        entries = hopeful[own]
        p, c, own = p[entries], c[entries], (np.cumsum(hopeful) - 1)[own[entries]]
        begin = np.flatnonzero(np.diff(own, prepend=-1))
        active, pi, more = active[hopeful], pi[hopeful] * 0.8, more[hopeful]
        pi[np.arange(len(active)), more] = 0.2
        used = np.flatnonzero((pi > 0).any(0))
        p, pi = p[:, used], pi[:, used]
        for _ in range(rounds):
            part = p * pi[own]
            new = np.add.reduceat(part * (c / part.sum(1))[:, None], begin, axis=0) / n[active][:, None]
            moved, pi = np.abs(new - pi).max(), new
            if moved < 1e-4:
                break
        gained = np.add.reduceat(c * np.log((p * pi[own]).sum(1)), begin)
        better = gained - value[active] > cost[active]
        active = active[better]
        value[active] = gained[better]
        share[active] = 0.0
        share[np.ix_(active, used)] = pi[better]
    return share, single


def tell_languages(docs: DataFrame, model: LanguageModel, penalty: float = 3.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, keep, lang_pred, score and languages (`name:share` of the chosen set, largest first) of every document.

    score is the predicted language's proportion times the posterior probability, with each letter counted once, that
    the text's likeliest single language is of the chosen set.
    """
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *keep))
    names, table, bits = np.array(model.languages, object), model.chances, model.bits

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            told, score, sets = ["und"] * len(texts), np.zeros(len(texts)), [""] * len(texts)
            for place, bucket, count in counted(texts, bits) if len(names) else ():
                known, own = np.unique(place, return_inverse=True)
                if not len(known):
                    continue
                share, single = mixtures(own, table[bucket], count, penalty)
                odds = np.exp((single - single.max(1, keepdims=True)) / 3)
                sure = np.where(share > 0, odds, 0).sum(1) / odds.sum(1)
                best = share.argmax(1)
                for i, k in enumerate(known):
                    if not any(c.isalpha() for c in texts[k]):
                        continue
                    order = [j for j in np.argsort(-share[i], kind="stable") if share[i, j] > 0]
                    told[k], score[k] = names[best[i]], min(1.0, share[i, best[i]] * sure[i])
                    sets[k] = ",".join(f"{names[j]}:{share[i, j]:.3f}" for j in order)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(told, pa.string()), pa.array(score), pa.array(sets, pa.string())], ["doc_id", *keep, "lang_pred", "score", "languages"])

    return docs.select("doc_id", *keep, "text").mapInArrow(per_batch, f"{kinds}, lang_pred string, score double, languages string")


def identify(docs: DataFrame, penalty: float = 3.0) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages; learned from the documents that aren't held out."""
    rows = tell_languages(docs, fit_languages(docs), penalty)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages")
