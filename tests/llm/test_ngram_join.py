import random
import re
from itertools import combinations

import numpy as np

from tidemark.llm import ngram_join
from tidemark.llm.components import components
from tidemark.llm.shared import Scratch


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({65 + i: 97 + i for i in range(26)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    name = {d: d for d in sets}
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            old, new = max(name[a], name[b]), min(name[a], name[b])
            name = {d: new if c == old else c for d, c in name.items()}
    return sorted((d, len(s), name[d]) for d, s in sets.items())


def test_against_brute_force(docs, corpus, sentences):
    rng = random.Random(5)
    rows = [r for r in corpus if r[0] not in (None, 400)]
    for base in range(8):  # chains and clouds of edits, on both sides of the threshold
        text = sentences(rng.choice((6, 30, 90, 240)), 40 + base).split()
        for i in range(14):
            copy = list(text)
            for _ in range(rng.randint(0, 1 + len(text) // 40)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(6)}"
            rows.append((1000 + 20 * base + i, " ".join(copy[: len(copy) - rng.randint(0, len(copy) // 9)])))
            text = copy if base % 2 else text
    got = sorted(tuple(r) for r in ngram_join.near_duplicates(docs(rows)).collect())
    assert got == brute(rows)


def test_small_blocks_find_what_large_ones_do(docs, sentences, monkeypatch):
    shared = sentences(50, 1)
    rows = [(i, shared + " " + sentences(6, i // 2)) for i in range(60)]
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 7)
    monkeypatch.setattr(ngram_join, "CANDIDATES", 1)
    monkeypatch.setattr(ngram_join, "MORE", 8)
    monkeypatch.setattr(ngram_join, "STAR_ROUNDS", 0)
    assert sorted(tuple(r) for r in ngram_join.near_duplicates(docs(rows)).collect()) == brute(rows)


def test_bitmaps_bound_from_above():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 900, rng.integers(10, 400)) << 7) for _ in range(20)]
    maps = ngram_join.folded([ngram_join.bitmap(s) for s in sets])
    for a, b in combinations(range(20), 2):
        apart = int(np.bitwise_count(maps[a] ^ maps[b]).sum())
        assert len(np.intersect1d(sets[a], sets[b])) <= (len(sets[a]) + len(sets[b]) - apart) // 2


def test_tile_leaves_components_alone():
    maps, flat = ngram_join.folded([ngram_join.bitmap(np.arange(30) << 7)] * 3), np.full(3, 30)
    tile = lambda comp, most: ngram_join.candidates(np.array([1, 2, 3]), flat, flat, np.array(comp), np.zeros(3, bool), np.zeros(3, int), maps, False, most)
    assert tile([1, 1, 3], 9) == ([(3, 1), (3, 2)], False)
    assert tile([1, 1, 3], 1) == ([(3, 1)], True)


def test_clouds_without_a_centre(docs, sentences, monkeypatch):
    """Near copies of a text that is not there: of any two, a part links; few candidates a round have to find them all."""
    rng, rows = random.Random(3), []
    for base in range(3):
        text = sentences(180, 70 + base).split()
        for i in range(60):
            copy = list(text)
            for _ in range(3):
                copy[rng.randrange(len(copy))] = f"z{rng.randrange(900)}"
            rows.append((100 * base + i, " ".join(copy)))
    monkeypatch.setattr(ngram_join, "CANDIDATES", 1)
    assert sorted(tuple(r) for r in ngram_join.near_duplicates(docs(rows)).collect()) == brute(rows)


def test_nulls_repeats_and_empty(docs, sentences):
    t = sentences(40, 1)
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs([(5, t), (5, t), (7, t), (None, t), (8, None), (9, " \t"), (1, "a b"), (2, "A b")])).collect())
    n = len(shingles(t))
    assert got == sorted([("5", n, 5), ("5", n, 5), ("7", n, 5), ("None", n, 5), ("8", 0, 8), ("9", 0, 9), ("1", 1, 1), ("2", 1, 1)])
    assert ngram_join.near_duplicates(docs([])).collect() == []


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["comp"] for r in components(edges, Scratch(spark, "t"), "t").collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
