from tests.llm.test_decontamination import brute, split
from tidemark.llm import decontamination
from tidemark.llm.decontamination import decontaminate, item_windows, prefixes
from tidemark.llm.shared import Scratch

TEXT = "item_id long, text string"


def test_prefix_is_the_rarest_shingle_and_impossible_windows_go(spark, docs):
    common, rare = "a b c d e f g h i", "zz"
    rows = [(i, f"{common} {common}") for i in range(5)] + [(9, f"{common} {rare}")]
    bench = spark.createDataFrame([(1, f"{common} {rare}"), (2, f"{common} nowhere")], TEXT)
    found = prefixes(item_windows(bench), docs(rows), Scratch(spark, "test")).collect()
    assert [(r["j"], r["q"], r["win"]) for r in found] == [(5, 5, f"{common} {rare}".split())]


def test_pieces_of_a_large_benchmark_give_the_same(spark, docs, sentences, monkeypatch):
    items = [(i, sentences(14, 9000 + i)) for i in range(6)] + [(8, "one two"), (9, "solo")]
    rows = [(i, sentences(15, i) + " " + x + " solo " + sentences(8, 40 + i)) for i, x in items] + [(50, None), (51, "one two one two")]
    want = sorted((str(d), *map(str, brute(t, [(i, split(x)) for i, x in items]))) for d, t in rows)
    bench = spark.createDataFrame(items, TEXT)
    for limit in (1_000_000, 8):
        monkeypatch.setattr(decontamination, "BROADCAST_ROWS", limit)
        assert sorted(tuple(map(str, r)) for r in decontaminate(docs(rows), bench).collect()) == want


def test_item_words_beyond_a_broadcast_are_counted_all_the_same(spark, docs, monkeypatch):
    monkeypatch.setattr(decontamination, "fits", lambda df: False)
    bench = spark.createDataFrame([(1, "x y z")], TEXT)
    got = decontaminate(docs([(1, "a x y z b X, Y. Z!"), (2, "x y")]), bench).collect()
    assert [(r["n_hit"], r["n_items"]) for r in sorted(got)] == [(6, 1), (0, 0)]


def test_a_very_long_text(spark, docs):
    text = "the quick brown fox jumps over lazy dogs today again " * 20_000
    items = [(1, "quick brown fox jumps over lazy dogs today again the quick brown"), (2, "fox")]
    (got,) = decontaminate(docs([(1, text)]), spark.createDataFrame(items, TEXT)).collect()
    # the last window that fits starts at the last fox but one, and the last fox stands right behind it
    assert (got["n_words"], got["n_hit"]) == (200_000, 200_000 - 7)
