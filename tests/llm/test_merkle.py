import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle
from tidemark.llm.shared import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, idx long, hash string, path string"


def table(spark, rows):
    """rows: doc_id, text, lang, source, n_chars; the other columns bear names that the operator uses."""
    return spark.createDataFrame([(*r, "t", 9, "h", "p") for r in rows], DOCS)


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text=None):
    doc_id, own, lang, source, n_chars = row
    told = (doc_id, source, lang, n_chars, own if text is None else text)
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in told))


def tree(nodes, paths, fanout):
    """The top of nodes (in order); paths: for each, the members to which a level's (before, after) is added."""
    while len(nodes) > 1:
        up, members = [], []
        for at in range(0, len(nodes), fanout):
            run = nodes[at : at + fanout]
            for i in range(len(run)):
                for path in paths[at + i]:
                    path.append(("".join(run[:i]), "".join(run[i + 1 :])))
            up.append(h("".join(run)))
            members.append([p for ps in paths[at : at + fanout] for p in ps])
        nodes, paths = up, members
    return nodes[0]


def brute(rows, fanout=8):
    by_lang = defaultdict(list)
    for row in rows:
        by_lang[row[2]].append(row)
    out, tops, members = [], [], []
    for lang in sorted(by_lang, key=lambda x: (x is not None, (x or "").encode())):
        mine = sorted(by_lang[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        paths = [[] for _ in mine]
        tops.append(tree([leaf(r) for r in mine], [[p] for p in paths], fanout))
        members.append(paths)
        out += [(r, p, tops[-1]) for r, p in zip(mine, paths, strict=True)]
    root = tree(tops, members, fanout) if tops else None
    found = []
    for row, path, subroot in out:
        told = str(row[0]).encode()
        lower = row[1].translate({c: c + 32 for c in range(65, 91)}) if row[1] is not None else None
        start = leaf(row, lower) if row[0] is not None and zlib.crc32(told) % 3 == 0 else leaf(row)
        for before, after in path:
            start = h(before + start + after)
        found.append((row[0], leaf(row), subroot, root, h("".join(b + a for b, a in path)), start, start == root))
    return found


def key(row):
    return tuple((v is not None, v) for v in row)


def same(spark, rows, fanout=8):
    got = merkle.verify_tampering(table(spark, rows), fanout)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows, fanout), key=key)


def make(n, langs):
    return [(i * 7 % n, f"Text {i} of Many\nÉ ß", langs(i), f"s{i % 3}" if i % 4 else None, i if i % 5 else None) for i in range(n)]


@pytest.mark.parametrize("n", [1, 8, 9, 65, 600])
def test_sizes_of_trees(spark, n):
    same(spark, make(n, lambda i: "en" if i % 3 else "de"))


def test_many_trees_and_other_fanouts(spark):
    rows = make(200, lambda i: (None, "", "=", "é", "z", "Z", "\U0001f600", "￿")[i % 8] if i % 2 else f"l{i % 23}")
    same(spark, rows)
    same(spark, rows, 2)
    same(spark, rows, 3)


def test_one_tree_holds_nearly_all(spark):
    same(spark, make(900, lambda i: "en" if i % 100 else f"l{i}"))


def test_odd_rows(spark):
    rows = [(1, None, "en", None, None), (1, None, "en", None, None), (1, "A", "en", None, 1), (None, "ABC", "en", "s", 3), (None, "ABC", None, "s", 3), (3, "", None, "", 0), (4, "- 1:a", "-", "-", -5), (5, "Q " * 200_000, "en", "s", 7)]
    same(spark, rows)
    same(spark, [])
    assert merkle.verify_tampering(table(spark, [])).collect() == []


def test_a_change_anywhere_changes_the_root(spark):
    rows = make(40, lambda i: "ab"[i % 2])
    root = lambda some: merkle.verify_tampering(table(spark, some)).first()["root"]
    first = root(rows)
    for i, change in enumerate([(0, 999), (1, "other"), (2, "c"), (3, "other"), (4, 999)]):
        row = list(rows[i])
        row[change[0]] = change[1]
        assert root([*rows[:i], tuple(row), *rows[i + 1 :]]) != first
    assert root(rows[::-1]) == first


def test_proofs_of_a_manifest(spark):
    leaves = table(spark, make(100, lambda i: f"l{i % 11}")).select("doc_id", "lang", merkle.leaf().alias("leaf"), F.col("source").alias("kept"))
    made = merkle.build_manifest(leaves, Scratch(spark, "test"))
    rows = made.proofs.withColumn("again", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    assert len(rows) == 100 and {r["again"] for r in rows} == {made.root} and {r["kept"] for r in rows} == {None, "s0", "s1", "s2"}
    assert {r["lang"]: r["subroot"] for r in made.trees.collect()} == {r["lang"]: r["subroot"] for r in rows}
