"""Trees of files: what is pruned or excluded is neither listed nor opened."""

import os
from collections import Counter

import pytest

from tidemark.sources import tree as T
from tidemark.sources import walk as W

FILES = {"a.py": "x = 1\n", "b.txt": "b", "src/c.py": "é", "src/deep/er/d.py": "d", "src/gen/e.py": "e", "src/gen/in/f.py": "f", "node_modules/g.py": "g", "src/.git/h.py": "h", "src/node_modules/i/j.py": "j", "build.py": "k", "src/bad.bin": b"\xff\xfe\x00", "empty/": None}


@pytest.fixture
def tree(tmp_path):
    for name, data in FILES.items():
        path = tmp_path / name
        if data is None:
            path.mkdir(parents=True)
            continue
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data if isinstance(data, bytes) else data.encode())
    os.symlink(tmp_path / "src", tmp_path / "loop")
    os.symlink(tmp_path / "a.py", tmp_path / "src/linked.py")
    return tmp_path


KEPT = {"a.py", "b.txt", "build.py", "src/c.py", "src/deep/er/d.py", "src/gen/e.py", "src/gen/in/f.py", "src/linked.py", "src/bad.bin"}


@pytest.mark.parametrize("tasks", [1, 2, 3, 50])
def test_only_wanted_files_are_opened(tree, monkeypatch, tasks):
    opened, listed = Counter(), Counter()
    read, select = W.Walk.opened, W.Walk.listed
    monkeypatch.setattr(W.Walk, "opened", lambda self, name: (opened.update([name]), read(self, name))[1])
    monkeypatch.setattr(W.Walk, "listed", lambda self, folder: (listed.update([folder]), select(self, folder))[1])
    reader = W.TreeReader({"path": str(tree), "excludes": '["src/gen", "*.txt"]', "tasks": str(tasks)})
    rows = [(r["path"], r["content"]) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    want = KEPT - {"b.txt", "src/gen/e.py", "src/gen/in/f.py"}
    assert opened == Counter(want) and sorted(p for p, _ in rows) == sorted(want)
    assert listed == Counter({"": 1, "src": 1, "src/deep": 1, "src/deep/er": 1, "empty": 1})
    assert dict(rows)["src/c.py"] == "é" and dict(rows)["src/bad.bin"] is None


def test_through_spark(spark, tree):
    got = {r["path"]: r["content"] for r in T.read_tree(spark, str(tree)).collect()}
    assert set(got) == KEPT and got["src/c.py"] == "é" and got["src/bad.bin"] is None
    assert {r["path"] for r in T.read_tree(spark, f"file://{tree}", excludes=["src/*"], suffix=".py").collect()} == {"a.py", "build.py"}
    assert {r["path"] for r in T.read_tree(spark, str(tree), excludes=["src/gen"], suffix=".py").collect()} == {"a.py", "build.py", "src/c.py", "src/deep/er/d.py", "src/linked.py"}
    assert T.read_tree(spark, str(tree / "empty")).collect() == []


def test_stores_that_only_spark_reads_give_the_same(spark, tree):
    os.remove(tree / "loop")
    for excludes in ((), ("src/gen", "*.txt")):
        same = [sorted((r["path"], r["content"] or "") for r in read(spark, str(tree), excludes=excludes, suffix="").collect()) for read in (T.read_tree, T.read_store)]
        assert same[0] == same[1]


def test_files_that_go_meanwhile(tree):
    reader = W.TreeReader({"path": str(tree), "tasks": "1"})
    planned = reader.partitions()
    os.remove(tree / "a.py")
    rows = {r["path"]: r["content"] for p in planned for b in reader.read(p) for r in b.to_pylist()}
    assert "a.py" not in rows or rows["a.py"] is None
