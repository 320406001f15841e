"""A data source for trees of files: folders that are never source, or that are excluded, are not entered.

The driver lists breadth first, without what is pruned, until it has as many folders as there should be tasks; each
of these folders is a partition that its task lists further and reads, the same way. Files met before that are dealt to
partitions by their bytes. So what the driver holds is bounded by the number of partitions and the files of the
topmost folders, and no file below a pruned folder, or excluded itself, is opened.
"""

from __future__ import annotations

import fnmatch
import json
import os
import re
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Directories that a scan never enters.
PRUNED = (".git", ".venv", "venv", "node_modules", "__pycache__", "dist", "build", ".ruff_cache", ".pytest_cache", ".mypy_cache")
FORMAT = "tidemark_tree"
SCHEMA = "path string, content string"
#: A partition of single files is closed at so many bytes, a batch of rows at so many.
FILES_BYTES, BATCH_BYTES = 32 << 20, 8 << 20


def located(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the place in it; an OSError or ValueError if only Spark can read it."""
    if "://" in root or root.startswith("file:"):
        store, base = fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", root))
        return store, base.rstrip("/") or "/"
    return fs.LocalFileSystem(), os.path.abspath(root)


class Walk:
    """What of a tree is wanted. excludes: globs over the path below the root, of folders or files; suffix: what names end with."""

    def __init__(self, root: str, excludes: Sequence[str] = (), pruned: Sequence[str] = PRUNED, suffix: str = ""):
        self.store, self.base = located(root)
        self.local = isinstance(self.store, fs.LocalFileSystem)
        self.excluded = re.compile("|".join(map(fnmatch.translate, excludes)) or r"(?!)")
        self.pruned, self.suffix = frozenset(pruned), suffix

    def listed(self, folder: str) -> tuple[list[str], list[tuple[str, int]]]:
        """Names below the root of folders to enter, and of files wanted with their sizes, both in order; links to folders are not followed."""
        folders, files = [], []
        for info in sorted(self.store.get_file_info(fs.FileSelector(f"{self.base}/{folder}" if folder else self.base)), key=lambda i: i.path):
            name = f"{folder}/{info.base_name}" if folder else info.base_name
            if info.type == fs.FileType.Directory:
                if info.base_name not in self.pruned and not self.excluded.match(name) and not (self.local and os.path.islink(info.path)):
                    folders.append(name)
            elif info.type == fs.FileType.File and name.endswith(self.suffix) and not self.excluded.match(name):
                files.append((name, info.size or 0))
        return folders, files

    def below(self, folder: str) -> Iterator[str]:
        """All wanted files in a folder and its folders."""
        todo = deque([folder])
        while todo:
            folders, files = self.listed(todo.popleft())
            yield from (name for name, _ in files)
            todo.extendleft(reversed(folders))

    def opened(self, name: str) -> bytes:
        with self.store.open_input_stream(f"{self.base}/{name}", compression=None) as stream:
            return stream.read()

    def text(self, name: str) -> str | None:
        """The file's text; None where it is no UTF-8, can't be read or has gone meanwhile."""
        try:
            return self.opened(name).decode()
        except (OSError, UnicodeDecodeError):
            return None


@dataclass
class Part(InputPartition):
    folders: list[str]
    files: list[str]


def parts(walk: Walk, tasks: int) -> list[Part]:
    """Folders, one a part, once there are so many of them or all are listed, and the files met on the way."""
    todo, loose, size, out = deque([""]), [], 0, []
    while todo and len(todo) < tasks:
        folders, files = walk.listed(todo.popleft())
        todo.extend(folders)
        for name, bytes_ in files:
            loose.append(name)
            size += bytes_
            if size >= FILES_BYTES:
                out.append(Part([], loose))
                loose, size = [], 0
    return [*out, *([Part([], loose)] if loose else []), *(Part([folder], []) for folder in todo)]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.asked = options
        self.tasks = int(options.get("tasks", "64"))

    def _walk(self) -> Walk:
        told = lambda key, default: tuple(json.loads(self.asked[key])) if key in self.asked else default
        return Walk(self.asked["path"], told("excludes", ()), told("pruned", PRUNED), self.asked.get("suffix", ""))

    def partitions(self) -> Sequence[InputPartition]:
        return parts(self._walk(), self.tasks) or [Part([], [])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        walk, names, texts, size = self._walk(), [], [], 0
        schema = pa.schema([("path", pa.string()), ("content", pa.string())])
        for name in (*partition.files, *(n for folder in partition.folders for n in walk.below(folder))):
            names.append(name)
            texts.append(walk.text(name))
            size += len(texts[-1] or "")
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], schema=schema)
                names, texts, size = [], [], 0
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], schema=schema)


class TreeSource(DataSource):
    """Options: path; excludes and pruned (JSON lists); suffix; tasks."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return TreeReader(dict(self.options))


def scan(spark: SparkSession, root: str, excludes: Sequence[str] = (), pruned: Sequence[str] = PRUNED, suffix: str = "", tasks: int | None = None) -> DataFrame:
    """path (below root) and content of every wanted file; content is null where it is no UTF-8."""
    spark.dataSource.register(TreeSource)
    tasks = tasks or 4 * spark.sparkContext.defaultParallelism
    told = {"excludes": json.dumps(list(excludes)), "pruned": json.dumps(list(pruned)), "suffix": suffix, "tasks": str(tasks)}
    return spark.read.format(FORMAT).options(**told).load(root)
