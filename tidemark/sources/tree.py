"""A source tree as tables, and its configuration."""

from __future__ import annotations

import tomllib
from collections.abc import Callable, Iterable, Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.sources.walk import PRUNED, located, scan

Config = dict[str, Any]


def read_tree(spark: SparkSession, root: str, excludes: Iterable[str] = (), suffix: str = "", pruned: Iterable[str] = PRUNED) -> DataFrame:
    """path (below root) and content of every file, in no order; content is null where it is no UTF-8. What is pruned or
    excluded is not opened, unless root is in a store that only Spark can read: its files are then read and left out."""
    try:
        located(root)
    except (OSError, ValueError):
        return read_store(spark, root, excludes, suffix, pruned)
    return scan(spark, root, tuple(excludes), tuple(pruned), suffix)


def read_store(spark: SparkSession, root: str, excludes: Iterable[str] = (), suffix: str = "", pruned: Iterable[str] = PRUNED) -> DataFrame:
    """As read_tree, by Spark's own reader of whole files."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").removeprefix("file://")
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^.*?" + X._quoted(base.rstrip("/")) + "/", "")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    rows = raw.select(path.alias("path"), text.alias("content"))
    folders = F.transform(F.sequence(F.lit(1), F.size(X.parts_of(F.col("path")))), lambda n: F.array_join(F.slice(X.parts_of(F.col("path")), F.lit(1), n), "/"))
    out = F.exists(folders, lambda f: X.matches_any(f, excludes)) if (excludes := list(excludes)) else F.lit(False)
    inside = F.slice(X.parts_of(F.col("path")), F.lit(1), F.size(X.parts_of(F.col("path"))) - 1)
    return rows.filter(F.col("path").endswith(suffix) & ~F.arrays_overlap(inside, F.array(*map(F.lit, pruned))) & ~out)


def as_files(table: DataFrame, path: Any, content: Any) -> DataFrame:
    """A table of texts as files."""
    return table.select(path.alias("path"), content.alias("content"))


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> Config:
    """Tables merge, anything else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def config_file(directory: str | Path, tool: str = "tidemark") -> Path | None:
    """<tool>.toml, or else .<tool>.toml, or else a pyproject.toml that has the tool's table."""
    for name in (f"{tool}.toml", f".{tool}.toml"):
        if (own := Path(directory, name)).is_file():
            return own
    shared = Path(directory, "pyproject.toml")
    return shared if shared.is_file() and tool in tomllib.loads(shared.read_text("utf-8")).get("tool", {}) else None


def read_config(directory: str | Path, tool: str = "tidemark") -> Config:
    """What the directory's configuration file says; nothing without one."""
    found = config_file(directory, tool)
    if found is None:
        return {}
    whole = tomllib.loads(found.read_text("utf-8"))
    return whole["tool"][tool] if found.name == "pyproject.toml" else whole


def find_config(start: str | Path, tool: str = "tidemark") -> Config:
    """The first configuration at start or above it."""
    here = Path(start).resolve()
    return next((c for d in (here, *here.parents) if (c := read_config(d, tool))), {})


# Profiles.
PROFILES: dict[str, Config] = {
    "strict": {"promote": ["ALL"]} | {c: {"enabled": True} for c in ("attribute_access", "named_args", "prose", "restating", "similarity", "test_style")},
    "layered": {"layer_deps": {"layers": ["presentation", "business", "persistence"], "transport_layers": [], "composition_root": ["main.py"], "allowed": {"presentation": ["business", "persistence"], "business": ["persistence"], "persistence": []}}},
    "hexagonal": {
        "layer_deps": {"layers": ["domain", "application", "infrastructure", "api"], "transport_layers": ["api"], "composition_root": ["api/dependencies.py", "api/dependencies/*", "api/main.py", "main.py"], "allowed": {"domain": [], "application": ["domain"], "infrastructure": ["domain", "application"], "api": ["domain", "application"]}},
        "port_coverage": {"composition_root": ["api/dependencies.py", "api/dependencies/*", "api/main.py", "main.py"]},
    },
    "clean": {
        "layer_deps": {"layers": ["entities", "use_cases", "interface_adapters", "frameworks"], "transport_layers": [], "composition_root": ["frameworks/main.py", "main.py"], "allowed": {"entities": [], "use_cases": ["entities"], "interface_adapters": ["use_cases", "entities"], "frameworks": ["interface_adapters", "use_cases", "entities"]}},
    },
}


def extended(config: Config, directory: str | Path = ".", load: Callable[[str], Config] | None = None) -> Config:
    """config over the profiles it extends, left to right; a profile's own extends counts for nothing."""
    names = config.get("extends", [])
    out: Config = {}
    for name in [names] if isinstance(names, str) else names:
        if name in PROFILES:
            profile = PROFILES[name]
        elif name.endswith(".toml") or "/" in name:
            if load is None and not Path(directory, name).is_file():
                raise ValueError(f"profile file '{name}' does not exist")
            profile = (load or (lambda n: tomllib.loads(Path(directory, n).read_text("utf-8"))))(name)
        else:
            raise ValueError(f"no profile '{name}'; there are {', '.join(sorted(PROFILES))}")
        out = merged(out, {k: v for k, v in profile.items() if k != "extends"})
    return merged(out, {k: v for k, v in config.items() if k != "extends"})


def region_configs(configs: Mapping[str, Config]) -> dict[str, Config]:
    """directory to configuration, each over those of its ancestors from the nearest with root = true down."""
    out: dict[str, Config] = {}
    for directory in sorted(configs, key=lambda d: d.count("/") + bool(d)):
        above = [d for d in out if d != directory and (d == "" or directory.startswith(d + "/"))]
        parent = max(above, key=len, default=None)
        own = {k: v for k, v in configs[directory].items() if k != "root"}
        out[directory] = own if configs[directory].get("root") or parent is None else merged(out[parent], own)
    return out


def section_of(document: str, code: str) -> str | None:
    """The part of a Markdown rule reference under the heading of a code, or else of its category."""
    lines = document.splitlines()
    heads = [(i, len(h) - len(h.lstrip("#")), h.lstrip("#").strip()) for i, h in enumerate(lines) if h.startswith("#")]
    for wanted in (code.upper(), code.upper().split("-")[0]):
        for n, (i, level, title) in enumerate(heads):
            if title.split(":")[0].split(" ")[0].upper() == wanted:
                end = next((j for j, other, _ in heads[n + 1 :] if other <= level), len(lines))
                return "\n".join(lines[i:end]).rstrip()
    return None
