"""What a configuration may hold, and how the command line, a configuration and its profiles come together."""

from __future__ import annotations

import importlib
import importlib.metadata
import pkgutil
from collections.abc import Iterable, Mapping
from typing import Any

import tidemark.rules
from tidemark.rules.base import RULES

GROUP = "tidemark.checks"
#: Checks that look for layers below source_root.
LAYOUT_CHECKS = ("layer_deps", "port_coverage", "security_patterns")

FLAG, NUMBER, WORD, WORDS, TABLE, TABLES = "true or false", "a number", "a text", "a list of texts", "a table", "a list of tables"
#: Settings by check, with the kind of value that each takes. Checks without a row have enabled only.
SETTINGS: dict[str, dict[str, str]] = {
    "attribute_access": {"flag_dynamic": FLAG},
    "comments": {"block_lines_per_branch": NUMBER, "commented_code": FLAG, "em_dash": FLAG, "emoji": FLAG, "max_block_lines": NUMBER, "max_comment_chars": NUMBER, "verbose": FLAG},
    "docs": {"allow": WORDS, "docs_root": WORD, "known_top_level": WORDS, "raster_extensions": WORDS, "sections": WORDS},
    "docstrings": {"min_lines": NUMBER, "require_private": FLAG},
    "domain_terms": {"rules": TABLES},
    "file_limits": dict.fromkeys(("class_method_warn", "complexity_error", "complexity_warn", "file_error", "file_warn", "func_error", "func_warn", "param_error", "param_warn"), NUMBER),
    "forbidden_paths": {"dirs": WORDS},
    "layer_deps": {"allowed": TABLE, "composition_root": WORDS, "layers": WORDS, "source_root": WORD, "transport_layers": WORDS},
    "naming_consistency": {"repo_crud": FLAG, "service_crud": FLAG},
    "naming_scope": {"allow": WORDS, "max_short_length": NUMBER, "max_span": NUMBER},
    "port_coverage": {"adapter_roots": WORDS, "composition_root": WORDS, "ports_dir": WORD, "ports_without_impl": WORDS, "skip_files": WORDS, "source_root": WORD},
    "prose": {"density": TABLE, "em_dash": FLAG, "em_dash_density": FLAG, "emoji": FLAG, "extensions": WORDS, "spellings": TABLE},
    "security_patterns": {"source_root": WORD},
    "similarity": dict.fromkeys(("attr_jaccard", "call_jaccard", "min_statements", "op_jaccard", "str_jaccard", "struct_ratio"), NUMBER),
    "skills": {"check_links": FLAG},
    "stale_paths": {"tokens": WORDS},
    "stray_artifacts": {"allow": WORDS, "assets": WORDS, "exclude": WORDS, "extensions": WORDS, "patterns": WORDS},
    "suppressions": {"allow_blanket": FLAG, "max_total": NUMBER, "word": WORD},
    "test_coverage": {"test_roots": WORDS},
    "test_style": {"dry_prefix_statements": NUMBER, "min_statements": NUMBER, "required_markers": NUMBER, "synonyms": TABLE},
}
TOP: dict[str, str] = {"baseline": WORD, "directive": WORD, "exclude": WORDS, "extends": WORDS, "ignore": WORDS, "per-file-ignores": TABLE, "plugins": WORDS, "promote": WORDS, "root": FLAG, "select": WORDS, "source_root": WORD}


def _fits(value: object, kind: str) -> bool:
    words = lambda v: isinstance(v, list | tuple) and all(isinstance(x, str) for x in v)
    return {
        FLAG: isinstance(value, bool),
        NUMBER: isinstance(value, int | float) and not isinstance(value, bool),
        WORD: isinstance(value, str),
        WORDS: words(value),
        TABLE: isinstance(value, Mapping),
        TABLES: isinstance(value, list | tuple) and all(isinstance(x, Mapping) for x in value),
    }[kind]


def validated(config: Mapping[str, Any]) -> dict[str, Any]:
    """config as it is, or a ValueError that names the first value of a wrong kind. Keys that nobody knows are left alone."""
    checks = {c for c, _ in RULES}
    for key, value in config.items():
        if key in TOP:
            if not _fits(value, TOP[key]) and not (key == "extends" and isinstance(value, str)):
                raise ValueError(f"{key} takes {TOP[key]}, not {value!r}")
        elif key in checks:
            if not isinstance(value, Mapping):
                raise ValueError(f"[{key}] is a table, not {value!r}")
            for name, v in value.items():
                kind = FLAG if name == "enabled" else SETTINGS.get(key, {}).get(name)
                if kind and not _fits(v, kind):
                    raise ValueError(f"[{key}] {name} takes {kind}, not {v!r}")
    return dict(config)


def configured(config: Mapping[str, Any]) -> dict[str, Any]:
    """config with the settings that the rules' own hooks make of their check's; what one of them rejects is a ValueError that names the check."""
    out = dict(config)
    for (check, code), r in sorted(RULES.items()):
        if r.configure is not None:
            try:
                out[check] = dict(r.configure(dict(out.get(check, {}))))
            except Exception as e:
                raise ValueError(f"[{check}] {code}: {e}") from e
    return out


def with_source_root(config: Mapping[str, Any]) -> dict[str, Any]:
    """The top-level source_root as a setting of the checks that look for layers, where they have none of their own."""
    out, root = dict(config), config.get("source_root")
    if root:
        for check in LAYOUT_CHECKS:
            out[check] = {"source_root": root} | dict(out.get(check, {}))
    return out


def listed(given: str | None, config: Mapping[str, Any], key: str) -> list[str]:
    """What the command line lists by commas; if that is nothing, what the configuration lists."""
    items = [x.strip() for x in (given or "").split(",")]
    return [x for x in items if x] or list(config.get(key, ()))


def load_plugins(names: Iterable[str] = (), group: str = GROUP) -> list[str]:
    """Imports the rules of this package, of all entry points of the group and of the named modules; what has been imported. Rules register themselves."""
    found = [f"{tidemark.rules.__name__}.{m.name}" for m in pkgutil.iter_modules(tidemark.rules.__path__)]
    found += [e.value.partition(":")[0] for e in importlib.metadata.entry_points(group=group)]
    found += names
    for name in found:
        try:
            importlib.import_module(name)
        except ImportError as e:
            raise ValueError(f"no plug-in '{name}': {e}") from e
    return found
