"""A whole run: facts once, the rules that are on, the chain, the report."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Mapping
from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import tidemark.operators.similarity
import tidemark.rules.architecture
import tidemark.rules.code
import tidemark.rules.prose
import tidemark.rules.security
import tidemark.rules.skills  # noqa: F401
from tidemark.functions import text as X
from tidemark.operators import baseline as B
from tidemark.operators import chain as C
from tidemark.plans.config import NUMBER, SETTINGS
from tidemark.rules.base import FINDING, RULES, Rule, Source, findings
from tidemark.sources import facts as facts_source
from tidemark.sources.tables import shared_folder, written


def source(files: DataFrame, settings: Mapping[str, Mapping[str, Any]] | None = None, rules: Iterable[Rule] | None = None) -> Source:
    """files: path, content. Parsing is the expensive step; callers that run several rules persist or write facts.

    rules: those that the source is for. Where all of them say what they read, there are no other facts.
    """
    settings = settings or {}
    python = files.filter(F.col("path").endswith(".py"))
    reads = [r.reads for r in rules] if rules is not None else [None]
    kept = None if None in reads else sorted({x for r in reads for x in r})
    return Source(files, facts_source.parse(python, int(settings.get("test_style", {}).get("dry_prefix_statements", 3)), kept), settings)


def chosen(settings: Mapping[str, Any], single: str | None = None) -> list[Rule]:
    """Rules that run: those on by default or by their check's settings; or those of one check, code or category."""
    if single:
        named = [r for r in RULES.values() if r.check == single]
        named = named or [r for r in RULES.values() if single.upper() in (r.code, r.code.split("-")[0]) and r.code != "TERM-NNN"]
        if not named:
            raise ValueError(f"no check, code or category '{single}'")
        return named
    flags = {("comments", "PROSE-001"): "em_dash", ("comments", "PROSE-003"): "emoji", ("prose", "PROSE-004"): "em_dash_density", ("naming_consistency", "NAMING-001"): "repo_crud", ("naming_consistency", "NAMING-002"): "service_crud"}
    opposite = {("comments", "CMT-001"): "commented_code", ("comments", "CMT-002"): "verbose", ("prose", "PROSE-001"): "em_dash", ("prose", "PROSE-003"): "emoji"}
    out = []
    for key, r in RULES.items():
        own = settings.get(r.check, {})
        on = bool(own.get(flags[key], False)) and own.get("enabled", r.check != "prose") if key in flags else own.get("enabled", r.on)
        if on and own.get(opposite.get(key, ""), True):
            out.append(r)
    return out


def wanted(rules: Iterable[Rule], select: Iterable[str] = (), ignore: Iterable[str] = ()) -> list[Rule]:
    """The rules of which the chain may keep findings; the others need not run. A rule of many codes, whose own ends in NNN, goes by its category."""
    select, ignore = ({c.strip().upper() for c in x if c.strip()} for x in (select, ignore))
    names = lambda r: {r.code.split("-")[0], *([] if r.code.endswith("NNN") else [r.code])}
    among = lambda r: not select or "ALL" in select or bool(select & names(r)) or (r.code.endswith("NNN") and any(c.startswith(r.code[:-3]) for c in select))
    return [r for r in rules if among(r) and "ALL" not in ignore and not ignore & names(r)]


Job = tuple[Source, Rule]


def find(src: Source, rules: Iterable[Rule] | None = None) -> DataFrame:
    """The findings of rules. A rule whose plan cannot be built becomes a notice of its own instead of failing the run."""
    return together([(src, r) for r in (rules if rules is not None else chosen(src.settings))], src.files)


def together(jobs: Iterable[Job], files: DataFrame) -> DataFrame:
    """The findings of rules, each over a source of its own, as one plan."""
    parts = []
    for src, r in jobs:
        try:
            parts.append(r.build(src))
        except Exception as e:  # noqa: BLE001  a plug-in's fault is reported, like any finding
            parts.append(_fault(files.sparkSession, r, e))
    if not parts:
        return findings(files.select("path").limit(0), "", "", "error", 0, "", "")
    return reduce(DataFrame.unionByName, parts)


def _fault(spark: SparkSession, r: Rule, e: Exception) -> DataFrame:
    said = next((x for x in str(e).splitlines() if x.strip()), "")
    return findings(spark.createDataFrame([("",)], "path string"), r.check, "RUN-000: check failed", "warning", 0, F.lit(f"{r.code}: {type(e).__name__}: {said}"[:500]), "Mend the check")


def isolated(src: Source, rules: Iterable[Rule], folder: str) -> DataFrame:
    """As find, by ended."""
    return ended([(src, r) for r in rules], src.files, folder)


def ended(jobs: Iterable[Job], files: DataFrame, folder: str) -> DataFrame:
    """As together, written below folder, which all executors see. A rule that fails while it runs becomes a notice too:
    where a group of rules fails, its halves run by themselves, down to the rule. So a run without faults is one job, and
    each fault costs some more for the halvings that lead to it."""
    todo, parts = [list(jobs)], []
    while todo:
        some = todo.pop()
        try:
            parts.append(written(together(some, files), f"{folder}/findings-{len(parts)}-{len(todo)}-{len(some)}"))
        except Exception as e:  # noqa: BLE001  see together
            if len(some) == 1:
                parts.append(_fault(files.sparkSession, some[0][1], e))
            else:
                todo += [some[len(some) // 2 :], some[: len(some) // 2]]
    return reduce(DataFrame.unionByName, parts)


def well_formed(found: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Findings about the rules themselves: blank names, descriptions, no codes; findings of strange checks or with blank fields."""
    return with_meta(found, rules).filter("check = 'meta'")


def with_meta(found: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """found, and findings of the check meta about it and about the rules. found is gone through once."""
    rules = list(rules)
    rows = [(r.check, "META-001", "check has a blank name") for r in rules if not r.check.strip()]
    rows += [(r.check, "META-002", "rule has a blank description") for r in rules if not r.description.strip()]
    rows += [(r.check, "META-003", "rule has no code") for r in rules if not r.code.strip()]
    about = found.sparkSession.createDataFrame(rows, "path string, code string, text string")
    own = findings(about, "meta", F.concat("code", F.lit(": "), "text"), "error", 0, F.col("text"), "Complete it", F.lit(0))
    strange = ~F.col("check").isin("meta", *{r.check for r in rules})
    blank = F.lit(False)
    for c in ("file", "rule", "message", "fix"):
        blank = blank | (F.trim(c) == "")

    def told(rule: str, message: Column, fix: str) -> Column:
        parts = {"check": F.lit("meta"), "severity": F.lit("error"), "rule": F.lit(rule), "code": F.lit(rule[:8]), "category": F.lit("META"), "message": message, "fix": F.lit(fix)}
        return F.struct(*(parts.get(c, F.col(c)).alias(c) for c in FINDING))

    extra = F.filter(
        F.array(
            F.when(strange, told("META-004: finding of another check", F.concat("check", F.lit(" is not registered")), "Name the check")),
            F.when(blank & (F.col("code") != "RUN-000"), told("META-005: finding with a blank field", F.concat(F.lit("Blank field in "), "rule"), "Fill it in")),
        ),
        lambda x: x.isNotNull(),
    )
    each = found.select(F.inline(F.concat(F.array(F.struct(*FINDING)), extra)))
    return each.unionByName(own)


NUMBERS = {f"{check}.{key}" for check, keys in SETTINGS.items() for key, kind in keys.items() if kind == NUMBER and key != "dry_prefix_statements"}


def _parted(settings: Mapping[str, Any]) -> tuple[dict[str, float], dict[str, dict[str, Any]]]:
    """Numbers by check.key, and all other settings by check."""
    tables = {c: v for c, v in settings.items() if isinstance(v, Mapping) and c != "per-file-ignores"}
    numbers = {f"{c}.{k}": float(x) for c, v in tables.items() for k, x in v.items() if f"{c}.{k}" in NUMBERS}
    return numbers, {c: {k: x for k, x in v.items() if f"{c}.{k}" not in NUMBERS} for c, v in tables.items()}


def passes(src: Source, rules: Iterable[Rule], regions: Mapping[str, Mapping[str, Any]], single: str | None = None, among: set[str] | None = None) -> list[Job]:
    """The rules of a run where folders below the root have settings of their own, each with the source that it looks at.

    Rules of several files look at all, under the root's settings. The others look at every file under those of its nearest
    region: its numbers are columns, so regions that differ in numbers alone share a plan, however many they are; for other
    settings a check has a plan for each different table of them.
    """
    codes = among if among is not None else {r.code for r in RULES.values()}
    wholes = {"": src.settings, **regions}
    parted = {name: _parted(whole) for name, whole in wholes.items()}
    checks = sorted({r.check for r in RULES.values() if not r.tree})
    kinds: dict[str, dict[str, int]] = {c: {} for c in checks}  # by check: its tables of settings, told apart
    of = {name: {c: kinds[c].setdefault(json.dumps(other.get(c, {}), sort_keys=True, default=str), len(kinds[c])) for c in checks} for name, (_, other) in parted.items()}
    varied = [c for c in checks if len(kinds[c]) > 1]
    places = [(name, parted[name][0], {c: of[name][c] for c in varied}) for name in wholes]
    files, facts = (C.with_regions(t, places) for t in (src.files, src.facts))
    out = [(src, r) for r in rules if r.tree]
    for c in checks:
        for kind in range(len(kinds[c])):
            settings = next(parted[name][1] for name in wholes if of[name][c] == kind)
            here = (lambda t, c=c, kind=kind: t.filter(F.element_at("kinds", F.lit(c)) == kind)) if c in varied else (lambda t: t)
            own = Source(here(files), here(facts), settings, ("region", "limits"))
            out += [(own, r) for r in chosen(settings, single) if r.check == c and not r.tree and r.code in codes]
    return out


def regional(src: Source, rules: Iterable[Rule], regions: Mapping[str, Mapping[str, Any]], single: str | None = None, among: set[str] | None = None) -> DataFrame:
    """The findings of passes."""
    return together(passes(src, rules, regions, single, among), src.files)


def check(files: DataFrame, config: Mapping[str, Any] | None = None, targets: DataFrame | None = None, baseline: DataFrame | None = None, single: str | None = None, prefix: str = "", regions: Mapping[str, Mapping[str, Any]] | None = None, folder: str | None = None) -> DataFrame:
    """Findings after the whole chain. config: the settings by check, and select, ignore, exclude, per-file-ignores, promote.

    regions: by folder, whole configurations for the files below it that no deeper region has (sources.tree.region_configs);
    the chain after the rules is the root's. folder: where files, facts and the rules' findings are written, a new one below
    spark.checkpoint.dir unless given; the result reads it.
    """
    config = dict(config or {})
    settings = {k: v for k, v in config.items() if isinstance(v, Mapping) and k != "per-file-ignores"}
    folder = folder or shared_folder(files.sparkSession, "check")
    files = written(files, f"{folder}/files")  # rules over paths and the chain would make or read the tree again, each for itself
    src = source(files, settings)
    src = replace(src, facts=written(src.facts, f"{folder}/facts"))
    rules = wanted(chosen(settings, single), config.get("select", ()), config.get("ignore", ()))
    among = {r.code for r in wanted(RULES.values(), config.get("select", ()), config.get("ignore", ()))}
    jobs = passes(src, rules, regions, single, among) if regions else [(src, r) for r in rules]
    found = with_meta(ended(jobs, files, folder), RULES.values())
    found = C.reanchor(C.keep_targets(found, targets), prefix)
    select = list(config.get("select", ())) or ([single] if single and single.upper() in {r.code for r in rules} else [])
    found = C.exclude(C.select_ignore(found, select, config.get("ignore", ())), config.get("exclude", ()))
    word = config.get("directive", "tidemark")
    silent = replace(src, files=src.files.filter(C.silencing(F.col("content"), word)))
    found = C.inline_ignores(C.per_file_ignores(found, config.get("per-file-ignores", {})), C_lines(silent, prefix), word)
    if baseline is not None:
        found = B.suppress(B.anchored(found, C_lines(src, prefix)), baseline).select(*FINDING)
    return C.promote(found, config.get("promote", ()))


def C_lines(src: Source, prefix: str) -> DataFrame:
    return C.reanchor(src.lines.withColumnRenamed("path", "file"), prefix).withColumnRenamed("file", "path")


def checks_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted({(r.check,) for r in RULES.values()}), "check string")


# --- sinks -------------------------------------------------------------------------------------------------------


def ndjson(found: DataFrame) -> DataFrame:
    """One document a finding, as text lines."""
    return found.select(F.to_json(F.struct("check", "severity", "file", "line", "code", "rule", "message", "fix")).alias("value"))


def github(found: DataFrame) -> DataFrame:
    e = X.github_escape
    level = F.when(F.col("severity") == "error", "error").otherwise("warning")
    return found.select(F.concat(F.lit("::"), level, F.lit(" file="), e(F.col("file")), F.lit(",line="), F.greatest("line", F.lit(1)), F.lit(",title="), e(F.col("code")), F.lit("::"), e(F.concat("message", F.lit(" Fix: "), "fix"))).alias("value"))


def as_json(found: DataFrame, checks: DataFrame) -> DataFrame:
    """One document a check: its status, violations and warnings. A check's findings are one array, as its report is."""
    item = F.struct("file", "line", "rule", "message", "fix", "code")
    lists = found.groupBy("check").agg(*(F.array_sort(F.collect_list(F.when(F.col("severity") == s, item))).alias(n) for s, n in (("error", "violations"), ("warning", "warnings"))))
    rows = C.rollup(found, checks).select("check", "status").join(lists, "check", "left")
    none = F.array().cast(lists.schema["violations"].dataType)
    return rows.select(F.to_json(F.struct("check", "status", F.coalesce("violations", none).alias("violations"), F.coalesce("warnings", none).alias("warnings"))).alias("value"))


def output_format(explicit: str | None = None, as_json_flag: bool = False, environment: Mapping[str, str] | None = None) -> str:
    """--json, then an explicit format, then github under that service, then concise."""
    if as_json_flag:
        return "json"
    return explicit or ("github" if (environment if environment is not None else os.environ).get("GITHUB_ACTIONS") == "true" else "concise")


def exit_code(results: DataFrame) -> int:
    return int(not results.filter("status = 'FAIL'").isEmpty())


def rules_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted((r.check, r.code, r.on, r.tree, r.description) for r in RULES.values()), "check string, code string, enabled boolean, tree boolean, description string")
