"""The command line: check, baseline, rules, rule, docs. 0 is a clean run, 1 one with violations, 2 a wrong use or configuration."""

from __future__ import annotations

import argparse
import json
import os
import sys
import tomllib
from collections.abc import Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

import tidemark
from tidemark.operators import baseline as B
from tidemark.operators import chain as C
from tidemark.plans import check as P
from tidemark.plans import report
from tidemark.plans.config import configured, listed, load_plugins, validated, with_source_root
from tidemark.rules.base import RULES
from tidemark.sources import tree as T
from tidemark.sources.tables import dropped, shared_folder, written

FORMATS = ("concise", "full", "json", "ndjson", "github")
BASELINE = "tidemark-baseline.json"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("tidemark")
    out.add_argument("--version", action="version", version=f"tidemark {getattr(tidemark, '__version__', '0')}")
    commands = out.add_subparsers(dest="command", required=True)
    check = commands.add_parser("check", help="check paths")
    check.add_argument("paths", nargs="*", default=["."])
    check.add_argument("--check", dest="single")
    for name in ("select", "ignore", "exclude", "promote"):
        check.add_argument(f"--{name}")
    check.add_argument("--show-config", action="store_true")
    check.add_argument("--plugin", action="append", default=[])
    check.add_argument("--output-format", choices=FORMATS)
    check.add_argument("--json", action="store_true")
    check.add_argument("--no-baseline", action="store_true")
    base = commands.add_parser("baseline", help="record or inspect known debt")
    base.add_argument("action", choices=("write", "status"))
    base.add_argument("paths", nargs="*", default=["."])
    commands.add_parser("rules", help="list all rules")
    commands.add_parser("rule", help="tell about one rule").add_argument("code")
    docs = commands.add_parser("docs", help="write the rule reference and the configuration's schema, or check that they are current")
    docs.add_argument("action", choices=("write", "check"))
    docs.add_argument("folder")
    return out


class Project:
    """Where a run takes place: its root, which has the configuration, the folder that is scanned, and the targets in it."""

    def __init__(self, paths: Sequence[str]):
        targets = [Path(p) for p in paths]
        for t in targets:
            if not t.exists():
                raise ValueError(f"path '{t}' does not exist")
        places = [t.resolve() for t in targets]
        folders = [p if p.is_dir() else p.parent for p in places]
        self.scan = Path(os.path.commonpath(folders))
        self.files_given = any(p.is_file() for p in places)
        self.targets = ["" if p == self.scan else p.relative_to(self.scan).as_posix() for p in places]
        self.root, self.config, self.file = self.scan, {}, None
        for folder in (self.scan, *self.scan.parents):
            if found := T.config_file(folder):
                self.root, self.file, self.config = folder, str(found), T.read_config(folder)
                break
        self.config = validated(T.extended(self.config, self.root))
        self.prefix = "" if self.scan == self.root else self.scan.relative_to(self.root).as_posix()

    def regions(self) -> dict[str, T.Config]:
        """Configurations of folders below the scanned one, each over those above it; the root's is ''."""
        own = {"": self.config}
        for folder, names, _ in os.walk(self.scan):
            names[:] = [n for n in names if n not in T.PRUNED]
            if Path(folder) != self.scan and T.config_file(folder):
                own[Path(folder).relative_to(self.scan).as_posix()] = T.extended(T.read_config(folder), folder)
        return {k: configured(with_source_root(validated(v))) for k, v in T.region_configs(own).items()}


class Run:
    """The tree as it is when the run begins, and the folder that all of the run's tables are in."""

    def __init__(self, spark: SparkSession, project: Project, exclude: Sequence[str] = ()):
        self.spark, self.folder = spark, shared_folder(spark, "run")
        excludes = [] if project.prefix else list(exclude)  # they are told from the root
        self.files = written(T.read_tree(spark, str(project.scan), excludes), f"{self.folder}/files")
        self.lines = P.C_lines(P.source(self.files), project.prefix)

    def __enter__(self) -> Run:
        return self

    def __exit__(self, *_: object) -> None:
        dropped(self.spark, self.folder)


def _findings(run: Run, project: Project, config: dict[str, Any], baseline: DataFrame | None, single: str | None = None) -> DataFrame:
    spark = run.spark
    targets = None if project.targets == [""] else spark.createDataFrame([(t,) for t in project.targets], "target string")
    regions = project.regions()
    regions[""] = configured(with_source_root(config))
    found = P.check(run.files, regions[""], targets, baseline, single, project.prefix, {k: v for k, v in regions.items() if k}, f"{run.folder}/check")
    return written(found, f"{run.folder}/found")


def _say(rows: DataFrame) -> None:
    for r in rows.toLocalIterator():
        print(r["value"])


def run_check(spark: SparkSession, args: argparse.Namespace) -> int:
    project = Project(args.paths)
    config = project.config | {k: listed(getattr(args, k), project.config, k) for k in ("select", "ignore", "exclude", "promote")}
    load_plugins([*config.get("plugins", ()), *args.plugin])
    if args.show_config:
        print("\n".join(report.config_listing(config, project.file, str(project.root))))
        return 0
    known, path = None, config.get("baseline")
    if path and not args.no_baseline:
        path = project.root / path
        if not path.is_file():
            raise ValueError(f"baseline '{path}' does not exist; 'baseline write' makes it")
        known = B.load(spark, str(path))
    with Run(spark, project, config["exclude"]) as run:
        return _report(run, project, config, known, args)


def _report(run: Run, project: Project, config: dict[str, Any], known: DataFrame | None, args: argparse.Namespace) -> int:
    spark = run.spark
    found = _findings(run, project, config, known, args.single)
    checks = P.checks_table(spark)
    if args.single:
        checks = spark.createDataFrame(sorted({(r.check,) for r in P.chosen(config, args.single)}), "check string")
    results, kind = C.rollup(found, checks), P.output_format(args.output_format, args.json)
    if kind == "json":
        print("[")
        _say(report.in_order(report.json_lines(found, checks)))
        print("]")
    elif kind in ("ndjson", "github"):
        _say(getattr(P, kind)(found))
    else:
        _say(report.in_order(report.human_lines(found, checks, kind == "full")))
        if kind == "concise":
            _say(report.summary_line(results))
        if known is not None:
            print("\n".join(report.drift_note(B.drift(B.anchored(found, run.lines), known), kind)))
    return P.exit_code(results)


def run_baseline(spark: SparkSession, args: argparse.Namespace) -> int:
    project = Project(args.paths)
    if project.files_given or project.targets != [""] or project.prefix:
        raise ValueError("'baseline' runs over the whole project root, without targets")
    load_plugins(project.config.get("plugins", ()))
    path = project.root / project.config.get("baseline", BASELINE)
    known = B.load(spark, str(path)) if path.is_file() else None
    if args.action == "status" and known is None:
        raise ValueError(f"baseline '{path}' does not exist; 'baseline write' makes it")
    with Run(spark, project, project.config.get("exclude", ())) as run:
        found = written(B.anchored(_findings(run, project, project.config, None), run.lines), f"{run.folder}/anchored")
        if args.action == "write":
            if known is not None:
                known = written(known, f"{run.folder}/known")  # the file is about to be replaced
            n = B.changes(found, known if known is not None else B.entries(found).limit(0))
            B.write(found, str(path))
            print(f"Wrote {n['now']} baseline entries ({n['findings']} findings): +{n['added']} new, -{n['pruned']} pruned (was {n['was']}).")
            if known is None:
                print(f'\nAdd to the configuration:\n\n    baseline = "{path.name}"')
            return 0
        gone = [(r["file"], r["code"]) for r in B.stale(found, known).orderBy("file", "code").toLocalIterator()]
        print(f"{len(gone)} stale baseline entries (matched nothing this run):" if gone else f"Baseline is current: all {known.count()} entries still match a finding.")
        print("\n".join(f"  {file}  {code}" for file, code in gone))
        return 0


def run_docs(args: argparse.Namespace) -> int:
    want = {"RULES.md": report.rule_reference(), "config.schema.json": json.dumps(report.config_schema(), indent=2) + "\n"}
    folder, stale = Path(args.folder), []
    for name, text in want.items():
        if args.action == "write":
            folder.mkdir(parents=True, exist_ok=True)
            (folder / name).write_text(text, "utf-8")
        elif not (folder / name).is_file() or (folder / name).read_text("utf-8") != text:
            stale.append(name)
    for name in stale:
        print(f"{name} is stale; 'docs write' makes it anew")
    return int(bool(stale))


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        load_plugins()
        if args.command == "rules":
            print("\n".join(report.rules_listing()))
            return 0
        if args.command == "rule":
            if args.code.upper() not in {r.code for r in RULES.values()} | {r.code.split("-")[0] for r in RULES.values()}:
                raise ValueError(f"no rule '{args.code}'; 'rules' lists them all")
            print(T.section_of(report.rule_reference(), args.code))
            return 0
        if args.command == "docs":
            return run_docs(args)
        spark = spark or SparkSession.builder.appName("tidemark").getOrCreate()
        return (run_check if args.command == "check" else run_baseline)(spark, args)
    except (ValueError, tomllib.TOMLDecodeError) as e:
        print(f"ERROR: {e}", file=sys.stderr)
        return 2
