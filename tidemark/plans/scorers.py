"""Scorers: a rule, the corpus it is held against, and how. All scorers of a registry are one plan and one relation of results."""

from __future__ import annotations

import json
import time
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import scoring as S
from tidemark.plans import check as P
from tidemark.rules.base import RULES


@dataclass(frozen=True)
class Scorer:
    """whole_files: labels are of files (line 0), not of lines."""

    code: str
    check: str
    settings: Mapping[str, Any] = field(default_factory=dict)
    whole_files: bool = False

    @property
    def corpus(self) -> str:
        return f"{self.check}.{self.code}"

    def hits(self, files: DataFrame) -> DataFrame:
        """corpus, file, line of what the rule finds in the corpus' files."""
        own = files.filter(F.col("corpus") == self.corpus).select("path", "content")
        rules = [RULES[(self.check, self.code)]]
        found = P.find(P.source(own, {self.check: self.settings}, rules), rules)
        return found.select(F.lit(self.corpus).alias("corpus"), "file", (F.lit(0) if self.whole_files else F.col("line")).alias("line"))


SCORERS: dict[str, Scorer] = {
    s.code: s
    for s in (
        Scorer("CMT-001", "comments"),
        Scorer("CMT-005", "restating", {"enabled": True}),
        Scorer("CMT-007", "docstrings", {"enabled": True}),
        Scorer("NAMING-005", "naming_scope", {"enabled": True}),
        Scorer("PROSE-004", "prose", {"enabled": True, "em_dash_density": True}, whole_files=True),
        Scorer("SECRETPY-001", "secrets"),
        Scorer("SIMILAR-001", "similarity", {"enabled": True}, whole_files=True),
        Scorer("SQL-001", "security_patterns"),
    )
}


def score(files: DataFrame, labels: DataFrame, scorers: Iterable[Scorer] | None = None) -> DataFrame:
    """rule, corpus, labels, stale, tp, fp, fn, tn, precision, recall, f1 of every scorer that has labels or findings.

    files: corpus, path, content. labels: corpus, file, line, expected. stale counts findings that no label covers: with
    any, the corpus is out of date and its precision can't be trusted.
    """
    scorers = list(scorers if scorers is not None else SCORERS.values())
    hits = reduce(DataFrame.unionByName, (s.hits(files) for s in scorers))
    rules = F.create_map(*(F.lit(x) for s in scorers for x in (s.corpus, s.code)))
    labels = labels.filter(F.col("corpus").isin(*(s.corpus for s in scorers)))
    return S.scored(labels, hits, ["corpus", "file", "line"], ["corpus"]).withColumn("rule", F.element_at(rules, F.col("corpus")))


def timings(files: DataFrame, scorers: Iterable[Scorer], runs: int = 3) -> dict[str, dict[str, Any]]:
    """By corpus: files, lines and the median of seconds that its rule takes over it."""
    sizes = {r["corpus"]: r.asDict() for r in files.groupBy("corpus").agg(F.count("*").alias("files"), F.sum(F.size(F.split("content", "\n"))).alias("lines")).collect()}
    out: dict[str, dict[str, Any]] = {}
    for s in scorers:
        if s.corpus not in sizes:
            out[s.corpus] = {"skipped": "no files"}
            continue
        taken = []
        for _ in range(runs):
            began = time.perf_counter()
            s.hits(files).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - began)
        out[s.corpus] = {"files": sizes[s.corpus]["files"], "lines": sizes[s.corpus]["lines"], "seconds": round(sorted(taken)[runs // 2], 3)}
    return out


def audit(files: DataFrame, labels: DataFrame, path: str | Path, metadata: Mapping[str, Any], scorers: Iterable[Scorer] | None = None, runs: int = 3) -> int:
    """Writes what every scorer found and how long it took; 1 if a corpus is stale or has no labels, else 0. runs = 0 leaves the timings out."""
    scorers = list(scorers if scorers is not None else SCORERS.values())
    found = {r["corpus"]: r.asDict() for r in score(files, labels, scorers).collect()}
    accuracy = []
    for s in scorers:
        own = found.get(s.corpus)
        if own is None or not own["labels"]:
            accuracy.append({"rule": s.code, "corpus": s.corpus, "error": "no labels"})
        elif own["stale"]:
            accuracy.append({"rule": s.code, "corpus": s.corpus, "error": f"{own['stale']} findings without a label"})
        else:
            accuracy.append({k: v for k, v in own.items() if k != "stale"})
    report = {"metadata": dict(metadata), "accuracy": accuracy, "performance": timings(files, scorers, runs) if runs else {}}
    Path(path).write_text(json.dumps(report, indent=2, sort_keys=True), "utf-8")
    return int(any("error" in a for a in accuracy))
