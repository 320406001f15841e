"""Frontmatter of skill files: the only dynamic schema there is, read to a map of tagged values."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

FIELDS = "path string, status string, fields map<string,struct<kind:string,value:string>>, body array<string>, body_line int"
_KEY = re.compile(r"([A-Za-z][\w-]*)\s*:(.*)")
_PAIR = re.compile(r"\s+[A-Za-z][\w-]*\s*:\s*.*")
_BLOCK = re.compile(r"[|>][0-9]*[+-]?")


def _scalar(text: str) -> tuple[str, str]:
    if text[0] in "{[":
        return "flow", text
    if text[0] in "\"'":
        return "scalar", text[1:-1] if len(text) > 1 and text[-1] == text[0] else text
    return "scalar", re.split(r"(?:^|(?<=[ \t]))#", text, maxsplit=1)[0].strip()


def read(content: str) -> tuple[str, dict[str, dict[str, str]], list[str], int]:
    """Status (ok, none, unterminated), fields, body lines, and the line at which the body begins."""
    lines = content.removeprefix("﻿").splitlines()
    if not lines or lines[0].strip() != "---":
        return "none", {}, lines, 1
    end = next((i for i in range(1, len(lines)) if lines[i].rstrip() == "---"), None)
    if end is None:
        return "unterminated", {}, [], 1
    fields, i = {}, 1
    while i < end:
        line, i = lines[i], i + 1
        m = None if line[:1] in (" ", "\t", "#") else _KEY.fullmatch(line)
        if not m:
            continue
        rest = m[2].strip()
        folded = bool(_BLOCK.fullmatch(rest))
        if rest and not folded:
            kind, value = _scalar(rest)
        else:
            block = []
            while i < end and (not lines[i].strip() or lines[i][0] in " \t"):
                block += [lines[i]] if lines[i].strip() else []
                i += 1
            pairs = block and not folded and all(map(_PAIR.fullmatch, block))
            kind, value = ("map", "") if pairs else ("block", " ".join(b.strip() for b in block)) if block else ("empty", "")
        fields[m[1]] = {"kind": kind, "value": value}
    return "ok", fields, lines[end + 1 :], end + 2


def parse(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(p, *read(c or "")) for p, c in zip(batch["path"], batch["content"], strict=True)], columns=["path", "status", "fields", "body", "body_line"])

    return files.select("path", "content").mapInPandas(run, FIELDS)
