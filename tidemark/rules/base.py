"""What a rule is: a table function from facts to findings, with a code, a check, a severity and a default."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X

FINDING = ("check", "severity", "file", "line", "rule", "code", "category", "message", "fix", "ord")


def findings(df: DataFrame, check: str, rule: str | Column, severity: str | Column, line: str | Column | int, message: Column | str, fix: str | Column, ord: str | Column = "line", file: str = "path") -> DataFrame:
    """Rows of df as findings. message and fix given as text are texts; line and ord given as text are columns."""
    column = lambda c: F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)
    text = lambda c: F.lit(c) if isinstance(c, str) else c
    code = X.code_of(text(rule))
    return df.select(
        F.lit(check).alias("check"),
        text(severity).alias("severity"),
        F.col(file).alias("file"),
        column(line).cast("int").alias("line"),
        text(rule).alias("rule"),
        code.alias("code"),
        X.category_of(code).alias("category"),
        text(message).alias("message"),
        text(fix).alias("fix"),
        F.coalesce(column(ord) if not (isinstance(ord, str) and ord == "line") else column(line), F.lit(0)).cast("int").alias("ord"),
    )


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with value, worked out once a row: conditions on a plain column would work it out again, each time that they name it."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


@dataclass(frozen=True)
class Source:
    """The facts of a tree. files: path and content of every text file; facts: a row a Python file.

    carried: columns that both have besides and that rules keep while they need them: region, the folder whose settings
    hold for a file, and limits, its numbers by check.key.
    """

    files: DataFrame
    facts: DataFrame
    settings: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    carried: tuple[str, ...] = ()

    def of(self, check: str, key: str, default: Any) -> Any:
        return self.settings.get(check, {}).get(key, default)

    def limit(self, check: str, key: str, default: float) -> Column:
        """A number that may differ by file; over rows that have the carried columns."""
        whole = F.lit(self.of(check, key, default))
        return F.coalesce(F.element_at("limits", F.lit(f"{check}.{key}")), whole) if "limits" in self.carried else whole

    def _rows(self, name: str) -> DataFrame:
        return self.facts.select("path", *self.carried, F.explode(name).alias("x")).select("path", *self.carried, "x.*")

    @cached_property
    def functions(self) -> DataFrame:
        return self._rows("functions")

    @cached_property
    def classes(self) -> DataFrame:
        return self._rows("classes")

    @cached_property
    def comments(self) -> DataFrame:
        return self._rows("comments")

    @cached_property
    def imports(self) -> DataFrame:
        return self._rows("imports")

    @cached_property
    def calls(self) -> DataFrame:
        return self._rows("calls")

    @cached_property
    def attributes(self) -> DataFrame:
        return self._rows("attributes")

    @cached_property
    def assigns(self) -> DataFrame:
        return self._rows("assigns")

    @cached_property
    def lines(self) -> DataFrame:
        """path, line, text of every file."""
        return self.files.select("path", *self.carried, F.posexplode(X.split_lines(F.col("content"))).alias("k", "text")).select("path", *self.carried, (F.col("k") + 1).alias("line"), "text")


@dataclass(frozen=True)
class Rule:
    code: str
    check: str
    on: bool
    description: str
    build: Callable[[Source], DataFrame]
    tree: bool = False  # looks at several files together
    configure: Callable[[Mapping[str, Any]], Mapping[str, Any]] | None = None  # makes of its check's settings those that it builds with
    reads: tuple[str, ...] | None = None  # the facts that it looks at, or fields of their rows (functions.name); None: any


RULES: dict[tuple[str, str], Rule] = {}


def rule(code: str, check: str, description: str, on: bool = True, tree: bool = False, configure: Callable[[Mapping[str, Any]], Mapping[str, Any]] | None = None, reads: tuple[str, ...] | None = None) -> Callable:
    """Registers a table function under its check and code; plug-ins use it the same way. configure may complete a check's settings, or raise a ValueError about them.
    A rule that says what it reads may be given facts without the rest."""

    def put(build: Callable[[Source], DataFrame]) -> Callable[[Source], DataFrame]:
        RULES[(check, code)] = Rule(code, check, on, description, build, tree, configure, reads)
        return build

    return put


def notices(src: Source, check: str, code: str) -> DataFrame:
    """A warning at line 0 for each file that could not be parsed."""
    bad = src.facts.filter("error IS NOT NULL")
    return findings(bad, check, f"{code}: file could not be parsed", "warning", 0, F.concat(F.lit("Not checked: "), "error"), "Make the file parse")
