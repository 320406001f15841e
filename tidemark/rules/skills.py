"""Rules over SKILL.md files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import vocabulary as V
from tidemark.rules.base import Source, findings, rule
from tidemark.sources import frontmatter



def _skills(src: Source) -> DataFrame:
    rows = frontmatter.parse(src.files.filter((X.name_of(F.col("path")) == "SKILL.md") & ~X.in_any(F.col("path"), V.SKIP_DIRS)))
    return rows.withColumn("folder", F.element_at(X.parts_of(F.col("path")), -2))


def _field(name: str, part: str) -> Column:
    return F.element_at("fields", name)[part]


def _problems(rows: DataFrame, code: str, severity: str, problems: list[tuple[Column, str]]) -> DataFrame:
    found = F.filter(F.array(*(F.when(test, F.lit(text)) for test, text in problems)), lambda x: x.isNotNull())
    return findings(rows.select("path", F.explode(found).alias("text")), "skills", f"{code}: skill file", severity, 1, F.col("text"), "Correct the frontmatter", F.lit(0))


@rule("SKILL-001", "skills", "Skills are named after their directory")
def skill_name(src: Source) -> DataFrame:
    rows = _skills(src)
    none = _problems(rows.filter("status = 'none'"), "SKILL-001", "error", [(F.lit(True), "No frontmatter")])
    kind, value = _field("name", "kind"), _field("name", "value")
    plain, chars = kind == "scalar", value.rlike(r"^[a-z0-9-]+\z")
    edge = value.startswith("-") | value.endswith("-")
    named = _problems(rows.filter("status = 'ok'"), "SKILL-001", "error", [
        (kind.isNull(), "name is missing"),
        (kind == "empty", "name is empty"),
        (plain & (F.length(value) > 64), "name has more than 64 characters"),
        (plain & ~chars, "name has other characters than a-z, 0-9 and hyphens"),
        (plain & chars & edge, "name begins or ends with a hyphen"),
        (plain & chars & ~edge & value.contains("--"), "name has two hyphens in a row"),
        (plain & value.rlike(r"^[a-z0-9]+(-[a-z0-9]+)*\z") & (value != F.col("folder")), "name is not the directory's"),
    ])
    return none.unionByName(named)


@rule("SKILL-002", "skills", "Skills are described")
def skill_description(src: Source) -> DataFrame:
    kind, value = _field("description", "kind"), F.trim(_field("description", "value"))
    return _problems(_skills(src).filter("status = 'ok'"), "SKILL-002", "error", [(kind.isNull(), "description is missing"), (kind.isNotNull() & (kind != "map") & (value == ""), "description is empty"), ((kind != "map") & (F.length(value) > 1024), "description has more than 1024 characters")])


@rule("SKILL-003", "skills", "Optional fields have their form")
def skill_fields(src: Source) -> DataFrame:
    return _problems(_skills(src).filter("status = 'ok'"), "SKILL-003", "error", [
        (_field("compatibility", "kind").isin("scalar", "block") & (F.length(F.trim(_field("compatibility", "value"))) > 500), "compatibility has more than 500 characters"),
        ((_field("metadata", "kind") == "scalar") & (_field("metadata", "value") != ""), "metadata is no map"),
        (_field("allowed-tools", "kind") == "map", "allowed-tools is a map"),
    ])


@rule("SKILL-004", "skills", "Skills are short")
def skill_body(src: Source) -> DataFrame:
    return _problems(_skills(src).filter("status = 'ok'"), "SKILL-004", "warning", [(F.size("body") > 500, "body has more than 500 lines")])


@rule("SKILL-005", "skills", "Links lead somewhere")
def skill_links(src: Source) -> DataFrame:
    """A fence closes with its own marker only; indented code is no link. Targets are looked up among files and directories; one above the tree is missing."""
    rows = _skills(src).filter("status = 'ok'") if src.of("skills", "check_links", True) else _skills(src).limit(0)
    mark = lambda x: F.substring(F.ltrim(x), 1, 3)
    marks = F.filter(F.transform("body", lambda x, i: F.when(mark(x).isin("```", "~~~"), F.struct(i.alias("at"), mark(x).alias("mark")))), lambda m: m.isNotNull())
    # what opens and closes: a fold over the few lines that are marks, not over all
    turn = lambda acc, m: F.when(acc["open"].isNull() | (acc["open"] == m["mark"]), F.struct(F.when(acc["open"].isNull(), m["mark"]).alias("open"), F.concat(acc["bounds"], F.array(m["at"])).alias("bounds"))).otherwise(acc)
    bounds = F.aggregate(marks, F.struct(F.lit(None).cast("string").alias("open"), F.array(F.lit(-1)).alias("bounds")), turn)["bounds"]
    rows = rows.withColumn("bounds", F.concat(bounds, F.array(F.size("body"))))
    runs = F.filter(F.transform("bounds", lambda x, i: F.when(i % 2 == 0, F.struct(x.alias("before"), F.get("bounds", i + 1).alias("next")))), lambda r: r.isNotNull() & r["next"].isNotNull())
    rows = rows.withColumn("runs", runs)
    cut = F.transform("runs", lambda r: F.struct((r["before"] + 1).alias("first"), F.slice("body", r["before"] + 2, r["next"] - r["before"] - 1).alias("texts")))
    rows = rows.select("path", "body_line", F.explode(cut).alias("r")).select("path", "body_line", "r.first", F.posexplode("r.texts").alias("j", "text"))
    rows = rows.filter(~F.col("text").startswith("    ") & ~F.col("text").startswith("\t")).withColumn("k", F.col("first") + F.col("j"))
    links = rows.select("path", (F.col("body_line") + F.col("k")).alias("line"), F.explode(F.regexp_extract_all("text", F.lit(r"\[[^\]]*\]\(([^)]+)\)"), F.lit(1))).alias("link"))
    target = F.regexp_replace(F.get(F.split(F.trim("link"), r"\s+"), F.lit(0)), "^<+|>+$", "")
    links = links.withColumn("target", target).filter((F.col("target") != "") & ~F.col("target").rlike(r"^[#/]") & ~F.col("target").rlike(r"(?i)^[a-z][a-z0-9+.-]*:"))
    folder = F.regexp_replace("path", "[^/]*$", "")
    links = links.withColumn("full", X.folded_path(F.concat(folder, F.regexp_replace("target", "#.*$", "")))).filter("full <> ''")
    parts = X.parts_of(F.col("path"))
    known = src.files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("full")).distinct()
    return findings(links.join(known, "full", "left_anti"), "skills", "SKILL-005: broken link", "warning", "line", F.format_string("Link target '%s' is missing", "target"), "Correct the path")


@rule("SKILL-006", "skills", "Frontmatter can be read")
def skill_unclear(src: Source) -> DataFrame:
    rows = _skills(src)
    cut = _problems(rows.filter("status = 'unterminated'"), "SKILL-006", "warning", [(F.lit(True), "frontmatter never ends")])
    return cut.unionByName(_problems(rows.filter("status = 'ok'"), "SKILL-006", "warning", [(_field("name", "kind").isin("block", "map", "flow"), "name is no simple value"), (_field("description", "kind") == "map", "description is no text")]))
