"""Rules over comments, Markdown lines and pages."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import vocabulary as V
from tidemark.operators.groups import islands
from tidemark.rules.base import Source, findings, once, rule



def term_matches(rows: DataFrame, rules: list[dict[str, Any]]) -> DataFrame:
    """Findings of forbidden terms in rows (path, line, text); rules: id, canonical, forbidden."""
    table = [(r["id"], r["canonical"], "|".join(map(X._quoted, r["forbidden"]))) for r in rules if r.get("forbidden")]
    if not table:
        return findings(rows.limit(0), "domain_terms", "TERM-NNN", "error", "line", "", "")
    whole = lambda words: rf"(?iU)\b({words})\b"
    told = lambda code, canonical: lambda t: F.struct(F.lit(code).alias("id"), F.lit(canonical).alias("canonical"), t.alias("term"))
    hits = [F.transform(F.regexp_extract_all("text", F.lit(whole(words)), F.lit(1)), told(code, canonical)) for code, canonical, words in table]
    some = rows.filter(F.col("text").rlike("(?iu)" + "|".join(words for *_, words in table)))  # rows are gone through once; most hold none, which is told without the ends of words
    hits = some.select("path", "line", F.explode(F.flatten(F.array(*hits))).alias("x")).select("path", "line", "x.*")
    use = F.concat(F.lit("Use '"), F.col("canonical"), F.lit("'"))
    return findings(hits, "domain_terms", F.concat("id", F.lit(": "), use, F.lit(" instead of '"), "term", F.lit("'")), "error", "line", F.format_string("Forbidden term '%s'", "term"), use)


def _kept_comments(src: Source) -> DataFrame:
    return src.comments.filter(~X.in_any(F.col("path"), V.SKIP_DIRS))


@rule("CMT-001", "comments", "Dead code is deleted", reads=("comments",))
def dead_code(src: Source) -> DataFrame:
    rows = _kept_comments(src).filter("code AND NOT metadata")
    return findings(rows, "comments", "CMT-001: commented-out code", "error", "line", F.concat(F.lit("Commented-out code: "), F.substring("text", 1, 60)), "Delete it")


@rule("CMT-002", "comments", "Comments are short")
def long_comments(src: Source) -> DataFrame:
    """Long lines, and runs of comment lines longer than the function at hand allows. Runs are islands of line less rank."""
    get = lambda k, d: src.limit("comments", k, d)
    long = _kept_comments(src).filter(F.length("text") > get("max_comment_chars", 120))
    lines = findings(long, "comments", "CMT-002: comment is too long", "error", "line", F.format_string("Comment has %d characters", F.length("text")), "Tighten it")
    runs = islands(_kept_comments(src).filter("standalone"), "path", "line", src.carried)
    spans = src.functions.select(F.col("path").alias("p"), F.col("line").alias("from"), F.col("end").alias("to"), "complexity")
    runs = runs.filter(F.col("n") > get("max_block_lines", 6)).join(spans, F.col("path") == F.col("p"), "left")
    inside = F.max(F.when(F.col("first").between(F.col("from"), F.col("to")), F.col("complexity")))
    after = F.max(F.when((F.col("from") - F.col("last")).between(0, 2), F.col("complexity")))
    runs = runs.groupBy("path", "first", "n").agg(F.coalesce(inside, after, F.lit(1)).alias("complexity"), *(F.first(c).alias(c) for c in src.carried))
    runs = runs.filter(F.col("n") > get("max_block_lines", 6) + (F.col("complexity") - 1) * get("block_lines_per_branch", 2))
    return lines.unionByName(findings(runs, "comments", "CMT-002: comment block is too long", "error", "first", F.format_string("Comment block has %d lines", "n"), "Tighten it", F.col("first")))


def _comment_texts(src: Source) -> DataFrame:
    skip = X.in_any(F.col("path"), V.SKIP_DIRS)
    docs = src.facts.filter(~skip).select("path", F.explode("doc_lines").alias("x")).select("path", "x.line", "x.text")
    return _kept_comments(src).select("path", "line", "text").unionByName(docs)


@rule("PROSE-001", "comments", "No em dashes in comments", on=False)
def comment_dash(src: Source) -> DataFrame:
    return findings(_comment_texts(src).filter(F.col("text").contains(V.EM_DASH)), "comments", "PROSE-001: em dash", "error", "line", "Em dash in a comment or docstring", "Use a comma or a full stop")


@rule("PROSE-003", "comments", "No emoji in comments", on=False)
def comment_emoji(src: Source) -> DataFrame:
    return findings(_comment_texts(src).filter(F.col("text").rlike(V.EMOJI)), "comments", "PROSE-003: emoji", "error", "line", "Emoji in a comment or docstring", "Remove it")


@rule("CMT-005", "restating", "Comments say why", on=False, reads=("comments",))
def restating(src: Source) -> DataFrame:
    row = src.facts.filter(~X.in_any(F.col("path"), V.SKIP_DIRS))
    beside = lambda c, i, k: F.coalesce(F.get("comments", i + k)["standalone"] & (F.get("comments", i + k)["line"] == c["line"] + k), F.lit(False))
    lonely = lambda c, i: ~(c["standalone"] & (beside(c, i, -1) | beside(c, i, 1)))
    told = F.transform("comments", lambda c, i: F.when(lonely(c, i) & c["simple"], c))  # comments are in order, one a line at most
    alone = row.select("path", *src.carried, F.explode(F.filter(told, lambda c: c.isNotNull())).alias("x")).select("path", *src.carried, "x.*")
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), lambda w: ~w.isin(*V.STOPWORDS))
    verbs = F.create_map(*(F.lit(x) for kv in V.VERBS.items() for x in kv))
    rows = once(alone.filter(~X.allowlisted(F.col("text"))), "words", words).filter("size(words) BETWEEN 1 AND 4")
    said = F.forall("words", lambda w: F.when(w.isin(*V.VERBS), F.array_contains("verbs", F.element_at(verbs, w))).otherwise(F.array_contains("tokens", X.stem(w))))
    return findings(rows.filter(said), "restating", "CMT-005: comment restates the code", "error", "line", F.concat(F.lit("Comment restates the code: "), F.substring("text", 1, 50)), "Say why, or remove it")


@rule("SUPPRESS-001", "suppressions", "Few suppressions", on=False)
def suppression_budget(src: Source) -> DataFrame:
    """One finding for the tree, or for each region that has more than its budget, at the first directive, naming the three files with most."""
    region = F.col("region") if "region" in src.carried else F.lit("")
    rows = _directives(src).select("path", "line", region.alias("region"), src.limit("suppressions", "max_total", 0).alias("budget"))
    per_file = rows.groupBy("region", "path").agg(F.count("*").alias("n"), F.min("line").alias("line"), F.first("budget").alias("budget"))
    order = F.struct(X.parts_of(F.col("path")).alias("parts"), "line")
    total = per_file.groupBy("region").agg(F.sum("n").alias("n"), F.count("*").alias("files"), F.first("budget").alias("budget"), F.min(F.struct(order.alias("o"), "path", "line")).alias("first"))
    place = F.row_number().over(W.partitionBy("region").orderBy(F.desc("n"), "path"))
    most = per_file.withColumn("place", place).filter("place <= 3").groupBy("region").agg(F.array_sort(F.collect_list(F.struct("place", "path", "n"))).alias("most"))
    worst = F.array_join(F.transform("most", lambda x: F.format_string("%s (%d)", x["path"], x["n"])), ", ")
    rows = total.filter("n > budget").join(most, "region").select(F.col("first.path").alias("path"), F.col("first.line").alias("line"), "n", "files", worst.alias("worst"))
    return findings(rows, "suppressions", "SUPPRESS-001: too many suppressions", "error", "line", F.format_string("%d suppressions in %d files. Most: %s", "n", "files", "worst"), "Fix what they hide")


def directive(word: str) -> str:
    """The suppression directive of a tool of this name."""
    return rf"(?i)#\s*{word}\s*:\s*ignore(?:\s*\[([A-Za-z0-9_,\-\s]+)\])?"


NOQA = r"(?i)#\s*noqa(?:\s*:\s*([A-Za-z0-9_,\-\s]+))?"


def _directives(src: Source) -> DataFrame:
    """Comments that begin with a directive; blanket ones name no rule, or all."""
    rows = src.comments.filter(~X.in_any(F.col("path"), V.SKIP_DIRS))
    tries = []
    for pattern in (NOQA, directive(src.of("suppressions", "word", "tidemark"))):
        at_start = pattern.replace("(?i)", "(?i)^", 1)
        codes = F.transform(F.split(F.regexp_extract("raw", at_start, 1), ","), lambda c: F.upper(F.trim(c)))
        named = F.regexp_extract("raw", at_start, 1) != ""
        tries.append(F.when(F.col("raw").rlike(at_start), ~named | F.array_contains(codes, "ALL") | F.array_contains(codes, "*")))
    complete = src.facts.filter("tok_complete").select("path")
    return rows.withColumn("blanket", F.coalesce(*tries)).filter("blanket IS NOT NULL").join(complete, "path", "left_semi")


@rule("SUPPRESS-002", "suppressions", "Suppressions name their rule", on=False, reads=("comments", "tok_complete"))
def blanket(src: Source) -> DataFrame:
    rows = _directives(src).filter("blanket") if not src.of("suppressions", "allow_blanket", False) else _directives(src).limit(0)
    return findings(rows, "suppressions", "SUPPRESS-002: suppression of everything", "error", "line", F.concat(F.lit("Blanket directive "), F.col("raw")), "Name the codes")


@rule("STALE-001", "stale_paths", "Comments name paths that exist", on=True)
def stale(src: Source) -> DataFrame:
    tokens = list(src.of("stale_paths", "tokens", ()))
    rows = _comment_texts(src).filter(~F.col("path").startswith("tests/"))
    if not tokens:
        return findings(rows.limit(0), "stale_paths", "STALE-001", "error", "line", "", "")
    patterns = [p for t in tokens for p in (rf"`{X._quoted(t)}[A-Za-z0-9_./<>-]*`", rf"(?U)\b{X._quoted(t)}[A-Za-z0-9_]+\.py\b")]
    hits = rows.select("path", "line", F.explode(F.concat(*(F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in patterns))).alias("hit"))
    return findings(hits, "stale_paths", "STALE-001: stale path", "error", "line", F.format_string("Stale path %s", "hit"), "Name the current path")


def _markdown(src: Source, suffixes: tuple[str, ...]) -> DataFrame:
    return src.files.filter(X.suffix_of(F.col("path")).isin(*suffixes) & ~X.in_any(F.col("path"), V.SKIP_DIRS)).select("path", X.split_lines(F.col("content")).alias("lines"))


def _free_runs(pages: DataFrame) -> DataFrame:
    """path, runs (first, texts) of the lines between fences. A line is outside if it is no fence and an even number of fences
    comes before it. Runs are cut from the page's own lines, by the places of its fences: no state goes from line to line,
    so a page takes time in proportion to its lines, and no window is needed."""
    fence = lambda x: F.ltrim(x).startswith("```") | F.ltrim(x).startswith("~~~")
    marks = F.filter(F.transform("lines", lambda x, i: F.when(fence(x), i)), lambda i: i.isNotNull())
    bounds = F.concat(F.array(F.lit(-1)), F.col("marks"), F.array(F.size("lines")))
    even = F.filter(F.transform("bounds", lambda x, i: F.when(i % 2 == 0, F.struct(x.alias("before"), F.get("bounds", i + 1).alias("next")))), lambda r: r.isNotNull() & r["next"].isNotNull())
    runs = F.transform("runs", lambda r: F.struct((r["before"] + 1).alias("first"), F.slice("lines", r["before"] + 2, r["next"] - r["before"] - 1).alias("texts")))
    return pages.withColumn("marks", marks).withColumn("bounds", bounds).withColumn("runs", even).select("path", runs.alias("runs"))


def outside_fences(pages: DataFrame) -> DataFrame:
    """path, line, text of lines outside fenced blocks."""
    rows = _free_runs(pages).select("path", F.explode("runs").alias("r")).select("path", "r.first", F.posexplode("r.texts").alias("k", "text"))
    return rows.select("path", (F.col("first") + F.col("k") + 1).alias("line"), "text")


def _prose_pages(src: Source) -> DataFrame:
    suffixes = tuple(e.lstrip(".") for e in src.of("prose", "extensions", (".md", ".markdown")))
    return _markdown(src, suffixes)


def _prose_lines(src: Source) -> DataFrame:
    return outside_fences(_prose_pages(src)).withColumn("text", X.without_code(F.col("text")))


@rule("PROSE-001", "prose", "No em dashes", on=False)
def page_dash(src: Source) -> DataFrame:
    return findings(_prose_lines(src).filter(F.col("text").contains(V.EM_DASH)), "prose", "PROSE-001: em dash", "error", "line", "Em dash in prose", "Use a comma or a full stop")


@rule("PROSE-002", "prose", "British spelling", on=False)
def spelling(src: Source) -> DataFrame:
    known = {k.lower(): v for k, v in (V.SPELLINGS | dict(src.of("prose", "spellings", {}))).items()}
    pattern = r"(?iU)\b(" + "|".join(map(X._quoted, sorted(known, key=lambda w: (-len(w), w)))) + r")\b"
    table = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    rows = _prose_lines(src).select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("word"))
    return findings(rows, "prose", "PROSE-002: American spelling", "error", "line", F.format_string("'%s' is American spelling", "word"), F.format_string("Write '%s'", F.element_at(table, F.lower("word"))))


@rule("PROSE-003", "prose", "No emoji", on=False)
def page_emoji(src: Source) -> DataFrame:
    return findings(_prose_lines(src).filter(F.col("text").rlike(V.EMOJI)), "prose", "PROSE-003: emoji", "error", "line", "Emoji in prose", "Remove it")


def density(pages: DataFrame, limits: dict[str, float] = V.DENSITY) -> DataFrame:
    """path, em, words, sentences, em_sentences of pages (path, text) whose em dashes are dense. Most pages have few, so these are counted first."""
    text, dash = F.col("text"), V.EM_DASH
    rows = pages.withColumn("em", F.regexp_count(text, F.lit(dash))).filter(F.col("em") >= limits["min_em"])
    rows = once(rows.select("path", "em", X.word_count(text).alias("words"), X.sentences(text).alias("found")), "x", F.struct("words", F.size("found").alias("sentences"), F.size(F.filter("found", lambda s: s.contains(dash))).alias("em_sentences")))
    rows = rows.select("path", "em", "x.*").filter((F.col("words") >= limits["min_words"]) & (F.col("sentences") >= limits["min_sentences"]))
    return rows.filter((F.col("em") * 1000.0 / F.col("words") >= limits["em_per_1000"]) & (F.col("em_sentences") / F.col("sentences") >= limits["em_sentence_fraction"]))


@rule("PROSE-004", "prose", "Em dashes are rare", on=False)
def dash_density(src: Source) -> DataFrame:
    """A page's text is joined from its own runs, so no lines are shuffled."""
    lines = _free_runs(_prose_pages(src)).select("path", F.flatten(F.transform("runs", lambda r: r["texts"])).alias("lines")).filter("size(lines) > 0")
    pages = once(lines, "text", F.array_join(F.transform("lines", X.without_code), "\n")).drop("lines")
    return findings(density(pages, V.DENSITY | dict(src.of("prose", "density", {}))), "prose", "PROSE-004: many em dashes", "warning", 1, F.format_string("%d em dashes in %d words", "em", "words"), "Rewrite some of them")


def headings(src: Source) -> DataFrame:
    """path, line, level, text, style of headings outside fences: those with hashes, and lines underlined on the next."""
    free = outside_fences(_pages(src))
    w = W.partitionBy("path").orderBy("line")
    rows = free.withColumns({"before": F.lag("text").over(w), "before_line": F.lag("line").over(w)})
    hashes = r"(?U)^(#{1,6})\s+(\S.*)$"
    atx = rows.filter(F.col("text").rlike(hashes)).select("path", "line", F.length(F.regexp_extract("text", hashes, 1)).alias("level"), F.trim(F.regexp_extract("text", hashes, 2)).alias("text"))
    under = (F.col("before_line") == F.col("line") - 1) & (F.trim("before") != "") & ~F.col("before").rlike(hashes) & ~F.col("text").rlike(hashes)
    level = F.when(F.col("text").rlike(r"^=+\s*$"), 1).when(F.col("text").rlike(r"^-+\s*$"), 2)
    setext = rows.filter(under & level.isNotNull()).select("path", (F.col("line") - 1).alias("line"), level.alias("level"), F.trim("before").alias("text"))
    return atx.unionByName(setext)


def _pages(src: Source) -> DataFrame:
    root = src.of("docs", "docs_root", "docs")
    return _markdown(src, ("md",)).filter(F.col("path").startswith(f"{root}/"))


def _h1(src: Source) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.when(F.col("level") == 1, F.col("line"))))
    return _pages(src).select("path", "lines").join(headings(src).groupBy("path").agg(lines.alias("h1")), "path", "left").withColumn("h1", F.coalesce("h1", F.array().cast("array<int>")))


@rule("DOCS-001", "docs", "One title a page", on=False, tree=True)
def one_title(src: Source) -> DataFrame:
    rows = _h1(src).filter("size(h1) <> 1")
    return findings(rows, "docs", "DOCS-001: not one level-1 heading", "error", F.coalesce(F.get("h1", F.lit(1)), F.lit(1)), F.format_string("Page has %d level-1 headings", F.size("h1")), "Keep one title", F.lit(0))


@rule("DOCS-002", "docs", "Headings skip no level", on=False, tree=True)
def heading_skip(src: Source) -> DataFrame:
    rows = headings(src).withColumn("above", F.lag("level").over(W.partitionBy("path").orderBy("line"))).filter("level > above + 1")
    rows = rows.groupBy("path").agg(F.min(F.struct("line", "above", "level")).alias("x")).select("path", "x.*")
    return findings(rows, "docs", "DOCS-002: heading level skipped", "error", "line", F.format_string("H%d follows H%d", "level", "above"), "Use the level between")


@rule("DOCS-003", "docs", "Pages open by saying what they are", on=False, tree=True)
def opener(src: Source) -> DataFrame:
    first = F.get("h1", F.lit(0))
    step = lambda acc, x: F.when(F.trim(x).startswith("```") | F.trim(x).startswith("~~~"), F.struct((~acc["open"]).alias("open"), acc["found"].alias("found"))).when(acc["open"] | (F.trim(x) == "") | acc["found"].isNotNull(), acc).otherwise(F.struct(acc["open"].alias("open"), F.trim(x).alias("found")))
    start = F.struct(F.lit(False).alias("open"), F.lit(None).cast("string").alias("found"))
    rows = _h1(src).filter((F.size("h1") == 1) & (X.name_of(F.col("path")) != "index.md")).withColumn("opener", F.aggregate(F.slice("lines", first + 1, F.size("lines")), start, step)["found"])
    starts = F.lit(False)
    for o in V.DOC_OPENERS:
        starts = starts | F.coalesce(F.col("opener").startswith(o), F.lit(False))
    return findings(rows.filter(~starts), "docs", "DOCS-003: page does not say what it is", "error", first, "The first paragraph opens otherwise", "Begin with 'This page' or the like", F.lit(0))


IMAGE = r"!\[([^\]]*)\]\(([^)\s]+)"


@rule("DOCS-004", "docs", "Images have a text", on=False, tree=True)
def image_alt(src: Source) -> DataFrame:
    free = outside_fences(_pages(src))
    marks = free.select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(IMAGE), F.lit(1))).alias("alt")).filter("trim(alt) = ''").select("path", "line")
    return findings(marks.unionByName(untexted_images(free)), "docs", "DOCS-004: image without text", "error", "line", "Image has no alternative text", "Say what it shows")


def untexted_images(rows: DataFrame) -> DataFrame:
    """path, line of each img element in the column text without an alt text."""
    tags = rows.select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(r"(?i)<img\b([^>]*)>"), F.lit(1))).alias("tag"))
    alt = r"""(?i)\balt\s*=\s*("([^"]*)"|'([^']*)')"""
    return tags.filter(F.trim(F.concat(F.regexp_extract("tag", alt, 2), F.regexp_extract("tag", alt, 3))) == "").select("path", "line")


@rule("DOCS-005", "docs", "Drawings are vectors", on=False, tree=True)
def raster(src: Source) -> DataFrame:
    rows = outside_fences(_pages(src)).select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(IMAGE), F.lit(2))).alias("target"))
    clean = F.regexp_replace("target", r"[#?].*$", "")
    local = ~F.col("target").rlike(r"(?i)^[a-z][a-z0-9+.-]*://") & X.suffix_of(clean).isin(*src.of("docs", "raster_extensions", V.BINARY_SUFFIXES))
    rows = rows.filter(local & ~X.matches_any(clean, src.of("docs", "allow", ())))
    return findings(rows, "docs", "DOCS-005: raster image", "warning", "line", F.format_string("Raster image '%s'", "target"), "Draw it as a vector")


@rule("DOCS-006", "docs", "Sections have an index", on=False, tree=True)
def section_index(src: Source) -> DataFrame:
    root = src.of("docs", "docs_root", "docs")
    parts = X.parts_of(F.regexp_replace(F.col("path"), f"^{X._quoted(root)}/", ""))
    rows = _pages(src).filter(F.size(parts) > 1).select(F.get(parts, F.lit(0)).alias("section"), ((F.size(parts) == 2) & (F.element_at(parts, -1) == "index.md")).alias("index"))
    rows = rows.filter(F.col("section").isin(*src.of("docs", "sections", V.DOC_SECTIONS))).groupBy("section").agg(F.max("index").alias("index")).filter("NOT index")
    rows = rows.withColumn("path", F.concat(F.lit(f"{root}/"), "section", F.lit("/")))
    return findings(rows, "docs", "DOCS-006: section without index", "warning", 1, F.format_string("Section '%s' has no index.md", "section"), "Add it")


@rule("DOCS-007", "docs", "Pages lie in sections", on=False, tree=True)
def known_place(src: Source) -> DataFrame:
    root = src.of("docs", "docs_root", "docs")
    inner = F.regexp_replace(F.col("path"), f"^{X._quoted(root)}/", "")
    top = F.get(X.parts_of(inner), F.lit(0))
    rows = _pages(src).filter(~(top.isin(*src.of("docs", "sections", V.DOC_SECTIONS)) & inner.contains("/")) & ~inner.isin(*src.of("docs", "known_top_level", V.DOC_TOP_LEVEL)))
    return findings(rows, "docs", "DOCS-007: page outside the sections", "warning", 1, F.format_string("Page '%s' is in no section", inner), "Move it to one")


@rule("DOCS-008", "docs", "Headings are not numbered by hand", on=False, tree=True)
def numbered(src: Source) -> DataFrame:
    rows = headings(src).filter((F.col("level") >= 2) & F.col("text").rlike(r"^\d+(\.\d+)*[.)]\s"))
    return findings(rows, "docs", "DOCS-008: heading numbered by hand", "warning", "line", F.format_string("Heading '%s' is numbered", "text"), "Drop the number")
