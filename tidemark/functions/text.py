"""Scalar functions as column expressions."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import vocabulary as V


def glob_regex(glob: str) -> str:
    """A glob as a regular expression of the whole string for rlike; * spans slashes, and the end is the very end."""
    return "^" + fnmatch.translate(glob).replace(r"\Z", "").replace(r"\z", "") + r"\z"


def matches_any(value: Column, globs: Iterable[str]) -> Column:
    found = [value.rlike(glob_regex(g)) for g in globs]
    out = F.lit(False)
    for f in found:
        out = out | f
    return out


def norm_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")


def folded_path(path: Column) -> Column:
    """A path without empty and . parts, each .. taken out with the part before it; one above the root keeps its .. ahead."""
    step = lambda acc, x: F.when(x.isin("", "."), acc).when((x == "..") & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def code_of(rule: Column) -> Column:
    """The first word before the first colon."""
    return F.get(F.split(F.trim(F.get(F.split(rule, ":"), F.lit(0))), r"\s+"), F.lit(0))


def category_of(code: Column) -> Column:
    found = F.regexp_extract(code, r"^([A-Z]+)-\d+", 1)
    return F.when(found != "", found).otherwise(code)


def described(rule: Column) -> Column:
    """What stands after the first colon, or the whole."""
    return F.trim(F.when(rule.contains(":"), F.regexp_extract(rule, r"(?s)^[^:]*:(.*)$", 1)).otherwise(rule))


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


def github_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def csv_items(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def split_lines(text: Column) -> Column:
    """Lines at every line break that there is in Unicode, without an empty one after the last."""
    found = F.split(text, "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]")
    return F.when(F.element_at(found, -1) == "", F.slice(found, F.lit(1), F.size(found) - 1)).otherwise(found)


def effective_lines(lines: Column) -> Column:
    """How many are neither blank nor a comment."""
    return F.size(F.filter(lines, lambda x: x.rlike(r"(?U)^\s*[^\s#]")))


def without_code(line: Column) -> Column:
    """Each inline code span becomes one space, so that no words are joined."""
    return F.regexp_replace(line, r"(`+).*?\1", " ")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\w+"))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s(?<=[.!?]\s)\s*"), lambda s: s.rlike(r"(?U)\S"))


def identifier_parts(name: Column) -> Column:
    return F.transform(F.regexp_extract_all(name, F.lit(V.CAMEL.pattern), F.lit(0)), lambda x: F.lower(x))


def stem(word: Column) -> Column:
    out = word
    for ending in reversed(V.STEM_SUFFIXES):
        fits = word.endswith(ending) & (F.length(word) - len(ending) >= V.STEM_LEAST)
        out = F.when(fits, F.substring(word, F.lit(1), F.length(word) - len(ending))).otherwise(out)
    return out


def weighted_jaccard(a: Column, b: Column, empty_agrees: bool = False) -> Column:
    """Of two multisets, maps of counts: the sum of minima over the sum of maxima."""
    both = F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.struct(F.least(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))).alias("lo"), F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))).alias("hi"))))
    total = lambda part: F.aggregate(both, F.lit(0), lambda acc, x: acc + x[part])
    none = (F.size(a) == 0) | (F.size(b) == 0)
    neither = (F.size(a) == 0) & (F.size(b) == 0)
    return F.when(neither, 1.0).when(none, 1.0 if empty_agrees else 0.0).otherwise(total("lo") / total("hi"))


def allowlisted(text: Column) -> Column:
    """A comment that gives reasons, sources or marks rather than restating."""
    low = F.lower(text)
    starts = F.lit(False)
    for p in V.PRAGMAS:
        starts = starts | low.startswith(p)
    tag = F.regexp_replace(F.get(F.split(F.trim(low), r"\s+"), F.lit(0)), ":+$", "").isin(*V.ALLOW_TAGS)
    phrase = low.rlike("|".join(map(_quoted, V.ALLOW_PHRASES)))
    word = low.rlike(r"(?U)\b(?:" + "|".join(V.ALLOW_WORDS) + r")\b")
    parts = F.split(F.trim(text), r"\s+")
    header = F.trim(text).rlike(r"^[-=#*~ ]{2,}$") | ((F.size(parts) >= 2) & F.forall(parts, lambda w: (F.upper(w) == w) & (F.lower(w) != w) & (F.length(w) >= 2)))
    return starts | tag | phrase | word | header | low.rlike(r"#\d+")


def _quoted(text: str) -> str:
    return re.sub(r"([.()\[\]{}*+?|^$\\-])", r"\\\1", text)


def parts_of(path: Column) -> Column:
    return F.split(path, "/")


def name_of(path: Column) -> Column:
    return F.element_at(parts_of(path), -1)


def stem_of(path: Column) -> Column:
    return F.regexp_replace(name_of(path), r"(?<=.)\.[^.]*$", "")


def suffix_of(path: Column) -> Column:
    """Of the last dot on, lower-case and without the dot; none for a name that begins with its only dot."""
    return F.lower(F.regexp_extract(name_of(path), r".\.([^.]+)$", 1))


def in_any(path: Column, names: Iterable[str]) -> Column:
    return F.arrays_overlap(parts_of(path), F.array(*map(F.lit, names)))
