"""Rules over functions, classes, imports, names and calls of Python files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import vocabulary as V
from tidemark.operators.groups import shared
from tidemark.rules.base import Source, findings, notices, once, rule



def _is_test() -> Column:
    return X.name_of(F.col("path")).startswith("test_")


def _below(*prefixes: str) -> Column:
    """The path begins with one of these directories, or has it further down."""
    out = F.lit(False)
    for p in prefixes:
        out = out | F.col("path").startswith(p) | F.col("path").contains(f"/{p}")
    return out


def _limited(df: DataFrame, value: Column, warn: Column | int, error: Column | int) -> DataFrame:
    """Rows at or above a limit, with their severity; a warning limit above the error limit counts for nothing."""
    warn, error = (F.lit(x) if isinstance(x, int) else x for x in (warn, error))
    return df.withColumn("value", value).filter(F.col("value") >= F.least(warn, error)).withColumn("sev", F.when(F.col("value") >= error, "error").otherwise("warning"))


def _sized(df: DataFrame) -> DataFrame:
    return df.filter(~X.name_of(F.col("path")).isin("__init__.py", "conftest.py") & ~_is_test() & ~X.in_any(F.col("path"), V.MIGRATIONS))


@rule("SIZE-001", "file_limits", "Files stay below a number of effective lines", reads=("error", "lines"))
def size_file(src: Source) -> DataFrame:
    rows = _limited(_sized(src.facts.filter("error IS NULL")), X.effective_lines(F.col("lines")), src.limit("file_limits", "file_warn", 300), src.limit("file_limits", "file_error", 500))
    return findings(rows, "file_limits", "SIZE-001: file is too long", F.col("sev"), 1, F.format_string("File has %d effective lines", "value"), "Split the file")


@rule("SIZE-002", "file_limits", "Functions stay below a number of effective lines", reads=("lines", "functions.idx", "functions.name", "functions.line", "functions.end"))
def size_function(src: Source) -> DataFrame:
    rows = _sized(src.facts).select("path", *src.carried, "lines", F.explode("functions").alias("x")).select("path", *src.carried, F.slice("lines", F.col("x.line"), F.col("x.end") - F.col("x.line") + 1).alias("own"), "x.name", "x.line", "x.idx")
    rows = _limited(rows, X.effective_lines(F.col("own")), src.limit("file_limits", "func_warn", 50), src.limit("file_limits", "func_error", 80))
    return findings(rows, "file_limits", "SIZE-002: function is too long", F.col("sev"), "line", F.format_string("Function '%s' has %d effective lines", "name", "value"), "Split the function", "idx")


@rule("SIZE-003", "file_limits", "Classes have few methods", reads=("classes.idx", "classes.name", "classes.line", "classes.n_methods"))
def size_class(src: Source) -> DataFrame:
    rows = _sized(src.classes).filter(F.col("n_methods") > src.limit("file_limits", "class_method_warn", 10))
    return findings(rows, "file_limits", "SIZE-003: class has too many methods", "warning", "line", F.format_string("Class '%s' has %d methods", "name", "n_methods"), "Split the class", "idx")


@rule("COMPLEXITY-001", "file_limits", "Functions branch little")
def complexity(src: Source) -> DataFrame:
    rows = _limited(_sized(src.functions), F.col("complexity"), src.limit("file_limits", "complexity_warn", 10), src.limit("file_limits", "complexity_error", 15))
    return findings(rows, "file_limits", "COMPLEXITY-001: function is too complex", F.col("sev"), "line", F.format_string("Function '%s' has a complexity of %d", "name", "value"), "Split the function", "idx")


@rule("PARAM-001", "file_limits", "Functions take few parameters")
def param_count(src: Source) -> DataFrame:
    first = F.get(F.filter("params", lambda p: p["kind"].isin("posonly", "pos", "kwonly")), F.lit(0))["name"]
    own = F.size("params") - F.coalesce(first.isin("self", "cls"), F.lit(False)).cast("int")
    rows = _limited(_sized(src.functions), own, src.limit("file_limits", "param_warn", 5), src.limit("file_limits", "param_error", 8))
    return findings(rows, "file_limits", "PARAM-001: function takes too many parameters", F.col("sev"), "line", F.format_string("Function '%s' takes %d parameters", "name", "value"), "Group the parameters in an object", "idx")


@rule("SIZE-000", "file_limits", "Files parse")
def size_notice(src: Source) -> DataFrame:
    return notices(src, "file_limits", "SIZE-000")


def _typed(df: DataFrame) -> DataFrame:
    return df.filter(~_below("tests/", "migrations/"))


def _annotations(src: Source) -> DataFrame:
    """path, idx, line, what, weak, bare: each annotation of a parameter (in order) or a return that is weak."""
    order = F.array(*(F.filter("params", lambda p: p["kind"] == kind) for kind in ("pos", "posonly", "kwonly")))
    params = _typed(src.functions).select("path", "idx", F.explode(F.flatten(order)).alias("p"), "name").select("path", "idx", "p.line", F.format_string("Parameter '%s' of '%s'", "p.name", "name").alias("what"), "p.weak", "p.bare")
    returns = _typed(src.functions).select("path", "idx", "line", F.format_string("Return type of '%s'", "name").alias("what"), F.col("returns_weak").alias("weak"), F.col("returns_bare").alias("bare"))
    return params.unionByName(returns).filter("weak IS NOT NULL")


@rule("TYPE-001", "strong_types", "Containers say what they hold")
def type_leaf(src: Source) -> DataFrame:
    rows = _annotations(src).filter("weak IN ('any', 'object')")
    return findings(rows, "strong_types", "TYPE-001: container without a type of its items", F.when(F.col("weak") == "any", "error").otherwise("warning"), "line", F.format_string("%s leaves its items open (%s)", "what", "weak"), "Name a domain type", "idx")


@rule("TYPE-002", "strong_types", "Containers have parameters")
def type_bare(src: Source) -> DataFrame:
    return findings(_annotations(src).filter("weak = 'bare'"), "strong_types", "TYPE-002: bare container", "error", "line", F.format_string("%s is a bare '%s'", "what", "bare"), "Give the container's parameters", "idx")


@rule("TYPE-003", "strong_types", "Keyword catch-alls are typed")
def type_kwargs(src: Source) -> DataFrame:
    rows = _typed(src.functions).select("path", "idx", "name", F.explode("params").alias("p")).filter("p.kind = 'kwarg'")
    rows = rows.filter(F.col("p.ann").isNull() | F.col("p.ann").isin("Any", "dict", "dict[str, Any]", "Dict[str, Any]"))
    return findings(rows, "strong_types", "TYPE-003: untyped keyword catch-all", "error", F.col("p.line"), F.format_string("'**%s' of '%s' is untyped", "p.name", "name"), "Use Unpack of a TypedDict", "idx")


@rule("TYPE-004", "strong_types", "A typed function has a return type")
def type_return(src: Source) -> DataFrame:
    rows = _typed(src.functions).filter(F.col("returns").isNull() & F.exists("params", lambda p: p["ann"].isNotNull()) & ~F.col("generator") & F.col("returns_value"))
    return findings(rows, "strong_types", "TYPE-004: return type is missing", "warning", "line", F.format_string("'%s' returns a value without saying its type", "name"), "Add the return annotation", "idx")


@rule("TYPE-000", "strong_types", "Files parse")
def type_notice(src: Source) -> DataFrame:
    return notices(src, "strong_types", "TYPE-000")


@rule("KWARG-001", "named_args", "Several parameters are passed by keyword", on=False)
def named_args(src: Source) -> DataFrame:
    rows = src.facts.select("path", "lines", "error", F.explode_outer("functions").alias("x")).filter(~_is_test())
    bad = rows.filter("error IS NOT NULL")
    count = F.size(F.filter("x.params", lambda p: (p["kind"] == "pos") & ~p["name"].isin("self", "cls") & ~p["depends"]))
    noqa = F.get(F.col("lines"), F.col("x.line") - 1).contains("# noqa: KWARG-001")
    rows = rows.filter(~F.col("x.name").rlike("^__.*__$") & ~noqa).withColumn("n", count).filter("n > 1")
    out = findings(rows, "named_args", "KWARG-001: parameters without a bare *", "error", F.col("x.line"), F.format_string("Function '%s' takes %d positional parameters", "x.name", "n"), "Put a bare * before them", F.col("x.idx"))
    return out.unionByName(findings(bad, "named_args", "KWARG-001: parse error", "warning", 0, "File could not be parsed", "Make the file parse"))


@rule("IMPORT-001", "pattern_divergence", "Imports stand at the top")
def inline_import(src: Source) -> DataFrame:
    rows = src.facts.select("path", "lines", F.explode("imports").alias("x")).filter(~_is_test() & F.col("x.in_function") & ~F.col("x.typing"))
    rows = rows.filter(~F.col("path").startswith("infrastructure/observability/") & ~F.col("path").startswith("api/v1/main.py"))
    rows = rows.filter(~F.get(F.col("lines"), F.col("x.line") - 1).contains("# noqa: IMPORT-001"))
    what = F.when(F.col("x.is_from"), F.coalesce("x.module", F.lit("<relative>"))).otherwise(F.array_join("x.names", ", "))
    return findings(rows, "pattern_divergence", "IMPORT-001: import inside a function", "error", F.col("x.line"), F.format_string("Import '%s' stands inside a function", what), "Move it to the top of the file", F.col("x.idx"))


@rule("ENDPOINT-001", "pattern_divergence", "Endpoints nest little")
def endpoint_nesting(src: Source) -> DataFrame:
    rows = src.facts.select("path", "lines", F.explode("functions").alias("x")).filter(F.col("path").startswith("api/v1/endpoints") & ~_is_test() & (F.col("x.nesting") > 4))
    rows = rows.filter(~F.get(F.col("lines"), F.col("x.line") - 1).contains("# noqa: ENDPOINT-001"))
    return findings(rows, "pattern_divergence", "ENDPOINT-001: endpoint nests too deep", "warning", F.col("x.line"), F.format_string("'%s' nests %d deep", "x.name", "x.nesting"), "Take logic out of the endpoint", F.col("x.idx"))


@rule("PATTERN-000", "pattern_divergence", "Files parse")
def pattern_notice(src: Source) -> DataFrame:
    return notices(src, "pattern_divergence", "PATTERN-000")


def _attribute_calls(src: Source) -> DataFrame:
    return src.calls.filter(~_is_test() & ~_below("tests/", "test/"))


def _literal_identifier() -> Column:
    name = F.col("arg1")
    return (F.col("arg1_kind") == "str") & name.rlike(r"(?U)^[\p{L}_][\w]*\z") & ~(name.startswith("__") & name.endswith("__"))


@rule("ATTR-001", "attribute_access", "Types are told by types", on=False)
def has_attribute(src: Source) -> DataFrame:
    rows = _attribute_calls(src).filter((F.col("bare") == "hasattr") & (F.col("n_args") >= 2) & _literal_identifier())
    return findings(rows, "attribute_access", "ATTR-001: hasattr tells types apart", "warning", "line", F.format_string("hasattr(..., '%s') asks for structure", "arg1"), "Use a protocol and isinstance", "idx")


@rule("ATTR-002", "attribute_access", "Attributes of known name are written as such", on=False)
def named_attribute(src: Source) -> DataFrame:
    rows = _attribute_calls(src).filter(((F.col("bare") == "getattr") & (F.col("n_args") == 2)) | (F.col("bare").isin("setattr", "delattr") & (F.col("n_args") >= 2)))
    known = _literal_identifier() if not src.of("attribute_access", "flag_dynamic", False) else _literal_identifier() | (F.col("arg1_kind") != "str")
    return findings(rows.filter(known), "attribute_access", "ATTR-002: attribute by name", "warning", "line", F.format_string("%s(..., %s) hides the attribute", "bare", "arg1"), "Access the attribute directly", "idx")


def _class_methods(src: Source, *folders: str) -> DataFrame:
    under = F.lit(False)
    for f in folders:
        under = under | F.col("path").startswith(f"{f}/")
    rows = src.functions.filter(under & F.col("owner").isNotNull() & ~F.col("name").startswith("_"))
    bad = F.coalesce(*(F.when(F.col("name").startswith(p), F.lit(p)) for p in V.CRUD_PREFIXES))
    good = F.create_map(*(F.lit(x) for kv in V.CRUD_PREFIXES.items() for x in kv))
    return rows.withColumn("bad", bad).filter("bad IS NOT NULL").withColumn("good", F.element_at(good, F.col("bad")))


@rule("NAMING-001", "naming_consistency", "Repositories use CRUD verbs", on=False)
def repository_names(src: Source) -> DataFrame:
    rows = _class_methods(src, "infrastructure/repositories", "infrastructure/persistence")
    return findings(rows, "naming_consistency", "NAMING-001: repository method prefix", "error", "line", F.format_string("'%s' begins with '%s'", "name", "bad"), F.format_string("Begin with '%s'", "good"), "idx")


@rule("NAMING-002", "naming_consistency", "Services use CRUD verbs", on=False)
def service_names(src: Source) -> DataFrame:
    rows = _class_methods(src, "application/services")
    return findings(rows, "naming_consistency", "NAMING-002: service method prefix", "error", "line", F.format_string("'%s' begins with '%s'", "name", "bad"), F.format_string("Begin with '%s'", "good"), "idx")


@rule("NAMING-003", "naming_consistency", "Endpoints are named after their verb")
def endpoint_names(src: Source) -> DataFrame:
    verb = F.get(F.filter("decorators", lambda d: d["called"] & d["attr"].isin(*V.VERB_PREFIXES)), F.lit(0))["attr"]
    fits = F.lit(False)
    for method, prefixes in V.VERB_PREFIXES.items():
        for p in prefixes:
            fits = fits | ((F.col("verb") == method) & F.col("name").startswith(p))
    rows = src.functions.filter(F.col("path").startswith("api/v1/endpoints/") & ~F.col("name").isin(*V.VERB_EXEMPT)).withColumn("verb", verb).filter(F.col("verb").isNotNull() & ~fits)
    return findings(rows, "naming_consistency", F.format_string("NAMING-003: %s handler is named otherwise", F.upper("verb")), "warning", "line", F.format_string("Handler '%s' serves %s", "name", "verb"), "Name it after its verb", "idx")


@rule("NAMING-004", "naming_consistency", "Functions that return bool ask a question")
def bool_names(src: Source) -> DataFrame:
    exempt = F.exists("decorators", lambda d: F.coalesce(d["name"], d["attr"]).isin(*V.BOOL_EXEMPT))
    asks = F.lit(False)
    for p in V.BOOL_PREFIXES:
        asks = asks | F.col("name").startswith(p)
    rows = src.functions.filter(F.col("returns_bool") & ~F.col("name").startswith("_") & ~asks & ~F.coalesce(exempt, F.lit(False)) & ~F.col("in_protocol"))
    plain = F.regexp_replace("name", "^(check_|get_|compute_|fetch_|build_|make_|run_)", "")
    return findings(rows, "naming_consistency", "NAMING-004: bool function without a question", "warning", "line", F.format_string("'%s' returns bool", "name"), F.concat(F.lit("Name it is_"), plain), "idx")


@rule("NAMING-005", "naming_scope", "Short names live shortly", on=False, reads=("functions.idx", "functions.name", "functions.extents"))
def short_names(src: Source) -> DataFrame:
    allowed = [*V.SHORT_NAMES_ALLOWED, *src.of("naming_scope", "allow", ())]
    rows = src.functions.filter(~X.in_any(F.col("path"), (*V.SKIP_DIRS, *V.MIGRATIONS))).select("path", *src.carried, "idx", "name", F.explode("extents").alias("e"))
    span = F.col("e.last") - F.col("e.first") + 1
    short = ~F.col("e.name").isin(*allowed) & ~F.col("e.name").startswith("__") & (F.length(F.regexp_replace("e.name", "^_+", "")) <= src.limit("naming_scope", "max_short_length", 2))
    rows = rows.filter(short & (span > src.limit("naming_scope", "max_span", 20)))
    return findings(rows, "naming_scope", "NAMING-005: short name over a long span", "error", F.col("e.first"), F.format_string("'%s' lives over %d lines of '%s'", "e.name", span, "name"), "Give it a name that reads", "idx")


@rule("CMT-006", "docstrings", "Public definitions are described", on=False, reads=("functions.idx", "functions.name", "functions.line", "functions.end", "functions.doc", "functions.owner", "functions.params", "classes.idx", "classes.name", "classes.line", "classes.end", "classes.doc"))
def missing_docstring(src: Source) -> DataFrame:
    rows = _definitions(src).filter("doc IS NULL")
    return findings(rows, "docstrings", "CMT-006: docstring is missing", "error", "line", F.format_string("'%s' has no docstring", "name"), "Say what it is for", "idx")


def _definitions(src: Source) -> DataFrame:
    """Functions and classes long enough to be described; dunder names never are, private ones by a setting."""
    params = F.transform("params", lambda p: p["name"])
    functions = src.functions.select("path", *src.carried, "idx", "name", "line", "end", "doc", "owner", params.alias("given"))
    classes = src.classes.select("path", *src.carried, "idx", "name", "line", "end", "doc", F.lit(None).cast("string").alias("owner"), F.array().cast("array<string>").alias("given"))
    skip = X.name_of(F.col("path")).isin("__init__.py", "conftest.py", "setup.py") | _is_test() | X.in_any(F.col("path"), (*V.SKIP_DIRS, *V.MIGRATIONS))
    name = F.col("name")
    described = ~name.rlike("^__.*__$") if src.of("docstrings", "require_private", False) else ~name.startswith("_")
    long = F.col("end") - F.col("line") + 1 >= src.limit("docstrings", "min_lines", 5)
    return functions.unionByName(classes).filter(~skip & described & long)


@rule("CMT-007", "docstrings", "Docstrings say more than the name", on=False, reads=("functions.idx", "functions.name", "functions.line", "functions.end", "functions.doc", "functions.owner", "functions.params", "classes.idx", "classes.name", "classes.line", "classes.end", "classes.doc"))
def vacuous_docstring(src: Source) -> DataFrame:
    stems = lambda c: F.transform(X.identifier_parts(c), lambda w: X.stem(w))
    rows = _definitions(src).filter("doc IS NOT NULL")
    filler = F.array(*map(F.lit, V.FILLER))
    content = F.transform(F.filter(X.identifier_parts(F.regexp_replace("doc", "[.,]", " ")), lambda w: ~F.array_contains(filler, w)), lambda w: X.stem(w))
    known = F.concat(stems(F.col("name")), F.flatten(F.transform("given", lambda p: stems(p))), stems(F.coalesce("owner", F.lit(""))))
    rows = once(once(rows, "content", content), "known", known)
    covered = F.forall("content", lambda w: F.exists("known", lambda s: (w == s) | ((F.length(s) >= 3) & (w.startswith(s) | s.startswith(w)))))
    rows = rows.filter((F.size("content") == 0) | (~X.allowlisted(F.trim("doc")) & covered))
    return findings(rows, "docstrings", "CMT-007: docstring says nothing", "error", F.col("line"), F.format_string("The docstring of '%s' repeats its signature", "name"), "Say why, or drop it", "idx")


@rule("DRY-001", "duplication", "Function bodies are written once", tree=True)
def clones(src: Source) -> DataFrame:
    """Peers are named from a counted, sorted aggregate; the group itself is joined back, so a hot body stays spread."""
    rows = _sized(src.functions).filter("n_body >= 5").select("path", "line", "name", "idx", "body_sha")
    rows = shared(rows, "body_sha", F.struct("path", "line", "name"))
    return findings(rows, "duplication", "DRY-001: function body stands elsewhere too", "error", "line", F.format_string("'%s' has the body of %d functions, the first at %s:%d", "name", "n", "first.path", "first.line"), "Share one function", "idx")


@rule("DRY-000", "duplication", "Files parse", tree=True)
def clone_notice(src: Source) -> DataFrame:
    return notices(src, "duplication", "DRY-000")


def _tests(src: Source) -> DataFrame:
    stem = X.stem_of(F.col("path"))
    file = (stem.startswith("test_") | stem.endswith("_test")) & ~stem.isin("conftest", "__init__", "fixtures", "factories") & ~X.in_any(F.col("path"), V.SKIP_DIRS)
    fixture = F.exists("x.decorators", lambda d: F.coalesce(d["attr"] == "fixture", F.lit(False)))
    return src.facts.filter(file).select("path", *src.carried, "lines", F.explode("functions").alias("x")).filter(F.col("x.name").startswith("test_") & ~fixture)


@rule("AAA-001", "test_style", "Tests mark their sections", on=False)
def test_sections(src: Source) -> DataFrame:
    get = lambda k, d: src.of("test_style", k, d)
    own = F.slice("lines", F.col("x.line"), F.col("x.end") - F.col("x.line") + 1)
    words = {k: (*v, *get("synonyms", {}).get(k, ())) for k, v in V.SECTIONS.items()}
    marked = lambda alias: F.exists("own", lambda t: t.rlike(r"(?i)^\s*#\s*(" + "|".join(alias) + r")\b")).cast("int")
    hit = [marked(w) for w in words.values()]
    need = F.least(F.lit(3), F.greatest(F.lit(1), src.limit("test_style", "required_markers", 2)))
    rows = _tests(src).filter(F.col("x.n_statements") > src.limit("test_style", "min_statements", 3)).withColumn("own", own).withColumn("n", sum(hit, F.lit(0))).filter(F.col("n") < need)
    return findings(rows, "test_style", "AAA-001: test without sections", "error", F.col("x.line"), F.format_string("'%s' marks %d sections", "x.name", "n"), "Mark arrange, act and assert", F.col("x.idx"))


@rule("AAA-002", "test_style", "Tests don't begin alike", on=False)
def test_prefixes(src: Source) -> DataFrame:
    rows = _tests(src).filter("x.prefix_sha IS NOT NULL").withColumn("n", F.count("*").over(W.partitionBy("path", "x.prefix_sha"))).filter("n > 1")
    return findings(rows, "test_style", "AAA-002: tests share their beginning", "error", F.col("x.line"), F.format_string("'%s' begins as %d tests do", "x.name", "n"), "Make a fixture of it", F.col("x.idx"))


@rule("TERM-NNN", "domain_terms", "Terms of the domain are used", on=True, reads=("error", "lines", "names", "doc_lines"))
def domain_terms(src: Source) -> DataFrame:
    from tidemark.rules.prose import term_matches

    exempt = X.in_any(F.col("path"), V.SKIP_DIRS)
    row = lambda line, text: F.struct(line.cast("int").alias("line"), text.alias("text"))
    names = F.transform("names", lambda x: row(x["line"], x["name"]))
    told = lambda t: t.contains("#") & ~F.ltrim(t).startswith("import ") & ~F.ltrim(t).startswith("from ")
    lines = F.filter(F.transform("lines", lambda t, k: row(k + 1, t)), lambda x: told(x["text"]))
    hashes = F.when(F.col("error").isNull(), F.transform(lines, lambda x: row(x["line"], F.regexp_extract(x["text"], "(#.*)$", 1)))).otherwise(F.array().cast("array<struct<line:int,text:string>>"))
    docs = F.transform("doc_lines", lambda x: row(x["line"], x["text"]))
    rows = src.facts.filter(~exempt).select("path", F.explode(F.concat(names, hashes, docs)).alias("x")).select("path", "x.*")
    return term_matches(rows, src.of("domain_terms", "rules", ()))
