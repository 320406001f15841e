"""Rules over layers, ports, tests and paths: relations between files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import vocabulary as V
from tidemark.rules.base import Source, findings, notices, rule



def modules(src: Source) -> DataFrame:
    """path, idx, line, module, names, bound: one row per module that an import names."""
    rows = src.imports
    plain = rows.filter("NOT is_from").select("path", "idx", "line", F.explode("names").alias("module"), F.array().cast("array<string>").alias("names"), F.col("bound"))
    return plain.unionByName(rows.filter("is_from AND module IS NOT NULL").select("path", "idx", "line", "module", "names", "bound"))


def _layer_rows(src: Source) -> DataFrame:
    """path, idx, line, layer, target, root (in a composition root): imports of another layer that it may not see."""
    get = lambda k, d: src.of("layer_deps", k, d)
    layers, allowed = list(get("layers", V.LAYERS)), {k: tuple(v) for k, v in get("allowed", V.LAYER_ALLOWED).items()}
    package = get("source_root", "").rstrip("/").rsplit("/", 1)[-1]
    rows = modules(src).withColumn("layer", F.coalesce(*(F.when(F.col("path").startswith(f"{x}/"), F.lit(x)) for x in layers))).filter("layer IS NOT NULL")
    parts = F.split("module", r"\.")
    own = F.get(parts, F.lit(0))
    target = F.when(own.isin(*layers), own).when((own == package) & (F.lit(package) != ""), F.get(parts, F.lit(1)))
    rows = rows.withColumn("target", target).filter(F.col("target").isin(*layers) & (F.col("target") != F.col("layer")))
    root = X.matches_any(F.col("path"), get("composition_root", V.LAYER_ROOTS)) & F.col("layer").isin(*get("transport_layers", ("api",)))
    may = F.lit(False)
    for layer, targets in allowed.items():
        if targets:
            may = may | ((F.col("layer") == layer) & F.col("target").isin(*targets))
    return rows.withColumn("root", root).filter(~may & ~(F.col("root") & (F.col("target") == "infrastructure")))


def _layer_code() -> Column:
    outer = (F.col("target") == "infrastructure") & ~F.col("layer").isin("domain", "application", "infrastructure") & ~F.col("root")
    named = F.coalesce(*(F.when(F.col("layer") == k, F.lit(v)) for k, v in V.LAYER_CODES.items()), F.lit("LAYER"))
    return F.when(outer, F.lit("LAYER-005")).otherwise(named)


def _layer_rule(code: str, what: str) -> None:
    @rule(code, "layer_deps", what, tree=True)
    def layer(src: Source) -> DataFrame:
        rows = _layer_rows(src).withColumn("code", _layer_code()).filter(F.col("code") == code)
        return findings(rows, "layer_deps", F.concat(F.lit(f"{code}: "), F.format_string("%s/ imports from %s/", "layer", "target")), "error", "line", F.format_string("%s/ imports from %s/", "layer", "target"), "Depend inwards only", "idx")


for _code, _what in (("LAYER-001", "The domain imports no other layer"), ("LAYER-002", "The application imports the domain only"), ("LAYER-003", "The infrastructure imports inner layers only"), ("LAYER-004", "The transport imports inner layers only"), ("LAYER-005", "Adapters are bound in the composition root"), ("LAYER", "Layers import what they may")):
    _layer_rule(_code, _what)


@rule("LAYER-006", "layer_deps", "Transport layers are layers", tree=True)
def layer_config(src: Source) -> DataFrame:
    layers = src.of("layer_deps", "layers", V.LAYERS)
    odd = [t for t in src.of("layer_deps", "transport_layers", ("api",)) if t not in layers]
    rows = src.files.sparkSession.createDataFrame([(".", t) for t in odd], "path string, name string")
    return findings(rows, "layer_deps", "LAYER-006: transport layer is no layer", "warning", 0, F.format_string("'%s' is no layer", "name"), "Name a layer")


@rule("LAYER-000", "layer_deps", "Files parse", tree=True)
def layer_notice(src: Source) -> DataFrame:
    return notices(src, "layer_deps", "LAYER-000")


def _adapters(src: Source) -> DataFrame:
    """Paths of adapter files that parse."""
    under = F.lit(False)
    for r in src.of("port_coverage", "adapter_roots", ("infrastructure/services",)):
        under = under | F.col("path").startswith(f"{r}/")
    return src.facts.filter(under & F.col("error").isNull() & ~X.name_of(F.col("path")).isin(*src.of("port_coverage", "skip_files", ("__init__.py",))))


def _ports_dir(src: Source) -> str:
    return src.of("port_coverage", "ports_dir", "application/ports").strip("/")


@rule("PORT-001", "port_coverage", "Adapters implement a port", tree=True)
def adapter_without_port(src: Source) -> DataFrame:
    dotted = _ports_dir(src).replace("/", ".")
    met = modules(src).filter(F.col("module").contains(dotted)).select("path").distinct()
    rows = _adapters(src).select("path").join(met, "path", "left_anti")
    return findings(rows, "port_coverage", "PORT-001: adapter without a port", "error", 1, F.format_string("'%s' imports no port", "path"), "Implement a port", F.lit(0))


@rule("PORT-002", "port_coverage", "Ports have an adapter", tree=True)
def port_without_adapter(src: Source) -> DataFrame:
    folder = _ports_dir(src)
    dotted = folder.replace("/", ".")
    here = F.col("path").startswith(f"{folder}/") & (F.size(X.parts_of(F.col("path"))) == len(folder.split("/")) + 1) & ~X.name_of(F.col("path")).isin("__init__.py", *src.of("port_coverage", "ports_without_impl", V.PORT_WITHOUT_ADAPTER))
    ports = src.classes.filter("protocol").filter(here).withColumn("stem", X.stem_of(F.col("path")))
    used = modules(src).join(_adapters(src).select("path"), "path", "left_semi")
    after = used.select(F.regexp_extract("module", rf"(?:^|\.){X._quoted(dotted)}\.([^.]+)", 1).alias("stem")).filter("stem <> ''")
    named = used.filter(F.col("module").rlike(rf"(^|\.){X._quoted(dotted)}\z")).select(F.explode("names").alias("stem"))
    rows = ports.join(after.unionByName(named).distinct(), "stem", "left_anti")
    return findings(rows, "port_coverage", "PORT-002: port without an adapter", "error", "line", F.format_string("No adapter imports '%s'", "name"), "Implement it", "idx")


@rule("PORT-003", "port_coverage", "Adapters are made in the composition root", tree=True)
def adapter_made(src: Source) -> DataFrame:
    roots = [r.replace("/", ".") for r in src.of("port_coverage", "adapter_roots", ("infrastructure/services",))]
    of_adapter = F.lit(False)
    for r in roots:
        of_adapter = of_adapter | F.col("module").contains(r)
    api = F.col("path").startswith("api/") & ~X.matches_any(F.col("path"), src.of("port_coverage", "composition_root", V.PORT_ROOTS))
    made = src.classes.filter("top").join(_adapters(src).select("path"), "path", "left_semi").select(F.col("name").alias("made")).distinct()
    imports = modules(src).filter(api)
    reached = imports.filter(of_adapter).groupBy("path").agg(F.min(F.struct("idx", "line")).alias("at"), F.flatten(F.collect_list("bound")).alias("bound"))
    all_names = imports.select("path", F.explode("names").alias("made")).join(made, "made").groupBy("path").agg(F.collect_set("made").alias("classes"))
    reached = reached.join(all_names, "path", "left").withColumn("classes", F.coalesce("classes", F.array().cast("array<string>")))
    calls = src.calls.filter(api).join(reached, "path")
    direct = calls.filter(F.array_contains("classes", F.col("bare"))).select("path", "idx", "line", F.col("bare").alias("what"))
    dotted = calls.filter(F.array_contains("bound", F.col("receiver"))).withColumnRenamed("method", "made").join(made, "made").select("path", "idx", "line", F.col("made").alias("what"))
    calls = direct.unionByName(dotted)
    only = reached.join(calls.select("path").distinct(), "path", "left_anti").select("path", "at.idx", "at.line", F.array_join("classes", ", ").alias("what"))
    return findings(calls.unionByName(only), "port_coverage", "PORT-003: adapter used outside the composition root", "error", "line", F.format_string("'%s' is reached directly", "what"), "Depend on the port", "idx")


TESTABLE = {
    "api/v1/endpoints": "endpoints", "application/services": "services", "application/commands": "commands", "application/queries": "queries",
    "infrastructure/repositories": "infrastructure.repositories", "infrastructure/signing": "infrastructure.signing", "infrastructure/secrets": "infrastructure.secrets",
}


@rule("TESTFILE-001", "test_coverage", "Modules have a test", tree=True)
def untested(src: Source) -> DataFrame:
    """By the test's name, by that name less its last part, or by an import of the module in any test."""
    folder = F.array_join(F.slice(X.parts_of(F.col("path")), F.lit(1), F.size(X.parts_of(F.col("path"))) - 1), "/")
    hints = F.create_map(*(F.lit(x) for kv in TESTABLE.items() for x in kv))
    rows = src.facts.select("path", folder.alias("folder"), X.stem_of(F.col("path")).alias("stem")).filter(F.col("folder").isin(*TESTABLE) & ~F.col("stem").startswith("_") & ~F.col("stem").isin("dependencies", "main", "logging", "session"))
    rows = rows.withColumn("needle", F.concat(F.element_at(hints, F.col("folder")), F.lit("."), "stem"))
    roots = src.of("test_coverage", "test_roots", ("tests/integration",))
    tests = src.facts.withColumn("folder", folder).filter(F.col("folder").isin(*roots) & X.name_of(F.col("path")).startswith("test_"))
    stems = tests.select(F.substring(X.stem_of(F.col("path")), 6, 1 << 20).alias("stem")).distinct()
    rows = rows.join(stems, "stem", "left_anti")
    short = F.when(F.col("stem").contains("_"), F.regexp_replace("stem", "_[^_]*$", ""))
    rows = rows.withColumn("short", short)
    rows = rows.join(stems.withColumnRenamed("stem", "short"), "short", "left_anti")
    # each import as dotted prefixes' suffixes, so that "contains the needle" is an equi-join on words between dots
    used = modules(src).join(tests.select("path"), "path", "left_semi").select(F.explode(F.concat(F.array("module"), F.transform("names", lambda n: F.concat("module", F.lit("."), n)))).alias("m"))
    parts = F.split("m", r"\.")
    spans = used.select(parts.alias("p")).select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("i")).select("p", "i", F.explode(F.sequence(F.lit(1), F.size("p") - F.col("i") + 1)).alias("n")).select(F.array_join(F.slice("p", F.col("i"), F.col("n")), ".").alias("needle")).distinct()
    rows = rows.join(spans, "needle", "left_anti")
    return findings(rows, "test_coverage", "TESTFILE-001: module without a test", "warning", 1, F.format_string("No test of '%s'", "stem"), "Add a test file", F.lit(0))


@rule("JUNK-001", "stray_artifacts", "No clutter")
def clutter(src: Source) -> DataFrame:
    rows = _artifacts(src).filter("kind = 'junk'")
    return findings(rows, "stray_artifacts", "JUNK-001: stray file", "error", 1, F.format_string("'%s' looks like clutter", "path"), "Delete or ignore it", F.lit(0))


@rule("JUNK-002", "stray_artifacts", "Images lie with the assets")
def stray_image(src: Source) -> DataFrame:
    rows = _artifacts(src).filter("kind = 'image'")
    return findings(rows, "stray_artifacts", "JUNK-002: image outside the assets", "error", 1, F.format_string("Image '%s' lies outside the assets", "path"), "Move it", F.lit(0))


def _artifacts(src: Source) -> DataFrame:
    get = lambda k: tuple(src.of("stray_artifacts", k, ()))
    name, folders = X.name_of(F.col("path")), F.slice(X.parts_of(F.col("path")), F.lit(1), F.size(X.parts_of(F.col("path"))) - 1)
    allowed = X.matches_any(F.col("path"), get("allow")) | X.matches_any(name, get("allow"))
    junk = X.matches_any(name, (*V.JUNK_GLOBS, *get("patterns")))
    image = X.suffix_of(F.col("path")).isin(*V.BINARY_SUFFIXES, *(e.lstrip(".") for e in get("extensions"))) & ~F.arrays_overlap(folders, F.array(*map(F.lit, (*V.ASSET_DIRS, *get("assets")))))
    rows = src.files.select("path").filter(~X.in_any(F.col("path"), (*V.VENDOR_DIRS, *get("exclude"))) & ~allowed)
    return rows.withColumn("kind", F.when(junk, "junk").when(image, "image"))


@rule("PATH-001", "forbidden_paths", "Forbidden directories stay away")
def forbidden(src: Source) -> DataFrame:
    parts = X.parts_of(F.col("path"))
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    rows = src.files.filter(F.size(parts) > 1).select(F.explode(above).alias("path")).distinct().filter(~X.in_any(F.col("path"), (".venv", "venv", "node_modules", "__pycache__")))
    dirs = [d.strip("/") for d in src.of("forbidden_paths", "dirs", ())]
    rows = rows.filter(X.matches_any(F.col("path"), [g for d in dirs for g in (d, f"*/{d}")]))
    return findings(rows, "forbidden_paths", "PATH-001: forbidden directory", "error", 1, F.format_string("Directory '%s' is forbidden", "path"), "Move or remove it", F.lit(0))
