"""Rules over calls and literals that endanger a system."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import vocabulary as V
from tidemark.rules.base import Source, findings, notices, rule

CHECK = "security_calls"


def _calls(src: Source) -> DataFrame:
    dotted = F.array_join("chain", ".")
    return src.calls.filter(~X.in_any(F.col("path"), V.SKIP_DIRS)).withColumns({"dotted": dotted, "root": F.get("chain", F.lit(0)), "last": F.when(F.size("chain") > 0, F.element_at("chain", -1))})


def _kwarg(name: str) -> Column:
    return F.element_at("kwargs", name)


def _found(rows: DataFrame, code: str, what: str, message: Column, fix: str) -> DataFrame:
    return findings(rows, CHECK, f"{code}: {what}", "error", "line", message, fix, "idx")


@rule("SHELL-001", CHECK, "Nothing runs through a shell")
def shell(src: Source) -> DataFrame:
    run = (F.size("chain") == 2) & (F.col("root") == "subprocess") & F.col("last").isin(*V.SUBPROCESS) & (_kwarg("shell") == "True")
    rows = _calls(src).filter(F.col("dotted").isin("os.system", "os.popen") | run)
    return _found(rows, "SHELL-001", "call through a shell", F.format_string("%s runs through a shell", "dotted"), "Pass a list of arguments without a shell")


@rule("DESERIAL-001", CHECK, "Untrusted objects are not revived")
def deserial(src: Source) -> DataFrame:
    pickles = (F.size("chain") == 2) & F.col("root").isin(*V.UNPICKLERS) & F.col("last").isin("load", "loads")
    loader = F.element_at(F.split(_kwarg("Loader"), r"\."), -1)
    yaml = (F.col("dotted") == "yaml.load") & ~F.coalesce(loader.isin(*V.SAFE_LOADERS), F.lit(False))
    rows = _calls(src).filter(pickles | yaml | (F.col("dotted") == "yaml.unsafe_load"))
    return _found(rows, "DESERIAL-001", "unsafe deserialisation", F.format_string("%s can run code", "dotted"), "Use a format without code")


@rule("EVAL-001", CHECK, "No text is run as code")
def evaluated(src: Source) -> DataFrame:
    rows = _calls(src).filter(F.col("bare").isin("eval", "exec", "compile") & (F.col("n_args") > 0) & (F.col("arg0_kind") != "str"))
    return _found(rows, "EVAL-001", "text run as code", F.format_string("%s() of an expression", "bare"), "Use ast.literal_eval or a table of functions")


@rule("CRYPTO-001", CHECK, "Hashes and protocols are strong")
def crypto(src: Source) -> DataFrame:
    weak = F.col("dotted").isin("hashlib.md5", "hashlib.sha1") & ~F.coalesce(_kwarg("usedforsecurity") == "False", F.lit(False))
    new = (F.col("dotted") == "hashlib.new") & (F.col("arg0_kind") == "str") & F.lower("arg0").isin("md5", "sha1")
    calls = _calls(src).filter(weak | new).select("path", "line", "idx", "dotted")
    protocols = src.attributes.filter(~X.in_any(F.col("path"), V.SKIP_DIRS)).withColumn("dotted", F.array_join("chain", ".")).filter(F.col("dotted").isin(*(f"ssl.{p}" for p in V.WEAK_TLS))).select("path", "line", "idx", "dotted")
    return _found(calls.unionByName(protocols), "CRYPTO-001", "weak hash or protocol", F.format_string("%s is weak", "dotted"), "Use sha256 or newer protocols")


@rule("TLS-001", CHECK, "Certificates are verified")
def tls(src: Source) -> DataFrame:
    off = F.col("root").isin(*V.TLS_CLIENTS) & (_kwarg("verify") == "False")
    calls = _calls(src).filter(off | (F.col("dotted") == "ssl._create_unverified_context")).select("path", "line", "idx", "dotted")
    none = src.attributes.filter(~X.in_any(F.col("path"), V.SKIP_DIRS)).withColumn("dotted", F.array_join("chain", ".")).filter("dotted = 'ssl.CERT_NONE'").select("path", "line", "idx", "dotted")
    return _found(calls.unionByName(none), "TLS-001", "certificates are not verified", F.format_string("%s skips verification", "dotted"), "Verify certificates")


@rule("DEBUG-001", CHECK, "Nothing runs in debug mode")
def debug(src: Source) -> DataFrame:
    target = F.col("bare").isin(*V.FRAMEWORKS) | F.col("last").isin(*V.FRAMEWORKS, "run", "run_server")
    calls = _calls(src).filter(target & (_kwarg("debug") == "True")).select("path", "line", "idx", F.coalesce("last", "bare").alias("what"))
    name = F.lower(X.name_of(F.col("path")))
    own = src.assigns.filter((F.col("context") == "var") & (F.col("target") == "DEBUG") & (F.col("kind") == "bool") & (F.col("value") == "True") & (name.endswith("settings.py") | name.endswith("config.py")))
    return _found(calls.unionByName(own.select("path", "line", "idx", F.lit("DEBUG").alias("what"))), "DEBUG-001", "debug mode", F.format_string("%s turns debugging on", "what"), "Read it from the environment")


def _layer_relative(src: Source) -> Column:
    root = src.of("security_patterns", "source_root", "").strip("/")
    return F.when(F.col("path").startswith(f"{root}/"), F.substring(F.col("path"), len(root) + 2, 1 << 20)).otherwise(F.col("path")) if root else F.col("path")


@rule("AUTHN-001", "security_patterns", "Mutations ask who calls")
def authentication(src: Source) -> DataFrame:
    rows = src.functions.filter(_layer_relative(src).startswith("api/") & ~X.name_of(F.col("path")).startswith("test_") & F.exists("decorators", lambda d: d["called"] & F.coalesce(d["attr"].isin(*V.MUTATIONS), F.lit(False))))
    rows = rows.filter(~F.col("name").isin(*V.AUTH_EXEMPT) & ~F.exists("params", lambda p: p["kind"].isin("pos", "kwonly") & p["auth"]))
    return findings(rows, "security_patterns", "AUTHN-001: mutation without authentication", "error", "line", F.format_string("Endpoint '%s' does not ask who calls", "name"), "Depend on the current user", "idx")


@rule("SQL-001", "security_patterns", "SQL is not put together", reads=("calls",))
def raw_sql(src: Source) -> DataFrame:
    receiver = F.lower(F.coalesce("receiver", F.lit("")))
    foreign = receiver.rlike("|".join(V.NOT_DATABASES))
    execute = F.col("method").isin(*V.SQL_METHODS) & ~foreign
    read = F.coalesce(F.col("method").isin(*V.SQL_READS), F.lit(False)) | F.coalesce(F.col("bare").isin(*V.SQL_READS), F.lit(False))
    rows = src.calls.filter(~F.col("path").contains("alembic") & ~X.name_of(F.col("path")).startswith("test_")).withColumn("execute", F.coalesce(execute, F.lit(False))).filter(F.col("execute") | read)
    rows = rows.filter(F.col("sql_text").rlike(V.SQL_TEXT))
    params = F.map_contains_key("kwargs", "params") | F.map_contains_key("kwargs", "parameters") | F.map_contains_key("kwargs", "vars") | (F.col("execute") & (F.col("n_args") >= 2))
    rows = rows.filter(F.col("sql_interpolated") | ~(F.col("sql_text").rlike(V.SQL_PLACEHOLDER) & params))
    how = F.when(F.col("sql_interpolated"), "put together").otherwise("without parameters")
    return findings(rows, "security_patterns", "SQL-001: raw SQL", "error", F.coalesce("sql_line", "line"), F.format_string("SQL text %s", how), "Use the query builder or bound parameters", "idx")


@rule("SQL-000", "security_patterns", "Files parse")
def sql_notice(src: Source) -> DataFrame:
    return notices(src, "security_patterns", "SQL-000")


@rule("SECRETPY-001", "secrets", "No secrets in the source", reads=("assigns",))
def secrets(src: Source) -> DataFrame:
    name = X.name_of(F.col("path"))
    rows = src.assigns.filter((F.col("kind") == "str") & ~name.isin("conftest.py", "seed_dev.py") & ~name.startswith("test_") & ~X.in_any(F.col("path"), V.SKIP_DIRS))
    parts = F.split(F.lower("target"), "_")
    named = F.col("target").rlike(V.SECRET_NAMES) & ~F.get(parts, F.lit(0)).isin(*V.SECRET_NOT_FIRST) & ~F.element_at(parts, -1).isin(*V.SECRET_NOT_LAST)
    value = F.col("value")
    strong = (F.length(value) >= 32) & value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]")
    looks = (F.length(value) >= 6) & ~value.rlike(r"\s") & (strong | ~value.rlike(V.SECRET_PLACEHOLDERS))
    shaped = (F.col("context") == "literal") & (value.rlike(V.SECRET_WHOLE) | (value.rlike(V.SECRET_SHAPES) & ~value.rlike(V.SECRET_PLACEHOLDERS)))
    rows = rows.filter((named & looks) | shaped).dropDuplicates(["path", "line"])
    return findings(rows, "secrets", "SECRETPY-001: secret in the source", "error", "line", "A literal looks like a credential", "Read it from the environment", "idx")
