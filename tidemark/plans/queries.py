"""The engine's operators over the driver's tables, and the same results as SQL.

Rules over Python and Markdown run on files made of the supplier table: a row is dealt one of the rule's cases, and what
the case is known to have is what the SQL expects. Text rules and the chain run on documents as Markdown files named
source/doc_id.md. Both are adapted inputs, as the tables hold no source trees.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import baseline as B
from tidemark.operators import chain as C
from tidemark.operators import groups as G
from tidemark.operators import scoring as S
from tidemark.plans import check as P
from tidemark.plans import report
from tidemark.plans.cases import CASES, TRAPS, Case
from tidemark.plans.corpora import CORPORA, EXPECTED
from tidemark.plans.scorers import SCORERS, Scorer, score
from tidemark.functions import text as X
from tidemark.rules import code as code_rules
from tidemark.rules import prose
from tidemark.rules.base import RULES, Rule, Source, findings
from tidemark.sources.tables import shared_folder, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


# --- rules over cases --------------------------------------------------------------------------------------------


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k: each row's key once. The table is small and often one part, but much is made of a row, so rows are dealt out."""
    tasks = 2 * spark.sparkContext.defaultParallelism
    return _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")).repartition(tasks, "k").distinct()


def _made_files(spark: SparkSession, sf_dir: str, made: Sequence[tuple[int, int, str, str, str]]) -> DataFrame:
    """path, content, each once: of made (i, n, tag, path, source) those with i = key mod n for each row of supplier, tag and key for {k}.
    Files are told apart by paths, the number of their source, and the key if that has it: sources are no part of the shuffle."""
    sources = {s: t for t, s in enumerate(dict.fromkeys(m[-1] for m in made))}
    dealt = spark.createDataFrame([(i, n, tag, path, sources[s], "{k}" in s) for i, n, tag, path, s in made], "i int, n int, tag string, path string, t int, keyed boolean")
    texts = spark.createDataFrame([(t, s) for s, t in sources.items()], "t int, source string")
    key = F.concat("tag", F.col("k").cast("string"))
    rows = _keys(spark, sf_dir).join(F.broadcast(dealt), F.col("k") % F.col("n") == F.col("i"))
    rows = rows.select(F.replace("path", F.lit("{k}"), key).alias("path"), "t", F.when(F.col("keyed"), key).otherwise("").alias("key")).distinct()
    return rows.join(F.broadcast(texts), "t").select("path", F.when(F.col("key") == "", F.col("source")).otherwise(F.replace("source", F.lit("{k}"), F.col("key"))).alias("content"))


def dealt_files(spark: SparkSession, sf_dir: str, cases: Sequence[Case]) -> DataFrame:
    """path, content: one case for each row of supplier, in turn."""
    return _made_files(spark, sf_dir, [(i, len(cases), "", *file) for i, c in enumerate(cases) for file in ((c.path, c.source), *c.beside)])


def case_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: for each row of supplier, in turn, one case of every key; the key is part of {k}, or of the path where that has none."""
    tag = lambda key: "".join(c for c in key.lower() if c.isalnum()) + "x"
    under = lambda key, path: path if "{k}" in path else f"{tag(key)}/{path}"
    return _made_files(spark, sf_dir, [(i, len(found), tag(key), under(key, path), source) for key, (_, found) in sorted(CASES.items()) for i, c in enumerate(found) for path, source in ((c.path, c.source), *c.beside)])


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case_query(name: str, key: str, settings: Mapping[str, Any], cases: Sequence[Case]) -> None:
    check, _, code = key.partition(".")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rules = [RULES[(check, code)]]
        src = P.source(dealt_files(spark, sf_dir, cases), {check: settings}, rules)
        return P.find(src, rules).select("file", "code", "severity", F.col("line").cast("long").alias("line"))

    run.__name__ = name
    expected = [(i, c.path, n, *f) for i, c in enumerate(cases) for n, f in enumerate(c.found)]
    if code == "PATH-001":
        expected = [(0, "legacy", 0, code, "error", 1), (1, "m{k}/legacy", 0, code, "error", 1)]
    if not expected:
        raise ValueError(f"{key} finds nothing")
    values = ", ".join(f"({i}, {_quoted(p)}, {n}, '{c}', '{s}', {line})" for i, p, n, c, s, line in expected)
    QUERIES[name] = run
    ORACLES[name] = f"""
WITH expected(i, path, n, code, severity, line) AS (VALUES {values})
SELECT file, code, severity, line FROM (SELECT DISTINCT replace(path, '{{k}}', CAST(s_suppkey AS VARCHAR)) AS file, n, code, severity, CAST(line AS BIGINT) AS line
FROM supplier JOIN expected ON s_suppkey % {len(cases)} = i)"""


for _key, (_settings, _cases) in CASES.items():
    _case_query("rule_" + _key.replace(".", "_").replace("-", "_").lower(), _key, _settings, _cases)
for _name, (_key, _settings, _cases) in TRAPS.items():
    _case_query(f"trap_{_name}", _key, _settings, _cases)

# --- scorers over labelled corpora -------------------------------------------------------------------------------


def labelled_files(spark: SparkSession, sf_dir: str, corpora: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """corpus, path, content and corpus, file, line, expected: for each row of supplier, in turn, a source of every corpus, and its labels."""
    own = [(c, len(CORPORA[c]), i, x) for c in corpora for i, x in enumerate(CORPORA[c])]
    sources = spark.createDataFrame([(c, n, i, x.path, x.source) for c, n, i, x in own], "corpus string, n int, i int, path string, content string")
    labels = spark.createDataFrame([(c, n, i, x.path, line, EXPECTED[mark]) for c, n, i, x in own for line, mark in x.labels], "corpus string, n int, i int, path string, line int, expected boolean")
    rows = _keys(spark, sf_dir)

    def dealt(table: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(table), F.col("k") % F.col("n") == F.col("i")).withColumn("path", F.replace("path", F.lit("{k}"), F.col("k").cast("string")))

    return dealt(sources).select("corpus", "path", "content"), dealt(labels).select("corpus", F.col("path").alias("file"), "line", "expected")


def _score_sql(corpora: Iterable[str]) -> str:
    """What is labelled, and known to be found or not, in the sources that rows are dealt."""
    counts = lambda x: ", ".join(str(sum(m == mark for _, m in x.labels)) for mark in "+!?-")
    values = ", ".join(f"('{c}', {len(CORPORA[c])}, {i}, {counts(x)})" for c in corpora for i, x in enumerate(CORPORA[c]))
    total = ", ".join(f"CAST(sum({x}) AS BIGINT) AS {x}" for x in ("tp", "fp", "fn", "tn"))
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / CAST({b} AS DOUBLE) ELSE 0.0 END"
    return f"""
WITH marks(corpus, n, i, tp, fp, fn, tn) AS (VALUES {values}),
sums AS (SELECT corpus, {total} FROM (SELECT DISTINCT s_suppkey AS k FROM supplier) JOIN marks ON k % n = i GROUP BY corpus),
shares AS (SELECT *, {share("tp", "(tp + fp)")} AS precision, {share("tp", "(tp + fn)")} AS recall FROM sums)
SELECT split_part(corpus, '.', 2) AS rule, corpus, tp + fp + fn + tn AS labels, CAST(0 AS BIGINT) AS stale, tp, fp, fn, tn, precision, recall, {share("2 * precision * recall", "(precision + recall)")} AS f1 FROM shares"""


def _scorer_query(name: str, scorers: list[Scorer]) -> None:
    corpora = [s.corpus for s in scorers]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return score(*labelled_files(spark, sf_dir, corpora), scorers).select("rule", "corpus", "labels", "stale", "tp", "fp", "fn", "tn", "precision", "recall", "f1")

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, _score_sql(corpora)


for _scorer in SCORERS.values():
    _scorer_query("scorer_" + _scorer.code.replace("-", "_").lower(), [_scorer])
_scorer_query("scorers_all", list(SCORERS.values()))

# --- findings over documents -------------------------------------------------------------------------------------

TERMS = [{"id": "TERM-001", "canonical": "person", "forbidden": ["idiot", "scum"]}, {"id": "TERM-002", "canonical": "poor", "forbidden": ["pathetic", "worthless", "stupid"]}]
SIZES = (12, 30)


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select(F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), F.col("text").alias("content"), "doc_id")


def document_source(files: DataFrame) -> Source:
    return Source(files.select("path", "content"), files.select("path").limit(0))


def document_findings(files: DataFrame) -> DataFrame:
    """Forbidden terms by line, and documents of many effective lines."""
    terms = prose.term_matches(document_source(files).lines, TERMS)
    sized = code_rules._limited(files, X.effective_lines(X.split_lines(F.col("content"))), *SIZES)
    size = findings(sized, "file_limits", "SIZE-001: file is too long", F.col("sev"), 1, F.format_string("File has %d effective lines", "value"), "Split the file")
    return terms.unionByName(size)


_WORDS = {t["id"]: rf"(?i)\b({'|'.join(t['forbidden'])})\b" for t in TERMS}
_HITS = " ".join(f"WHEN '{code}' THEN regexp_extract_all(text, '{pattern}', 1)" for code, pattern in _WORDS.items())
_NAMES = ", ".join(f"('{t['id']}', '{t['canonical']}')" for t in TERMS)

FOUND = f"""
WITH files AS (SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.md' AS file, text, doc_id FROM documents),
lines AS (SELECT file, doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM files),
terms(code, canonical) AS (VALUES {_NAMES}),
hits AS (SELECT file, doc_id, line, code, canonical, unnest(CASE code {_HITS} END) AS term FROM lines, terms),
sized AS (SELECT file, doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(ltrim(x), '#'))) AS n FROM files),
found AS (
  SELECT 'domain_terms' AS "check", 'error' AS severity, file, doc_id, CAST(line AS BIGINT) AS line, code || ': Use ''' || canonical || ''' instead of ''' || term || '''' AS rule, code, 'TERM' AS category, 'Forbidden term ''' || term || '''' AS message FROM hits
  UNION ALL
  SELECT 'file_limits', CASE WHEN n >= {SIZES[1]} THEN 'error' ELSE 'warning' END, file, doc_id, 1, 'SIZE-001: file is too long', 'SIZE-001', 'SIZE', 'File has ' || CAST(n AS VARCHAR) || ' effective lines' FROM sized WHERE n >= {SIZES[0]})
"""
SHOWN = ("check", "severity", "file", "line", "code", "message")
SHOW = 'SELECT "check", severity, file, line, code, message FROM'


def _show(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("long").alias(c) if c == "line" else F.col(c) for c in SHOWN))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_findings(document_files(spark, sf_dir))


def _documents_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As _documents, written, for reports that go through findings several times."""
    return written(_documents(spark, sf_dir), f"{shared_folder(spark, 'findings')}/documents")


@query(f"{FOUND} {SHOW} found")
def term_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show(_documents(spark, sf_dir))


@query(f"{FOUND} {SHOW} found WHERE category IN ('TERM', 'SIZE') AND code <> 'TERM-002'")
def select_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show(C.select_ignore(_documents(spark, sf_dir), ["term", "SIZE-001"], ["TERM-002"]))


@query(f"{FOUND} {SHOW} found WHERE NOT starts_with(file, 'src1') AND NOT file LIKE '%/%7.md'")
def exclude_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show(C.exclude(_documents(spark, sf_dir), ["src1*", "*/*7.md"]))


@query(f"{FOUND} {SHOW} found WHERE NOT (starts_with(file, 'src0/') AND category = 'TERM') AND NOT (file LIKE '%5.md' AND code = 'SIZE-001')")
def per_file_ignores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show(C.per_file_ignores(_documents(spark, sf_dir), {"src0/*": ["TERM"], "*5.md": ["SIZE-001"]}))


@query(f"{FOUND} SELECT \"check\", CASE WHEN code = 'SIZE-001' THEN 'error' ELSE severity END AS severity, file, line, code, message FROM found")
def promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show(C.promote(_documents(spark, sf_dir), ["SIZE"]))


@query(f"{FOUND} {SHOW} found WHERE starts_with(file, 'src2/') OR file = 'src3/3.md'")
def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([("src2",), ("src3/3.md",)], "target string")
    return _show(C.keep_targets(_documents(spark, sf_dir), wanted))


@query(f"{FOUND} SELECT \"check\", severity, 'docs/' || file AS file, line, code, message FROM found")
def reanchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show(C.reanchor(_documents(spark, sf_dir), "docs"))


@query(f"{FOUND} {SHOW} found WHERE NOT ((doc_id % 7 = 0) OR (doc_id % 7 = 1 AND category = 'TERM') OR (doc_id % 7 = 2 AND code = 'SIZE-001'))")
def inline_ignores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line gets a directive by its document: bare, for TERM, for SIZE-001 in the tool's own form, or none."""
    files = document_files(spark, sf_dir)
    lines = files.select("doc_id", "path", F.posexplode(X.split_lines(F.col("content"))).alias("k", "text"))
    kind = F.col("doc_id") % 7
    mark = F.when(kind == 0, " # noqa").when(kind == 1, " # noqa: TERM, X1").when(kind == 2, " # tidemark: ignore[SIZE-001]").otherwise("")
    lines = lines.select("path", (F.col("k") + 1).alias("line"), F.concat("text", mark).alias("text"))
    return _show(C.inline_ignores(document_findings(files), lines))


# --- the baseline ------------------------------------------------------------------------------------------------

ANCHORED = rf"""{FOUND},
anchored AS (SELECT f.*, CASE WHEN f.line >= 2 AND trim(l.text) <> '' THEN 'sha:' || sha256(trim(l.text)) ELSE 'desc:' || sha256(trim(substr(rule, strpos(rule, ':') + 1))) END AS anchor
  FROM found f LEFT JOIN lines l ON f.file = l.file AND f.line = l.line),
ordered AS (SELECT *, row_number() OVER (PARTITION BY file, code, anchor ORDER BY "check", severity <> 'error', line, message) AS place FROM anchored),
entries AS (SELECT file, code, anchor, CASE WHEN max(CAST(severity = 'error' AS INT)) = 1 THEN 'error' ELSE 'warning' END AS severity, max(CASE WHEN place = 1 THEN message END) AS message, CAST(count(*) AS BIGINT) AS count FROM ordered GROUP BY file, code, anchor),
known AS (SELECT e.file, e.code, e.anchor, 'error' AS known, (e.count + 1) // 2 AS budget FROM entries e JOIN files USING (file) WHERE doc_id % 2 = 0),
met AS (SELECT a.*, known.known, budget, known.known IS NOT NULL AS eligible FROM anchored a LEFT JOIN known USING (file, code, anchor)),
turned AS (SELECT *, row_number() OVER (PARTITION BY file, code, anchor, eligible ORDER BY "check", severity <> 'error', line, message) AS turn FROM met)
"""


def _anchored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Findings with anchors, and a baseline of those of even documents with half their counts. Both ask for the findings several times, so they are written."""
    files, folder = document_files(spark, sf_dir), shared_folder(spark, "baseline")
    found = B.anchored(written(document_findings(files), f"{folder}/findings"), document_source(files).lines)
    found = written(found, f"{folder}/anchored")
    even = files.filter("doc_id % 2 = 0").select(F.col("path").alias("file"))
    known = B.entries(found).join(even, "file", "left_semi").withColumns({"count": F.expr("cast((count + 1) div 2 as int)"), "severity": F.lit("error")})
    return found, known.select(*B.KEY, "severity", "count")


@query(f"{ANCHORED} SELECT * FROM entries")
def baseline_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = _anchored(spark, sf_dir)
    return B.entries(found).withColumn("count", F.col("count").cast("long"))


@query(f"{ANCHORED} {SHOW} turned WHERE NOT (eligible AND turn <= budget)")
def baseline_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show(B.suppress(*_anchored(spark, sf_dir)))


def _moved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The findings of every third document have moved since."""
    found, known = _anchored(spark, sf_dir)
    ids = F.regexp_extract("file", r"/(\d+)\.md$", 1).cast("long")
    return found.withColumn("anchor", F.when(ids % 3 == 0, F.concat("anchor", F.lit("-moved"))).otherwise(F.col("anchor"))), known


MOVED = f"{ANCHORED}, moved AS (SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN anchor || '-moved' ELSE anchor END AS anchor) FROM anchored)"


@query(f"{MOVED} SELECT file, code, anchor, CAST(budget AS BIGINT) AS count FROM known k WHERE NOT EXISTS (SELECT 1 FROM moved m WHERE m.file = k.file AND m.code = k.code AND m.anchor = k.anchor)")
def baseline_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.stale(*_moved(spark, sf_dir)).select(*B.KEY, F.col("count").cast("long").alias("count"))


@query(f"""{MOVED}, gone AS (SELECT file, code FROM known k WHERE NOT EXISTS (SELECT 1 FROM moved m WHERE m.file = k.file AND m.code = k.code AND m.anchor = k.anchor)),
strange AS (SELECT file, code FROM moved m WHERE NOT EXISTS (SELECT 1 FROM known k WHERE m.file = k.file AND m.code = k.code AND m.anchor = k.anchor))
SELECT file, code FROM gone INTERSECT SELECT file, code FROM strange""")
def baseline_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.drift(*_moved(spark, sf_dir))


# --- rollups and scores ------------------------------------------------------------------------------------------

ROLLUP = f"""{FOUND}, checks AS (SELECT * FROM (VALUES ('domain_terms'), ('file_limits'), ('prose')) AS t("check")),
counts AS (SELECT c."check", CAST(count(*) FILTER (WHERE severity = 'error') AS BIGINT) AS n_violations, CAST(count(*) FILTER (WHERE severity = 'warning') AS BIGINT) AS n_warnings FROM checks c LEFT JOIN found f ON c."check" = f."check" GROUP BY 1),
results AS (SELECT "check", CASE WHEN n_violations > 0 THEN 'FAIL' WHEN n_warnings > 0 THEN 'WARN' ELSE 'PASS' END AS status, n_violations, n_warnings FROM counts)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.rollup(_documents(spark, sf_dir), spark.createDataFrame([("domain_terms",), ("file_limits",), ("prose",)], "check string"))


@query(f"{ROLLUP} SELECT * FROM results")
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir)


@query(f"{ROLLUP} SELECT count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'WARN') AS warned, count(*) FILTER (WHERE status = 'FAIL') AS failed FROM results")
def summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.summary(_results(spark, sf_dir))


@query(f"{FOUND} SELECT code, count(*) AS findings FROM found GROUP BY code")
def tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tally(_documents(spark, sf_dir))


@query(f"""{FOUND}, judged AS (SELECT l.doc_id, toxic = 1 AS expected, l.doc_id IN (SELECT doc_id FROM found WHERE category = 'TERM') AS hit FROM labels l),
c AS (SELECT count(*) FILTER (WHERE expected AND hit) AS tp, count(*) FILTER (WHERE NOT expected AND hit) AS fp, count(*) FILTER (WHERE expected AND NOT hit) AS fn, count(*) FILTER (WHERE NOT expected AND NOT hit) AS tn FROM judged),
p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM c)
SELECT 'TERM' AS rule, tp, fp, fn, tn, round(CAST(precision AS DOUBLE), 9) AS precision, round(CAST(recall AS DOUBLE), 9) AS recall, round(CAST(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS DOUBLE), 9) AS f1 FROM p""")
def scorer_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = document_files(spark, sf_dir)
    hits = document_findings(files).filter("category = 'TERM'").join(files.select(F.col("path").alias("file"), "doc_id"), "file").select("doc_id")
    labels = _table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("expected"), F.lit("TERM").alias("rule"))
    out = S.confusion(labels, hits, ["doc_id"], ["rule"])
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


# --- sinks, regions and the findings about rules ----------------------------------------------------------------

FIXED = f"""{FOUND}, fixed AS (SELECT *, CASE category WHEN 'TERM' THEN 'Use ''' || CASE code WHEN 'TERM-001' THEN 'person' ELSE 'poor' END || '''' ELSE 'Split the file' END AS fix FROM found)"""


@query(f"""{FIXED} SELECT CAST(to_json({{'check': "check", 'severity': severity, 'file': file, 'line': line, 'code': code, 'rule': rule, 'message': message, 'fix': fix}}) AS VARCHAR) AS value FROM fixed""")
def sink_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.ndjson(_documents(spark, sf_dir))


@query(f"""{FIXED} SELECT '::' || severity || ' file=' || file || ',line=' || CAST(line AS VARCHAR) || ',title=' || code || '::' || message || ' Fix: ' || fix AS value FROM fixed""")
def sink_github(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.github(_documents(spark, sf_dir))


@query(f"""{FIXED}, texts AS (SELECT "check", count(*) FILTER (WHERE severity = 'error') AS e, count(*) FILTER (WHERE severity = 'warning') AS w,
  string_agg('  VIOLATION: ' || file || ':' || CAST(line AS VARCHAR) || ' — ' || message || chr(10) || '    Rule: ' || rule || chr(10) || '    Fix: ' || fix || chr(10), '' ORDER BY severity <> 'error', string_split(file, '/'), line, message) AS texts FROM fixed GROUP BY "check")
SELECT "check", '[' || CASE WHEN e > 0 THEN 'FAIL' ELSE 'WARN' END || '] ' || "check" || chr(10) || texts || '--- ' || "check" || ': ' || CAST(e AS VARCHAR) || ' violations, ' || CAST(w AS VARCHAR) || ' warnings ---' AS value FROM texts""")
def sink_human(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.human(_documents(spark, sf_dir), spark.createDataFrame([("domain_terms",), ("file_limits",), ("prose",)], "check string"))


@query(f"""{ROLLUP} SELECT 'Summary: 3 checks — ' || CAST(count(*) FILTER (WHERE status = 'PASS') AS VARCHAR) || ' passed, ' || CAST(count(*) FILTER (WHERE status = 'WARN') AS VARCHAR) || ' warnings, ' || CAST(count(*) FILTER (WHERE status = 'FAIL') AS VARCHAR) || ' failed.' AS value FROM results""")
def sink_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary_line(_results(spark, sf_dir))


@query(f"""{FOUND}, odd AS (SELECT CASE WHEN "check" = 'file_limits' THEN 'META-004' END AS strange, CASE WHEN doc_id % 5 = 0 THEN 'META-005' END AS blank, file, line FROM found)
SELECT code, file, line FROM (SELECT strange AS code, file, line FROM odd UNION ALL SELECT blank, file, line FROM odd) WHERE code IS NOT NULL""")
def meta_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """META-004 and META-005: of two checks one is registered, and every fifth document's findings have a blank fix."""
    found = _documents(spark, sf_dir)
    number = F.regexp_extract("file", r"/(\d+)\.md$", 1).cast("long")
    found = found.withColumn("fix", F.when(number % 5 == 0, " ").otherwise(F.col("fix")))
    rules = [r for r in RULES.values() if r.check == "domain_terms"]
    return P.well_formed(found, rules).select("code", "file", F.col("line").cast("long").alias("line"))


@query("""WITH files AS (SELECT source AS region, source || '/' || CAST(doc_id AS VARCHAR) || '.py' AS file, doc_id % 12 + 1 AS n FROM documents)
SELECT file, CASE WHEN n >= CASE region WHEN 'src1' THEN 9 ELSE 7 END THEN 'error' ELSE 'warning' END AS severity FROM files WHERE n >= CASE region WHEN 'src1' THEN 8 WHEN 'src2' THEN 2 ELSE 5 END""")
def regional_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SIZE-001 on a source a row, of as many lines as its document's id says, under settings by folder."""
    files = _table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".py"))).alias("path"), F.repeat(F.lit("x = 1\n"), (F.col("doc_id") % 12 + 1).cast("int")).alias("content"))
    sizes = lambda warn, error: {"file_limits": {"file_warn": warn, "file_error": error}}
    src = P.source(files, sizes(5, 7))
    found = P.regional(src, [RULES[("file_limits", "SIZE-001")]], {"src1": sizes(8, 9), "src2": sizes(2, 7)}, "SIZE-001")
    return found.filter("code = 'SIZE-001'").select("file", "severity")


@query("""SELECT status, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'odd' WHEN s_suppkey % 3 = 1 THEN 'old' ELSE 'new' END AS status FROM supplier) GROUP BY status""")
def folded_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with . and .. that lead back to a row's own name, above the root, or to the root itself."""
    k = F.col("s_suppkey")
    path = F.when(k % 3 == 0, F.concat(F.lit("../a/"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("a/./b/../"), k.cast("string"), F.lit("/c//.."))).otherwise(F.lit("x/.."))
    rows = _table(spark, sf_dir, "supplier").select(k.cast("string").alias("k"), X.folded_path(path).alias("p"))
    status = F.when(F.col("p") == F.concat(F.lit("../a/"), "k"), "odd").when(F.col("p") == F.concat(F.lit("a/"), "k"), "old").when(F.col("p") == "", "new").otherwise("wrong")
    return rows.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


_ITEMS = """{'file': file, 'line': line, 'rule': rule, 'message': message, 'fix': fix, 'code': code}"""


@query(f"""{FIXED}, parted AS (SELECT "check", severity, file, line, message, array_to_string(list_transform(range(count(*)), lambda i: '  VIOLATION: ' || file || ':' || CAST(line AS VARCHAR) || ' — ' || message || chr(10) || '    Rule: ' || rule || chr(10) || '    Fix: ' || fix), chr(10)) AS value FROM fixed GROUP BY "check", severity, file, line, rule, message, fix),
counts AS (SELECT "check", count(*) FILTER (WHERE severity = 'error') AS e, count(*) FILTER (WHERE severity = 'warning') AS w FROM fixed GROUP BY "check")
SELECT "check", 1 AS part, value FROM parted
UNION ALL SELECT "check", 0, '[' || CASE WHEN e > 0 THEN 'FAIL' ELSE 'WARN' END || '] ' || "check" FROM counts
UNION ALL SELECT "check", 2, '--- ' || "check" || ': ' || CAST(e AS VARCHAR) || ' violations, ' || CAST(w AS VARCHAR) || ' warnings ---' || chr(10) FROM counts""")
def sink_human_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-HUMAN as rows of heads, findings and feet, which tasks write in order."""
    return report.human_lines(_documents_once(spark, sf_dir), spark.createDataFrame([("domain_terms",), ("file_limits",), ("prose",)], "check string")).select("check", "part", "value")


@query(f"""{FIXED}, parted AS (SELECT "check", severity, line, message, file, array_to_string(list_transform(range(count(*)), lambda i: CAST(to_json({_ITEMS}) AS VARCHAR)), ',' || chr(10)) AS value FROM fixed GROUP BY "check", severity, file, line, rule, message, fix, code),
placed AS (SELECT *, row_number() OVER (PARTITION BY "check", severity ORDER BY string_split(file, '/'), line, message) AS place FROM parted),
checks("check", comma) AS (VALUES ('domain_terms', ''), ('file_limits', ','), ('prose', ',')),
counts AS (SELECT c."check", comma, count(*) FILTER (WHERE severity = 'error') AS e, count(*) FILTER (WHERE severity = 'warning') AS w FROM checks c LEFT JOIN fixed f ON f."check" = c."check" GROUP BY ALL)
SELECT "check", CASE severity WHEN 'error' THEN 1 ELSE 3 END AS part, CASE WHEN place > 1 THEN ',' ELSE '' END || value AS value FROM placed
UNION ALL SELECT "check", 0, comma || '{{"check":"' || "check" || '","status":"' || CASE WHEN e > 0 THEN 'FAIL' WHEN w > 0 THEN 'WARN' ELSE 'PASS' END || '","violations":[' FROM counts
UNION ALL SELECT "check", 2, '],"warnings":[' FROM counts UNION ALL SELECT "check", 4, ']}}' FROM counts""")
def sink_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-JSON as the lines of one array, a row for each."""
    return report.json_lines(_documents_once(spark, sf_dir), spark.createDataFrame([("domain_terms",), ("file_limits",), ("prose",)], "check string")).select("check", "part", "value")


@query("""WITH files AS (SELECT doc_id % 1000 AS region, 'd' || CAST(doc_id % 1000 AS VARCHAR) || '/' || CAST(doc_id AS VARCHAR) || '.py' AS file, doc_id % 12 + 1 AS n FROM documents),
limits AS (SELECT *, 3 + region % 7 AS warn, 4 + region % 9 AS error FROM files)
SELECT file, CASE WHEN n >= error THEN 'error' ELSE 'warning' END AS severity FROM limits WHERE n >= least(warn, error)""")
def regional_thousand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SIZE-001 under the settings of a thousand folders, in one plan: thresholds are columns."""
    number = F.col("doc_id") % 1000
    files = _table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), number.cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.repeat(F.lit("x = 1\n"), (F.col("doc_id") % 12 + 1).cast("int")).alias("content"))
    regions = {f"d{i}": {"file_limits": {"file_warn": 3 + i % 7, "file_error": 4 + i % 9}} for i in range(1000)}
    found = P.regional(P.source(files), [RULES[("file_limits", "SIZE-001")]], regions, "SIZE-001")
    return found.filter("code = 'SIZE-001'").select("file", "severity")


@query(f"""{FOUND}, late AS (SELECT min(doc_id) AS doc_id FROM documents)
SELECT "check", severity, file, line, code FROM found UNION ALL SELECT 'late', 'warning', '', CAST(0 AS BIGINT), 'RUN-000' FROM late WHERE doc_id IS NOT NULL""")
def isolated_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U-ISOL: of three rules one fails on a row while it runs; it becomes a notice, the findings of the others stand."""
    files = document_files(spark, sf_dir)
    rows, first = document_findings(files), files.agg(F.min("doc_id").alias("first"))

    def late(src: Source) -> DataFrame:
        odd = files.join(F.broadcast(first), F.col("doc_id") == F.col("first"))
        return findings(odd, "late", "LATE-001: fails", "error", 1, F.raise_error(F.concat(F.lit("late on "), "path")).cast("string"), "fix")

    rules = [Rule("TERM-NNN", "domain_terms", True, "terms", lambda src: rows.filter("check = 'domain_terms'")), Rule("LATE-001", "late", True, "fails", late), Rule("SIZE-001", "file_limits", True, "sizes", lambda src: rows.filter("check = 'file_limits'"))]
    src = document_source(files)
    return P.isolated(src, rules, shared_folder(spark, "isolated")).select("check", "severity", "file", F.col("line").cast("long").alias("line"), "code")


@query(f"""{FOUND} SELECT code, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'META-004' AS code FROM found UNION ALL SELECT unnest(['META-001', 'META-002', 'META-003'])) GROUP BY code""")
def meta_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """META-001 to META-003: rules with a blank check, description or code; META-004 as none of them has the findings' checks."""
    rules = [Rule("A-001", " ", True, "a", document_findings), Rule("A-002", "a", True, "\t", document_findings), Rule(" ", "a", True, "c", document_findings)]
    return P.well_formed(_documents(spark, sf_dir), rules).groupBy("code").agg(F.count("*").alias("n"))


@query("""SELECT 'LAYER-006' AS code, '.' AS file, name || ' of ' || CAST(n AS VARCHAR) AS told FROM (SELECT count(*) AS n FROM supplier), (VALUES ('edge'), ('cli')) t(name)
UNION ALL SELECT 'LAYER', 'm/a_' || CAST(s_suppkey AS VARCHAR) || '.py', 'core/ imports from shell/' FROM supplier WHERE s_suppkey % 2 = 0""")
def layer_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LAYER-006 on transport layers that are none, and LAYER, the code of layers that have none of their own, on a source a row."""
    rows = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    path = F.concat(F.lit("core/a_"), F.col("k").cast("string"), F.lit(".py"))
    files = rows.select(path.alias("path"), F.when(F.col("k") % 2 == 0, "import shell.x\n").otherwise("import os\n").alias("content"))
    src = P.source(files, {"layer_deps": {"layers": ["core", "shell"], "allowed": {"core": []}, "transport_layers": ["shell", "edge", "cli"]}})
    found = P.find(src, [RULES[("layer_deps", "LAYER-006")], RULES[("layer_deps", "LAYER")]])
    name = F.concat(F.regexp_extract("message", "'(.*)'", 1), F.lit(" of "), F.lit(rows.count()).cast("string"))
    return found.select("code", F.regexp_replace("file", "^core/", "m/").alias("file"), F.when(F.col("code") == "LAYER-006", name).otherwise(F.col("message")).alias("told"))


#: Sources with what they are like to read: effective lines (the encoding is one), declared names, short ones, definitions, described ones, loads, depth.
_READ = (
    ("# why\nx_{k} = [f(a) for a in b if a for c in d if c if e]\n", 2, 3, 2, 0, 0, (5,), 3),
    ("def long_{k}(q, rows):\n    'Tells what it does in words'\n    return {v: (1 if v else [z() for z in v]) for v in rows}\n", 4, 5, 2, 1, 1, (3, 1), 5),
    ("class Named_{k}:\n    total = sum(x for x in y)\n\n    def go(self):\n        pass\n", 5, 5, 1, 2, 0, (0,), 3),
    ("value_{k} = 1\n", 2, 1, 0, 0, 0, (), 1),
)


def _read_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = spark.createDataFrame([(i, r[0]) for i, r in enumerate(_READ)], "i long, source string")
    rows = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")).join(F.broadcast(dealt), F.col("k") % len(_READ) == F.col("i"))
    files = rows.select(F.concat(F.lit("m"), F.col("i").cast("string"), F.lit("/a_"), F.col("k").cast("string"), F.lit(".py")).alias("path"), F.replace("source", F.lit("{k}"), F.col("k").cast("string")).alias("content"))
    return P.source(files).facts


@query("WITH t(i, effective_lines, names, short, definitions, documented, most, depth) AS (VALUES " + ", ".join(f"({i}, {r[1]}, {r[2]}, {r[3]}, {r[4]}, {r[5]}, {max(r[6], default=0)}, {r[7]})" for i, r in enumerate(_READ)) + """)
SELECT 'm' || CAST(i AS VARCHAR) || '/a_' || CAST(s_suppkey AS VARCHAR) || '.py' AS path, CAST(effective_lines AS BIGINT) AS effective_lines, round(CASE WHEN names > 0 THEN short / CAST(names AS DOUBLE) ELSE 0.0 END, 3) AS short_name_rate,
  CAST(definitions - documented AS BIGINT) AS undocumented_definitions, CAST(most AS BIGINT) AS max_comprehension_load, CAST(depth AS BIGINT) AS max_expression_depth FROM supplier JOIN t ON s_suppkey % 4 = i""")
def reading_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-READ by file."""
    count = lambda c: F.col(c).cast("long").alias(c)
    return S.reading(_read_facts(spark, sf_dir)).select("path", count("effective_lines"), "short_name_rate", count("undocumented_definitions"), count("max_comprehension_load"), count("max_expression_depth"))


@query("WITH t(i, load) AS (VALUES " + ", ".join(f"({i}, {x})" for i, r in enumerate(_READ) for x in r[6]) + """)
SELECT count(*) AS comprehensions, CAST(median(load) AS DOUBLE) AS median, quantile_cont(CAST(load AS DOUBLE), 0.9) AS p90, CAST(max(load) AS BIGINT) AS most FROM supplier JOIN t ON s_suppkey % 4 = i""")
def comprehension_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-READ: median, 90th percentile and maximum of the loads of all comprehensions."""
    out = S.comprehension_loads(_read_facts(spark, sf_dir), [])
    return out.select("comprehensions", F.col("median").cast("double").alias("median"), F.col("p90").cast("double").alias("p90"), F.col("most").cast("long").alias("most"))


@query(r"""WITH docs AS (SELECT doc_id, source, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS next, regexp_extract_all(lower(text), '[a-z]+') AS words FROM documents WHERE source IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL),
bags AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(words) AS w FROM docs) GROUP BY ALL),
sides AS (SELECT d.doc_id, d.next, b.w, b.n, 0 AS m FROM docs d JOIN bags b ON b.doc_id = d.doc_id WHERE d.next IS NOT NULL UNION ALL SELECT d.doc_id, d.next, b.w, 0, b.n FROM docs d JOIN bags b ON b.doc_id = d.next),
met AS (SELECT doc_id, next, w, sum(n) AS n, sum(m) AS m FROM sides GROUP BY ALL)
SELECT doc_id, next, round(CASE WHEN min(greatest(n, m)) IS NULL THEN 1.0 ELSE CAST(sum(least(n, m)) AS DOUBLE) / sum(greatest(n, m)) END, 9) AS jaccard FROM met GROUP BY ALL""")
def weighted_jaccard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-WJACC of the words of a document and of the next one of its source."""
    docs = _table(spark, sf_dir, "documents").filter("source IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL")
    words = F.regexp_extract_all(F.lower(F.translate("text", "\u0130", "i")), F.lit("[a-z]+"), F.lit(0))  # else its dot is a character of its own
    counted = docs.select("doc_id", F.explode(words).alias("w")).groupBy("doc_id", "w").agg(F.count("*").cast("int").alias("n"))
    bags = counted.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "n"))).alias("bag"))
    follows = docs.select("doc_id", F.lead("doc_id").over(W.partitionBy("source").orderBy("doc_id")).alias("next")).filter("next IS NOT NULL").distinct()
    pairs = follows.join(bags.withColumnRenamed("bag", "bag_a"), "doc_id", "left").join(bags.select(F.col("doc_id").alias("next"), F.col("bag").alias("bag_b")), "next", "left").filter("bag_a IS NOT NULL OR bag_b IS NOT NULL")
    none = F.create_map().cast("map<string,int>")
    pairs = pairs.withColumns({c: F.coalesce(c, none) for c in ("bag_a", "bag_b")})
    return pairs.select("doc_id", "next", F.round(X.weighted_jaccard(F.col("bag_a"), F.col("bag_b")), 9).alias("jaccard"))


@query(f"""{FOUND} SELECT code, severity, file, line FROM found WHERE code = 'SIZE-001'""")
def single_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-SINGLE: of a run asked for one code the other findings of its check, and all else, are left out."""
    found = _documents(spark, sf_dir)
    rules = P.chosen({}, "SIZE-001")
    return C.select_ignore(found, [r.code for r in rules]).select("code", "severity", "file", "line")


@query(f"""{FOUND}, sources AS (SELECT DISTINCT coalesce(source, '') AS source FROM documents)
SELECT s.source, CAST(max(CASE WHEN f.severity = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS code FROM sources s LEFT JOIN found f ON split_part(f.file, '/', 1) = s.source GROUP BY s.source""")
def exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-EXIT: the exit code of a run over each source by itself; 1 if any of its checks fails."""
    sources = _table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("check")).distinct()
    found = _documents(spark, sf_dir).withColumn("check", F.substring_index("file", "/", 1))
    return C.rollup(found, sources).select(F.col("check").alias("source"), (F.col("status") == "FAIL").cast("long").alias("code"))


@query("""SELECT lang AS severity, count(*) AS events, avg(CAST(quality = 1 AS DOUBLE)) AS handled, avg(CAST(toxic = 1 AS DOUBLE)) AS in_code, avg(CAST(n_chars > 1000 AS DOUBLE)) AS in_report, avg(CAST(doc_id % 3 = 0 AS DOUBLE)) AS overclaim
FROM (SELECT d.lang, d.n_chars, l.* FROM labels l JOIN documents d USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL AND n_chars IS NOT NULL) GROUP BY lang""")
def handled_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-ART on labels as verdicts and languages as severities."""
    rows = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id").filter("quality IS NOT NULL AND toxic IS NOT NULL AND n_chars IS NOT NULL")
    said = {"severity": F.col("lang"), "handled": F.col("quality") == 1, "in_code": F.col("toxic") == 1, "in_report": F.col("n_chars") > 1000, "overclaim": F.col("doc_id") % 3 == 0}
    return S.handled_rates(rows.withColumns(said))


@query("SELECT event_type AS name, median(value) AS seconds FROM events GROUP BY event_type")
def median_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-MEDIAN of the values of events, by type, as seconds of runs."""
    return S.median_seconds(_table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("value").alias("seconds")))


# --- text, groups and windows ------------------------------------------------------------------------------------


@query("""SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.md' AS file, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(ltrim(x), '#'))) AS BIGINT) AS effective FROM documents""")
def effective_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = document_files(spark, sf_dir)
    return files.select(F.col("path").alias("file"), X.effective_lines(X.split_lines(F.col("content"))).cast("long").alias("effective"))


@query(r"""WITH lines AS (SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.md' AS file, unnest(string_split(replace(text, ' | ', ' — '), chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
SELECT file, CAST(line AS BIGINT) AS line FROM lines WHERE contains(text, '—')""")
def em_dash_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column separators stand for dashes, as the texts have none."""
    files = document_files(spark, sf_dir).withColumn("content", F.replace("content", F.lit(" | "), F.lit(" — ")))
    return prose.page_dash(document_source(files)).select("file", F.col("line").cast("long").alias("line"))


DENSE = {"min_em": 4, "min_words": 50, "min_sentences": 2, "em_per_1000": 30.0, "em_sentence_fraction": 0.2}


@query(rf"""WITH t AS (SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.md' AS file, replace(text, ' | ', ' — ') AS text FROM documents),
s AS (SELECT file, text, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS parts, len(text) - len(replace(text, '—', '')) AS em, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) AS words FROM t),
c AS (SELECT file, em, words, len(parts) AS sentences, len(list_filter(parts, lambda x: contains(x, '—'))) AS em_sentences FROM s)
SELECT file, CAST(em AS BIGINT) AS em, CAST(words AS BIGINT) AS words, CAST(sentences AS BIGINT) AS sentences, CAST(em_sentences AS BIGINT) AS em_sentences FROM c
WHERE em >= {DENSE['min_em']} AND words >= {DENSE['min_words']} AND sentences >= {DENSE['min_sentences']} AND em * 1000.0 / words >= {DENSE['em_per_1000']} AND em_sentences / sentences >= {DENSE['em_sentence_fraction']}""")
def em_dash_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = document_files(spark, sf_dir).select("path", F.replace("content", F.lit(" | "), F.lit(" — ")).alias("text"))
    out = prose.density(pages, DENSE).withColumnRenamed("path", "file")
    return out.select("file", *(F.col(c).cast("long").alias(c) for c in ("em", "words", "sentences", "em_sentences")))


@query(r"""WITH lines AS (SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.md' AS file, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
hits AS (SELECT file, line, lower(unnest(regexp_extract_all(' ' || regexp_replace(text, '[^\p{L}\p{N}_]+', '  ', 'g') || ' ', '(?i) (tion|anat|color) ', 1))) AS word FROM lines)
SELECT file, CAST(line AS BIGINT) AS line, word, CASE word WHEN 'tion' THEN 'shun' WHEN 'anat' THEN 'annat' ELSE 'colour' END AS better FROM hits""")
def spelling_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = document_source(document_files(spark, sf_dir))
    src = Source(src.files, src.facts, {"prose": {"spellings": {"tion": "shun", "anat": "annat"}}})
    rows = prose.spelling(src)
    word, better = F.lower(F.regexp_extract("message", "'([^']*)'", 1)), F.regexp_extract("fix", "'([^']*)'", 1)
    return rows.filter(word.isin("tion", "anat", "color")).select("file", F.col("line").cast("long").alias("line"), word.alias("word"), better.alias("better"))


@query(r"""SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.py' AS file, CAST(1 AS BIGINT) AS line FROM documents WHERE regexp_matches(text, 'token = "[0-9a-f]{40}"')""")
def secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SECRETPY-001 on the assignments that stand in documents."""
    from tidemark.rules.security import secrets

    docs = _table(spark, sf_dir, "documents")
    line = F.regexp_extract("text", r"(token = \"[^\"\n]*\")", 1)
    files = docs.select(F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".py"))).alias("path"), line.alias("content")).filter("content <> ''")
    return secrets(P.source(files)).select("file", F.col("line").cast("long").alias("line"))


@query(r"""WITH every AS (SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.py' AS file, regexp_extract_all(text, 'token = "[^"\n]*"') AS found FROM documents),
lines AS (SELECT file, unnest(found) AS text, generate_subscripts(found, 1) AS line FROM every)
SELECT file, CAST(line AS BIGINT) AS line FROM lines WHERE regexp_matches(text, '"[0-9a-f]{40}"')""")
def every_secret_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SECRETPY-001 on all assignments that stand in documents, each on a line of its own."""
    from tidemark.rules.security import secrets

    docs = _table(spark, sf_dir, "documents")
    lines = F.array_join(F.regexp_extract_all("text", F.lit(r"(token = \"[^\"\n]*\")"), F.lit(1)), "\n")
    files = docs.select(F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".py"))).alias("path"), lines.alias("content")).filter("content <> ''")
    return secrets(P.source(files)).select("file", F.col("line").cast("long").alias("line"))


@query("""WITH h AS (SELECT doc_id, sha256(lower(text)) AS sha FROM documents), g AS (SELECT sha, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first FROM h GROUP BY sha HAVING count(*) > 1)
SELECT doc_id, n, first FROM h JOIN g USING (sha)""")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-CLONE: the members of each group of equal normalised texts, counted by an aggregate that is joined back."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.lower("text"), 256).alias("sha"))
    return G.shared(rows, "sha", F.col("doc_id")).select("doc_id", "n", "first")


@query(r"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
short AS (SELECT doc_id, line, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS island FROM lines WHERE len(text) < 200)
SELECT doc_id, CAST(min(line) AS BIGINT) AS first, CAST(max(line) AS BIGINT) AS last, count(*) AS n FROM short GROUP BY doc_id, island HAVING count(*) > 1""")
def comment_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-RUNS on runs of short lines."""
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "text")).filter(F.char_length("text") < 200)
    return G.islands(lines, "doc_id", "k").filter("n > 1").select("doc_id", *((F.col(c) + 1).cast("long").alias(c) for c in ("first", "last")), "n")


@query(r"""WITH letters AS (SELECT n_nationkey AS k, n_regionkey AS r, unnest(string_split(n_name, '')) AS c FROM nation), bags AS (SELECT k, r, c, count(*) AS n FROM letters GROUP BY ALL),
keys AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey),
every AS (SELECT DISTINCT c FROM letters),
sides AS (SELECT keys.a, keys.b, coalesce(x.n, 0) AS n, coalesce(y.n, 0) AS m FROM keys CROSS JOIN every LEFT JOIN bags x ON x.k = keys.a AND x.c = every.c LEFT JOIN bags y ON y.k = keys.b AND y.c = every.c)
SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, round(CAST(sum(least(n, m)) AS DOUBLE) / sum(greatest(n, m)), 9) AS jaccard FROM sides GROUP BY a, b""")
def weighted_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-WJACC of the letters of nations' names, in pairs within a region."""
    letters = _table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", F.explode(F.filter(F.split("n_name", ""), lambda c: c != "")).alias("c"))
    bags = letters.groupBy("n_nationkey", "n_regionkey", "c").count().groupBy("n_nationkey", "n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("c", F.col("count").cast("int")))).alias("bag"))
    a, b = (bags.select("n_regionkey", F.col("n_nationkey").cast("long").alias(k), F.col("bag").alias(f"bag_{k}")) for k in "ab")
    return a.join(b, "n_regionkey").filter("a < b").select("a", "b", F.round(X.weighted_jaccard(F.col("bag_a"), F.col("bag_b")), 9).alias("jaccard"))


@query(r"""WITH t AS (SELECT page_id, replace(html, '<b>', CASE page_id % 3 WHEN 0 THEN '<img src="x">' WHEN 1 THEN '<IMG alt='' '' src=x>' ELSE '<img alt="y">' END) AS html FROM pages),
tags AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<img\b([^>]*)>', 1)) AS tag FROM t)
SELECT page_id, count(*) AS images FROM tags WHERE trim(coalesce(regexp_extract(tag, '(?i)\balt\s*=\s*("([^"]*)"|''([^'']*)'')', 2), '') || coalesce(regexp_extract(tag, '(?i)\balt\s*=\s*("([^"]*)"|''([^'']*)'')', 3), '')) = '' GROUP BY page_id""")
def image_alt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The img branch of DOCS-004 on pages whose b elements are images."""
    tag = F.when(F.col("page_id") % 3 == 0, '<img src="x">').when(F.col("page_id") % 3 == 1, "<IMG alt=' ' src=x>").otherwise('<img alt="y">')
    rows = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.lit(1).alias("line"), F.replace("html", F.lit("<b>"), tag).alias("text"))
    return prose.untexted_images(rows).groupBy(F.col("path").alias("page_id")).agg(F.count("*").alias("images"))


@query("""WITH regions(directory) AS (VALUES (''), ('src1'), ('src1/deep'), ('src2')), files AS (SELECT source || CASE WHEN doc_id % 2 = 0 THEN '/deep/' ELSE '/' END || CAST(doc_id AS VARCHAR) || '.md' AS file FROM documents),
near AS (SELECT file, directory, row_number() OVER (PARTITION BY file ORDER BY len(directory) DESC) AS r FROM files JOIN regions ON directory = '' OR starts_with(file, directory || '/'))
SELECT file, directory AS region FROM near WHERE r = 1""")
def region_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    deep = F.when(F.col("doc_id") % 2 == 0, "/deep/").otherwise("/")
    files = docs.select(F.concat("source", deep, F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    regions = spark.createDataFrame([("",), ("src1",), ("src1/deep",), ("src2",)], "directory string")
    return C.nearest_regions(files, regions).select(F.col("path").alias("file"), "region")


# --- cases that are one finding for many files -------------------------------------------------------------------


@query("""SELECT CAST(count(*) AS BIGINT) * 2 AS n, count(*) AS files, min(s_suppkey) || '.py' AS file FROM (SELECT lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS s_suppkey FROM supplier)""")
def suppression_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SUPPRESS-001: two directives a file, one finding at the first."""
    rows = _table(spark, sf_dir, "supplier").select(F.concat(F.lpad(F.col("s_suppkey").cast("string"), 9, "0"), F.lit(".py")).alias("path"), F.lit("x = 1  # noqa\ny = 2  # noqa: A1\nz = '# noqa'\n").alias("content"))
    out = prose.suppression_budget(P.source(rows, {"suppressions": {"enabled": True}}))
    number = lambda i: F.regexp_extract("message", r"^(\d+) suppressions in (\d+)", i).cast("long")
    return out.select(number(1).alias("n"), number(2).alias("files"), "file")


@query("""SELECT 'docs/' || s || '/' AS file FROM (VALUES ('tutorials'), ('how-to')) AS t(s)""")
def section_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOCS-006: of the sections that the rows' pages lie in, those without an index."""
    kind = F.col("s_suppkey") % 4
    where = F.when(kind == 0, F.lit("tutorials/p")).when(kind == 1, F.lit("how-to/a/index")).when(kind == 2, F.lit("reference/p")).otherwise(F.lit("other/p"))
    pages = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("docs/"), where, F.when(kind == 1, "").otherwise(F.col("s_suppkey").cast("string")), F.lit(".md")).alias("path"), F.lit("# A\n").alias("content")).distinct()
    index = spark.createDataFrame([("docs/reference/index.md", "# R\n")], "path string, content string")
    files = pages.unionByName(index)
    return prose.section_index(Source(files, files.select("path").limit(0), {"docs": {"enabled": True}})).select("file")


@query("""SELECT CAST(s_suppkey AS BIGINT) AS k, CAST(s_suppkey % 12 + 1 AS BIGINT) AS complexity, CAST(s_suppkey % 5 AS BIGINT) AS params, CAST(s_suppkey % 12 + 2 AS BIGINT) AS effective FROM supplier""")
def function_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-COMPLEX, A-PARAMS and A-EFFLINES of one function a row, made from the row's key."""
    k = F.col("s_suppkey")
    body = F.concat(F.repeat(F.lit("    if p: pass\n"), (k % 12).cast("int")), F.lit("    return 0\n"))
    params = F.array_join(F.transform(F.sequence(F.lit(0), k % 5), lambda i: F.concat(F.lit("p"), i.cast("string"))), ", ")
    rows = _table(spark, sf_dir, "supplier").select(F.concat(k.cast("string"), F.lit(".py")).alias("path"), F.concat(F.lit("def f("), F.regexp_replace(params, r"(, )?p0", "self"), F.lit("):\n# note\n"), body).alias("content"))
    own = P.source(rows).facts.select("path", "lines", F.explode("functions").alias("x"))
    count = F.size("x.params") - (F.get("x.params", F.lit(0))["name"] == "self").cast("int")
    return own.select(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("k"), F.col("x.complexity").cast("long").alias("complexity"), count.cast("long").alias("params"), X.effective_lines(F.slice("lines", F.col("x.line"), F.col("x.end") - F.col("x.line") + 1)).cast("long").alias("effective"))


@query()
def whole_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All default rules over a tree of all cases' files, through the whole chain."""
    return _show(P.check(case_tree(spark, sf_dir), {"ignore": ["CMT"], "exclude": ["tests/*"], "promote": ["NAMING"]}))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, forbidden terms by line, ignores and excludes, and the status of each check."""
    found = C.exclude(C.select_ignore(_documents(spark, sf_dir), (), ["TERM-002"]), ["src9/*"])
    return C.rollup(found, spark.createDataFrame([("domain_terms",), ("file_limits",)], "check string"))
