"""The queries of this subpackage and, where SQL can tell the same result, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.fingerprints import fingerprint_edits

    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.pii import scan_pii

    return scan_pii(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.line_dedup import RUN, dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents"), run=RUN, short_equal=True)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "epochs")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.decontamination import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.warc import archive_pages

    return archive_pages(table(spark, sf_dir, "pages"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.merkle import verify_tampering

    return verify_tampering(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op13_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.languages import identify

    return identify(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_licenses, op3_pii, op4_line_dedup, op5_mixing, op6_decontamination, op7_warc, op8_ngram_join, op9_html_text, op10_quality, op11_merkle, op12_whitening, op13_languages)}


def _license_sql() -> str:
    """The templates as rows, and the blocks as they are cut; the join without its filters, which drop no pair that meets the threshold."""
    from tidemark.llm.licenses import BLOCK, NOTICES, PHRASES, STRIDE

    rows = [(t.label, t.words, t.need, t in PHRASES) for t in (*PHRASES, *NOTICES)]
    values = ", ".join(f"('{label}', {list(found)!r}, {need}, {base})" for label, found, need, base in rows)
    return rf"""
WITH docs AS (SELECT doc_id, md5(coalesce(text, '')) AS h, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
templates(label, words, need, base) AS (VALUES {values}),
cut AS (SELECT DISTINCT doc_id, h, unnest(range(0, len(words), {STRIDE})) AS spot, words FROM docs WHERE len(words) > 0),
blocks AS (SELECT doc_id, h, spot, words[spot + 1 : spot + {BLOCK}] AS part FROM cut),
pairs AS (SELECT b.*, t.label, t.base, t.words AS phrase, len(list_intersect(list_distinct(part), list_distinct(t.words))) AS overlap, len(list_distinct(t.words)) AS size
  FROM blocks b, templates t WHERE len(list_intersect(list_distinct(part), list_distinct(t.words))) >= t.need),
placed AS (SELECT *, CASE WHEN base THEN list_filter(range(0, {STRIDE}), lambda i: part[i + 1 : i + len(phrase)] = phrase) ELSE [] END AS starts FROM pairs),
found AS (SELECT doc_id, h, sum(len(starts)) AS n_base, min(spot + list_min(starts)) AS first_word, max(spot + list_max(starts)) AS last_word,
  array_to_string(list_sort(list_distinct(list(label) FILTER (WHERE base))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels,
  max(overlap / size) AS score, count(*) FILTER (WHERE NOT base) AS blocks
  FROM placed WHERE NOT base OR len(starts) > 0 GROUP BY doc_id, h)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score, coalesce(blocks, 0) AS blocks
FROM docs d LEFT JOIN found f ON d.doc_id IS NOT DISTINCT FROM f.doc_id AND d.h = f.h
"""


def _merkle_sql() -> str:
    """Levels by recursion over (tree, level), for the languages and then for the tree of their subroots; proofs and folding by recursion over levels."""

    def told(value: str) -> str:
        return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(map(told, ("doc_id", "source", "lang", "n_chars", text))) + ")"

    def levels(leaves: str) -> str:
        return f"""(SELECT tree, 0 AS level, idx, hash, n FROM {leaves} UNION ALL
  SELECT tree, level + 1, idx // 8, sha256(string_agg(hash, '' ORDER BY idx)), (n + 7) // 8 FROM {{name}} WHERE n > 1 GROUP BY tree, level, idx // 8, n)"""

    def steps(name: str) -> str:
        return f"""(SELECT a.tree, a.level, a.idx, coalesce(string_agg(b.hash, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), '') AS before,
    coalesce(string_agg(b.hash, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '') AS after
  FROM {name} a JOIN {name} b ON a.tree = b.tree AND a.level = b.level AND a.idx // 8 = b.idx // 8 WHERE a.n > 1 GROUP BY ALL)"""

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH RECURSIVE docs AS (SELECT *, row_number() OVER () AS r, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda v, _: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 3 = 0 AS chosen FROM documents),
hashed AS (SELECT r, doc_id, coalesce('=' || lang, '') AS tree, {leaf("text")} AS hash, CASE WHEN chosen THEN {leaf(lower)} ELSE {leaf("text")} END AS start FROM docs),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, hash) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM hashed),
nodes AS {levels("leaves").format(name="nodes")},
subroots AS (SELECT '' AS tree, tree AS lang_tree, hash, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS {levels("subroots").format(name="tops")},
low AS {steps("nodes")},
high AS {steps("tops")},
depth AS (SELECT tree, max(level) AS depth FROM nodes GROUP BY tree),
path AS (
  SELECT l.r, s.level, s.before, s.after FROM leaves l JOIN low s ON s.tree = l.tree AND s.idx = l.idx // CAST(power(8, s.level) AS BIGINT)
  UNION ALL
  SELECT l.r, d.depth + s.level, s.before, s.after FROM leaves l JOIN depth d ON d.tree = l.tree JOIN subroots t ON t.lang_tree = l.tree JOIN high s ON s.idx = t.idx // CAST(power(8, s.level) AS BIGINT)),
folds AS (SELECT r, start AS hash, 0 AS level FROM leaves UNION ALL SELECT f.r, sha256(p.before || f.hash || p.after), f.level + 1 FROM folds f JOIN path p ON p.r = f.r AND p.level = f.level),
proofs AS (SELECT r, string_agg(before || after, '' ORDER BY level) AS proof FROM path GROUP BY r),
ends AS (SELECT r, arg_max(hash, level) AS folded_root FROM folds GROUP BY r)
SELECT l.doc_id, l.hash AS leaf, s.hash AS subroot, t.hash AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, e.folded_root, e.folded_root = t.hash AS verified
FROM leaves l JOIN subroots s ON s.lang_tree = l.tree JOIN tops t ON t.n = 1 JOIN ends e ON e.r = l.r LEFT JOIN proofs p ON p.r = l.r
"""


ORACLES = {
    "op5_mixing": r"""
WITH rows AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS src,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':mix') AS key
  FROM documents),
sizes AS (SELECT src, source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sizes),
weighed AS (SELECT *, [1, 2, 3][(rank - 1) % 3 + 1] AS weight, source_size * 3 AS cap FROM ranked),
placed AS (SELECT *, CAST(cap AS DOUBLE) / weight AS fills_at,
  row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / weight, rank) AS place FROM weighed),
shared AS (SELECT *, CAST(CAST(sum(source_size) OVER () AS BIGINT)
    - coalesce(CAST(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS DOUBLE)
  / CAST(sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS per_weight FROM placed),
opened AS (SELECT *, min(CASE WHEN per_weight < fills_at THEN place END) OVER () AS open_place FROM shared),
levels AS (SELECT *, max(CASE WHEN place = open_place THEN per_weight END) OVER () AS level FROM opened),
targets AS (SELECT src, source_size, CASE WHEN open_place IS NULL OR place < open_place THEN CAST(cap AS DOUBLE) ELSE level * weight END AS target FROM levels),
begun AS (SELECT r.doc_id, r.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
  coalesce(CAST(sum(r.size) OVER (PARTITION BY r.src ORDER BY r.key, r.doc_id NULLS FIRST, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start
  FROM rows r JOIN targets t ON r.src = t.src),
cut AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM begun)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - start)) AS BIGINT) AS taken,
  CAST(epochs AS BIGINT) AS epochs FROM cut
""",
    "op7_warc": r"""
WITH rows AS (SELECT page_id, url, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
refs AS (SELECT *, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS first, count(*) OVER (PARTITION BY html) AS n FROM rows),
kinds AS (SELECT *, payload_bytes >= 1000 AND n > 1 AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM refs)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first END AS refers_to, url FROM kinds
""",
    "op6_decontamination": r"""
WITH docs AS (SELECT doc_id, md5(coalesce(text, '')) AS h, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark WHERE item_id IS NOT NULL),
windows AS (SELECT DISTINCT item_id, words[i + 1 : i + 10] AS win FROM (SELECT *, unnest(range(0, greatest(len(words) - 10, 0) + 1)) AS i FROM items WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT len(win) AS k FROM windows),
places AS (SELECT DISTINCT doc_id, h, spot, k, words[spot + 1 : spot + k] AS win FROM (SELECT doc_id, h, words, k, unnest(range(0, greatest(len(words) - k + 1, 0))) AS spot FROM docs, sizes)),
hits AS (SELECT p.doc_id, p.h, p.spot, p.k, w.item_id FROM places p JOIN windows w ON p.win = w.win),
covered AS (SELECT doc_id, h, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, h, unnest(range(spot, spot + k)) AS pos FROM hits) GROUP BY ALL),
named AS (SELECT doc_id, h, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))), ',') AS ids FROM hits GROUP BY ALL)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c ON d.doc_id IS NOT DISTINCT FROM c.doc_id AND d.h = c.h LEFT JOIN named n ON d.doc_id IS NOT DISTINCT FROM n.doc_id AND d.h = n.h
""",
    "op2_licenses": _license_sql(),
    "op11_merkle": _merkle_sql(),
    "op8_ngram_join": r"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 4, 1) END), lambda i: array_to_string(w[i + 1 : i + 5], ' ')))) AS s FROM docs),
kinds AS (SELECT s, row_number() OVER () AS sid, len(s) AS n FROM (SELECT DISTINCT s FROM sets WHERE len(s) > 0)),
parts AS (SELECT sid, n, unnest(s) AS e FROM kinds),
pairs AS (SELECT a.sid AS a, b.sid AS b, a.n + b.n - count(*) AS either, count(*) AS shared FROM parts a JOIN parts b ON a.e = b.e AND a.sid <> b.sid AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.sid, b.sid, a.n, b.n),
links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 80 * either),
reach AS (SELECT sid AS a, sid AS b FROM kinds UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
first AS (SELECT k.sid, min(s.doc_id) AS doc_id, count(*) AS copies FROM kinds k JOIN sets s ON s.s = k.s GROUP BY k.sid),
named AS (SELECT r.a AS sid, min(f.doc_id) AS name, sum(f.copies) AS copies FROM reach r JOIN first f ON f.sid = r.b GROUP BY r.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CASE WHEN copies > 1 THEN coalesce(name, s.doc_id) ELSE s.doc_id END AS component_id FROM sets s LEFT JOIN kinds k ON k.s = s.s LEFT JOIN named n ON n.sid = k.sid
""",
}
