import hashlib
import re

import xxhash
from pyspark.sql import functions as F

from tidemark.llm import fingerprints as fp

K = 32


def brute(text):
    lower = text.translate({65 + i: 97 + i for i in range(26)})
    h = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)]
    out = set()
    for i in range(max(1, len(h) - 4) if h else 0):
        value = 42
        for x in h[i : i + 5]:
            value = xxhash.xxh64(x.to_bytes(8, "little"), seed=value).intdigest()
        out.add(value)
    return out


def encode(hashes, k=K):
    return "".join(f"{v ^ (1 << 63):016X}" for v in sorted(hashes)[:k])


def test_against_brute_force(docs, corpus):
    rows = corpus[:-3] + [corpus[-1]]
    got = {r["doc_id"]: r for r in fp.fingerprint_edits(docs(rows), K).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        r = got[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (encode(brute(text)), encode(brute(edited)))
        a, b = brute(text), brute(edited)
        union = sorted(a | b)[:K]
        assert r["near_edited"] == (1.0 if not union else sum(x in a and x in b for x in union) / len(union))


def test_many_parts_see_the_next(spark, docs, sentences):
    rows = [(i * 3, sentences(8, i)) for i in range(300)]
    scratch = fp.Scratch(spark, "t")
    seen = fp.with_next(docs(rows), scratch, rows_a_part=20)
    assert seen.filter("own").count() == 300 and seen.filter("NOT own").count() == seen.select("part").distinct().count() > 5
    got = fp.fingerprint_edits(docs(rows), K).orderBy("doc_id").collect()
    again = fp.fingerprint_edits(docs(rows[::-1]), K).orderBy("doc_id").collect()
    assert got == again


def test_merge_and_estimates(spark, docs, sentences):
    rows = [(i, sentences(300, i // 2)) for i in range(6)]
    sketches = fp.with_sketch(docs(rows).select("doc_id", "text"), "text", "sk", K)
    whole = fp.merged(sketches.withColumn("g", F.lit(1)), ["g"], "sk", K).first()["sk"]
    union = set().union(*(brute(t) for _, t in rows))
    assert [v + (1 << 63) for v in whole] == sorted(union)[:K]
    n = sketches.agg(F.max(fp.distinct_estimate(F.col("sk"), K))).first()[0]
    assert 150 < n < 600
    pair = sketches.alias("a").crossJoin(sketches.alias("b")).filter("a.doc_id = 0 and b.doc_id in (1, 2)")
    near = pair.select("b.doc_id", fp.resemblance(F.col("a.sk"), F.col("b.sk"), K).alias("r"), fp.containment(F.col("a.sk"), F.col("b.sk"), K).alias("c")).orderBy("doc_id").collect()
    assert near[0]["r"] == near[0]["c"] == 1.0 and near[1]["r"] < 0.2


def test_empty_table(docs):
    assert fp.fingerprint_edits(docs([]), K).collect() == []


def test_one_row_and_ties(docs):
    assert fp.fingerprint_edits(docs([(1, "a b c d e f")]), K).first()["near_next"] == 1.0
    assert fp.fingerprint_edits(docs([(1, "x"), (1, "x"), (None, None)]), K).count() == 3
