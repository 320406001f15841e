from pyspark.sql import functions as F

import tidemark.plans.check as P
from tidemark.functions import text as X
from tidemark.rules.base import RULES

DENSE = "The plan — as it stands — is sound and the team will carry it out — slowly. "
PAGES = {
    "docs/dense.md": "# Plan\n\n" + DENSE * 40,
    "docs/split.md": (DENSE.strip() + "\n\n```\ncode — only\n```\n") * 40,
    "docs/fenced.md": "```\n" + DENSE * 40 + "\n```\n",
    "docs/spans.md": ("`a — b` is sound and the team will carry it out in due course. ") * 60,
    "docs/empty.md": "",
    "docs/none.md": None,
}
CODE = {
    "a/alone.py": "# increment counter\ncounter += 1\n\n# set total\ntotal = 0\n",
    "a/block.py": "# increment counter\n# set total\ntotal = 0\ncount = 0  # set count\n",
    "a/beside.py": "count = 0  # set count\n# set total\ntotal = 0\n",
}


def _found(spark, key, settings, files):
    rule = RULES[key]
    rows = spark.createDataFrame(list(files.items()), "path string, content string")
    found = P.find(P.source(rows, {key[0]: settings}, [rule]), [rule])
    return found._jdf.queryExecution().toString(), sorted((r["file"], r["line"]) for r in found.collect())


def test_dense_pages_are_told_without_a_shuffle(spark):
    plan, found = _found(spark, ("prose", "PROSE-004"), {"enabled": True, "em_dash_density": True}, PAGES)
    assert found == [("docs/dense.md", 1), ("docs/split.md", 1)]
    assert "Exchange" not in plan and "Aggregate" not in plan


def test_comments_that_stand_alone_are_told_without_a_window(spark):
    plan, found = _found(spark, ("restating", "CMT-005"), {"enabled": True}, CODE)
    assert found == [("a/alone.py", 1), ("a/alone.py", 4), ("a/beside.py", 1), ("a/beside.py", 2), ("a/block.py", 4)]
    assert "Window" not in plan


def test_words_and_sentences(spark):
    texts = ["", " ", "One.  Two! Three?\nFour", "a_b — été éa, 3.5 . .  x.", "...  \n ?", "क्षमा नहीं. \U0001d400b"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    words = F.regexp_count("text", F.lit(r"(?U)\b\w+\b"))
    said = F.filter(F.split("text", r"(?U)(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"(?U)\s+", "") != "")
    for r in rows.select("text", words.alias("w"), said.alias("s"), X.word_count(F.col("text")).alias("words"), X.sentences(F.col("text")).alias("sentences")).collect():
        assert (r["words"], r["sentences"]) == (r["w"], r["s"]), r["text"]
